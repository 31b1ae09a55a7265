"""Collection analytics on Spark: DataFrame-in, DataFrame-out operators."""

import sys

from pyspark import cloudpickle

# the few functions that run in Python workers travel with the job, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
