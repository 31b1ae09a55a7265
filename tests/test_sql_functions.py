from decimal import Decimal

from pyspark.sql import functions as F

from curatorium.functions import sql, text


def test_sql_functions_equal_the_columns(spark):
    assert sql.register(spark) == ["norm_name", "usage_cost", "tier_rank"]
    names = ["Château d'Yquem 2015", "Œuf & Æther", "Côte-Rôtie 1999er", "The `Estate´", None, "é1999 x"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    rows = df.select(text.norm_name(F.col("s")).alias("a"), F.expr("norm_name(s)").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    row = spark.sql("select usage_cost('Some-Opus-4', 1000000, 100000, 3) as c, tier_rank('ultra') as t, tier_rank('?') as n").first()
    assert (row.c, row.t, row.n) == (Decimal("6.03"), 4, 0)
