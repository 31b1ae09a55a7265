"""Writing results: append-only logs, snapshots and streaming upserts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from curatorium.operators.facts import latest
from curatorium.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, reachable by every executor."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once and read back, for frames that a query uses several times: compact, typed, and with sizes the planner knows."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def append_log(df: DataFrame, path: str, time_column: str, rows_per_task: int = 1_000_000) -> None:
    """Append to a log partitioned by month, so month filters prune folders."""
    rows = df.withColumn("month", F.date_format(time_column, "yyyy-MM"))
    # as many write tasks per month as its rows need; one row per month is broadcast
    tasks = rows.groupBy("month").agg(F.ceil(F.count(F.lit(1)) / rows_per_task).alias("_tasks"))
    dealt = rows.join(F.broadcast(tasks), rows["month"].eqNullSafe(tasks["month"])).drop(tasks["month"])
    (
        dealt.repartition("month", F.pmod(F.xxhash64(*df.columns), F.col("_tasks"))).drop("_tasks")
        .write.mode("append").partitionBy("month").parquet(path)
    )


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The log with its month as text; a filter on `month` prunes folders."""
    return spark.read.schema(StructType([*schema.fields, StructField("month", StringType())])).parquet(path)


class Upserts:
    """A keyed table that streams write to: a base in buckets of the key, and the young deltas after it.

    A micro-batch becomes the delta of its id, split by bucket. `compact` merges the young deltas into new files of the
    buckets they touch and then names, in one rename, the version each bucket has from now on; until that rename, and for whoever
    read before it, the old files stand. A batch that runs again replaces its delta, or changes nothing once it is
    compacted. Batch ids grow; one writer at a time. Old versions are left to the folder's retention."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str], order: list[str], buckets: int = 16):
        self.spark, self.folder, self.schema, self.keys, self.order, self.buckets = spark, folder, schema, keys, order, buckets

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        path, fs = self._path(pattern)
        return [f.getPath().toString() for f in (fs.globStatus(path) or [])]

    def manifest(self) -> dict:
        """The newest version: its number, the last batch in it, and the version of every bucket that has a base."""
        numbers = [int(n.rsplit("/", 1)[1].removesuffix(".json")) for n in self._names("manifest/*.json")]
        if not numbers:
            return {"version": 0, "upto": -1, "buckets": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/manifest/{max(numbers)}.json", wholetext=True).first()[0])

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """A foreachBatch body."""
        if batch_id <= self.manifest()["upto"]:
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        batch.select(*self.schema.names).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy(
            "bucket").parquet(f"{self.folder}/log/batch={batch_id}")

    def _young(self, upto: int) -> tuple[list[str], set[int]]:
        """Paths of the deltas after `upto`, and the buckets they touch, from names alone."""
        found = [p for p in self._names("log/batch=*/bucket=*") if int(p.split("batch=")[1].split("/")[0]) > upto]
        return found, {int(p.rsplit("bucket=", 1)[1]) for p in found}

    def _base(self, state: dict, buckets: set[int]) -> DataFrame:
        paths = [f"{self.folder}/base/version={v}/bucket={b}" for b, v in state["buckets"].items() if int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _merged(self, state: dict, paths: list[str], buckets: set[int]) -> DataFrame:
        """The last write per key in these buckets; the id of its batch decides between equal `order`."""
        kinds = StructType([*self.schema.fields, StructField("batch", LongType())])
        deltas = self.spark.read.schema(kinds).option("basePath", f"{self.folder}/log").parquet(*paths).select(*kinds.names)
        old = self._base(state, buckets).withColumn("batch", F.lit(-1).cast("long"))
        return latest(old.unionByName(deltas), self.keys, [*self.order, "batch"]).select(*self.schema.names)

    def compact(self) -> None:
        state = self.manifest()
        paths, buckets = self._young(state["upto"])
        if not paths:
            return
        version = state["version"] + 1
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        self._merged(state, paths, buckets).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy(
            "bucket").parquet(f"{self.folder}/base/version={version}")
        upto = max(int(p.split("batch=")[1].split("/")[0]) for p in paths)
        new = {"version": version, "upto": upto, "buckets": state["buckets"] | {str(b): version for b in buckets}}
        draft, fs = self._path(f"manifest/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if not fs.rename(draft, self._path(f"manifest/{version}.json")[0]):
            raise RuntimeError(f"another writer has made version {version} of {self.folder}")

    def read(self) -> DataFrame:
        """One row per key. Buckets without young deltas are passed on as they are, without a shuffle."""
        state = self.manifest()
        paths, touched = self._young(state["upto"])
        quiet = self._base(state, {int(b) for b in state["buckets"]} - touched)
        return quiet.unionByName(self._merged(state, paths, touched)) if paths else quiet
