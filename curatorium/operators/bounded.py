"""Broadcast only what was counted first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20


def _bytes(df: DataFrame) -> Column:
    """About what a row takes: 16 for a number, the length of texts, nested values as JSON."""
    def width(field: StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(field.dataType, (ArrayType, MapType, StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        return F.lit(16)

    return sum((width(f) for f in df.schema.fields), F.lit(0))


def small_or_shuffled(df: DataFrame, rows: int = MAX_BROADCAST_ROWS, size: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint when the side has at most `rows` rows and about `size` bytes, else the side itself: the equi join
    on it then shuffles. Counting stops at the bound."""
    n, total = df.limit(rows + 1).select(_bytes(df).alias("b")).agg(F.count(F.lit(1)), F.sum("b")).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def shuffled(df: DataFrame) -> DataFrame:
    """A side that grows with the input, for an equi join that shuffles. The planner goes by the size of compressed files and
    would send tables of a million rows through the driver, once a join."""
    return df.hint("merge")
