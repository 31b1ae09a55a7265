"""Repeatable chance: the same key always draws the same number, on any executor."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---- fixed values: draw shares ----
DRAW_CUTS = ((0.01, "ultra"), (0.06, "superrare"), (0.24, "rare"))
DRAW_REST = "common"
VARIANT_SHARE = 0.05
# ---- end of fixed values ----


def key_number(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def stable_bucket(key: Column, buckets: int = 4) -> Column:
    return F.pmod(key_number(key), F.lit(buckets))


def uniform(key: Column) -> Column:
    """Evenly spread in [0, 1)."""
    return key_number(key) / F.lit(4294967296.0)


def draw_tier(key: Column) -> Column:
    u = uniform(key)
    out = F.when(u < DRAW_CUTS[0][0], DRAW_CUTS[0][1])
    for cut, tier in DRAW_CUTS[1:]:
        out = out.when(u < cut, tier)
    return out.otherwise(DRAW_REST)


def draw_variant(key: Column) -> Column:
    return uniform(key) < VARIANT_SHARE
