"""The ordered tier scale."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---- fixed values, lowest first ----
TIERS = ("common", "rare", "superrare", "ultra", "icon")
# ---- end of fixed values ----


def tier_rank(tier: Column) -> Column:
    """1..5, 0 when unknown."""
    return F.coalesce(F.array_position(F.lit(list(TIERS)), tier), F.lit(0)).cast("int")


def tier_name(rank: Column) -> Column:
    return F.try_element_at(F.lit(list(TIERS)), rank.cast("int"))


def effective_tier(is_icon: Column, override: Column, tier: Column) -> Column:
    return F.when(F.coalesce(is_icon, F.lit(False)), F.lit("icon")).otherwise(F.coalesce(override, tier))
