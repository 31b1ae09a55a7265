"""Row validation with a reject reason, and the gate in front of the write path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curatorium.functions.tiers import TIERS

# ---- fixed values: limits and vocabularies ----
COVERS = ("bordeaux", "groen", "blauw", "cognac", "zwart")
PAGE_COLORS = ("zwart", "creme")
NAME_PATTERN = r"^[\p{L}\p{N} .'&-]+$"
MAX_NAME = 24
MAX_RANK = 10
MAX_PAGE_KEY = 80
MAX_PAGE_ITEMS = 40
FEEDBACK_KINDS = ("bug", "idee", "compliment", "anders")
MAX_FEEDBACK = 2000
MIN_CONFIDENCE = 0.5
# ---- end of fixed values ----


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first broken rule; a condition that is unknown does not break one."""
    out = F.when(rules[0][1], F.lit(rules[0][0]))
    for reason, broken in rules[1:]:
        out = out.when(broken, F.lit(reason))
    return out


def with_reason(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    return df.withColumn("reason", first_reason(rules))


def split(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    checked = with_reason(df, rules)
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def item_rules(name: Column, region: Column) -> list[tuple[str, Column]]:
    return [("invalid_wine", blank(name) | blank(region))]


def profile_rules(cover: Column, pages: Column, name: Column) -> list[tuple[str, Column]]:
    return [
        ("invalid_cover", ~cover.isin(*COVERS)),
        ("invalid_pages", ~pages.isin(*PAGE_COLORS)),
        ("invalid_name", name.isNotNull() & ((F.length(name) > MAX_NAME) | ~name.rlike(NAME_PATTERN))),
    ]


def rank_rules(rank: Column) -> list[tuple[str, Column]]:
    return [("bad_rank", rank.isNotNull() & ~rank.between(1, MAX_RANK))]


def tier_rules(tier: Column) -> list[tuple[str, Column]]:
    return [("bad_tier", tier.isNotNull() & ~tier.isin(*TIERS[:-1]))]


def page_rules(page: Column, item_count: Column) -> list[tuple[str, Column]]:
    return [
        ("invalid_page", page.isNull() | ~F.length(page).between(1, MAX_PAGE_KEY)),
        ("invalid_items", item_count > MAX_PAGE_ITEMS),
    ]


def feedback_rules(kind: Column, message: Column) -> list[tuple[str, Column]]:
    return [
        ("bad_kind", kind.isNull() | ~kind.isin(*FEEDBACK_KINDS)),
        ("bad_message", message.isNull() | ~F.length(message).between(1, MAX_FEEDBACK)),
    ]


def gate_status(is_label: Column, real: Column, confidence: Column, name: Column, admin: Column) -> Column:
    """A picture of a picture is refused first, an unreadable label second."""
    return (
        F.when(is_label & ~F.coalesce(real, F.lit(True)) & ~admin, "not_real")
        .when(~is_label | (F.coalesce(confidence, F.lit(0.0)) < MIN_CONFIDENCE) | (F.coalesce(name, F.lit("")) == ""),
              "not_recognized")
        .otherwise("ok")
    )
