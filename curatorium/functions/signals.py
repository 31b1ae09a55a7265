"""Cleaning and merging of semi-structured fields that arrive as JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---- fixed values: what a drawn element may carry ----
ELEMENT_KINDS = ("text", "art", "lines", "rule")
MAX_ELEMENTS = 24
HEX_COLOR = "^#[0-9a-fA-F]{6}$"
NAMED_COLOR = "metal"
TEXT_LIMITS = {"t": 6, "s": 48, "font": 12, "align": 6, "svg": 6000}
NUMBER_FIELDS = ("x", "y", "w", "h", "size", "weight", "ls", "cols", "thick")
FLAG_FIELDS = ("italic", "upper")
# ---- end of fixed values ----

ELEMENT_SCHEMA = "struct<{}>".format(
    ",".join([f"{n}:string" for n in TEXT_LIMITS] + ["color:string"] + [f"{n}:double" for n in NUMBER_FIELDS]
             + [f"{n}:boolean" for n in FLAG_FIELDS])
)


def valid_color(c: Column) -> Column:
    return F.when(c.rlike(HEX_COLOR) | (c == NAMED_COLOR), c)


def tenth(c: Column) -> Column:
    """Rounded to 0.1, halves upward; null unless finite."""
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(finite, F.floor(c * 10 + 0.5) / 10)


def clean_elements(elements: Column) -> Column:
    """Known fields only, at most 24 read, unknown kinds dropped; null when nothing is left."""

    def clean(e: Column) -> Column:
        parts = [F.substring(e[n], 1, size).alias(n) for n, size in TEXT_LIMITS.items()]
        parts.append(valid_color(e["color"]).alias("color"))
        parts += [tenth(e[n]).alias(n) for n in NUMBER_FIELDS]
        parts += [F.when(e[n], F.lit(True)).alias(n) for n in FLAG_FIELDS]
        return F.struct(*parts)

    kept = F.filter(F.transform(F.slice(elements, 1, MAX_ELEMENTS), clean), lambda e: e["t"].isin(*ELEMENT_KINDS))
    return F.when(F.size(kept) > 0, kept)


def merge_fields(estimate: Column, verified: Column, names: list[str]) -> Column:
    """Verified values win wherever they are present."""
    return F.struct(*[F.coalesce(verified[n], estimate[n]).alias(n) for n in names])


def merge_open(estimate: Column, verified: Column) -> Column:
    """`merge_fields` for variants with whatever fields they have: each present verified value wins, JSON null counting as missing.
    Fields that nobody has named yet are kept; null if neither side is an object."""
    def fields(v: Column) -> Column:
        known = F.when(F.schema_of_variant(v).startswith("OBJECT"), v.cast("map<string,variant>"))
        present = F.map_filter(known, lambda _, x: x.isNotNull() & ~F.is_variant_null(x))
        return F.coalesce(present, F.create_map().cast("map<string,variant>"))

    merged = F.map_zip_with(fields(estimate), fields(verified), lambda _, old, new: F.coalesce(new, old))
    return F.when(estimate.isNotNull() | verified.isNotNull(), F.to_variant_object(merged))
