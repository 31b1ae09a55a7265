"""Recognition payloads: JSON text in, typed and trimmed item columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curatorium.functions.text import blank_to_null, natural_key, slug, year_exact

DEFAULT_STYLE = "stil"  # a fixed value
PAYLOAD_SCHEMA = (
    "naam string, maker string, jaar string, druif string, stijl string, regio string, land string, app string, "
    "grape string, style string, color string, tags array<string>, "
    "signals struct<price_eur_low: double, price_eur_high: double, classification: string, producer_fame: string, "
    "production: string, rarity_nl: string, vintage_quality: string, large_format: boolean, iconic: boolean>"
)


def parse(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("p", F.from_json(column, PAYLOAD_SCHEMA))


def item_columns() -> dict[str, Column]:
    p = F.col("p")

    def price(name: str) -> Column:
        return F.nullif(p["signals"][name], F.lit(0.0))

    return {
        "item_key": natural_key(p["maker"], p["naam"]),
        "name": F.trim(p["naam"]),
        "maker": F.trim(F.coalesce(p["maker"], F.lit(""))),
        "year": year_exact(p["jaar"]),
        "grapes": blank_to_null(p["druif"]),
        "style_text": blank_to_null(p["stijl"]),
        "region": slug(p["regio"]),
        "country": blank_to_null(p["land"]),
        "appellation": blank_to_null(p["app"]),
        "grape": blank_to_null(p["grape"]),
        "style": blank_to_null(F.coalesce(p["style"], F.lit(DEFAULT_STYLE))),
        "color": blank_to_null(p["color"]),
        "tags": F.coalesce(F.transform(p["tags"], F.lower), F.array().cast("array<string>")),
        "price_eur_low": price("price_eur_low"),
        "price_eur_high": price("price_eur_high"),
        **{name: p["signals"][name] for name in ("classification", "producer_fame", "production", "rarity_nl")},
        "large_format": F.coalesce(p["signals"]["large_format"], F.lit(False)),
        "iconic": F.coalesce(p["signals"]["iconic"], F.lit(False)),
        "vintage_quality": F.coalesce(p["signals"]["vintage_quality"], F.lit("onbekend")),
    }


def ingest(df: DataFrame, column: str) -> DataFrame:
    return parse(df, column).withColumns(item_columns()).drop("p")
