"""Prices and usage cost."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---- fixed values ----
PRICE_SYMBOL_BANDS = (12, 25, 60, 200)
# (fragments of the model name, price per million tokens in, out); the last row is the default
USAGE_RATES = (
    (("fable", "mythos"), 10, 50),
    (("opus",), 4, 20),
    (("sonnet",), 2, 10),
    ((), 1, 5),
)
SEARCH_COST = "0.01"
# ---- end of fixed values ----


def band(value: Column, limits: tuple, results: tuple) -> Column:
    """results[i] for the first limit above the value, else the last result."""
    out = F.when(value < F.lit(limits[0]), F.lit(results[0]))
    for limit, result in zip(limits[1:], results[1:]):
        out = out.when(value < F.lit(limit), F.lit(result))
    return F.when(value.isNotNull(), out.otherwise(F.lit(results[-1])))


def price_mid(low: Column, high: Column) -> Column:
    return (F.coalesce(low, high) + F.coalesce(high, low)) / F.lit(2)


def price_symbols(mid: Column) -> Column:
    """One to five euro signs, null without a price."""
    return F.repeat(F.lit("€"), band(mid, PRICE_SYMBOL_BANDS, (1, 2, 3, 4, 5)))


def usage_cost(model: Column, tokens_in: Column, tokens_out: Column, searches: Column | None = None) -> Column:
    def rate(position: int) -> Column:
        out = F.lit(USAGE_RATES[-1][position])
        for row in reversed(USAGE_RATES[:-1]):
            hit = F.lit(False)
            for fragment in row[0]:
                hit = hit | F.lower(model).contains(fragment)
            out = F.when(hit, F.lit(row[position])).otherwise(out)
        return out.cast("long")

    micros = tokens_in.cast("long") * rate(1) + tokens_out.cast("long") * rate(2)
    cost = micros.cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(7,6)")
    if searches is not None:
        cost = cost + searches.cast("decimal(10,0)") * F.lit(SEARCH_COST).cast("decimal(4,2)")
    return cost
