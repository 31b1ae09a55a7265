"""The scalar functions for SQL users: temporary SQL functions, expanded by the optimizer, no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from curatorium.functions.money import SEARCH_COST, USAGE_RATES
from curatorium.functions.text import ACCENTS, LIGATURES, PLAIN, STOPWORDS
from curatorium.functions.tiers import TIERS


def _norm_name() -> str:
    folded = "translate(lower(coalesce(s, '')), '{}', '{}')".format(ACCENTS.replace("'", "\\'"), PLAIN)
    for glyph, letters in LIGATURES.items():
        folded = f"replace({folded}, '{glyph}', '{letters}')"
    year = r"(?<![\\p{L}\\p{N}_])(?:18|19|20)[0-9]{2}(?![\\p{L}\\p{N}_])"
    words = f"split(regexp_replace(regexp_replace({folded}, '{year}', ' '), '[^a-z0-9]+', ' '), ' ')"
    fillers = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"array_join(filter({words}, w -> w <> '' and w not in ({fillers})), ' ')"


def _rate(position: int) -> str:
    cases = " ".join(
        "when {} then {}".format(" or ".join(f"contains(lower(model), '{f}')" for f in row[0]), row[position]) for row in USAGE_RATES[:-1])
    return f"case {cases} else {USAGE_RATES[-1][position]} end"


def register(spark: SparkSession) -> list[str]:
    """Create norm_name, usage_cost and tier_rank for this session; returns their names."""
    tiers = ", ".join(f"'{t}'" for t in TIERS)
    bodies = {
        "norm_name(s string) returns string": _norm_name(),
        "usage_cost(model string, tokens_in bigint, tokens_out bigint, searches int) returns decimal(30,8)":
            f"cast((tokens_in * {_rate(1)} + tokens_out * {_rate(2)}) * 0.000001BD + searches * {SEARCH_COST}BD as decimal(30,8))",
        "tier_rank(tier string) returns int": f"cast(coalesce(array_position(array({tiers}), tier), 0) as int)",
    }
    for signature, body in bodies.items():
        spark.sql(f"create or replace temporary function {signature} return {body}")
    return [signature.split("(")[0] for signature in bodies]
