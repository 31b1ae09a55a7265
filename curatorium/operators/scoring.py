"""Rule scoring: signals in, (tier, reason, score) out, as pure column expressions.

A rule version is data (`RuleSet`), so old and new versions can be scored side by side
in one projection without a shuffle. Points are decimals; a double never decides a tier.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from curatorium.functions.money import band, price_mid, price_symbols

JOINER = " · "


@dataclass(frozen=True)
class RuleSet:
    price_limits: tuple
    price_points: tuple
    unknown_price_points: str
    bonus: dict                      # signal -> {value: points}
    bonus_cap: str | None
    malus: dict
    malus_cap: str | None
    cuts: tuple                      # lowest score of ultra, superrare, rare
    old_points: str = "0.25"
    large_points: str = "0.25"
    iconic_points: str | None = None
    critic_points: tuple = ()        # ((at least, points), ...)
    crowd_malus: tuple = ()          # ((at least, points), ...)
    shops_points: tuple | None = None  # ((at most, points), ...) measured shops replace the estimate
    rare_below_shops: int | None = None
    old_needs_ageing: bool = False
    expensive_icon_from: int | None = None
    adjustment: dict = field(default_factory=dict)   # version 1 only: separately clamped
    adjustment_range: tuple | None = None
    words: dict = field(default_factory=dict)
    price_words: tuple | None = None  # None: rounded amount
    symbols_last: bool = False


# ---- fixed values: the published rule versions and their wording ----
_WORDS_1 = {
    "iconic": "iconische wijn",
    "producer_fame": {"wereldberoemd": "wereldberoemd huis", "gerenommeerd": "gerenommeerde maker"},
    "critic": ((95, "topscores van critici"), (92, "hoge critici-scores")),
    "classification": {"top": "topclassificatie", "premium": "cru/reserva-niveau"},
    "rarity_nl": {"zeldzaam": "zeldzaam in Nederland", "ongewoon": "ongewoon in Nederland"},
    "shops": ((0, "nauwelijks te koop in Nederland"), (3, "zeldzaam in Nederland")),
    "vintage_quality": {"top": "topjaar", "slecht": "zwak jaar"},
    "small": "kleine oplage",
    "old": "bewaarwijn op leeftijd",
    "large": "grootformaat",
    "brand": "bekend merk, ruim verkrijgbaar",
}
_BONUS = {
    "classification": {"top": "0.25", "premium": "0.1"},
    "producer_fame": {"wereldberoemd": "0.25", "gerenommeerd": "0.1"},
    "production": {"zeer klein": "0.25", "klein": "0.1"},
    "rarity_nl": {"zeldzaam": "0.4", "ongewoon": "0.15"},
    "vintage_quality": {"top": "0.25", "goed": "0.1"},
}
_MALUS = {
    "producer_fame": {"merk": "0.25"},
    "production": {"massa": "0.25"},
    "vintage_quality": {"slecht": "0.25"},
}
V1 = RuleSet(
    price_limits=(10, 15, 25, 45, 80, 150, 300),
    price_points=("0", "0.5", "1", "1.25", "1.5", "2", "2.5", "3"),
    unknown_price_points="0.25",
    bonus={
        "classification": {"top": "0.75", "premium": "0.5", "kwaliteit": "0.25"},
        "producer_fame": {"wereldberoemd": "0.4", "gerenommeerd": "0.25", "merk": "-0.25"},
        "production": {"zeer klein": "0.5", "klein": "0.25", "massa": "-0.25"},
        "rarity_nl": {"zeldzaam": "0.75", "ongewoon": "0.5"},
    },
    bonus_cap=None,
    malus={},
    malus_cap=None,
    cuts=("3.25", "2", "1"),
    expensive_icon_from=300,
    adjustment={"vintage_quality": {"top": "0.5", "goed": "0.25", "slecht": "-0.25"}},
    adjustment_range=("-0.5", "0.75"),
    words={**_WORDS_1, "vintage_quality": {"top": "topjaar", "goed": "goed jaar", "slecht": "zwak jaar"},
           "iconic": None, "critic": (), "old": "oude fles"},
)
V2 = RuleSet(
    price_limits=(12, 20, 35, 60, 100, 200, 400),
    price_points=("0", "0.5", "1", "1.5", "2", "2.5", "3", "3.5"),
    unknown_price_points="0",
    bonus=_BONUS,
    bonus_cap="0.75",
    malus=_MALUS,
    malus_cap="0.5",
    cuts=("3", "2", "1"),
    expensive_icon_from=300,
    words={**_WORDS_1, "iconic": None, "critic": (), "old": "oude fles"},
)
V3 = replace(
    V2,
    expensive_icon_from=None,
    price_words=("betaalbaar", "toegankelijk geprijsd", "middenklasse", "hogere prijsklasse", "topprijsklasse"),
)
V4 = replace(
    V3,
    bonus_cap="1",
    iconic_points="0.25",
    critic_points=((95, "0.25"), (92, "0.1")),
    crowd_malus=((25000, "0.1"),),
    shops_points=((0, "0.4"), (3, "0.25"), (10, "0.1")),
    old_needs_ageing=True,
    words=_WORDS_1,
)
V5 = replace(V4, shops_points=None, rare_below_shops=4)
V6 = replace(
    V5,
    words={**_WORDS_1, "vintage_quality": {"top": "topjaar", "slecht": "lastig wijnjaar"},
           "brand": "bekende naam, overal te vinden"},
    price_words=("voor elke dag", "voor een goed diner", "voor een bijzonder moment",
                 "voor grote gelegenheden", "een fles voor het leven"),
)
V7 = replace(
    V6,
    words={**_WORDS_1,
           "classification": {"top": "hoogste classificatie", "premium": "een reserva of cru"},
           "rarity_nl": {"zeldzaam": "amper in Nederlandse winkels", "ongewoon": "weinig in Nederlandse winkels"},
           "vintage_quality": {"top": "topjaar", "slecht": "moeilijk wijnjaar"},
           "large": "magnum of groter",
           "brand": "bekende naam"},
    price_words=("makkelijk te vinden", "een goede ontdekking", "lastig op te sporen",
                 "een echte vondst", "een zeldzame vondst"),
)
V8 = replace(V7, price_words=None, symbols_last=True)
PRICE_WORD_LIMITS = (12, 25, 60, 200)
OLD_AGE_WHITE, OLD_AGE_OTHER = 10, 15
# ---- end of fixed values ----

VERSIONS = {1: V1, 2: V2, 3: V3, 4: V4, 5: V5, 6: V6, 7: V7, 8: V8}
CURRENT = V8


def _pts(text: str) -> Column:
    return F.lit(Decimal(text)).cast("decimal(6,2)")


def _lookup(col: Column, table: dict) -> Column:
    out = None
    for value, points in table.items():
        out = F.when(col == value, _pts(points)) if out is None else out.when(col == value, _pts(points))
    return out.otherwise(_pts("0"))


def _at_least(col: Column, steps: tuple, convert=_pts, other: Column | None = None) -> Column:
    out = None
    for limit, result in steps:
        out = F.when(col >= limit, convert(result)) if out is None else out.when(col >= limit, convert(result))
    return out.otherwise(_pts("0") if other is None else other)


def _at_most(col: Column, steps: tuple, convert, other: Column) -> Column:
    out = None
    for limit, result in steps:
        out = F.when(col <= limit, convert(result)) if out is None else out.when(col <= limit, convert(result))
    return out.otherwise(other)


def _words(col: Column, table: dict) -> Column:
    out = None
    for value, text in table.items():
        out = F.when(col == value, F.lit(text)) if out is None else out.when(col == value, F.lit(text))
    return out


def _total(parts: list[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


def _points(s: dict[str, Column], mid: Column, aged: Column, scarce: Column, rules: RuleSet) -> Column:
    large, iconic, shops = s["large_format"], s["iconic"], s["nl_shops"]
    base = band(mid, rules.price_limits, tuple(Decimal(p) for p in rules.price_points))
    base = F.coalesce(base.cast("decimal(6,2)"), _pts(rules.unknown_price_points))
    plus = []
    for name, table in rules.bonus.items():
        points = _lookup(s[name], table)
        if name == "rarity_nl":
            if rules.shops_points is not None:
                measured = _at_most(shops, rules.shops_points, _pts, _pts("0"))
                points = F.when(shops.isNotNull(), measured).otherwise(points)
            points = F.when(scarce, points).otherwise(_pts("0"))
        plus.append(points)
    extra = [F.when(aged, _pts(rules.old_points)).otherwise(_pts("0")),
             F.when(large, _pts(rules.large_points)).otherwise(_pts("0"))]
    if rules.critic_points:
        plus.append(_at_least(s["critic_max"], rules.critic_points))
    if rules.iconic_points:
        plus.append(F.when(iconic, _pts(rules.iconic_points)).otherwise(_pts("0")))
    if rules.adjustment_range is None:
        plus += extra
    bonus = _total(plus)
    if rules.bonus_cap is not None:
        bonus = F.least(bonus, _pts(rules.bonus_cap).cast("decimal(12,2)"))
    score = base + bonus
    if rules.adjustment_range is not None:
        low, high = (_pts(x).cast("decimal(12,2)") for x in rules.adjustment_range)
        adjust = _total([_lookup(s[n], t) for n, t in rules.adjustment.items()] + extra)
        score = score + F.greatest(low, F.least(high, adjust))
    if rules.malus:
        minus = [_lookup(s[n], t) for n, t in rules.malus.items()]
        if rules.crowd_malus:
            minus.append(_at_least(s["vivino_count"], rules.crowd_malus))
        score = score - F.least(_total(minus), _pts(rules.malus_cap).cast("decimal(12,2)"))
    return score.cast("decimal(6,2)")


def _tier(s: dict[str, Column], mid: Column, score: Column, is_icon: Column, rules: RuleSet) -> Column:
    ultra, superrare, rare = rules.cuts
    listed = F.coalesce(is_icon, F.lit(False))
    if rules.expensive_icon_from is not None:
        listed = listed | (s["iconic"] & (F.coalesce(mid, F.lit(0)) >= rules.expensive_icon_from))
    return (
        F.when(listed, "icon").when(score >= _pts(ultra), "ultra").when(score >= _pts(superrare), "superrare")
        .when(score >= _pts(rare), "rare").otherwise("common")
    )


def _reason(
    s: dict[str, Column], mid: Column, aged: Column, scarce: Column, tier: Column, year: Column, rules: RuleSet
) -> Column:
    w, shops = rules.words, s["nl_shops"]
    nothing = F.lit(None).cast("string")
    reasons: list[Column] = []
    if rules.price_words is not None:
        reasons.append(band(mid, PRICE_WORD_LIMITS, rules.price_words))
    elif not rules.symbols_last:
        amount = F.when(mid < 100, F.round(mid, 0)).otherwise(F.round(mid / 10, 0) * 10)
        reasons.append(F.concat(F.lit("±€"), amount.cast("long").cast("string")))
    if w["iconic"]:
        reasons.append(F.when(s["iconic"], F.lit(w["iconic"])))
    reasons.append(_words(s["producer_fame"], w["producer_fame"]))
    if w["critic"]:
        reasons.append(_at_least(s["critic_max"], w["critic"], F.lit, nothing))
    reasons.append(_words(s["classification"], w["classification"]))
    rarity = F.when(scarce, _words(s["rarity_nl"], w["rarity_nl"]))
    if rules.shops_points is not None:
        rarity = F.when(shops.isNotNull(), _at_most(shops, w["shops"], F.lit, nothing)).otherwise(rarity)
    reasons.append(rarity)
    for value, text in w["vintage_quality"].items():
        reasons.append(F.when(s["vintage_quality"] == value, F.concat_ws(" ", F.lit(text), year.cast("string"))))
    reasons.append(F.when(s["production"].isin("klein", "zeer klein"), F.lit(w["small"])))
    reasons.append(F.when(aged, F.lit(w["old"])))
    reasons.append(F.when(s["large_format"], F.lit(w["large"])))
    reasons.append(F.when((s["producer_fame"] == "merk") & (tier == "common"), F.lit(w["brand"])))
    # concat_ws skips nulls and substring_index keeps the first n, both inside generated code
    joined = F.concat_ws(JOINER, *reasons)
    if rules.symbols_last:
        return F.concat_ws(JOINER, F.nullif(F.substring_index(joined, JOINER, 3), F.lit("")), price_symbols(mid))
    return F.substring_index(joined, JOINER, 4)


SIGNALS = (
    "price_eur_low price_eur_high classification producer_fame production rarity_nl vintage_quality "
    "large_format iconic nl_shops critic_max vivino_count ageworthy past_peak"
).split()


def with_score(items: DataFrame, as_of_year: int, rules: RuleSet = CURRENT, prefix: str = "") -> DataFrame:
    """Add tier, reason and score to items that carry the signal columns.

    Stacked projections name each intermediate once: the optimizer keeps a projection whose
    output is used more than once, so the generated code stays small.
    """
    s = {n: F.col(n) for n in SIGNALS}
    s["vintage_quality"] = F.col("_vintage")
    s["large_format"], s["iconic"] = F.col("_large"), F.col("_iconic")
    year, mid, aged, scarce = F.col("year"), F.col("_mid"), F.col("_aged"), F.col("_scarce")
    is_aged = F.lit(as_of_year) - year >= F.when(F.col("color") == "wit", OLD_AGE_WHITE).otherwise(OLD_AGE_OTHER)
    if rules.old_needs_ageing:
        is_aged = is_aged & ~F.coalesce(F.col("past_peak"), F.lit(False)) & F.coalesce(F.col("ageworthy"), F.lit(True))
    limit = rules.rare_below_shops
    is_scarce = F.lit(True) if limit is None else F.coalesce(s["nl_shops"], F.lit(0)) < limit
    tier, score = prefix + "tier", prefix + "score"
    prepared = items.withColumns({
        "_mid": price_mid(s["price_eur_low"], s["price_eur_high"]),
        "_vintage": F.coalesce(F.col("vintage_quality"), F.lit("onbekend")),
        "_large": F.coalesce(F.col("large_format"), F.lit(False)),
        "_iconic": F.coalesce(F.col("iconic"), F.lit(False)),
        "_aged": F.coalesce(is_aged, F.lit(False)),
        "_scarce": is_scarce,
    })
    scored = prepared.withColumn(score, _points(s, mid, aged, scarce, rules))
    tiered = scored.withColumn(tier, _tier(s, mid, F.col(score), F.col("is_icon"), rules))
    reasoned = tiered.withColumn(prefix + "reason", _reason(s, mid, aged, scarce, F.col(tier), year, rules))
    return reasoned.drop("_mid", "_vintage", "_large", "_iconic", "_aged", "_scarce")


def _let(value: Column, body) -> Column:
    """Names a value inside an expression, so it is computed once however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def score_of(item: Column, as_of_year: int, rules: RuleSet = CURRENT) -> Column:
    """The score of one item as struct(tier, reason, score), for an item that is itself a struct of the signal columns, `year`,
    `color` and `is_icon`. For whole tables `with_score` generates faster code."""
    def signals(p: Column) -> dict[str, Column]:
        own = {n: item[n] for n in SIGNALS}
        return own | {"vintage_quality": p["vintage"], "large_format": p["large"], "iconic": p["iconic"]}

    old = F.lit(as_of_year) - item["year"] >= F.when(item["color"] == "wit", OLD_AGE_WHITE).otherwise(OLD_AGE_OTHER)
    if rules.old_needs_ageing:
        old = old & ~F.coalesce(item["past_peak"], F.lit(False)) & F.coalesce(item["ageworthy"], F.lit(True))
    limit = rules.rare_below_shops
    scarce = F.lit(True) if limit is None else F.coalesce(item["nl_shops"], F.lit(0)) < limit
    prepared = F.struct(
        price_mid(item["price_eur_low"], item["price_eur_high"]).alias("mid"), F.coalesce(item["vintage_quality"], F.lit("onbekend")).alias("vintage"),
        F.coalesce(item["large_format"], F.lit(False)).alias("large"), F.coalesce(item["iconic"], F.lit(False)).alias("iconic"),
        F.coalesce(old, F.lit(False)).alias("aged"), scarce.alias("scarce"))

    def result(p: Column, tier: Column, score: Column) -> Column:
        reason = _reason(signals(p), p["mid"], p["aged"], p["scarce"], tier, item["year"], rules)
        return F.struct(tier.alias("tier"), reason.alias("reason"), score.alias("score"))

    return _let(prepared, lambda p: _let(_points(signals(p), p["mid"], p["aged"], p["scarce"], rules), lambda score: _let(
        _tier(signals(p), p["mid"], score, item["is_icon"], rules), lambda tier: result(p, tier, score))))


def tier_shift(items: DataFrame, as_of_year: int, old: RuleSet, new: RuleSet) -> DataFrame:
    """How many items move between tiers when the rules change; unchanged ones are left out."""
    both = with_score(with_score(items, as_of_year, old, "old_"), as_of_year, new, "new_")
    counts = both.groupBy("old_tier", "new_tier").agg(
        F.count(F.lit(1)).alias("items"), F.bool_or(F.col("old_tier") != F.col("new_tier")).alias("moved")
    )
    # filtered on an aggregate, so the whole rule text is not copied into a pushed-down predicate
    return counts.where("moved").drop("moved")
