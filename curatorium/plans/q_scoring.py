"""Scoring, tier changes and draws on the bound tables, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatorium.functions import chance
from curatorium.functions.tiers import effective_tier
from curatorium.operators import scoring, facts as fact_ops
from curatorium.session import cut_lineage
from curatorium.plans.bindings import AS_OF_YEAR, Data, oracle

_OUT = ("item_id", "tier", "reason", "cast(score as double) as score")


def score_tier(spark, sf_dir):
    return scoring.with_score(Data(spark, sf_dir).item, AS_OF_YEAR).selectExpr(*_OUT)


def _version(n):
    def run(spark, sf_dir):
        return scoring.with_score(Data(spark, sf_dir).item, AS_OF_YEAR, scoring.VERSIONS[n]).selectExpr(*_OUT)

    return run


def tier_shift(spark, sf_dir):
    return scoring.tier_shift(Data(spark, sf_dir).item, AS_OF_YEAR, scoring.V1, scoring.CURRENT)


def propagate_tier(spark, sf_dir):
    d = Data(spark, sf_dir)
    scored = scoring.with_score(d.item, AS_OF_YEAR).select(
        "item_id", effective_tier(F.col("is_icon"), F.col("tier_override"), F.col("tier")).alias("tier")
    )
    return fact_ops.follow_item_tier(d.fact, scored).select("fact_id", "tier", "changed")


def review_queue(spark, sf_dir):
    d = Data(spark, sf_dir)
    proposals = scoring.with_score(
        scoring.with_score(d.item, AS_OF_YEAR, scoring.V2, "old_"), AS_OF_YEAR, scoring.CURRENT, "new_"
    ).select("item_id", "old_tier", "new_tier", F.col("created_at").alias("proposed_at"))
    done = d.attempt.where("event_type = 'click'").select(
        "item_id", F.col("ts").alias("done_at"), F.when(F.col("event_id") % 2 == 0, "applied").otherwise("dismissed").alias("done")
    )
    return fact_ops.open_reviews(cut_lineage(proposals), done).select("item_id", "old_tier", "new_tier")


def draw_tier(spark, sf_dir):
    e = Data(spark, sf_dir).attempt
    key = F.concat(F.lit("tier-"), F.col("event_id").cast("string"))
    return e.groupBy(chance.draw_tier(key).alias("tier")).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


def draw_variant(spark, sf_dir):
    """A variant is never drawn for icons and stays once drawn."""
    d = Data(spark, sf_dir)
    icons = d.item.select("item_id", "is_icon")
    draws = d.attempt.join(icons, "item_id").withColumn(
        "hit", ~F.col("is_icon") & chance.draw_variant(F.concat(F.lit("variant-"), F.col("event_id").cast("string")))
    )
    return draws.groupBy("user_id", "item_id").agg(
        F.bool_or("hit").alias("full_art"), F.count(F.lit(1)).alias("draws")
    )


QUERIES = {
    "score_tier": score_tier,
    **{f"score_v{n}": _version(n) for n in range(1, 8)},
    "tier_shift": tier_shift,
    "propagate_tier": propagate_tier,
    "review_queue": review_queue,
    "draw_tier": draw_tier,
    "draw_variant": draw_variant,
}

# The checks keep every rule as rows of a table and join them to the items' signals, one row per signal and value.
# ---- fixed values: price steps, points and words per signal ----
_PRICE = ((0, 0), (12, "0.5"), (20, 1), (35, "1.5"), (60, 2), (100, "2.5"), (200, 3), (400, "3.5"))
_PRICE_1 = ((0, 0), (10, "0.5"), (15, 1), (25, "1.25"), (45, "1.5"), (80, 2), (150, "2.5"), (300, 3))
_QUALITY = (
    ("classification", "top", "0.25"), ("classification", "premium", "0.10"), ("fame", "wereldberoemd", "0.25"), ("fame", "gerenommeerd", "0.10"),
    ("production", "zeer klein", "0.25"), ("production", "klein", "0.10"), ("year", "top", "0.25"), ("year", "goed", "0.10"), ("large", "true", "0.25"))
_RARE = (("rarity", "zeldzaam", "0.40"), ("rarity", "ongewoon", "0.15"))
_SCARCE = (("few_rarity", "zeldzaam", "0.40"), ("few_rarity", "ongewoon", "0.15"))
_SHOPS = (("shops", "none", "0.40"), ("shops", "3", "0.25"), ("shops", "10", "0.10"), ("guess", "zeldzaam", "0.40"), ("guess", "ongewoon", "0.15"))
_LATER = (("critic", "95", "0.25"), ("critic", "92", "0.10"), ("iconic", "true", "0.25"), ("old", "true", "0.25"))
_MINUS = (("fame", "merk", "0.25"), ("production", "massa", "0.25"), ("year", "slecht", "0.25"))
_CROWD = (("crowd", "true", "0.10"),)
_PLUS_1 = (
    ("classification", "top", "0.75"), ("classification", "premium", "0.50"), ("classification", "kwaliteit", "0.25"), ("fame", "wereldberoemd", "0.40"),
    ("fame", "gerenommeerd", "0.25"), ("fame", "merk", "-0.25"), ("production", "zeer klein", "0.50"), ("production", "klein", "0.25"),
    ("production", "massa", "-0.25"), ("rarity", "zeldzaam", "0.75"), ("rarity", "ongewoon", "0.50"))
_FLEX_1 = (("year", "top", "0.50"), ("year", "goed", "0.25"), ("year", "slecht", "-0.25"), ("old", "true", "0.25"), ("large", "true", "0.25"))
_STEPS = ((3, "ultra"), (2, "superrare"), (1, "rare"), (-99, "common"))
_STEPS_1 = (("3.25", "ultra"), (2, "superrare"), (1, "rare"), (-99, "common"))
_FAME = (("fame", "wereldberoemd", "wereldberoemd huis"), ("fame", "gerenommeerd", "gerenommeerde maker"))
_CLASS_OLD = (("classification", "top", "topclassificatie"), ("classification", "premium", "cru/reserva-niveau"))
_CLASS_7 = (("classification", "top", "hoogste classificatie"), ("classification", "premium", "een reserva of cru"))
_RARE_WORDS = tuple(("rarity", v, v + " in Nederland") for v in ("zeldzaam", "ongewoon"))
_RARE_5 = tuple(("few_rarity", v, v + " in Nederland") for v in ("zeldzaam", "ongewoon"))
_RARE_4 = (("shops", "none", "nauwelijks te koop in Nederland"), ("shops", "3", "zeldzaam in Nederland"), ("guess", "zeldzaam", "zeldzaam in Nederland"),
           ("guess", "ongewoon", "ongewoon in Nederland"))
_RARE_7 = (("few_rarity", "zeldzaam", "amper in Nederlandse winkels"), ("few_rarity", "ongewoon", "weinig in Nederlandse winkels"))
_SMALL = tuple(("production", v, "kleine oplage") for v in ("klein", "zeer klein"))
_CRITIC = (("critic", "95", "topscores van critici"), ("critic", "92", "hoge critici-scores"))
_ICONIC = (("iconic", "true", "iconische wijn"),)


def _one(signal, text):
    return ((signal, "true", text),)


def _year_words(*words):
    return tuple(("year", v, w) for v, w in zip(("top", "slecht", "goed"), words))


def _price_words(*words):
    return tuple(("price", str(i), w) for i, w in enumerate(words))


_AMOUNT = (("amount", None, None),)
_P3 = _price_words("betaalbaar", "toegankelijk geprijsd", "middenklasse", "hogere prijsklasse", "topprijsklasse")
_P6 = _price_words("voor elke dag", "voor een goed diner", "voor een bijzonder moment", "voor grote gelegenheden", "een fles voor het leven")
_P7 = _price_words("makkelijk te vinden", "een goede ontdekking", "lastig op te sporen", "een echte vondst", "een zeldzame vondst")
_OLD_TAIL = (_SMALL, _one("old", "oude fles"), _one("large", "grootformaat"), _one("plain_brand", "bekend merk, ruim verkrijgbaar"))
_KEPT_TAIL = (_SMALL, _one("old", "bewaarwijn op leeftijd"), _one("large", "grootformaat"))
_SHARED_7 = (_ICONIC, _FAME, _CRITIC, _CLASS_7, _RARE_7, _year_words("topjaar", "moeilijk wijnjaar"), _SMALL, _one("old", "bewaarwijn op leeftijd"),
             _one("large", "magnum of groter"), _one("plain_brand", "bekende naam"))
_TODAY = dict(price=_PRICE, plus=_QUALITY + _SCARCE + _LATER, cap="1.00", minus=_MINUS + _CROWD, aged=True)
_CHECKED = {
    1: dict(price=_PRICE_1, unknown="0.25", plus=_PLUS_1, cap="99", flex=_FLEX_1, minus=(), dear=True, steps=_STEPS_1,
            words=(_AMOUNT, _FAME, _CLASS_OLD, _RARE_WORDS, _year_words("topjaar", "zwak jaar", "goed jaar"), *_OLD_TAIL)),
    2: dict(price=_PRICE, plus=_QUALITY + _RARE + (("old", "true", "0.25"),), cap="0.75", minus=_MINUS, dear=True,
            words=(_AMOUNT, _FAME, _CLASS_OLD, _RARE_WORDS, _year_words("topjaar", "zwak jaar"), *_OLD_TAIL)),
    3: dict(price=_PRICE, plus=_QUALITY + _RARE + (("old", "true", "0.25"),), cap="0.75", minus=_MINUS,
            words=(_P3, _FAME, _CLASS_OLD, _RARE_WORDS, _year_words("topjaar", "zwak jaar"), *_OLD_TAIL)),
    4: dict(_TODAY, plus=_QUALITY + _SHOPS + _LATER, words=(
        _P3, _ICONIC, _FAME, _CRITIC, _CLASS_OLD, _RARE_4, _year_words("topjaar", "zwak jaar"), *_KEPT_TAIL, _OLD_TAIL[-1])),
    5: dict(_TODAY, words=(
        _P3, _ICONIC, _FAME, _CRITIC, _CLASS_OLD, _RARE_5, _year_words("topjaar", "zwak jaar"), *_KEPT_TAIL, _OLD_TAIL[-1])),
    6: dict(_TODAY, words=(_P6, _ICONIC, _FAME, _CRITIC, _CLASS_OLD, _RARE_5, _year_words("topjaar", "lastig wijnjaar"), *_KEPT_TAIL,
                           _one("plain_brand", "bekende naam, overal te vinden"))),
    7: dict(_TODAY, words=(_P7, *_SHARED_7)),
    8: dict(_TODAY, words=_SHARED_7, keep=3, euro=True),
}
# ---- end of fixed values ----


def _values(rows):
    def text(v):
        return "null" if v is None else f"'{v}'" if isinstance(v, str) and not v.replace(".", "").replace("-", "").isdigit() else str(v)

    return "(values " + ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows) + ")"


def _quoted(rows):
    return "(values " + ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" for v in r) + ")" for r in rows) + ")"


def _tiers(tag, rules):
    """Common table expressions <tag>_item (signals of every item), <tag>_tier (item_id, total, tier)."""
    old = ("coalesce(age >= old_from and not past_peak and coalesce(ageworthy, true), false)" if rules.get("aged")
           else "coalesce(age >= old_from, false)")
    points = [(side, *row) for side in ("plus", "flex", "minus") for row in rules.get(side, ())]
    dear = " or (iconic and coalesce(p, 0) >= 300)" if rules.get("dear") else ""
    return f"""{tag}_item as (select *, {old} as was_old from (select *,
        (coalesce(price_eur_low, price_eur_high) + coalesce(price_eur_high, price_eur_low)) / 2 as p, coalesce(vintage_quality, 'onbekend') as vq,
        coalesce(nl_shops, 0) < 4 as few, {AS_OF_YEAR} - year as age, if(color = 'wit', 10, 15) as old_from from item)),
      {tag}_signal as (select item_id, s.signal, s.value from (select item_id, unnest([
        {{'signal': 'classification', 'value': classification}}, {{'signal': 'fame', 'value': producer_fame}}, {{'signal': 'production', 'value': production}},
        {{'signal': 'year', 'value': vq}}, {{'signal': 'large', 'value': large_format::varchar}}, {{'signal': 'iconic', 'value': iconic::varchar}},
        {{'signal': 'old', 'value': was_old::varchar}}, {{'signal': 'rarity', 'value': rarity_nl}}, {{'signal': 'few_rarity', 'value': if(few, rarity_nl, null)}},
        {{'signal': 'guess', 'value': if(nl_shops is null, rarity_nl, null)}}, {{'signal': 'crowd', 'value': (vivino_count >= 25000)::varchar}},
        {{'signal': 'shops', 'value': (select arg_min(v, n) from (values (0, 'none'), (3, '3'), (10, '10')) k(n, v) where nl_shops <= n)}},
        {{'signal': 'critic', 'value': (select max(v) from (values ('92'), ('95')) k(v) where critic_max >= v::int)}},
        {{'signal': 'price', 'value': (select count(*)::varchar from (values (12), (25), (60), (200)) k(v) where p >= v and p is not null) }}
        ]) as s from {tag}_item)),
      {tag}_sum as (select item_id, coalesce(sum(points) filter (side = 'plus'), 0) as plus, coalesce(sum(points) filter (side = 'flex'), 0) as flex,
        coalesce(sum(points) filter (side = 'minus'), 0) as minus
        from {tag}_signal left join (select side, signal, value, points::decimal(6, 2) as points from {_quoted(points)} k(side, signal, value, points))
        using (signal, value) group by item_id),
      {tag}_total as (select i.*, coalesce((select arg_max(x::decimal(6, 2), lo) from {_values(rules['price'])} k(lo, x) where p >= lo), {rules.get('unknown', 0)})
        + least(plus, {rules['cap']}) + greatest(-0.50, least(0.75, flex)) - least(minus, 0.50) as total from {tag}_item i join {tag}_sum using (item_id)),
      {tag}_tier as (select *, if(is_icon{dear}, 'icon', (select arg_max(t, lo) from {_values(rules.get('steps', _STEPS))} k(lo, t) where total >= lo)) as tier
        from {tag}_total)"""


def _score_check(rules):
    words = [(i, *row) for i, group in enumerate(rules["words"]) for row in group if row[1] is not None]
    reason = "(select string_agg(w, ' · ' order by pos) from v_word x where x.item_id = t.item_id and n <= {})".format(rules.get("keep", 4))
    if rules.get("euro"):
        reason = f"concat_ws(' · ', {reason}, nullif(repeat('€', (select count(*) from (values (0), (12), (25), (60), (200)) k(lo) where p >= lo)), ''))"
    else:
        reason = f"coalesce({reason}, '')"
    amount = """union all select item_id, -1, '±€' || cast(cast(if(p < 100, round(p), round(p / 10) * 10) as bigint) as varchar)
        from v_tier where p is not null""" if _AMOUNT in rules["words"] else ""
    return oracle(f"""
    with {_tiers('v', rules)},
      v_all as (select item_id, signal, value from v_signal union all
        select item_id, 'plain_brand', 'true' from v_tier where producer_fame = 'merk' and tier = 'common'),
      v_said as (select item_id, pos::int as pos, word || if(signal = 'year', coalesce(' ' || year, ''), '') as w
        from v_all join {_quoted(words)} k(pos, signal, value, word) using (signal, value) join v_tier using (item_id)
        where not (signal = 'price' and p is null) {amount}),
      v_word as (select *, row_number() over (partition by item_id order by pos) as n from v_said)
    select item_id, tier, {reason} as reason, cast(round(total, 2) as double) as score from v_tier t""", "item")


CHECKS = {
    "score_tier": _score_check(_CHECKED[8]),
    **{f"score_v{n}": _score_check(_CHECKED[n]) for n in range(1, 8)},
    "tier_shift": oracle(f"""
    with {_tiers('a', _CHECKED[1])}, {_tiers('b', _CHECKED[8])}
    select a.tier as old_tier, b.tier as new_tier, count(*) as items from a_tier a join b_tier b using (item_id) where a.tier <> b.tier group by all
    """, "item"),
    "propagate_tier": oracle(f"""
    with {_tiers('b', _CHECKED[8])},
    new as (select item_id, if(is_icon, 'icon', coalesce(tier_override, tier)) as new_tier from b_tier)
    select fact_id, coalesce(new_tier, tier) as tier, coalesce(new_tier, tier) is distinct from tier as changed
    from fact left join new using (item_id)""", "item", "fact"),
    "review_queue": oracle(f"""
    with {_tiers('a', _CHECKED[2])}, {_tiers('b', _CHECKED[8])}
    select i.item_id, a.tier as old_tier, b.tier as new_tier from item i join a_tier a on a.item_id = i.item_id join b_tier b on b.item_id = i.item_id
    where a.tier <> b.tier and not exists (select 1 from attempt x where x.event_type = 'click' and x.item_id = i.item_id
      and x.ts >= i.created_at)""", "item", "attempt"),
    "draw_tier": """
    select case when u < 0.01 then 'ultra' when u < 0.06 then 'superrare' when u < 0.24 then 'rare' else 'common' end as tier,
      count(*) as n, min(event_id) as first_id, max(event_id) as last_id
    from (select event_id, ('0x' || substr(md5('tier-' || event_id), 1, 8))::bigint / 4294967296.0 as u from events) group by 1""",
    "draw_variant": oracle("""
    select user_id, item_id, max(case when not is_icon and ('0x' || substr(md5('variant-' || event_id), 1, 8))::bigint / 4294967296.0 < 0.05
      then 1 else 0 end) = 1 as full_art, count(*) as draws
    from attempt join item using (item_id) group by all""", "item", "attempt"),
}
