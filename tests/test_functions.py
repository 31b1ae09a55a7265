"""Edge values of the column functions and of the scoring rules."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from curatorium.functions import money, signals, text
from curatorium.operators import scoring, validate


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [
    ("Château d'Yquem 2015", "yquem"), ("Rozier", "rozier"), ("CHÂTEAU ROZIER", "rozier"), (None, ""), ("Œuf & Æther", "oeuf aether"),
    ("The Estate", ""), ("Côte-Rôtie 1999er", "cote rotie 1999er"), ("20010", "20010"), ("  ", ""), ("vin de la vigne", "vin vigne"),
])
def test_norm_name(spark, raw, want):
    assert one(spark, text.norm_name(F.lit(raw))) == want


def test_norm_name_of_long_filler_runs(spark):
    assert one(spark, text.norm_name(F.repeat(F.lit("de la "), 200_000))) == ""


@pytest.mark.parametrize("raw, want", [
    ("€7–13", (7, 13, False)), ("€28+", (28, None, True)), ("€2.500+", (2500, None, True)), ("€18–36 (50 cl)", (18, 36, False)), ("?", (None, None, False)),
])
def test_price_range(spark, raw, want):
    assert tuple(one(spark, text.price_range(F.lit(raw)))) == want


@pytest.mark.parametrize("url, want", [("https://www.Shop.nl/x?y", "shop.nl"), ("no url", None), ("http://a.b.nl:80/", "a.b.nl")])
def test_host(spark, url, want):
    assert one(spark, text.host_of(F.lit(url))) == want


@pytest.mark.parametrize("mid, signs", [(11.99, 1), (12, 2), (24.9, 2), (25, 3), (60, 4), (200, 5), (None, None)])
def test_price_symbols(spark, mid, signs):
    got = one(spark, money.price_symbols(F.lit(mid).cast("decimal(12,4)")))
    assert got == (None if signs is None else "€" * signs)


def test_usage_cost(spark):
    got = one(spark, money.usage_cost(F.lit("Some-Opus-4"), F.lit(1_000_000), F.lit(100_000), F.lit(3)))
    assert got == Decimal("6.03")


def test_clean_elements_drops_everything_unknown(spark):
    doc = '[{"t":"svg"},{"t":"text","x":1.25,"color":"#12345G","s":"' + "a" * 60 + '"}]'
    got = one(spark, signals.clean_elements(F.from_json(F.lit(doc), f"array<{signals.ELEMENT_SCHEMA}>")))
    assert len(got) == 1 and got[0]["x"] == 1.3 and got[0]["color"] is None and len(got[0]["s"]) == 48
    assert one(spark, signals.clean_elements(F.from_json(F.lit('[{"t":"x"}]'), f"array<{signals.ELEMENT_SCHEMA}>"))) is None


BASE = dict(price_eur_low=None, price_eur_high=None, classification=None, producer_fame=None, production=None, rarity_nl=None,
            vintage_quality=None, large_format=None, iconic=None, nl_shops=None, critic_max=None, vivino_count=None, ageworthy=None,
            past_peak=None, year=None, color=None, is_icon=None)
SCHEMA = ("id long, price_eur_low decimal(12,4), price_eur_high decimal(12,4), classification string, producer_fame string, production string, "
          "rarity_nl string, vintage_quality string, large_format boolean, iconic boolean, nl_shops int, critic_max int, vivino_count int, "
          "ageworthy boolean, past_peak boolean, year int, color string, is_icon boolean")


def score(spark, rows, rules=scoring.CURRENT):
    data = [(i, *{**BASE, **{k: Decimal(v) if k.startswith("price") else v for k, v in r.items()}}.values()) for i, r in enumerate(rows)]
    out = scoring.with_score(spark.createDataFrame(data, SCHEMA), 2024, rules).orderBy("id").collect()
    return [(r.tier, r.reason, float(r.score)) for r in out]


def test_price_band_edges_are_monotone(spark):
    prices = [0, 11, 12, 19, 20, 34, 35, 59, 60, 99, 100, 199, 200, 399, 400, 9000]
    got = [s for _, _, s in score(spark, [dict(price_eur_low=p) for p in prices])]
    assert got == sorted(got) and got[:4] == [0, 0, 0.5, 0.5] and got[-1] == 3.5


def test_caps_rarity_age_and_icon(spark):
    everything = dict(price_eur_low=500, classification="top", producer_fame="wereldberoemd", production="zeer klein", rarity_nl="zeldzaam",
                      vintage_quality="top", large_format=True, iconic=True, nl_shops=0, critic_max=99, year=1990, color="rood")
    rows = [everything, {**everything, "is_icon": True}, dict(rarity_nl="zeldzaam", nl_shops=3), dict(rarity_nl="zeldzaam", nl_shops=4),
            dict(year=2014, color="wit"), dict(year=2014, color="rood"), dict(year=1990, past_peak=True), dict(year=1990, ageworthy=False),
            dict(producer_fame="merk", production="massa", vintage_quality="slecht", vivino_count=25000), {}]
    got = score(spark, rows)
    assert got[0][0] == "ultra" and got[0][2] == 4.5
    assert got[0][1] == "iconische wijn · wereldberoemd huis · topscores van critici · €€€€€"
    assert got[1][0] == "icon"
    assert [g[2] for g in got[2:8]] == [0.4, 0.0, 0.25, 0.0, 0.0, 0.0]
    assert got[2][1] == "amper in Nederlandse winkels" and got[3][1] == "" and got[4][1] == "bewaarwijn op leeftijd"
    assert got[8] == ("common", "moeilijk wijnjaar · bekende naam", -0.5)
    assert got[9] == ("common", "", 0.0)


def test_versions_differ_where_they_should(spark):
    row = [dict(price_eur_low=300, iconic=True)]
    assert score(spark, row, scoring.V2)[0][0] == "icon" and score(spark, row, scoring.V3)[0][0] == "ultra"
    assert score(spark, [dict(price_eur_low=104)], scoring.V2)[0][1] == "±€100"


def test_first_broken_rule_wins(spark):
    rules = validate.profile_rules(F.col("c"), F.col("p"), F.col("n"))
    df = spark.createDataFrame([("x", "x", "ok"), ("groen", "x", "ok"), ("groen", "zwart", "no#"), ("groen", "zwart", "Zoë d'A"), (None, "zwart", None)],
                               "c string, p string, n string")
    got = [r.reason for r in validate.with_reason(df, rules).collect()]
    assert got == ["invalid_cover", "invalid_pages", "invalid_name", None, None]
    good, bad = validate.split(df, rules)
    assert (good.count(), bad.count()) == (2, 3)


def test_the_score_as_one_expression(spark):
    from curatorium.operators import scoring
    from curatorium.plans.bindings import Data

    items = Data(spark, "/root/testdata/sf0.001").item
    for rules in (scoring.CURRENT, scoring.V1, scoring.V4):
        both = scoring.with_score(items, 2024, rules).withColumn(
            "s", scoring.score_of(F.struct(*[F.col(c) for c in items.columns]), 2024, rules))
        same = F.struct("tier", "reason", "score").eqNullSafe(F.struct("s.tier", "s.reason", "s.score"))
        assert both.where(~same).isEmpty() and both.count() == items.count()
