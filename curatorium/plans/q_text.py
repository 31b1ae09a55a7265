"""Sources, text functions, validation and matching on the bound tables, with their check SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from curatorium.functions import chance, dates, money, signals, text
from curatorium.operators import facts as fact_ops, matching, progress, validate
from curatorium.plans.bindings import AS_OF_YEAR, Data, oracle
from curatorium.sources import catalogue, documents, objects, payload, sinks


def norm_name(spark, sf_dir):
    d = Data(spark, sf_dir)
    texts = d.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(
        d.part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"),
                      F.concat(F.lit("Château d'"), F.initcap("p_name"), F.lit(" 1998 "), F.col("p_brand")).alias("text"))
    )
    return texts.withColumn("norm", text.norm_name(F.col("text"))).select(
        "kind", "id", F.md5("norm").alias("norm_md5"), F.length("norm").cast("long").alias("norm_chars")
    )


def natural_key(spark, sf_dir):
    p = Data(spark, sf_dir).part
    maker = F.when(F.col("p_partkey") % 9 != 0, F.concat(F.lit("  "), F.col("p_brand"), F.lit(" ")))
    return p.select("p_partkey", text.natural_key(maker, F.concat(F.initcap("p_name"), F.lit("  "))).alias("item_key"))


def stable_bucket(spark, sf_dir):
    i = Data(spark, sf_dir).item
    return i.select("item_id", chance.stable_bucket(text.natural_key(F.col("maker"), F.col("name"))).alias("bucket"))


def slug(spark, sf_dir):
    c = Data(spark, sf_dir).customer
    raw = F.when(F.col("c_custkey") % 8 == 0, F.lit("")).when(F.col("c_custkey") % 8 == 1, F.lit(None)).otherwise(
        F.concat(F.col("c_mktsegment"), F.lit("  "), F.col("c_name")))
    return c.select("c_custkey", text.slug(raw).alias("slug"))


def year_extract(spark, sf_dir):
    p = Data(spark, sf_dir).pages
    found = text.year_in_text(F.col("html"))
    last = F.right("url", F.lit(4))
    return p.select(
        "page_id", found.cast("long").alias("year_found"),
        text.year_in_range(found, AS_OF_YEAR).cast("long").alias("year_ok"), text.year_exact(last).cast("long").alias("url_year"),
    )


def price_band(spark, sf_dir):
    from decimal import Decimal

    from curatorium.operators.scoring import CURRENT

    i = Data(spark, sf_dir).item.withColumn("mid", money.price_mid(F.col("price_eur_low"), F.col("price_eur_high")))
    points = money.band(F.col("mid"), CURRENT.price_limits, tuple(Decimal(p) for p in CURRENT.price_points))
    return i.select("item_id", points.cast("double").alias("points"), money.price_symbols(F.col("mid")).alias("symbols"))


def price_text(spark, sf_dir):
    p = Data(spark, sf_dir).part
    size = F.col("p_size").cast("string")
    raw = (
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("€"), size, F.lit("–"), (F.col("p_size") * 2).cast("string")))
        .when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("€"), size, F.lit("+")))
        .when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("€"), size, F.lit(".000+")))
        .when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("€"), size, F.lit("–"), size, F.lit("9 (37,5 cl)")))
        .otherwise(F.lit("op aanvraag"))
    )
    return p.select("p_partkey", text.price_range(raw).alias("r")).select("p_partkey", "r.low", "r.high", "r.open_end")


def display_name(spark, sf_dir):
    u = Data(spark, sf_dir).users
    return u.select("user_id", text.display_name(F.col("display_name"), F.col("mail")).alias("name"))


def text_cap(spark, sf_dir):
    c = Data(spark, sf_dir).conversations
    return c.select(
        "conv_id", "turn", *[text.blank_to_null(F.col("text"), n).alias(f"first_{n}") for n in (40, 140, 300)]
    )


def local_day(spark, sf_dir):
    e = Data(spark, sf_dir).events
    return e.groupBy(
        dates.local_day(F.col("ts")).cast("string").alias("day"), dates.local_month(F.col("ts")).alias("month")
    ).agg(F.count(F.lit(1)).alias("n"))


def season_flag(spark, sf_dir):
    d = Data(spark, sf_dir)
    age = AS_OF_YEAR - F.col("year")
    old = age >= F.when(F.col("color") == "wit", 10).otherwise(15)
    return (
        d.fact.join(d.item.select("item_id", "year", "color"), "item_id")
        .groupBy(dates.in_harvest(F.col("created_at")).alias("harvest"), F.coalesce(old, F.lit(False)).alias("old"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def blend_hex(spark, sf_dir):
    c = Data(spark, sf_dir).customer
    a = F.concat(F.lit("#"), F.substring(F.md5(F.col("c_name")), 1, 6))
    b = F.concat(F.lit("#"), F.substring(F.md5(F.col("c_mktsegment")), 7, 6))
    return c.select("c_custkey", text.blend_hex(a, b, (F.col("c_custkey") % 13) / F.lit(12.0)).alias("color"))


def squash_has(spark, sf_dir):
    t = Data(spark, sf_dir).documents.withColumn("squashed", text.squash(F.col("text")))
    return t.select(
        "doc_id", F.length("squashed").cast("long").alias("chars"),
        text.contains_any(F.col("squashed"), ["theonth", "reauion", "eauxment"]).alias("hit"),
    )


def _style_documents(d: Data):
    k = F.col("p_partkey")

    def element(kind, x, color, i):
        return F.struct(
            kind.alias("t"), F.concat(F.col("p_name"), F.lit(" "), F.lit("z" * 40)).alias("s"), x.alias("x"),
            color.alias("color"), (k % 2 == i % 2).alias("upper"),
        )

    kinds = ("text", "art", "lines", "rule")
    els = [
        element(F.when(k % 5 == i, F.lit("bogus")).otherwise(F.lit(kinds[i % 4])), k % 100 + F.lit(0.25 * (i + 1)),
                F.when(k % 3 == 0, F.lit("metal")).when(k % 3 == 1, F.lit("#12ab3")).otherwise(
                    F.concat(F.lit("#"), F.substring(F.md5(F.col("p_name")), 1, 6))), i)
        for i in range(5)
    ]
    wanted = (k % 7).cast("int")
    all_els = F.concat(F.array(*els), F.array_repeat(els[4], 22))
    style = F.struct(F.lit(2).alias("v"), F.lit("#163322").alias("paper"), F.lit("gold").alias("metal"),
                     F.slice(all_els, 1, F.when(wanted == 6, 27).otherwise(wanted)).alias("els"))
    return d.part.select(k.cast("string").alias("item"), F.col("p_name").alias("name"), style.alias("style"))


def clean_elements(spark, sf_dir):
    raw = _style_documents(Data(spark, sf_dir)).select("item", F.to_json("style").alias("doc"))
    parsed = raw.select("item", F.from_json("doc", documents.DOCUMENT_SCHEMA.split("style ", 1)[1]).alias("s"))
    cleaned = parsed.select("item", signals.clean_elements(F.col("s.els")).alias("els"))
    return cleaned.select(
        F.col("item").cast("long").alias("item_id"),
        F.coalesce(F.size("els"), F.lit(0)).cast("long").alias("kept"),
        F.array_join(F.transform("els", lambda e: F.concat_ws("/", e["t"], F.substring(e["s"], -4, 4), F.length(e["s"]).cast("string"),
                     F.format_number(e["x"], 1), e["color"], e["upper"].cast("string"))), ";").alias("els"),
    )


def style_elements(spark, sf_dir):
    """Documents written as JSON lines to the shared folder and read back, one row per element."""
    d = Data(spark, sf_dir)
    folder = sinks.shared_folder(spark, "label-documents")
    _style_documents(d).write.json(folder)
    e = documents.elements(documents.read_documents(spark, folder))
    return e.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item").alias("items"),
                              F.max("position").cast("long").alias("last_position"))


def merge_signals_open(spark, sf_dir):
    """The same merge on documents whose fields nobody has fixed; `shelf`, `blend` and `seen` are unknown to the library."""
    k = F.col("item_id")
    i = Data(spark, sf_dir).item
    rough = F.to_json(F.struct("nl_shops", "critic_max", "rarity_nl", (k % 7).alias("shelf"), F.struct((k % 3).alias("share")).alias("blend")))
    checked = F.when(k % 5 != 0, F.to_json(F.struct(
        F.when(k % 3 == 0, k % 12).alias("nl_shops"), F.when(k % 2 == 0, k % 11).alias("shelf"), (k % 4 == 0).alias("seen"))))
    merged = i.select("item_id", signals.merge_open(F.parse_json(rough), F.parse_json(checked)).alias("m"))
    read = {"nl_shops": "bigint", "critic_max": "bigint", "rarity_nl": "string", "shelf": "bigint", "blend.share": "bigint", "seen": "boolean"}
    return merged.select("item_id", *[F.try_variant_get("m", f"$.{n}", t).alias(n.replace(".", "_")) for n, t in read.items()])


def merge_signals(spark, sf_dir):
    names = ["price_eur_low", "price_eur_high", "nl_shops", "critic_max", "rarity_nl"]
    i = Data(spark, sf_dir).item
    k = F.col("item_id")
    verified = F.struct(
        F.when(k % 4 == 0, (k % 90).cast("decimal(12,4)")).alias("price_eur_low"),
        F.when(k % 4 == 0, (k % 90 + 5).cast("decimal(12,4)")).alias("price_eur_high"),
        F.when(k % 3 == 0, (k % 12).cast("int")).alias("nl_shops"),
        F.lit(None).cast("int").alias("critic_max"),
        F.when(k % 6 == 0, F.lit("gewoon")).alias("rarity_nl"),
    )
    merged = i.select("item_id", signals.merge_fields(F.struct(*names), verified, names).alias("m"))
    return merged.select("item_id", F.col("m.price_eur_low").cast("double").alias("price_eur_low"),
                         F.col("m.price_eur_high").cast("double").alias("price_eur_high"),
                         F.col("m.nl_shops").cast("long").alias("nl_shops"),
                         F.col("m.critic_max").cast("long").alias("critic_max"), "m.rarity_nl")


def ingest_payload(spark, sf_dir):
    i = Data(spark, sf_dir).item
    k = F.col("item_id")
    raw = F.struct(
        F.concat(F.lit(" "), F.initcap("name"), F.lit(" ")).alias("naam"),
        F.when(k % 11 != 0, F.concat(F.col("maker"), F.lit("  "))).alias("maker"),
        F.when(k % 13 == 0, F.lit("NV")).otherwise(F.col("year").cast("string")).alias("jaar"),
        F.when(k % 2 == 0, F.lit("  ")).otherwise(F.col("grape")).alias("druif"),
        F.when(k % 10 != 0, F.concat(F.initcap("country"), F.lit("  "), F.col("region"))).alias("regio"),
        F.col("country").alias("land"), F.when(k % 14 != 0, F.col("style")).alias("style"), F.col("color").alias("color"),
        F.when(k % 4 != 0, F.array(F.upper("tag"), F.lit("Nieuw"))).alias("tags"),
        F.struct(F.when(k % 5 == 0, F.lit(0)).otherwise(F.col("price_eur_low").cast("int")).alias("price_eur_low"),
                 F.col("price_eur_high").cast("int").alias("price_eur_high"),
                 "classification", "producer_fame", "production", "rarity_nl", F.when(k % 2 == 0, F.col("vintage_quality")).alias("vintage_quality"),
                 "large_format", F.when(k % 3 == 0, F.col("iconic")).alias("iconic")).alias("signals"),
    )
    parsed = payload.ingest(i.select("item_id", F.to_json(raw).alias("doc")), "doc")
    return parsed.select(
        "item_id", "item_key", "name", "maker", F.col("year").cast("long").alias("year"), "grapes", "region", "country", "style",
        "color", F.array_join("tags", ",").alias("tags"), F.col("price_eur_low").cast("long").alias("low"),
        F.col("price_eur_high").cast("long").alias("high"), "classification", "producer_fame", "production", "rarity_nl", "large_format",
        "iconic", "vintage_quality",
    )


def catalogue_stored(spark, sf_dir):
    """The rule catalogue as a file in storage, read with its own schema, and what each slot's rule asks for."""
    folder = sinks.shared_folder(spark, "catalogue")
    spark.createDataFrame([(json.dumps(catalogue.packaged("sets"), ensure_ascii=False),)], "value string").coalesce(1).write.text(folder)
    fills = progress.slot_fill(_catalogue_items(spark, sf_dir), catalogue.slots(catalogue.read_sets(spark, folder)))
    return fills.groupBy("set_id", F.col("position").cast("long").alias("position")).agg(F.count(F.lit(1)).alias("items"))


def _catalogue_items(spark, sf_dir):
    return Data(spark, sf_dir).item.select(
        "item_id", "name", "maker", "region", "country", "appellation", "grape", "style", F.nullif("color", F.lit("")).alias("color"),
        F.array("tag").alias("tags"))


def catalogue_slots(spark, sf_dir):
    """Slots of the rule catalogue with the number of items from the set's own country."""
    d = Data(spark, sf_dir)
    slots = catalogue.slots(catalogue.sets_frame(spark, catalogue.packaged("sets")))
    per_country = d.item.groupBy("country").agg(F.count(F.lit(1)).alias("items"))
    return slots.join(per_country, F.col("set_country") == F.col("country"), "left").select(
        "set_id", F.col("position").cast("long").alias("position"), "slot", F.col("difficulty").cast("long").alias("difficulty"),
        "unlock", "secret", "always", F.size(F.col("rule.app")).cast("long").alias("apps"),
        F.coalesce("items", F.lit(0)).alias("items"),
    )


def usage_append(spark, sf_dir):
    d = Data(spark, sf_dir)
    folder = sinks.shared_folder(spark, "usage-log")
    for half in (0, 1):
        sinks.append_log(d.usage.where(F.col("usage_id") % 2 == half), folder, "created_at")
    return sinks.read_log(spark, folder, d.usage.schema).groupBy("month", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("tokens_in"))


def upsert_latest(spark, sf_dir):
    e = Data(spark, sf_dir).attempt
    cols = ["user_id", "item_id", "event_type", "ts", "event_id"]
    keys, order = ["user_id", "item_id"], ["ts", "event_id"]
    base = fact_ops.latest(e.where("event_type = 'signup'").select(cols), keys, order)
    return fact_ops.upsert_latest(base, e.where("event_type <> 'signup'").select(cols), keys, order).select(
        "user_id", "item_id", "event_type", "event_id")


def upsert_counter(spark, sf_dir):
    e = Data(spark, sf_dir).events
    monthly = e.groupBy(dates.local_month(F.col("ts")).alias("month"), "event_type").agg(F.count(F.lit(1)).alias("calls"))
    return fact_ops.upsert_counter(
        monthly.where("event_type <> 'view'").select("month", "calls"), monthly.where("event_type = 'view'").select("month", "calls"),
        ["month"], "calls")


def insert_if_absent(spark, sf_dir):
    e = Data(spark, sf_dir).attempt
    cols = ["user_id", "item_id", "event_id"]
    base = e.where("event_type = 'purchase'").groupBy("user_id", "item_id").agg(F.max("event_id").alias("event_id"))
    return fact_ops.insert_if_absent(base, e.where("event_type = 'click'").select(cols), ["user_id", "item_id"], ["event_id"])


def replace_or_delete(spark, sf_dir):
    """Page items per (user, page): each event replaces the page, an 'error' event empties it."""
    e = Data(spark, sf_dir).attempt.select(
        "user_id", (F.col("item_id") % 20).alias("page"), "ts", "event_id",
        F.when(F.col("event_type") == "error", F.array().cast("array<bigint>")).otherwise(
            F.sequence(F.lit(1).cast("bigint"), F.col("item_id") % 5 + 1)).alias("items"))
    keys, order = ["user_id", "page"], ["ts", "event_id"]
    base = fact_ops.latest(e.where("event_id % 2 = 0"), keys, order)
    saved = fact_ops.replace_or_delete(base, e.where("event_id % 2 = 1"), keys, order, "items")
    return saved.select("user_id", "page", "event_id", F.size("items").cast("long").alias("n"))


def _listing(d: Data):
    return d.fact.select(
        F.concat_ws("", F.col("user_id"), F.lit("/"), F.col("item_id"),
                    F.when((F.col("user_id") + F.col("item_id")) % 3 == 0, ".label.jpg").when(
                        (F.col("user_id") + F.col("item_id")) % 3 == 1, ".jpg").otherwise(".png")).alias("path"),
        F.when(F.col("item_id") % 4 != 0, F.col("created_at")).alias("updated_at"), "created_at")


def newest_object(spark, sf_dir):
    return objects.newest_object(_listing(Data(spark, sf_dir)))


def move_plan(spark, sf_dir):
    d = Data(spark, sf_dir)
    merges = d.item.where("item_id % 40 = 0").select(
        F.col("item_id").alias("kept_id"), (F.col("item_id") + 7).alias("dropped_id"), (F.col("item_id") % 120 == 0).alias("moved"))
    return objects.move_plan(merges, d.fact, _listing(d))


def validate_rows(spark, sf_dir):
    d = Data(spark, sf_dir)
    c = d.conversations.select(
        F.lit("feedback").alias("kind"), F.concat_ws("-", "conv_id", "turn").alias("id"),
        validate.first_reason(validate.feedback_rules(
            F.when(F.col("role") == "user", F.lit("idee")).when(F.col("turn") % 3 == 1, F.lit("bug")).otherwise(F.col("role")),
            F.col("text"))).alias("reason"))
    k = F.col("c_custkey")
    p = d.customer.select(
        F.lit("profile").alias("kind"), k.cast("string").alias("id"),
        validate.first_reason(
            validate.profile_rules(
                F.when(k % 9 == 0, F.lit("paars")).otherwise(F.lit("groen")), F.when(k % 10 == 0, F.lit("rood")).otherwise(F.lit("creme")),
                F.when(k % 4 == 0, F.col("c_name")).when(k % 4 == 1, F.concat(F.lit("Zoë "), F.col("c_mktsegment")))
                .when(k % 4 == 2, F.concat("c_mktsegment", "c_mktsegment", "c_mktsegment")))
            + validate.rank_rules((k % 12).cast("int"))
            + validate.tier_rules(F.when(k % 7 == 0, F.lit("icon")).otherwise(F.lit("rare")))
            + validate.page_rules(F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("set:"), F.col("c_name"))), (k % 43).cast("int"))
            + validate.item_rules(F.when(k % 13 == 0, F.lit("  ")).otherwise(F.col("c_name")), F.col("c_mktsegment"))).alias("reason"))
    return c.unionByName(p)


def gate_status(spark, sf_dir):
    e = Data(spark, sf_dir).events
    k = F.col("event_id")
    return e.select("event_id", validate.gate_status(
        F.col("event_type") != "error", F.when(k % 6 == 0, F.lit(False)).when(k % 6 == 1, F.lit(None)).otherwise(F.lit(True)),
        F.when(k % 9 != 0, F.col("value") / 100), F.when(k % 8 != 0, F.col("event_type")), F.col("user_id") % 10 == 0).alias("status"))


def _search(query):
    def run(spark, sf_dir):
        d = Data(spark, sf_dir)
        return matching.search(d.item, d.fact, query).select("item_id", "name", "maker")

    return run


def entity_regex(spark, sf_dir):
    return matching.classify(Data(spark, sf_dir).item, catalogue.packaged("icon_rules")).where("rule is not null").select(
        "item_id", F.col("rule").cast("long").alias("rule"))


def pattern_override(spark, sf_dir):
    d = Data(spark, sf_dir)
    fixed = matching.override(d.item, "ROD", "hot", "tier_override", "superrare", maker="brand#1").select(
        "item_id", F.col("tier_override").alias("tier"), "hit")
    # facts follow the item's tier; a corrected item's art flag is taken back
    followed = fact_ops.follow_item_tier(d.fact, fixed).join(fixed.select("item_id", "hit"), "item_id", "left")
    return followed.select("fact_id", "tier", (F.col("full_art") & ~F.coalesce("hit", F.lit(False))).alias("full_art"), "changed")


QUERIES = {f.__name__: f for f in (
    norm_name, natural_key, stable_bucket, slug, year_extract, price_band, price_text, display_name, text_cap, local_day,
    season_flag, blend_hex, squash_has, clean_elements, style_elements, merge_signals, merge_signals_open, ingest_payload, catalogue_slots, catalogue_stored,
    usage_append, upsert_latest, upsert_counter, insert_if_absent, replace_or_delete, newest_object, move_plan, validate_rows,
    gate_status, entity_regex, pattern_override)}
QUERIES["search_items"] = _search("Anvil")
QUERIES["search_owned"] = _search(None)


def _folded_sql(expr: str) -> str:
    """Letters of `expr` one by one, each looked up in a list of accents; ligatures are two letters."""
    known = dict(reversed([*zip(text.ACCENTS, text.PLAIN), *text.LIGATURES.items()]))
    pairs = ", ".join(f"'{a.replace(chr(39), chr(39) * 2)}': '{b}'" for a, b in known.items())
    return f"list_transform(string_split(lower(coalesce({expr}, '')), ''), lambda c: coalesce(map {{{pairs}}}[c], c)).array_to_string('')"


def norm_sql(expr: str) -> str:
    """Words of the folded text that are neither years nor fillers."""
    fillers = ", ".join(f"'{w}'" for w in text.STOPWORDS)
    words = f"regexp_split_to_array(regexp_replace({_folded_sql(expr)}, '\\b(18|19|20)\\d\\d\\b', ' ', 'g'), '[^a-z0-9]+')"
    return f"array_to_string(list_filter({words}, lambda w: w <> '' and w not in ({fillers})), ' ')"


def _squash_sql(expr: str) -> str:
    accents = text.ACCENTS.replace("'", "''")
    return f"""regexp_replace(replace(replace(translate(lower({expr}), '{accents}', '{text.PLAIN}'), 'œ', 'oe'), 'æ', 'ae'), '[^a-z0-9]+', '', 'g')"""


def _slots_sql() -> str:
    rows = []
    q = lambda v: "null" if v is None else "'" + str(v).replace("'", "''") + "'"
    for s in catalogue.packaged("sets"):
        for i, slot in enumerate(s["slots"]):
            r = slot["rule"]
            arr = lambda n: "null::varchar[]" if r.get(n) is None else "[" + ", ".join(q(x) for x in r[n]) + "]"  # noqa: E731, B023
            rows.append(f"({q(s['id'])}, {q(s.get('country'))}, {s['part']}, {q(s.get('unlock'))}, {str(s.get('secret', False)).lower()}, "
                        f"{str(s.get('always', False)).lower()}, {i}, {q(slot['slot'])}, {slot['difficulty']}, {q(r.get('region'))}, {arr('app')}, "
                        f"{q(r.get('grape'))}, {q(r.get('country'))}, {q(r.get('style'))}, {q(r.get('color'))}, {q(r.get('tag'))}, {q(r.get('key'))}, "
                        f"{arr('has')}, {q(slot['guide']['text'])}, {q(slot['guide']['price'])}, {q(slot['guide'].get('tip'))})")
    return ("slots(set_id, set_country, part, unlock, secret, always, position, slot, difficulty, r_region, r_app, r_grape, r_country, "
            "r_style, r_color, r_tag, r_key, r_has, guide, price, tip) as (values " + ",\n".join(rows) + ")")


SLOTS_SQL = _slots_sql()


def _icon_sql() -> str:
    out = []
    for r in catalogue.packaged("icon_rules"):
        pattern = "(?i)" + r["pattern"].replace("'", "''")
        country = "" if r["legend"] else f" and country = '{r['country']}'"
        out.append(f"when regexp_matches(concat_ws(' ', maker, name), '{pattern}'){country} then {r['priority']}")
    return "case " + " ".join(out) + " end"


ICON_SQL = _icon_sql()
_LISTING_SQL = """listing as (select user_id || '/' || item_id || case (user_id + item_id) % 3 when 0 then '.label.jpg' when 1 then '.jpg'
  else '.png' end as path, user_id, item_id, (user_id + item_id) % 3 as m, created_at from fact)"""
_HEXPART = "('0x' || substr({c}, {p}, 2))::int"


def _blend_part(p: int) -> str:
    x, y = _HEXPART.format(c="a", p=p), _HEXPART.format(c="b", p=p)
    return f"printf('%02x', cast(floor(greatest(0.0, least(255.0, {x} + ({y} - {x}) * t)) + 0.5) as bigint))"


CHECKS = {
    "norm_name": f"""select kind, id, md5(n) as norm_md5, length(n) as norm_chars from (
      select 'document' as kind, doc_id as id, {norm_sql('text')} as n from documents union all
      select 'part', p_partkey, {norm_sql("'Château d''' || p_name || ' 1998 ' || p_brand")} from part)""",
    "natural_key": """select p_partkey, coalesce(case when p_partkey % 9 <> 0 then lower(p_brand) end, '') || '|' || lower(p_name) as item_key from part""",
    "stable_bucket": oracle("""select item_id, ('0x' || substr(md5(lower(trim(maker)) || '|' || lower(trim(name))), 1, 8))::bigint % 4 as bucket from item""", "item"),
    "slug": """select c_custkey, case when c_custkey % 8 in (0, 1) then 'overig' else lower(c_mktsegment) || '-' ||
      regexp_replace(lower(c_name), '\\s+', '-', 'g') end as slug from customer""",
    "year_extract": """select page_id, y as year_found, case when y between 1800 and 2025 then y end as year_ok,
      case when regexp_full_match(right(url, 4), '[0-9]{4}') then right(url, 4)::bigint end as url_year
      from (select page_id, url, nullif(regexp_extract(html, '(18|19|20)[0-9][0-9]'), '')::bigint as y from pages)""",
    "price_band": oracle("""select item_id, cast(case when p < 12 then 0 when p < 20 then 0.5 when p < 35 then 1 when p < 60 then 1.5
      when p < 100 then 2 when p < 200 then 2.5 when p < 400 then 3 when p >= 400 then 3.5 end as double) as points,
      case when p is not null then repeat('€', 1 + (p >= 12)::int + (p >= 25)::int + (p >= 60)::int + (p >= 200)::int) end as symbols
      from (select item_id, (coalesce(price_eur_low, price_eur_high) + coalesce(price_eur_high, price_eur_low)) / 2 as p from item)""", "item"),
    "price_text": """select p_partkey, cast(case p_partkey % 5 when 4 then null when 2 then p_size * 1000 else p_size end as bigint) as low,
      cast(case p_partkey % 5 when 0 then p_size * 2 when 3 then p_size * 10 + 9 end as bigint) as high,
      p_partkey % 5 in (1, 2) as open_end from part""",
    "display_name": oracle("""select user_id, coalesce(nullif(trim(display_name), ''),
      upper(left(mail, 1)) || substr(split_part(split_part(mail, '@', 1), '.', 1), 2), 'Wijnvriend') as name from users""", "users"),
    "text_cap": "select conv_id, turn, " + ", ".join(f"left(nullif(trim(text), ''), {n}) as first_{n}" for n in (40, 140, 300)) + " from conversations",
    "local_day": """select cast(l::date as varchar) as day, strftime(l, '%Y-%m') as month, count(*) as n
      from (select (ts at time zone 'UTC') at time zone 'Europe/Amsterdam' as l from events) group by all""",
    "season_flag": oracle("""select month((created_at at time zone 'UTC') at time zone 'Europe/Amsterdam') in (9, 10, 11) as harvest,
      coalesce(2024 - year >= case when color = 'wit' then 10 else 15 end, false) as old, count(*) as n
      from fact join item using (item_id) group by all""".replace("created_at at", "fact.created_at at"), "item", "fact"),
    "blend_hex": f"""select c_custkey, '#' || {_blend_part(1)} || {_blend_part(3)} || {_blend_part(5)} as color from (
      select c_custkey, substr(md5(c_name), 1, 6) as a, substr(md5(c_mktsegment), 7, 6) as b, (c_custkey % 13) / 12.0::double as t from customer)""",
    "squash_has": f"""select doc_id, length(s) as chars, contains(s, 'theonth') or contains(s, 'reauion') or contains(s, 'eauxment') as hit
      from (select doc_id, {_squash_sql('text')} as s from documents)""",
    "clean_elements": """with e as (select p_partkey, p_name, unnest(range(0, least(24, case p_partkey % 7 when 6 then 27 else p_partkey % 7 end))) as pos from part),
      f as (select *, least(pos, 4) as i from e),
      g as (select p_partkey, pos, i, case i % 4 when 0 then 'text' when 1 then 'art' when 2 then 'lines' else 'rule' end as t,
        left(p_name || ' ' || repeat('z', 40), 48) as s,
        floor((p_partkey % 100 + 0.25 * (i + 1))::double * 10 + 0.5) / 10 as x,
        case p_partkey % 3 when 0 then 'metal' when 2 then '#' || left(md5(p_name), 6) end as color,
        case when p_partkey % 2 = i % 2 then 'true' end as up from f where p_partkey % 5 <> i),
      k as (select p_partkey, count(*) as n, string_agg(concat_ws('/', t, right(s, 4), length(s), printf('%.1f', x), color, up), ';' order by pos) as els from g group by 1)
      select part.p_partkey as item_id, coalesce(n, 0) as kept, els from part left join k using (p_partkey)""",
    "style_elements": """with e as (select p_partkey, unnest(range(0, case p_partkey % 7 when 6 then 27 else p_partkey % 7 end)) as pos from part),
      g as (select p_partkey, pos, case when p_partkey % 5 = least(pos, 4) then 'bogus' else case least(pos, 4) % 4 when 0 then 'text' when 1 then 'art' when 2 then 'lines' else 'rule' end end as t from e)
      select t, count(*) as n, count(distinct p_partkey) as items, max(pos) as last_position from g group by 1""",
    "merge_signals": oracle("""select item_id, cast(case when item_id % 4 = 0 then item_id % 90 else price_eur_low end as double) as price_eur_low,
      cast(case when item_id % 4 = 0 then item_id % 90 + 5 else price_eur_high end as double) as price_eur_high,
      cast(case when item_id % 3 = 0 then item_id % 12 else nl_shops end as bigint) as nl_shops, cast(critic_max as bigint) as critic_max,
      case when item_id % 6 = 0 then 'gewoon' else rarity_nl end as rarity_nl from item""", "item"),
    "merge_signals_open": oracle("""select item_id, cast(case when item_id % 5 <> 0 and item_id % 3 = 0 then item_id % 12 else nl_shops end as bigint) as nl_shops,
      cast(critic_max as bigint) as critic_max, rarity_nl, case when item_id % 5 <> 0 and item_id % 2 = 0 then item_id % 11 else item_id % 7 end as shelf,
      item_id % 3 as blend_share, case when item_id % 5 <> 0 then item_id % 4 = 0 end as seen from item""", "item"),
    "ingest_payload": oracle("""with n as (select *, list_aggregate(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') as cap,
        upper(country[1]) || lower(country[2:]) as c1 from item)
      select item_id, case when item_id % 11 = 0 then '' else lower(trim(maker)) end || '|' || name as item_key, cap as name,
      case when item_id % 11 = 0 then '' else trim(maker) end as maker, case when item_id % 13 = 0 then null else cast(year as bigint) end as year,
      case when item_id % 2 = 0 then null else grape end as grapes,
      case when item_id % 10 = 0 then 'overig' else regexp_replace(lower(country), '\\s+', '-', 'g') || '-' || lower(region) end as region,
      country, case when item_id % 14 = 0 then 'stil' else style end as style, nullif(color, '') as color, case when item_id % 4 = 0 then '' else tag || ',nieuw' end as tags,
      case when item_id % 5 = 0 then null else cast(price_eur_low as bigint) end as low, cast(price_eur_high as bigint) as high,
      classification, producer_fame, production, rarity_nl, large_format, item_id % 3 = 0 and iconic as iconic,
      case when item_id % 2 = 0 and vintage_quality is not null then vintage_quality else 'onbekend' end as vintage_quality from n""", "item"),
    "catalogue_slots": oracle(f"""with {SLOTS_SQL} select set_id, cast(position as bigint) as position, slot, cast(difficulty as bigint) as difficulty,
      unlock, secret, always, cast(len(r_app) as bigint) as apps, (select count(*) from item where country = set_country) as items from slots""", "item"),
    "usage_append": oracle("""select strftime(created_at, '%Y-%m') as month, kind, count(*) as n, cast(sum(input_tokens) as bigint) as tokens_in from usage group by all""", "usage"),
    "upsert_latest": oracle("""select user_id, item_id, event_type, event_id from attempt
      qualify row_number() over (partition by user_id, item_id order by ts desc, event_id desc) = 1""", "attempt"),
    "upsert_counter": """select strftime((ts at time zone 'UTC') at time zone 'Europe/Amsterdam', '%Y-%m') as month, count(*) as calls from events group by 1""",
    "insert_if_absent": oracle("""select user_id, item_id, case when max(case when event_type = 'purchase' then event_id end) is not null
      then max(case when event_type = 'purchase' then event_id end) else min(event_id) end as event_id
      from attempt where event_type in ('purchase', 'click') group by all""", "attempt"),
    "replace_or_delete": oracle("""select user_id, page, event_id, item_id % 5 + 1 as n from (
      select *, item_id % 20 as page from attempt qualify row_number() over (partition by user_id, item_id % 20 order by ts desc, event_id desc) = 1)
      where event_type <> 'error'""", "attempt"),
    "newest_object": oracle(f"""with {_LISTING_SQL} select cast(item_id as varchar) as item, path from listing where m < 2
      qualify row_number() over (partition by item_id order by m, created_at desc, path desc) = 1""", "fact"),
    "move_plan": oracle(f"""with {_LISTING_SQL} select user_id || '/' || (item_id + 7) || '.label.jpg' as source, user_id || '/' || item_id || '.label.jpg' as target
      from fact where item_id % 40 = 0 and item_id % 120 <> 0 and item_id in (select item_id from item)
      and user_id || '/' || item_id || '.label.jpg' not in (select path from listing)""", "item", "fact"),
    "validate_rows": """select 'feedback' as kind, conv_id || '-' || turn as id,
      case when not (role = 'user' or turn % 3 = 1) and role not in ('bug','idee','compliment','anders') then 'bad_kind'
        when length(text) not between 1 and 2000 then 'bad_message' end as reason from conversations union all
      select 'profile', cast(c_custkey as varchar), case when c_custkey % 9 = 0 then 'invalid_cover' when c_custkey % 10 = 0 then 'invalid_pages'
        when c_custkey % 4 = 0 or (c_custkey % 4 = 1 and length('Zoë ' || c_mktsegment) > 24) or (c_custkey % 4 = 2 and length(c_mktsegment) * 3 > 24) then 'invalid_name'
        when c_custkey % 12 not between 1 and 10 then 'bad_rank' when c_custkey % 7 = 0 then 'bad_tier' when c_custkey % 11 = 0 then 'invalid_page'
        when c_custkey % 43 > 40 then 'invalid_items' when c_custkey % 13 = 0 then 'invalid_wine' end from customer""",
    "gate_status": """select event_id, case when event_type <> 'error' and event_id % 6 = 0 and user_id % 10 <> 0 then 'not_real'
      when event_type = 'error' or event_id % 9 = 0 or value / 100 < 0.5 or event_id % 8 = 0 then 'not_recognized' else 'ok' end as status from events""",
    "search_items": oracle("""select item_id, name, maker from item where name ilike '%anvil%' or maker ilike '%anvil%'
      order by created_at desc, item_id desc limit 60""", "item"),
    "search_owned": oracle("""select item_id, name, maker from item where item_id in (select item_id from fact)
      order by created_at desc, item_id desc limit 60""", "item", "fact"),
    "entity_regex": oracle(f"select item_id, rule from (select item_id, cast({ICON_SQL} as bigint) as rule from item) where rule is not null", "item"),
    "pattern_override": oracle("""with n as (select item_id, case when name ilike '%rod%' and name not ilike '%hot%' and maker ilike '%brand#1%' then 'superrare' else tier_override end as new_tier,
        name ilike '%rod%' and name not ilike '%hot%' and maker ilike '%brand#1%' as hit from item)
      select fact_id, coalesce(new_tier, tier) as tier, full_art and not coalesce(hit, false) as full_art, coalesce(new_tier, tier) is distinct from tier as changed from fact left join n using (item_id)""", "item", "fact"),
}
