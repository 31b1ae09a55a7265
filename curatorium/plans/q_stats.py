"""Joins, aggregates, windows and rankings on the bound tables, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatorium.functions.text import blank_to_null
from curatorium.operators import facts as fact_ops, kpi, ranking
from curatorium.plans.bindings import AS_OF, Data, oracle
from curatorium.sources.sinks import stored


def join_inner(spark, sf_dir):
    d = Data(spark, sf_dir)
    return d.fact.select("fact_id", "item_id", "tier").join(d.item.select("item_id", "name", "country"), "item_id").select(
        "fact_id", "name", "country", "tier")


def join_left(spark, sf_dir):
    """Messages with their writer, falling back from the chosen name to the mail's local part."""
    d = Data(spark, sf_dir)
    messages = d.conversations.select("conv_id", "turn", (F.col("conv_id") * 3).alias("user_id"))
    who = F.coalesce(blank_to_null(F.col("display_name")), F.split_part("mail", F.lit("@"), F.lit(1)))
    return messages.join(d.users.select("user_id", "display_name", "mail"), "user_id", "left").select(
        "conv_id", "turn", who.alias("who"))


def owned_items(spark, sf_dir):
    d = Data(spark, sf_dir)
    return d.item.select("item_id", "name").join(d.fact.select("item_id"), "item_id", "left_semi")


def unowned_items(spark, sf_dir):
    d = Data(spark, sf_dir)
    return d.item.select("item_id", "name").join(d.fact.select("item_id"), "item_id", "left_anti")


def daily_spine(spark, sf_dir):
    a = Data(spark, sf_dir).attempt
    out = kpi.daily_spine(AS_OF, kpi.SPINE_DAYS, {"scans": a.where("event_type = 'click'"), "cards": a.where("event_type = 'signup'")})
    return out.withColumn("day", F.col("day").cast("string"))


def count_by(spark, sf_dir):
    return Data(spark, sf_dir).fact.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def kpi_row(spark, sf_dir):
    d = Data(spark, sf_dir)
    feedback = d.conversations.select((F.col("turn") % 2 == 0).alias("handled"))
    facts = d.fact.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 8215 DAYS"))
    return kpi.kpi_row(d.users, d.attempt.where("event_type = 'click'"), facts, d.item, d.edge, feedback, AS_OF)


def active_approx(spark, sf_dir):
    """Sketched distinct counts, for when exactness is not worth a shuffle of everybody, held against the exact ones."""
    a = Data(spark, sf_dir).attempt
    # two aggregates: in one, the planner would keep a sketch for every person of a type
    about = a.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("about")).withColumnRenamed("event_type", "_type")
    both = a.groupBy("event_type").agg(F.countDistinct("user_id").alias("users")).join(about, F.col("event_type").eqNullSafe(F.col("_type")))
    return both.select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= 0.06 * F.col("users")).alias("close"))


def active_sketched(spark, sf_dir):
    """Trailing windows of 7 and 30 days from a stored table of daily sketches, with the exact numbers beside them."""
    sketches = stored(kpi.daily_sketches(Data(spark, sf_dir).attempt), "daily-sketches")
    about = kpi.active_from_sketches(sketches).withColumn("day", F.col("day").cast("string"))
    both = rolling_active(spark, sf_dir).join(about, "day")
    close = {f"close{w}": F.abs(F.col(f"about{w}") - F.col(f"active{w}")) <= 0.08 * F.col(f"active{w}") + 1 for w in kpi.ACTIVE_WINDOWS}
    return both.select("day", "active7", "active30", *[c.alias(n) for n, c in close.items()])


def tier_map(spark, sf_dir):
    return kpi.tier_map(Data(spark, sf_dir).fact, ["user_id"]).select("user_id", F.to_json("tiers").alias("tiers"))


def cost_month(spark, sf_dir):
    return kpi.cost_by_kind(Data(spark, sf_dir).usage, "2024-01-20 00:00:00").withColumn("usd", F.col("usd").cast("double"))


def nested_album(spark, sf_dir):
    """Album pages as a friend sees them: no notes, only of people who have a friend."""
    d = Data(spark, sf_dir)
    neighbours = fact_ops.both_ends(d.edge).select("user_id").distinct()
    visible = d.fact.join(neighbours, "user_id", "left_semi").drop("memo")
    card = F.struct(F.col("item_id").alias("id"), F.col("tier").alias("tier"), F.col("bottles").alias("bottles"), F.col("full_art").alias("art"))
    return ranking.album_pages(visible, card).select("user_id", "page", F.to_json("cards").alias("cards"))


def names_per_tier(spark, sf_dir):
    out = kpi.names_per_tier(Data(spark, sf_dir).catalog)
    return out.select("tier", F.col("tier_order").cast("long").alias("tier_order"), "line", "n", "names")


def host_count(spark, sf_dir):
    p = Data(spark, sf_dir).pages.withColumn("group_id", F.col("page_id") % 90)
    return kpi.host_count(p, ["group_id"], "url", ".net", ["tiontion.example.com", "thther.example.org"]).withColumn(
        "shops", F.col("shops").cast("long"))


def country_heat(spark, sf_dir):
    d = Data(spark, sf_dir)
    return kpi.country_heat(d.fact.join(d.item.select("item_id", "country"), "item_id")).withColumn(
        "opacity", F.round("opacity", 6))


def rolling_active(spark, sf_dir):
    a = Data(spark, sf_dir).attempt
    week, month = (kpi.rolling_active(a, n, f"active{n}") for n in kpi.ACTIVE_WINDOWS)
    return week.join(month, "day").select(F.col("day").cast("string").alias("day"), "active7", "active30")


def compact_ranks(spark, sf_dir):
    return ranking.compact_ranks(Data(spark, sf_dir).fact).select("fact_id", F.col("new_rank").cast("long").alias("new_rank"))


def stack_top(spark, sf_dir):
    d = Data(spark, sf_dir)
    placed = d.fact.join(d.item.select("item_id", "region", "country"), "item_id")
    return ranking.stack_top(placed, ["user_id", "country"]).select("user_id", "country", "top_fact", "stack_size")


def latest_value(spark, sf_dir):
    d = Data(spark, sf_dir)
    bottles = d.orders.join(d.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("o_orderdate").alias("ts"), "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") % 3 != 0, 1980 + F.col("l_orderkey") % 40).alias("year"))
    return ranking.latest_value(bottles, ["user_id", "item_id"], "year", ["ts", "l_orderkey", "l_linenumber"])


def milestones(spark, sf_dir):
    d = Data(spark, sf_dir)
    return ranking.milestones(d.fact, d.tasks("orders", "lineitem")).select(
        "user_id", F.col("n").cast("long").alias("n"), "item_id", F.date_format("created_at", "yyyy-MM-dd").alias("reached"))


def newest_items(spark, sf_dir):
    return ranking.newest(Data(spark, sf_dir).item).select("item_id", "name")


def batch_pages(spark, sf_dir):
    return ranking.batch_pages(Data(spark, sf_dir).catalog.select("item_id", "created_at")).select("item_id", "position", "batch").withColumn(
        "position", F.col("position").cast("long"))


def neighbours(spark, sf_dir):
    return fact_ops.both_ends(Data(spark, sf_dir).edge).select("user_id", "friend_id")


QUERIES = {f.__name__: f for f in (
    join_inner, join_left, owned_items, unowned_items, daily_spine, count_by, kpi_row, active_approx, active_sketched, tier_map, cost_month,
    nested_album, names_per_tier, host_count, country_heat, rolling_active, compact_ranks, stack_top, latest_value, milestones,
    newest_items, batch_pages, neighbours)}

_ROLLING = oracle("""with d as (select d::date as day from (select min(ts)::date as lo, max(ts)::date as hi from attempt), generate_series(lo, hi, interval 1 day) g(d)), ud as (select distinct user_id, ts::date as day from attempt)
      select cast(d.day as varchar) as day, count(distinct case when ud.day > d.day - 7 then user_id end) as active7, count(distinct user_id) as active30
      from d left join ud on ud.day <= d.day and ud.day > d.day - 30 group by 1""", "attempt")

CHECKS = {
    "join_inner": oracle("select fact_id, name, country, tier from fact join item using (item_id)", "item", "fact"),
    "join_left": oracle("""select conv_id, turn, coalesce(nullif(trim(display_name), ''), split_part(mail, '@', 1)) as who
      from conversations left join users on user_id = conv_id * 3""", "users"),
    "owned_items": oracle("select item_id, name from item where exists (select 1 from fact where fact.item_id = item.item_id)", "item", "fact"),
    "unowned_items": oracle("select item_id, name from item where not exists (select 1 from fact where fact.item_id = item.item_id)", "item", "fact"),
    "daily_spine": oracle(f"""select cast(d::date as varchar) as day,
      (select count(*) from attempt where event_type = 'click' and ts::date = d::date) as scans,
      (select count(*) from attempt where event_type = 'signup' and ts::date = d::date) as cards
      from generate_series(date '{AS_OF[:10]}' - interval 13 days, date '{AS_OF[:10]}', interval 1 day) g(d)""", "attempt"),
    "count_by": oracle("select tier, count(*) as n from fact group by 1", "fact"),
    "kpi_row": oracle(f"""with f as (select item_id, created_at + interval 8215 days as created_at from fact), n as (select timestamp '{AS_OF}' as t)
      select (select count(*) from users) as users, (select count(*) from users, n where created_at > t - interval 7 days) as new7,
      (select count(distinct user_id) from attempt, n where event_type = 'click' and ts > t - interval 7 days) as active7,
      (select count(distinct user_id) from attempt, n where event_type = 'click' and ts > t - interval 30 days) as active30,
      (select count(*) from attempt, n where event_type = 'click' and ts >= date_trunc('month', t)) as month_recognitions,
      (select count(*) from f) as cards, (select count(*) from f, n where created_at > t - interval 7 days) as cards7,
      (select count(*) from item where item_id in (select item_id from f)) as items,
      (select count(*) from item, n where item_id in (select item_id from f) and created_at > t - interval 7 days) as items7,
      (select count(*) from edge) as friends, (select count(*) from conversations where turn % 2 <> 0) as feedback_open""",
                      "item", "fact", "users", "edge", "attempt"),
    "tier_map": oracle("""select user_id, '{' || string_agg('"' || tier || '":' || n, ',' order by tier) || '}' as tiers
      from (select user_id, tier, count(*) as n from fact group by all) group by 1""", "fact"),
    "cost_month": oracle("""select kind, count(*) as n, cast(round(sum((input_tokens * i + output_tokens * o)::decimal(20,0) / 1000000 + web_searches * 0.01), 2) as double) as usd
      from (select *, case when model ilike '%fable%' or model ilike '%mythos%' then 10 when model ilike '%opus%' then 4 when model ilike '%sonnet%' then 2 else 1 end as i,
        case when model ilike '%fable%' or model ilike '%mythos%' then 50 when model ilike '%opus%' then 20 when model ilike '%sonnet%' then 10 else 5 end as o from usage)
      where created_at >= timestamp '2024-01-01' group by 1""", "usage"),
    "nested_album": oracle("""with n as (select *, row_number() over (partition by user_id order by created_at, fact_id) - 1 as i from fact
        where user_id in (select a from edge union select b from edge))
      select user_id, cast(floor(i / 9) as bigint) as page, '[' || string_agg('{"id":' || item_id || ',"tier":"' || tier || '","bottles":' || bottles || ',"art":' || full_art || '}', ',' order by i) || ']' as cards
      from n group by all""", "fact", "edge"),
    "names_per_tier": oracle("""with n as (select coalesce(tier, '(nog niet beoordeeld)') as t, name, tier_reason, item_id from catalog),
      p as (select *, row_number() over (partition by t order by name, item_id) - 1 as i from n)
      select t as tier, cast(list_position(['common','rare','superrare','ultra','icon','(nog niet beoordeeld)'], t) as bigint) as tier_order,
      cast(floor(i / 50) as bigint) as line, count(*) as n, string_agg(name || ' (' || coalesce(tier_reason, '-') || ')', '  |  ' order by i) as names from p group by all""", "catalog"),
    "host_count": """with h as (select page_id % 90 as group_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') as host from pages),
      c as (select *, host in ('tiontion.example.com', 'thther.example.org') or host like '%.tiontion.example.com' or host like '%.thther.example.org' as chain from h)
      select group_id, cast(case when bool_or(chain) then 10 else nullif(count(distinct case when host like '%.net' then host end), 0) end as bigint) as shops from c group by 1""",
    "country_heat": oracle("""with c as (select country, count(*) as n from fact join item using (item_id) group by 1)
      select country, n, round(0.6::double + 0.4::double * least(1.0::double, n / greatest(4, (select max(n) from c))), 6) as opacity from c""", "item", "fact"),
    "active_approx": oracle("select event_type, count(distinct user_id) as users, true as close from attempt group by 1", "attempt"),
    "active_sketched": f"select *, true as close7, true as close30 from ({_ROLLING}) q",
    "rolling_active": _ROLLING,
    "compact_ranks": oracle("""select fact_id, case when r <= 10 then r end as new_rank from (select fact_id, row_number() over (partition by user_id order by fav_rank, fact_id) as r
      from fact where fav_rank is not null)""", "fact"),
    "stack_top": oracle("""select user_id, country, fact_id as top_fact, stack_size from (select *, count(*) over (partition by user_id, country) as stack_size,
      row_number() over (partition by user_id, country order by top_at desc nulls last, list_position(['common','rare','superrare','ultra','icon'], tier) desc, fact.created_at, fact_id) as r
      from fact join item using (item_id)) where r = 1""", "item", "fact"),
    "latest_value": """select o_custkey as user_id, l_partkey as item_id, cast((list(1980 + l_orderkey % 40 order by o_orderdate desc, l_orderkey desc, l_linenumber desc)
      filter (l_linenumber % 3 <> 0))[1] as bigint) as year from orders join lineitem on o_orderkey = l_orderkey group by all""",
    "milestones": oracle("""select user_id, n, item_id, strftime(created_at, '%Y-%m-%d') as reached from (select *, row_number() over (partition by user_id order by created_at, item_id) as n from fact)
      where n in (10, 25, 50, 100)""", "fact"),
    "newest_items": oracle("select item_id, name from item order by created_at desc, item_id desc limit 60", "item"),
    "batch_pages": oracle("""select item_id, r as position, cast(floor((r - 1) / 12) as bigint) as batch from (select item_id, row_number() over (order by created_at, item_id) as r from catalog)""", "catalog"),
    "neighbours": oracle("select a as user_id, b as friend_id from edge union all select b, a from edge", "edge"),
}
