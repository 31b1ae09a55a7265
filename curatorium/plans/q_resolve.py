"""Entity resolution on the bound tables, with check SQL that compares rows pairwise or one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatorium.operators import resolve
from curatorium.plans.bindings import Data, oracle
from curatorium.plans.q_text import norm_sql
from curatorium.session import cut_lineage


def dup_leader(spark, sf_dir):
    return resolve.leaders(Data(spark, sf_dir).catalog)


def dup_pairs(spark, sf_dir):
    return resolve.duplicate_pairs(Data(spark, sf_dir).catalog)


def dup_blocks(spark, sf_dir):
    return resolve.block_statistics(Data(spark, sf_dir).catalog)


def lookup_two_stage(spark, sf_dir):
    d = Data(spark, sf_dir)
    attempts = d.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(
        d.part.select("p_partkey", "p_name", "p_brand"), "p_partkey").select(
        "l_orderkey", "l_linenumber", "p_partkey",
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("The "), F.col("p_name"))).otherwise(F.col("p_name")).alias("name"),
        F.when(F.col("l_linenumber") % 5 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("maker"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit("WIT")).when(F.col("l_linenumber") % 3 == 1, F.lit("rood"))
        .otherwise(F.lit("")).alias("color"))
    # the same label text is looked up once, however often it was scanned
    distinct = attempts.groupBy("name", "maker", "color").agg(F.count(F.lit(1)).alias("scans"))
    return resolve.lookup_two_stage(distinct, d.catalog).select(
        "name", "maker", "color", "scans", "item_id", "stage")


def merge_survivor(spark, sf_dir):
    out = resolve.merge_survivors(Data(spark, sf_dir).catalog)
    return out.withColumns({"year": F.col("year").cast("long"), "first_user": F.col("first_user").cast("long")})


def merge_facts(spark, sf_dir):
    d = Data(spark, sf_dir)
    # the decision is stored once and then applied; recomputing it per use would repeat the matching
    pairs = cut_lineage(resolve.duplicate_pairs(d.catalog))
    return resolve.merge_facts(d.fact, pairs, resolve.given_tiers(d.catalog, pairs)).withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd")).withColumn("top_at", F.date_format("top_at", "yyyy-MM-dd")).withColumn(
        "fav_rank", F.col("fav_rank").cast("long"))


def merge_audit(spark, sf_dir):
    d = Data(spark, sf_dir)
    return resolve.merge_audit(d.fact, resolve.duplicate_pairs(d.catalog), d.catalog)


def first_user(spark, sf_dir):
    return resolve.first_user(Data(spark, sf_dir).attempt)


QUERIES = {f.__name__: f for f in (
    dup_leader, dup_pairs, dup_blocks, lookup_two_stage, merge_survivor, merge_facts, merge_audit, first_user)}

_BLOCK = f"""blk as (select *, {norm_sql('name')} as n, {norm_sql('maker')} as m, lower(color) as c from catalog),
  ok as (select * from blk where length(n) >= 3 and m <> ''),
  cmp as (select a.item_id as a, a.created_at as ta, b.item_id as b, b.created_at as tb from ok a join ok b on a.n = b.n and a.m = b.m
    and (a.created_at, a.item_id) < (b.created_at, b.item_id) and (a.c = '' or b.c = '' or a.c = b.c)),
  head as (select n, m, arg_min(c, (created_at, item_id)) as c0 from ok group by n, m),
  gone as (select distinct b as item_id from cmp join ok x on x.item_id = b join ok y on y.item_id = a join head on head.n = x.n and head.m = x.m
    where y.c = x.c or x.c = '' or head.c0 = ''),
  led as (select b as item_id, arg_min(a, (ta, a)) as leader_id from cmp where b in (select item_id from gone)
    and a not in (select item_id from gone) group by b),
  al as (select item_id, leader_id from led union all select item_id, item_id from ok where item_id not in (select item_id from gone))"""
_TURN = "(case when r.item_id = leader_id then 0 else 1 end, r.created_at, r.item_id)"


def _first(name: str) -> str:
    return f"(list(r.{name} order by {_TURN}) filter (r.{name} is not null))[1] as {name}"


CHECKS = {
    "dup_leader": oracle(f"with {_BLOCK} select item_id, leader_id from al", "catalog"),
    "dup_pairs": oracle(f"with {_BLOCK} select leader_id as keep_id, item_id as drop_id from led", "catalog"),
    "dup_blocks": oracle(f"""with {_BLOCK}, cnt as (select n, m, count(*) as items from ok group by n, m having count(*) > 1),
      pr as (select x.n, x.m, count(*) as pairs from cmp join ok x on x.item_id = a group by x.n, x.m)
      select n as norm_name, m as norm_maker, items, coalesce(pairs, 0) as pairs from cnt left join pr using (n, m)""", "catalog"),
    "lookup_two_stage": oracle(f"""with {_BLOCK},
      att as (select case when l_linenumber % 2 = 0 then 'The ' || p_name else p_name end as name,
        case when l_linenumber % 5 = 0 then '' else p_brand end as maker,
        case l_linenumber % 3 when 0 then 'WIT' when 1 then 'rood' else '' end as color, count(*) as scans
        from lineitem join part on l_partkey = p_partkey group by all),
      keyed as (select *, {norm_sql('name')} as n, {norm_sql('maker')} as m from att),
      e as (select k.name, k.maker, k.color, arg_min(i.item_id, (i.created_at, i.item_id)) as id from keyed k
        join blk i on lower(trim(i.maker)) || '|' || lower(trim(i.name)) = lower(trim(k.maker)) || '|' || lower(trim(k.name)) group by all),
      f as (select k.name, k.maker, k.color, arg_min(i.item_id, (i.created_at, i.item_id)) as id from keyed k join blk i on i.n = k.n and i.m = k.m
        and length(k.n) >= 3 and k.m <> '' and (k.color = '' or i.c = '' or i.c = lower(k.color)) group by all)
      select k.name, k.maker, k.color, k.scans, coalesce(e.id, f.id) as item_id,
        case when e.id is not null then 'exact' when f.id is not null then 'norm' else 'new' end as stage
      from keyed k left join e on e.name = k.name and e.maker = k.maker and e.color = k.color
      left join f on f.name = k.name and f.maker = k.maker and f.color = k.color""", "catalog"),
    # one pair after the other, in a table that every step sees as the last one left it
    "merge_survivor": oracle(f"""with recursive {_BLOCK},
      todo as (select leader_id as keep, led.item_id as gone_id, row_number() over (order by c.created_at, c.item_id) as n from led join catalog c on c.item_id = led.item_id),
      w as (select item_id, 0::bigint as n, name, maker, lower(trim(coalesce(maker, ''))) || '|' || lower(trim(name)) as wk, tier, tier_reason, first_user, year, signals,
          coalesce(is_icon, false) as icon, label_style as l, label_version as v, coalesce(label_locked, false) as locked, false as dead, 0::bigint as merged, false as refused from catalog),
      st using key (item_id) as (select * from w
        union
        select q.* from (
          with now_ as (select * from todo where n = (select max(n) from st) + 1),
          kd as (select k, d, now_.n as step, case when k.icon then k.name when d.icon then d.name when length(d.name) > length(k.name) then d.name else k.name end as nm,
              not k.locked and d.l is not null and (d.v = 2 or k.l is null or d.locked) as lab
            from now_ join recurring.st k on k.item_id = keep join recurring.st d on d.item_id = gone_id),
          j as (select *, lower(trim(coalesce(k.maker, ''))) || '|' || lower(trim(nm)) as nk from kd),
          t as (select *, exists (select 1 from recurring.st x where not x.dead and x.item_id <> j.k.item_id and x.item_id <> j.d.item_id and x.wk = j.nk) as taken from j)
          select k.item_id, step, case when taken then k.name else nm end, k.maker, case when taken then k.wk else nk end,
            case when taken then k.tier else coalesce(k.tier, d.tier) end, case when taken then k.tier_reason else coalesce(k.tier_reason, d.tier_reason) end,
            case when taken then k.first_user else coalesce(k.first_user, d.first_user) end, case when taken then k.year else coalesce(k.year, d.year) end,
            case when taken then k.signals else coalesce(k.signals, d.signals) end, case when taken then k.icon else k.icon or d.icon end,
            case when lab then d.l else k.l end, case when lab then d.v else k.v end, case when lab then d.locked else k.locked end, false, k.merged + 1, k.refused or taken from t
          union all select d.item_id, step, d.name, d.maker, d.wk, d.tier, d.tier_reason, d.first_user, d.year, d.signals, d.icon, d.l, d.v, d.locked, true, d.merged, d.refused from t) q)
      select item_id, name, tier, tier_reason, cast(first_user as bigint) as first_user, cast(year as bigint) as year, signals, icon as is_icon, l as label_style,
        refused as key_taken, merged as absorbed from st where merged > 0 and not dead""", "catalog"),
    "merge_facts": oracle(f"""with {_BLOCK},
      rk as (select unnest(['common','rare','superrare','ultra','icon']) as tier, unnest([1,2,3,4,5]) as rank),
      gv as (select leader_id as item_id, case when bool_or(is_icon) then 'icon' else
        (list(coalesce(r.tier_override, r.tier) order by {_TURN}) filter (coalesce(r.tier_override, r.tier) is not null))[1] end as given
        from (select catalog.*, al.leader_id from catalog join al using (item_id)) r group by leader_id having count(*) > 1),
      mv as (select fact.*, coalesce(leader_id, fact.item_id) as target, leader_id is not null as moved, rank
        from fact left join led on led.item_id = fact.item_id join rk on rk.tier = fact.tier),
      ag as (select user_id, target, arg_min(fact_id, (moved, created_at, fact_id)) as fact_id,
        (list(fav_rank order by moved, created_at, fact_id))[1] as fav_rank, (list(top_at order by moved, created_at, fact_id))[1] as top_at, cast(sum(bottles) as bigint) as bottles, max(rank) as rank,
        bool_or(full_art) as full_art, (list(memo order by moved, created_at, fact_id) filter (memo is not null))[1] as memo, min(created_at) as created_at, bool_or(moved) as touched
        from mv group by user_id, target)
      select user_id, target as item_id, fact_id, bottles, case when touched then coalesce(given, rk.tier) else rk.tier end as tier, full_art, memo,
        strftime(created_at, '%Y-%m-%d') as created_at,
      cast(fav_rank as bigint) as fav_rank, strftime(top_at, '%Y-%m-%d') as top_at from ag join rk using (rank) left join gv on gv.item_id = target""", "catalog", "fact"),
    "merge_audit": oracle(f"""with {_BLOCK} select leader_id as keep_id, led.item_id as drop_id, k.name || ' + ' || d.name as names,
      (select count(*) from fact where fact.item_id = led.item_id) as cards_moved
      from led join catalog k on k.item_id = leader_id join catalog d on d.item_id = led.item_id""", "catalog", "fact"),
    "first_user": oracle("select item_id, arg_min(user_id, (ts, event_id)) as first_user from attempt group by 1", "attempt"),
}
