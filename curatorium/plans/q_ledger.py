"""Ledgers on the bound events, with check SQL that replays them where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatorium.operators import ledger
from curatorium.plans.bindings import Data, oracle

_LOG = ["event_id", "ts", "user_id", "item_id"]


def daily_quota(spark, sf_dir):
    """New cards and repeats count together."""
    d = Data(spark, sf_dir)
    log = d.attempt.where("event_type = 'signup'").select(*_LOG).unionByName(d.attempt.where("event_type = 'purchase'").select(*_LOG))
    return ledger.daily_quota(log, d.users).select("event_id", "status")


def _repeats(d: Data):
    return d.attempt.where("event_type in ('purchase', 'click', 'error')").withColumn("item_id", F.col("item_id") % 10).select(*_LOG)


def _cards10(d: Data):
    rows = d.attempt.where("event_type in ('signup', 'view')").withColumn("item_id", F.col("item_id") % 10)
    return rows.groupBy("user_id", "item_id").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("user_id", "item_id", "f.ts", "f.event_id")


def cooldown_daily(spark, sf_dir):
    d = Data(spark, sf_dir)
    return ledger.cooldown(_repeats(d), _cards10(d)).select("event_id", "status")


def repeat_ledger(spark, sf_dir):
    d = Data(spark, sf_dir)
    one = d.users.withColumn("daily_limit", (F.col("daily_limit") + 1) / 2).withColumn("daily_limit", F.col("daily_limit").cast("int"))
    return ledger.repeats(_repeats(d), _cards10(d), one).select("event_id", "status")


def admission_ledger(spark, sf_dir):
    d = Data(spark, sf_dir)
    limits = d.users.withColumn("daily_limit", F.when(F.col("daily_limit") > 2, 2).otherwise(1))
    rows = d.attempt.withColumn("item_id", F.col("item_id") % 25)
    return ledger.admission(rows.select(*_LOG), limits).select("event_id", "status")


def guarantee_ledger(spark, sf_dir):
    d = Data(spark, sf_dir)
    draws = d.attempt.select((F.col("user_id") % 20).alias("user_id"), "ts", "event_id", (F.col("item_id") % 37 == 0).alias("is_icon"))
    return ledger.guarantee(draws, F.concat(F.lit("g-"), F.col("event_id").cast("string"))).drop("ts")


def running_best(spark, sf_dir):
    from curatorium.functions.chance import draw_tier

    d = Data(spark, sf_dir)
    draws = d.attempt.select("event_id", "ts", "user_id", (F.col("item_id") % 5).alias("item_id"),
                             draw_tier(F.concat(F.lit("b-"), F.col("event_id").cast("string"))).alias("drawn"))
    return ledger.running_best(draws).select("event_id", "drawn", "old_tier", "tier", "upgraded")


def cap_ledger(spark, sf_dir):
    d = Data(spark, sf_dir)
    calls = d.attempt.select("event_id", "ts", (F.col("user_id") % 15).alias("user_id"))
    return ledger.capped(calls, d.users, month_cap=6000, day_cap=10).select("event_id", "status")


def confirm_within(spark, sf_dir):
    d = Data(spark, sf_dir)
    year = F.when(F.col("item_id") % 5 != 0, 1990 + F.col("item_id") % 2)
    rows = d.attempt.withColumn("year", year)
    return ledger.confirm_within(rows.where("event_type = 'view'"), rows.where("event_type in ('click', 'purchase')"), minutes=720).select(
        "event_id", "check_id", "status")


def ranked_insert(spark, sf_dir):
    d = Data(spark, sf_dir)
    ops = d.attempt.select("user_id", "ts", "event_id", (F.col("item_id") % 30).alias("card"), (F.col("event_id") % 11).alias("rank"))
    return ledger.ranked_insert(ops).select("event_id", "favourites")


def sticky_first(spark, sf_dir):
    d = Data(spark, sf_dir)
    notes = d.attempt.select("user_id", (F.col("item_id") % 4).alias("item_id"), "ts", "event_id",
                             F.when(F.col("event_type") != "error", F.concat_ws("", F.lit("memo "), F.col("item_id"))).alias("text"))
    return ledger.sticky_first(notes, ["user_id", "item_id"]).select(
        "event_id", F.date_format("written_at", "yyyy-MM-dd HH:mm:ss").alias("written_at"))


QUERIES = {f.__name__: f for f in (
    daily_quota, cooldown_daily, repeat_ledger, admission_ledger, guarantee_ledger, running_best, cap_ledger, confirm_within,
    ranked_insert, sticky_first)}

_DAY = "cast((ts at time zone 'UTC') at time zone 'Europe/Amsterdam' as date)"
_REPEAT = f"""rep as (select event_id, ts, user_id, item_id % 10 as item_id, {_DAY} as day from attempt where event_type in ('purchase','click','error')),
  crd as (select user_id, item_id % 10 as item_id, min(ts) as ts, arg_min(event_id, (ts, event_id)) as event_id from attempt where event_type in ('signup','view') group by 1, 2),
  crd_day as (select *, {_DAY} as day from crd),
  cool as (select r.*, case when c.ts is null or c.ts > r.ts then 'no_card'
    when r.day > c.day and row_number() over (partition by r.user_id, r.item_id, r.day order by r.ts, r.event_id) = 1 then 'bottle' else 'cooldown' end as status
    from rep r left join crd_day c using (user_id, item_id))"""

CHECKS = {
    "daily_quota": oracle(f"""select event_id, case when row_number() over (partition by user_id, {_DAY} order by ts, event_id) <= coalesce(daily_limit, 3) then 'ok' else 'limit' end as status
      from attempt left join users using (user_id) where event_type in ('signup', 'purchase')""", "users", "attempt"),
    "cooldown_daily": oracle(f"with {_REPEAT} select event_id, status from cool", "attempt"),
    "repeat_ledger": oracle(f"""with {_REPEAT},
      mix as (select user_id, day, ts, event_id from cool where status = 'bottle' union all select user_id, day, ts, event_id from crd_day),
      num as (select event_id, row_number() over (partition by user_id, day order by ts, event_id) as n from mix),
      tried as (select c.*, min(case when c.status = 'bottle' then n end) over (partition by c.user_id, item_id, c.day) as first_n from cool c left join num using (event_id))
      select event_id, case when status <> 'no_card' and first_n > floor((coalesce(daily_limit, 3) + 1) / 2) then 'limit' else status end as status
      from tried left join users using (user_id)""", "users", "attempt"),
    "admission_ledger": oracle(f"""with recursive lim as (select user_id, case when daily_limit > 2 then 2 else 1 end as cap from users),
      att as (select event_id, ts, user_id, item_id % 25 as item_id, {_DAY} as day from attempt),
      cand as (select user_id, item_id, day, min(ts) as ts, arg_min(event_id, ts) as event_id from att group by 1, 2, 3),
      span as (select min(day) as d0, max(day) as d1 from att),
      walk as (
        select u.user_id, d0 - 1 as day, []::bigint[] as owned, []::bigint[] as ids from (select distinct user_id from att) u, span
        union all
        select w.user_id, w.day + 1, list_concat(w.owned, coalesce(x.items, [])), coalesce(x.ids, [])
        from walk w left join lateral (
          select list(item_id) as items, list(event_id) as ids from (
            select c.item_id, c.event_id, row_number() over (order by c.ts, c.event_id) as n, coalesce(cap, 3) as cap
            from cand c left join lim on lim.user_id = c.user_id
            where c.user_id = w.user_id and c.day = w.day + 1 and not list_contains(w.owned, c.item_id)) q where n <= cap) x on true
        where w.day < (select d1 from span)),
      won as (select user_id, unnest(ids) as event_id from walk),
      own as (select w.user_id, c.item_id, c.ts, c.event_id from won w join cand c on c.event_id = w.event_id)
      select a.event_id, case when o.event_id = a.event_id then 'new' when (a.ts, a.event_id) > (o.ts, o.event_id) then 'duplicate' else 'limit' end as status
      from att a left join own o on o.user_id = a.user_id and o.item_id = a.item_id""", "users", "attempt"),
    "guarantee_ledger": """with recursive d as (select event_id, user_id % 20 as user_id, row_number() over (partition by user_id % 20 order by ts, event_id) as n,
        ('0x' || substr(md5('g-' || event_id), 1, 8))::bigint / 4294967296.0 as u, coalesce(json_extract_string(props, '$.k')::bigint % 37 = 0, false) as icon from events),
      s as (select user_id, n, event_id, u, 0::bigint as su, 0::bigint as ss, case when icon then 'icon' when u < 0.01 then 'ultra' when u < 0.06 then 'superrare' when u < 0.24 then 'rare' else 'common' end as tier from d where n = 1
        union all
        select d.user_id, d.n, d.event_id, d.u, case when s.tier = 'ultra' then 0 else s.su + 1 end, case when s.tier in ('ultra', 'superrare') then 0 else s.ss + 1 end,
          case when d.icon then 'icon' when (case when s.tier = 'ultra' then 0 else s.su + 1 end) >= 99 then 'ultra'
            when (case when s.tier in ('ultra', 'superrare') then 0 else s.ss + 1 end) >= 24 then 'superrare'
            when d.u < 0.01 then 'ultra' when d.u < 0.06 then 'superrare' when d.u < 0.24 then 'rare' else 'common' end
        from s join d on d.user_id = s.user_id and d.n = s.n + 1)
      select user_id, event_id, tier, case when tier = 'ultra' then 0 else su + 1 end as since_ultra,
        case when tier in ('ultra', 'superrare') then 0 else ss + 1 end as since_superrare from s""",
    "running_best": """with d as (select event_id, ts, user_id, cast(props->>'k' as bigint) % 5 as item_id, ('0x' || substr(md5('b-' || event_id), 1, 8))::bigint / 4294967296.0 as u from events),
      r as (select *, case when u < 0.01 then 4 when u < 0.06 then 3 when u < 0.24 then 2 else 1 end as rank from d),
      w as (select *, max(rank) over (partition by user_id, item_id order by ts, event_id rows between unbounded preceding and 1 preceding) as old from r)
      select event_id, (['common','rare','superrare','ultra'])[rank] as drawn, (['common','rare','superrare','ultra'])[old] as old_tier,
        (['common','rare','superrare','ultra'])[greatest(rank, coalesce(old, 0))] as tier, rank > coalesce(old, 0) as upgraded from w""",
    "cap_ledger": oracle(f"""with c as (select event_id, ts, user_id % 15 as user_id, {_DAY} as day, strftime((ts at time zone 'UTC') at time zone 'Europe/Amsterdam', '%Y-%m') as month from attempt),
      n as (select c.*, row_number() over (partition by c.user_id, day order by ts, event_id) <= greatest(10, coalesce(daily_limit, 3) * 5) as fine from c left join users using (user_id)),
      m as (select *, coalesce(sum(fine::int) over (partition by month order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as used from n)
      select event_id, case when used >= 6000 then 'month_cap' when fine then 'ok' else 'day_cap' end as status from m""", "users", "attempt"),
    "confirm_within": oracle("""with r as (select event_id, ts, user_id, event_type, case when item_id % 5 <> 0 then 1990 + item_id % 2 end as year from attempt),
      j as (select c.event_id, c.ts, c.year, p.event_id as check_id, p.ts as pts, p.year as pyear from r c left join r p on p.event_id =
        (select arg_max(q.event_id, (q.ts, q.event_id)) from r q where q.event_type = 'view' and q.user_id = c.user_id and q.ts <= c.ts)
        where c.event_type in ('click', 'purchase')),
      k as (select *, coalesce(ts <= pts + interval 720 minutes, false) as in_time, year is null or pyear is null or year = pyear as agree from j),
      u as (select *, min(case when in_time and agree then ts end) over (partition by check_id) as used from k)
      select event_id, check_id, case when in_time and agree and used = ts then 'ok' when not in_time or used < ts then 'back_expired' else 'back_failed' end as status from u""", "attempt"),
    "ranked_insert": oracle("""with recursive o as (select event_id, user_id, item_id % 30 as card, event_id % 11 as rank, row_number() over (partition by user_id order by ts, event_id) as n from attempt),
      s as (select user_id, 0::bigint as n, 0::bigint as event_id, []::bigint[] as favs from (select distinct user_id from o) union all
        select o.user_id, o.n, o.event_id, case when rank = 0 then list_filter(favs, lambda c: c <> card)
          else list_concat(list_concat(list_filter(favs, lambda c, i: c <> card and i < rank), [card]), list_filter(favs, lambda c, i: c <> card and i >= rank and i < 10)) end
        from s join o on o.user_id = s.user_id and o.n = s.n + 1)
      select event_id, array_to_string(favs, ',') as favourites from s where n > 0""", "attempt"),
    "sticky_first": oracle("""with n as (select event_id, ts, user_id, item_id % 4 as item_id, event_type = 'error' as cleared from attempt),
      g as (select *, sum(cleared::int) over (partition by user_id, item_id order by ts, event_id) as island from n)
      select event_id, case when not cleared then strftime(min(case when not cleared then ts end) over (partition by user_id, item_id, island), '%Y-%m-%d %H:%M:%S') end as written_at from g""", "attempt"),
}
