"""Roles (items, facts, users, ...) bound to the given tables.

Each role is one SELECT that Spark and the check engine both understand, so the library is
fed exactly what the check sees. Only four spellings differ; `Dialect` holds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF_YEAR = 2024
ROWS_PER_TASK, MANY_TASKS = 500_000, 16
AS_OF = "2024-01-31 00:00:00"   # the events end on 30 January 2024


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def ts_plus_minutes(self, base: str, minutes: str) -> str:
        if self.spark:
            return f"(TIMESTAMP_NTZ'{base}' + make_dt_interval(0, 0, cast({minutes} as int)))"
        return f"(TIMESTAMP '{base}' + to_minutes(cast({minutes} as bigint)))"

    def json_int(self, col: str, name: str) -> str:
        if self.spark:
            return f"cast(get_json_object({col}, '$.{name}') as bigint)"
        return f"cast(json_extract_string({col}, '$.{name}') as bigint)"

    def key_number(self, expr: str) -> str:
        if self.spark:
            return f"cast(conv(substr(md5({expr}), 1, 8), 16, 10) as bigint)"
        return f"('0x' || substr(md5({expr}), 1, 8))::bigint"

    def text_array(self, *exprs: str) -> str:
        return f"array({', '.join(exprs)})" if self.spark else f"[{', '.join(exprs)}]"


SPARK, DUCK = Dialect(True), Dialect(False)


def _item(d: Dialect) -> str:
    k = "p_partkey"
    return f"""
    select {k} as item_id, p_name as name,
      case when {k} % 11 = 0 then '' else p_brand end as maker,
      case when {k} % 15 = 0 then null else cast(1990 + {k} % 35 as int) end as year,
      n_name as region, r_name as country, p_type as appellation,
      p_brand as grape,
      case {k} % 6 when 5 then 'mousserend' when 4 then 'zoet' else 'stil' end as style,
      case {k} % 4 when 0 then '' when 1 then 'rood' when 2 then 'wit' else 'rosé' end as color,
      case {k} % 3 when 0 then 'reserva' when 1 then 'crianza' else 'jong' end as tag,
      {k} % 101 = 0 as is_icon,
      case when {k} % 53 = 0 then 'ultra' end as tier_override,
      case when {k} % 19 = 0 or {k} % 23 = 0 then null else cast(p_size * 8 as decimal(12,4)) end as price_eur_low,
      case when {k} % 19 = 0 or {k} % 29 = 0 then null else cast(p_size * 10 as decimal(12,4)) end as price_eur_high,
      case p_type when 'PROMO' then 'top' when 'LARGE' then 'premium' when 'MEDIUM' then 'kwaliteit' end as classification,
      case {k} % 7 when 0 then 'wereldberoemd' when 1 then 'gerenommeerd' when 2 then 'merk' end as producer_fame,
      case {k} % 11 when 1 then 'zeer klein' when 2 then 'klein' when 3 then 'massa' end as production,
      case {k} % 5 when 0 then 'zeldzaam' when 1 then 'ongewoon' end as rarity_nl,
      case {k} % 9 when 0 then 'top' when 1 then 'goed' when 2 then 'slecht' end as vintage_quality,
      {k} % 37 = 0 as large_format, {k} % 31 = 0 as iconic,
      case when {k} % 8 = 7 then null else cast({k} % 8 as int) end as nl_shops,
      cast(case {k} % 13 when 0 then 97 when 1 then 93 when 2 then 90 end as int) as critic_max,
      cast(case {k} % 17 when 3 then 30000 when 4 then 25000 else {k} % 1000 end as int) as vivino_count,
      case {k} % 4 when 0 then false when 1 then null else true end as ageworthy,
      {k} % 10 = 0 as past_peak,
      {d.ts_plus_minutes('2023-01-01 00:00:00', f'({k} % 100000) * 2')} as created_at
    from {{part}} join {{nation}} on n_nationkey = {k} % 25 join {{region}} on r_regionkey = n_regionkey
    """


def _fact(d: Dialect) -> str:
    return f"""
    select o_custkey as user_id, l_partkey as item_id,
      o_custkey * 1000000000 + l_partkey as fact_id,
      min(o_orderdate) as created_at, count(*) as bottles,
      max(case when l_quantity >= 49 then 1 else 0 end) = 1 as full_art,
      case when (o_custkey * 3 + l_partkey) % 5 = 0 then 'note ' || cast(l_partkey as varchar(20)) end as memo,
      case when (o_custkey + l_partkey) % 4 = 0 then cast((o_custkey + l_partkey) % 13 + 1 as int) end as fav_rank,
      case when l_partkey % 7 = 0 then max(o_orderdate) end as top_at,
      case (o_custkey * 7 + l_partkey) % 6 when 0 then 'rare' when 1 then 'superrare' when 2 then 'ultra'
           else 'common' end as tier
    from {{orders}} join {{lineitem}} on o_orderkey = l_orderkey
    group by o_custkey, l_partkey
    """


def _users(d: Dialect) -> str:
    return f"""
    select c_custkey as user_id,
      case when c_custkey % 6 = 0 then '  ' when c_custkey % 7 = 0 then null else c_name end as display_name,
      case when c_custkey % 14 = 7 then null
           else lower(c_mktsegment) || '.' || cast(c_custkey as varchar(20)) || '@mail.test' end as mail,
      cast(1 + c_custkey % 4 as int) as daily_limit,
      case when c_custkey % 3 = 0 then null else lower(c_mktsegment) end as cover_color,
      {d.ts_plus_minutes('2023-12-01 00:00:00', '(c_custkey % 50000) * 37')} as created_at
    from {{customer}}
    """


def _edge(d: Dialect) -> str:
    return f"""
    select a, b, {d.ts_plus_minutes('2023-06-01 00:00:00', '(a * 31 + b) % 100000')} as created_at from (
      select distinct least(c, o) as a, greatest(c, o) as b from (
        select c_custkey as c, (c_custkey * 7 + 3) % (select count(*) from {{customer}}) as o from {{customer}}) x
      where c <> o) y
    """


def _attempt(d: Dialect) -> str:
    return f"""
    select event_id, ts, user_id, event_type, {d.json_int('props', 'k')} as item_id, value from {{events}}
    """


def _usage(d: Dialect) -> str:
    return """
    select event_id as usage_id, ts as created_at, event_type as kind,
      case user_id % 4 when 0 then 'Opus-large' when 1 then 'sonnet-mid' when 2 then 'fable-x' else 'small' end as model,
      cast(event_id % 5000 as int) as input_tokens, cast(event_id % 700 as int) as output_tokens,
      cast(event_id % 3 as int) as web_searches
    from {events}
    """


def _catalog(d: Dialect) -> str:
    """Items with spelling variants of one name, so that resolution and merging have work."""
    k = "p_partkey"
    return f"""
    select {k} as item_id,
      case {k} % 3 when 0 then p_name when 1 then 'Château ' || p_name else p_name || ' 1998' end as name,
      case when {k} % 17 = 0 then '' when {k} % 5 = 0 then 'Domaine ' || p_brand else p_brand end as maker,
      case {k} % 4 when 0 then '' when 1 then 'rood' when 2 then 'wit' else 'Rood' end as color,
      case when {k} % 4 = 1 then null else cast(1990 + {k} % 30 as int) end as year,
      {k} % 97 = 0 as is_icon,
      case when {k} % 53 = 0 then 'ultra' end as tier_override,
      case {k} % 5 when 0 then null when 1 then 'common' when 2 then 'rare' when 3 then 'superrare' else 'ultra' end as tier,
      case when {k} % 5 <> 0 then 'reason ' || cast({k} % 5 as varchar(5)) end as tier_reason,
      case when {k} % 3 <> 2 then {k} % 150 end as first_user,
      case when {k} % 6 <> 0 then 'label ' || cast({k} as varchar(20)) end as label_style,
      cast(case when {k} % 2 = 0 then 2 else 1 end as int) as label_version,
      {k} % 29 = 0 and {k} % 6 <> 0 as label_locked,
      case when {k} % 4 <> 1 then 'measured ' || cast({k} as varchar(20)) end as signals,
      {d.ts_plus_minutes('2023-01-01 00:00:00', f'({k} * 7) % 500')} as created_at
    from {{part}}
    """


ROLES = {"catalog": _catalog, "item": _item, "fact": _fact, "users": _users, "edge": _edge, "attempt": _attempt, "usage": _usage}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


class Data:
    """The given tables and the roles on top of them, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def role(self, name: str) -> DataFrame:
        text = ROLES[name](SPARK)
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        if "lineitem" in used and (parts := self.tasks("orders", "lineitem")):
            used |= {t: used[t].repartition(parts, k) for t, k in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"))}
        return self.spark.sql(text, **used)

    def tasks(self, *tables: str) -> int | None:
        """As many tasks as the tables' rows need. The planner may give each core one task, whatever that holds; None where a
        task or two per core hold everything."""
        parts = sum(self.table(t).count() for t in tables) // ROWS_PER_TASK
        return parts if parts >= MANY_TASKS else None

    def __getattr__(self, name: str) -> DataFrame:
        if name in ROLES:
            return self.role(name)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def oracle(body: str, *roles: str) -> str:
    """Put the roles in front of a check query as common table expressions."""
    parts = []
    for role in roles:
        text = ROLES[role](DUCK)
        for t in TABLES:
            text = text.replace("{" + t + "}", t)
        parts.append(f"{role} as materialized ({text})")
    if not parts:
        return body
    head = ", ".join(parts)
    stripped = body.lstrip()
    if stripped.lower().startswith("with recursive"):
        return f"with recursive {head}, {stripped[len('with recursive'):]}"
    if stripped.lower().startswith("with "):
        return f"with {head}, {stripped[5:]}"
    return f"with {head} {stripped}"
