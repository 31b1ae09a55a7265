"""Catalogue progress, rewards, social and geo queries on the bound tables, with their check SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from curatorium.operators import geo, progress, ranking, social
from curatorium.plans.bindings import Data, oracle
from curatorium.plans.q_text import SLOTS_SQL
from curatorium.sources import catalogue
from curatorium.sources.sinks import stored

BASICS = ["ribbon", "star", "stamp"]


class _Album:
    """The frames most progress queries share, built when first asked for. With `keep`, the facts are stored, for queries that use
    them several times; so the big tables are joined once. Nothing else is stored."""

    def __init__(self, spark, sf_dir, keep=False):
        self.spark, self.d = spark, Data(spark, sf_dir)
        self.store = stored if keep else lambda df, name: df
        self.items = self.d.item.select(
            "item_id", "name", "maker", "region", "country", "appellation", "grape", "style", F.nullif("color", F.lit("")).alias("color"),
            F.array("tag").alias("tags"))

    @cached_property
    def facts(self):
        columns = ["user_id", "item_id", "fact_id", "created_at", "tier", "full_art", "memo", "fav_rank"]
        return self.store(self.d.fact.select(*columns), "facts")

    @cached_property
    def edge(self):
        return self.d.edge

    @cached_property
    def slots(self):
        return catalogue.slots(catalogue.sets_frame(self.spark, catalogue.packaged("sets")))

    @cached_property
    def fills(self):
        return progress.slot_fill(self.items, self.slots)

    @cached_property
    def filled(self):
        return progress.filled_sets(self.facts, self.fills, self.slots)

    @cached_property
    def progress(self):
        return progress.set_progress(self.filled, self.slots)

    @cached_property
    def visible(self):
        return progress.visible_sets(self.progress, self.d.users, self.slots)

    @cached_property
    def shared(self):
        return social.shared_items(self.edge, self.facts, self.items)

    @cached_property
    def metrics(self):
        return progress.reward_metrics(self.d.users, self.facts, self.items, self.edge, self.visible, self.shared)

    @cached_property
    def rewards(self):
        return catalogue.literal_frame(
            self.spark, catalogue.packaged("rewards"), "id string, metric string, goal bigint, badges array<string>")

    @cached_property
    def opened(self):
        """Which rewards were opened already: by person and place in the list."""
        ids = [r["id"] for r in catalogue.packaged("rewards")]
        return self.d.users.select("user_id", F.posexplode(F.lit(ids)).alias("i", "reward")).where(
            "(user_id + i) % 4 = 0").select("user_id", "reward")


def _long(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def slot_fill(spark, sf_dir):
    return _long(_Album(spark, sf_dir).fills.select("item_id", "set_id", "position"), "position")


def set_progress(spark, sf_dir):
    return _Album(spark, sf_dir).progress.select("user_id", "set_id", "filled", "total", "complete")


def set_visible(spark, sf_dir):
    return _Album(spark, sf_dir).visible.select("user_id", "set_id", "filled", "total", "complete")


def gap_guide(spark, sf_dir):
    a = _Album(spark, sf_dir)
    return _long(progress.gap_guide(a.visible, a.slots), "position", "difficulty")


def leftovers(spark, sf_dir):
    a = _Album(spark, sf_dir)
    return progress.leftovers(a.facts.select("user_id", "item_id"), a.fills)


def chapters(spark, sf_dir):
    a = _Album(spark, sf_dir)
    out = progress.chapters(a.facts.select("user_id", "item_id", "created_at").join(a.items.select("item_id", "country"), "item_id"))
    return out.withColumn("first_at", F.date_format("first_at", "yyyy-MM-dd"))


def reward_metrics(spark, sf_dir):
    return _Album(spark, sf_dir, keep=True).metrics


def reward_progress(spark, sf_dir):
    a = _Album(spark, sf_dir, keep=True)
    return progress.reward_progress(a.metrics, a.rewards)


def due_rewards(spark, sf_dir):
    a = _Album(spark, sf_dir, keep=True)
    return progress.due_rewards(progress.reward_progress(a.metrics, a.rewards), a.opened)


def earned_badges(spark, sf_dir):
    a = _Album(spark, sf_dir, keep=True)  # facts for sets, counts and places
    return progress.earned_badges(a.d.users, a.facts, a.items, a.visible, a.opened, a.rewards, BASICS)


def icon_coverage(spark, sf_dir):
    a = _Album(spark, sf_dir)
    return progress.icon_coverage(a.facts, a.items, catalogue.packaged("icon_rules"))


def shared_items(spark, sf_dir):
    return _Album(spark, sf_dir, keep=True).shared


def cosine_counts(spark, sf_dir):
    a = _Album(spark, sf_dir, keep=True)
    out = social.cosine_counts(a.edge, social.profiles(a.facts, a.items))
    return out.withColumns({c: F.round(c, 9) for c in ("region_cos", "color_cos")})


def taste_match(spark, sf_dir):
    a = _Album(spark, sf_dir, keep=True)
    return social.taste_match(social.cosine_counts(a.edge, social.profiles(a.facts, a.items)), a.shared)


def friend_list(spark, sf_dir):
    d = Data(spark, sf_dir)
    return social.friend_list(d.edge, d.users, d.fact).withColumn("since", F.date_format("since", "yyyy-MM-dd HH:mm:ss"))


def friend_album(spark, sf_dir):
    d = Data(spark, sf_dir)
    requests = d.attempt.select("event_id", F.col("user_id").alias("viewer_id"), (F.col("user_id") * 7 + F.col("item_id") % 4 + 2).alias("owner_id"))
    pages = d.attempt.where("event_type = 'click'").groupBy("user_id", (F.col("item_id") % 5).alias("page")).agg(
        F.count(F.lit(1)).alias("items")).withColumn("page", F.concat(F.lit("set:"), F.col("page").cast("string")))
    out = social.friend_album(requests, d.edge, d.users, d.fact, pages)
    return out.drop("viewer_id", "owner_id").withColumn("stickers", F.to_json("stickers"))


def viewer_album(spark, sf_dir):
    """What each viewer sees: the album pages of all friends, without notes."""
    d = Data(spark, sf_dir)
    card = F.struct(F.col("item_id").alias("id"), F.col("tier").alias("tier"))
    pages = ranking.album_pages(d.fact.select("user_id", "item_id", "tier", "created_at", "fact_id"), card)
    return social.visible_albums(d.edge, pages).select("viewer_id", "user_id", "page", F.to_json("cards").alias("cards"))


def canonical_edges(spark, sf_dir):
    d = Data(spark, sf_dir)
    code = F.upper(F.substring(F.md5(F.col("user_id").cast("string")), 1, 8))
    invites = d.users.select("user_id", code.alias("code"))
    wanted = F.when(F.col("event_id") % 10 == 0, F.lit("nope")).otherwise(
        F.concat(F.lit(" "), F.lower(F.upper(F.substring(F.md5(F.col("item_id").cast("string")), 1, 8)))))
    accepts = d.attempt.where("event_type = 'click'").select("event_id", "ts", "user_id", wanted.alias("code"))
    out = social.accept_invites(accepts, invites, d.edge)
    return out.select("event_id", "a", "b", "status")


def _points(d: Data):
    k = F.col("c_custkey")
    return d.customer.select(
        k.alias("user_id"), "c_nationkey", ((k * 7919) % 35000 / F.lit(100.0) - 175).alias("lon"),
        ((k * 104729) % 15000 / F.lit(100.0) - 70).alias("lat"))


def point_in_polygon(spark, sf_dir):
    d = Data(spark, sf_dir)
    shapes = catalogue.literal_frame(spark, catalogue.packaged("polygons"), "id string, p array<array<array<array<double>>>>")
    k = F.col("c_custkey")
    everywhere = d.customer.select(k.alias("user_id"), ((k * 7919) % 36000 / F.lit(100.0) - 180).alias("lon"), ((k * 104729) % 18000 / F.lit(100.0) - 90).alias("lat"))
    return geo.point_in_polygon(everywhere, shapes).select("user_id", "id")


def within_radius(spark, sf_dir):
    return geo.within_radius(_points(Data(spark, sf_dir)), 12.5, 41.9).select("user_id", F.round("distance", 6).alias("distance"))


def bbox_overlap(spark, sf_dir):
    p = _points(Data(spark, sf_dir)).withColumn("ring", F.floor(F.col("lon") / 10) * 100 + F.floor(F.col("lat") / 10))
    rings = geo.ring_boxes(p, ["ring"])
    return geo.box_overlap(rings, catalogue.packaged("boxes")).select("ring", "box")


def project_box(spark, sf_dir):
    x, y = geo.project(F.col("lon"), F.col("lat"), catalogue.packaged("boxes")[0], 300.0)
    return _points(Data(spark, sf_dir)).select("user_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


def thin_sequence(spark, sf_dir):
    k = F.col("c_custkey")
    walk = Data(spark, sf_dir).customer.select(
        (k % 40).alias("ring"), k.alias("step"), ((k * 37) % 100 / F.lit(100.0)).alias("lon"), ((k * 53) % 60 / F.lit(100.0)).alias("lat"))
    return geo.thin_rings(walk, "ring", "step")


def pin_lookup(spark, sf_dir):
    a = _Album(spark, sf_dir)
    pins = catalogue.packaged("pins")
    of_set = catalogue.literal_frame(spark, pins["sets"], "set_id string, lat double, lon double")
    of_slot = catalogue.literal_frame(spark, pins["slots"], "set_id string, slot string, lat double, lon double")
    return geo.pin_lookup(a.fills.where("part = 1"), of_set, of_slot).select("item_id", "set_id", "slot", "lat", "lon")


QUERIES = {f.__name__: f for f in (
    slot_fill, set_progress, set_visible, gap_guide, leftovers, chapters, reward_metrics, reward_progress, due_rewards, earned_badges,
    icon_coverage, shared_items, cosine_counts, taste_match, friend_list, friend_album, viewer_album, canonical_edges, point_in_polygon, within_radius,
    bbox_overlap, project_box, thin_sequence, pin_lookup)}

_FILL = f"""{SLOTS_SQL},
  it as materialized (select *, nullif(color, '') as col, lower(trim(maker)) || '|' || lower(trim(name)) as k from item),
  fill as materialized (select item_id, set_id, position, slot, part from it join slots on (r_region is null or r_region = region) and (r_app is null or list_contains(r_app, appellation))
    and (r_grape is null or r_grape = grape) and (r_country is null or r_country = country) and (r_style is null or r_style = style)
    and (r_color is null or r_color = col) and (r_tag is null or r_tag = tag) and (r_key is null or r_key = k)
    and (r_has is null or len(list_filter(r_has, lambda h: contains(regexp_replace(lower(appellation), '[^a-z0-9]', '', 'g'), h))) > 0)),
  filled as materialized (select distinct user_id, set_id, position from fact join fill using (item_id)),
  totals as (select set_id, any_value(unlock) as unlock, bool_or(always) as always, count(*) as total from slots group by 1),
  prog as materialized (select user_id, set_id, count(*) as filled, total, count(*) = total as complete from filled join totals using (set_id) group by user_id, set_id, total),
  vis as materialized (select u.user_id, t.set_id, coalesce(p.filled, 0) as filled, t.total, coalesce(p.filled, 0) = t.total as complete
    from users u cross join totals t left join prog p on p.user_id = u.user_id and p.set_id = t.set_id
    where t.always or exists (select 1 from prog q where q.user_id = u.user_id and q.set_id = t.unlock and q.complete) or (t.unlock is null and p.filled > 0))"""
_KEYED = """own as (select distinct user_id, lower(trim(maker)) || '|' || lower(trim(name)) as k from fact join item using (item_id)),
  shr as materialized (select a, b, (select count(*) from own x join own y using (k) where x.user_id = a and y.user_id = b) as shared from edge)"""
_BOTH = "be as (select a as u, b as f from edge union all select b, a from edge)"
_REWARDS = catalogue.packaged("rewards")
_REWARD_ROWS = "rw(i, id, metric, goal, badges) as (values " + ", ".join(
    f"({i}, '{r['id']}', '{r['metric']}', {r['goal']}::bigint, {r['badges']!r})" for i, r in enumerate(_REWARDS)) + ")"
_OPENED = f"{_REWARD_ROWS}, opened as materialized (select user_id, id as reward, badges from users cross join rw where (user_id + i) % 4 = 0)"
_METRICS = f"""{_FILL}, {_KEYED}, {_BOTH},
  met as materialized (select u.user_id,
    (select count(*) from fact where fact.user_id = u.user_id) as cards,
    (select count(*) from be where be.u = u.user_id) as friends,
    (select count(distinct country) from fact join item using (item_id) where fact.user_id = u.user_id) as lands,
    (select count(distinct case when style = 'mousserend' then 'bubbels' else nullif(color, '') end) from fact join item using (item_id) where fact.user_id = u.user_id) as colors,
    cast(exists (select 1 from fact where fact.user_id = u.user_id and tier in ('superrare', 'ultra', 'icon')) as bigint) as shiny,
    (select count(memo) from fact where fact.user_id = u.user_id) as memos,
    (select count(fav_rank) from fact where fact.user_id = u.user_id) as top,
    (select count(*) from vis where vis.user_id = u.user_id and complete) as sets,
    coalesce((select max(shared) from shr where shr.a = u.user_id or shr.b = u.user_id), 0) as shared,
    cast(exists (select 1 from fact where fact.user_id = u.user_id and month((created_at at time zone 'UTC') at time zone 'Europe/Amsterdam') in (9, 10, 11)) as bigint) as autumn
    from users u)"""
_PROGRESS = f"""{_METRICS}, {_OPENED}, lng as materialized (unpivot met on cards, friends, lands, colors, shiny, memos, top, sets, shared, autumn into name metric value value),
  pr as materialized (select user_id, id as reward, least(value, goal) as n, goal, value >= goal as ready from lng join rw using (metric))"""
_COS = """reg as (select user_id, region as v, count(*) as n from fact join item using (item_id) group by all),
  col as materialized (select user_id, v, count(*) as n from (select user_id, case when style = 'mousserend' then 'bubbels' else nullif(color, '') end as v from fact join item using (item_id)) where v is not null group by all),
  siz as materialized (select user_id, count(*) as n from fact group by 1)"""


def _cos(t: str) -> str:
    sq = f"(select sum(n * n) from {t} where user_id = {{u}})"
    return (f"coalesce((select sum(x.n * y.n) from {t} x join {t} y using (v) where x.user_id = a and y.user_id = b)::double "
            f"/ sqrt(({sq.format(u='a')} * {sq.format(u='b')})::double), 0)")


_COSINE = f"""{_COS}, cosn as materialized (select a, b, {_cos('reg')} as region_cos, {_cos('col')} as color_cos,
  coalesce((select n from siz where user_id = a), 0) as size_a, coalesce((select n from siz where user_id = b), 0) as size_b from edge)"""
_POINTS = """pts as (select c_custkey as user_id, c_nationkey, ((c_custkey * 7919) % 35000) / 100.0::double - 175 as lon, ((c_custkey * 104729) % 15000) / 100.0::double - 70 as lat from customer)"""
_EDGE_ROWS = ", ".join(
    f"('{s['id']}', {p}, {r}, {a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)"
    for s in catalogue.packaged("polygons") for p, poly in enumerate(s["p"]) for r, ring in enumerate(poly) for a, b in zip(ring, ring[1:]))
_BOXES = ", ".join(f"('{b['name']}', {b['lon_min']}, {b['lat_min']}, {b['lon_max']}, {b['lat_max']})" for b in catalogue.packaged("boxes"))
_B0 = catalogue.packaged("boxes")[0]
_PINS = catalogue.packaged("pins")
_ICONS = catalogue.packaged("icon_rules")
_ICON_ROWS = ", ".join("('{}', '{}', '(?i){}', {})".format(
    r["country"], r["name"].replace("'", "''"), r["pattern"].replace("'", "''"), str(bool(r["legend"])).lower()) for r in _ICONS)

CHECKS = {
    "slot_fill": oracle(f"with {_FILL} select item_id, set_id, cast(position as bigint) as position from fill", "item", "fact", "users"),
    "catalogue_stored": oracle(f"with {_FILL} select set_id, cast(position as bigint) as position, count(*) as items from fill group by all", "item", "fact", "users"),
    "set_progress": oracle(f"with {_FILL} select user_id, set_id, filled, total, complete from prog", "item", "fact", "users"),
    "set_visible": oracle(f"with {_FILL} select user_id, set_id, filled, total, complete from vis", "item", "fact", "users"),
    "gap_guide": oracle(f"""with {_FILL} select v.user_id, v.set_id, cast(s.position as bigint) as position, s.slot, cast(s.difficulty as bigint) as difficulty, guide as text, price, tip
      from vis v join slots s using (set_id) left join filled f on f.user_id = v.user_id and f.set_id = v.set_id and f.position = s.position where not complete and f.user_id is null""", "item", "fact", "users"),
    "leftovers": oracle(f"with {_FILL} select user_id, item_id from fact where item_id not in (select item_id from fill where part = 1)", "item", "fact", "users"),
    "chapters": oracle("select user_id, country, count(*) as items, strftime(min(fact.created_at), '%Y-%m-%d') as first_at from fact join item using (item_id) group by all", "item", "fact"),
    "reward_metrics": oracle(f"with {_METRICS} select * from met", "item", "fact", "users", "edge"),
    "reward_progress": oracle(f"with {_PROGRESS} select * from pr", "item", "fact", "users", "edge"),
    "due_rewards": oracle(f"with {_PROGRESS} select user_id, reward from pr where ready and (user_id, reward) not in (select (user_id, reward) from opened)", "item", "fact", "users", "edge"),
    "earned_badges": oracle(f"""with {_FILL}, {_OPENED}, fi as (select fact.*, country, region from fact join item using (item_id))
      select user_id, 'b:' || b as badge from users cross join (select unnest({BASICS!r}) as b) union
      select user_id, 'v:' || country from fi union
      select user_id, 'm:' || m from (select user_id, count(*) as n from fact group by 1) cross join (select unnest([10, 25, 50, 100]) as m) where n >= m union
      select user_id, 'e:' || set_id from vis where complete union
      select user_id, 'h:' || region from fi where full_art union
      select user_id, 'p:' || unnest(badges) from opened""", "item", "fact", "users"),
    "icon_coverage": oracle(f"""with ic(country, icon, pattern, legend) as (values {_ICON_ROWS}),
      own as materialized (select distinct user_id, ic.country, ic.icon, true as had from fact join item using (item_id) join ic on regexp_matches(concat_ws(' ', item.maker, item.name), pattern)),
      ch as (select distinct user_id, country from fact join item using (item_id))
      select user_id, country, icon, legend, coalesce(had, false) as owned from ch join ic using (country) left join own using (user_id, country, icon)""", "item", "fact"),
    "viewer_album": oracle("""with n as (select *, row_number() over (partition by user_id order by created_at, fact_id) - 1 as i from fact),
      p as (select user_id, cast(floor(i / 9) as bigint) as page, '[' || string_agg('{"id":' || item_id || ',"tier":"' || tier || '"}', ',' order by i) || ']' as cards from n group by all),
      f as (select a as viewer_id, b as user_id from edge union all select b, a from edge)
      select viewer_id, user_id, page, cards from f join p using (user_id)""", "fact", "edge"),
    "shared_items": oracle(f"with {_KEYED} select a, b, shared from shr", "item", "fact", "edge"),
    "cosine_counts": oracle(f"with {_COSINE} select a, b, round(region_cos, 9) as region_cos, round(color_cos, 9) as color_cos, size_a, size_b from cosn", "item", "fact", "edge"),
    "taste_match": oracle(f"""with {_KEYED}, {_COSINE} select a, b, shared, cast(case when size_a > 0 and size_b > 0 then
      floor((region_cos * 0.5::double + color_cos * 0.25::double + least(1.0::double, shared / greatest(1, least(size_a, size_b)) * 2) * 0.25::double) * 100 + 0.5) else 0 end as bigint) as match
      from cosn join shr using (a, b)""", "item", "fact", "edge"),
    "friend_list": oracle("""with be as (select a as user_id, b as friend_id, created_at from edge union all select b, a, created_at from edge)
      select be.user_id, friend_id, coalesce(nullif(trim(display_name), ''), upper(left(mail, 1)) || substr(split_part(split_part(mail, '@', 1), '.', 1), 2), 'Wijnvriend') as name,
      coalesce(cover_color, 'bordeaux') as cover, (select count(*) from fact where fact.user_id = friend_id) as cards, strftime(be.created_at, '%Y-%m-%d %H:%M:%S') as since
      from be left join users on users.user_id = friend_id""", "fact", "users", "edge"),
    "friend_album": oracle("""with req as (select event_id, user_id as v, user_id * 7 + item_id % 4 + 2 as o from attempt),
      pg as (select user_id, 'set:' || item_id % 5 as page, count(*) as n from attempt where event_type = 'click' group by all),
      st as (select user_id, '{' || string_agg('"' || page || '":' || n, ',' order by page) || '}' as stickers from pg group by 1),
      fr as (select req.*, exists (select 1 from edge where (a = v and b = o) or (a = o and b = v)) as ok from req)
      select event_id, case when ok then 'ok' else 'not_friends' end as status,
      case when ok then coalesce(nullif(trim(display_name), ''), upper(left(mail, 1)) || substr(split_part(split_part(mail, '@', 1), '.', 1), 2), 'Wijnvriend') end as name,
      case when ok then coalesce(cover_color, 'bordeaux') end as cover, case when ok then (select count(*) from fact where fact.user_id = o) end as cards,
      case when ok then stickers end as stickers from fr left join users on users.user_id = o left join st on st.user_id = o""", "fact", "users", "edge", "attempt"),
    "canonical_edges": oracle("""with inv as (select user_id as other, upper(substr(md5(cast(user_id as varchar)), 1, 8)) as code from users),
      acc as (select event_id, ts, user_id, case when event_id % 10 = 0 then 'NOPE' else upper(substr(md5(cast(item_id as varchar)), 1, 8)) end as code from attempt where event_type = 'click'),
      j as (select acc.*, other, least(user_id, other) as a, greatest(user_id, other) as b from acc left join inv using (code)),
      n as (select *, row_number() over (partition by a, b, other is not null and other <> user_id order by ts, event_id) as r from j)
      select event_id, case when other is null then user_id else a end as a, case when other is null then user_id else b end as b, case when other is null then 'invalid' when other = user_id then 'self'
        when r = 1 and (a, b) not in (select (edge.a, edge.b) from edge) then 'ok' else 'already' end as status from n""", "users", "attempt", "edge"),
    # corners as vectors; the edge meets the meridian's plane where the plane's distances of its ends balance
    "point_in_polygon": f"""with pts as (select c_custkey as user_id, radians(((c_custkey * 7919) % 36000) / 100.0::double - 180) as lon, radians(((c_custkey * 104729) % 18000) / 100.0::double - 90) as lat from customer),
      raw(id, polygon, ring, x1, y1, x2, y2) as (values {_EDGE_ROWS}),
      ed as (select id, polygon, ring, radians(x1) as l1, radians(x2) as l2, [cos(radians(y1)) * cos(radians(x1)), cos(radians(y1)) * sin(radians(x1)), sin(radians(y1))] as a,
        cos(radians(y1)) as c1, cos(radians(y2)) as c2, sin(radians(y1)) as z1, sin(radians(y2)) as z2, x1, x2 from raw),
      away as (select id, polygon, atan2(-sum(a[2]), -sum(a[1])) as lon, atan2(-sum(a[3]), sqrt(sum(a[1]) ** 2 + sum(a[2]) ** 2)) as lat from ed where ring = 0 group by all),
      probe as (select p.user_id, k.id, k.polygon, p.lon, p.lat from pts p cross join away k union all select null, id, polygon, lon, lat from away),
      hit as (select user_id, id, polygon, lat, c1 * sin(radians(x1 - degrees(lon))) as s1, c2 * sin(radians(x2 - degrees(lon))) as s2, c1 * cos(l1 - lon) as f1, c2 * cos(l2 - lon) as f2, z1, z2
        from probe join ed using (id, polygon)),
      n as (select user_id, id, polygon, count(*) filter ((s1 > 0) <> (s2 > 0) and abs(s2) * f1 + abs(s1) * f2 > 0
        and (abs(s2) * z1 + abs(s1) * z2) * cos(lat) > (abs(s2) * f1 + abs(s1) * f2) * sin(lat)) % 2 as odd from hit group by all)
      select n.user_id, n.id from n join n o on o.user_id is null and o.id = n.id and o.polygon = n.polygon where n.user_id is not null and n.odd <> o.odd""",
    "within_radius": f"""with {_POINTS}, h as (select user_id, sin(radians(lat - 41.9) / 2) ** 2 + cos(radians(lat)) * cos(radians(41.9)) * sin(radians(lon - 12.5) / 2) ** 2 as h from pts)
      select user_id, round(2 * asin(least(1.0, sqrt(h))), 6) as distance from h where 2 * asin(least(1.0, sqrt(h))) <= 1.5""",
    "bbox_overlap": f"""with {_POINTS}, r as (select cast(floor(lon / 10) * 100 + floor(lat / 10) as bigint) as ring, min(lon) as x0, min(lat) as y0, max(lon) as x1, max(lat) as y1 from pts group by 1),
      bx(box, a, b, c, d) as (values {_BOXES}) select ring, box from r join bx on x1 >= a and x0 <= c and y1 >= b and y0 <= d""",
    "project_box": f"""with {_POINTS}, k as (select cos(radians(({_B0['lat_min']} + {_B0['lat_max']}) / 2)) as c)
      select user_id, round((lon - {_B0['lon_min']}) * (300.0 / (({_B0['lon_max']} - {_B0['lon_min']}) * c)) * c, 4) as x,
      round(({_B0['lat_max']} - lat) * (300.0 / (({_B0['lon_max']} - {_B0['lon_min']}) * c)), 4) as y from pts cross join k""",
    "thin_sequence": """with recursive w as (select c_custkey % 40 as ring, c_custkey as step, round(floor(((c_custkey * 37) % 100 / 100.0::double) / 0.1::double + 0.5) * 0.1::double, 2) as x,
        round(floor(((c_custkey * 53) % 60 / 100.0::double) / 0.1::double + 0.5) * 0.1::double, 2) as y, row_number() over (partition by c_custkey % 40 order by c_custkey) as n from customer),
      s as (select ring, step, x, y, n, x as lx, y as ly, true as keep from w where n = 1 union all
        select w.ring, w.step, w.x, w.y, w.n, case when sqrt((w.x - lx) ** 2 + (w.y - ly) ** 2) < 0.25 then lx else w.x end, case when sqrt((w.x - lx) ** 2 + (w.y - ly) ** 2) < 0.25 then ly else w.y end,
          sqrt((w.x - lx) ** 2 + (w.y - ly) ** 2) >= 0.25 from s join w on w.ring = s.ring and w.n = s.n + 1),
      kp as (select * from s where keep and ring in (select ring from s where keep group by 1 having count(*) >= 4)),
      ends as (select ring, max(step) as last, arg_min(x, step) as x0, arg_min(y, step) as y0, arg_max(x, step) as x1, arg_max(y, step) as y1 from kp group by 1)
      select ring, step, x as lon, y as lat from kp union all select ring, last + 1, x0, y0 from ends where x0 <> x1 or y0 <> y1""",
    "pin_lookup": oracle(f"""with {_FILL}, sp(set_id, lat, lon) as (values {', '.join(f"('{p['set_id']}', {p['lat']}::double, {p['lon']}::double)" for p in _PINS['sets'])}),
      lp(set_id, slot, lat, lon) as (values {', '.join(f"('{p['set_id']}', '{p['slot']}', {p['lat']}::double, {p['lon']}::double)" for p in _PINS['slots'])})
      select item_id, fill.set_id, fill.slot, coalesce(lp.lat, sp.lat) as lat, coalesce(lp.lon, sp.lon) as lon from fill left join lp on lp.set_id = fill.set_id and lp.slot = fill.slot
      left join sp on sp.set_id = fill.set_id where part = 1 and coalesce(lp.lat, sp.lat) is not null""", "item", "fact", "users"),
}
