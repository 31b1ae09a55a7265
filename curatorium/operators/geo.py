"""Points and polygons on the sphere; map boxes, rings and their thinning on the longitude/latitude plane."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from curatorium.operators.bounded import small_or_shuffled
from curatorium.operators.ordered import Automaton, compose

# ---- fixed values ----
VIEW_RADIUS = 1.5        # radians
SNAP_STEP, MIN_DISTANCE = 0.1, 0.25
MIN_RING = 4
# ---- end of fixed values ----

CELL = 10.0  # degrees; only speeds up, never decides


def polygon_edges(shapes: DataFrame) -> DataFrame:
    """Shapes with nested rings -> one row per polygon with the edges of all rings, whether the north pole is inside, the grid
    columns it touches and its range of latitudes.

    Edges are the shorter great-circle arcs between neighbouring points. Inside is the side away from the antipode of the
    outer ring's mean direction (of the south pole, if the points cancel out), so a polygon must fit into some half of the sphere."""
    def edge(s: Column, e: Column) -> Column:
        ends = {"x1": s[0], "y1": s[1], "x2": e[0], "y2": e[1]}
        turns = {f"{f.__name__}{n}": f(F.radians(p[1])) for n, p in ((1, s), (2, e)) for f in (F.sin, F.cos)}
        return F.struct(*[c.cast("double").alias(n) for n, c in (ends | turns).items()])

    edges = F.flatten(F.transform("rings", lambda r: F.zip_with(
        F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda s, e: edge(s, e))))
    polygon = shapes.select("id", F.posexplode("p").alias("polygon", "rings")).select(
        "id", "polygon", F.slice(F.col("rings")[0], 1, F.size(F.col("rings")[0]) - 1).alias("_outer"), edges.alias("edges"))
    parts = {
        "_x": lambda p: F.cos(F.radians(p[1])) * F.cos(F.radians(p[0])),
        "_y": lambda p: F.cos(F.radians(p[1])) * F.sin(F.radians(p[0])), "_z": lambda p: F.sin(F.radians(p[1]))}
    mean = polygon.withColumns({
        n: F.aggregate(F.transform("_outer", f), F.lit(0.0), lambda total, v: total + v) for n, f in parts.items()})
    size = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y") + F.col("_z") * F.col("_z"))
    clear = size > 1e-9
    outside = mean.withColumns({
        "_lon": F.when(clear, F.degrees(F.atan2(-F.col("_y"), -F.col("_x")))).otherwise(0.0),
        "_lat": F.when(clear, F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.col("_z") / size))))).otherwise(-90.0)})
    poled = outside.withColumn("north", crossings(F.col("edges"), F.col("_lon"), F.col("_lat")) % 2)
    south = (crossings(F.col("edges"), F.col("_lon"), F.lit(-90.0)) + F.col("north")) % 2

    def span(e: Column) -> Column:
        """Latitudes of an arc: those of its ends, or the great circle's turning point if that lies between them."""
        turn = F.cos(F.radians(e["x1"] - e["x2"]))
        along = e["sin1"] * e["sin2"] + e["cos1"] * e["cos2"] * turn
        first, second = e["sin2"] - along * e["sin1"], e["sin1"] - along * e["sin2"]
        normal = e["cos1"] * e["cos2"] * F.sin(F.radians(e["x2"] - e["x1"]))
        top = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(normal) / F.sqrt(F.greatest(F.lit(1e-300), 1 - along * along)))))
        return F.struct(
            F.when((first < 0) & (second < 0), -top).otherwise(F.least(e["y1"], e["y2"])).alias("low"),
            F.when((first > 0) & (second > 0), top).otherwise(F.greatest(e["y1"], e["y2"])).alias("high"))

    def columns(e: Column) -> Column:
        begin, turn = F.pmod(e["x1"] + 180, F.lit(360.0)), F.pmod(e["x2"] - e["x1"] + 180, F.lit(360.0)) - 180
        return F.transform(F.sequence(_row(F.least(begin, begin + turn)), _row(F.greatest(begin, begin + turn))),
                           lambda c: F.pmod(c, F.lit(_COLUMNS)).cast("int"))

    spans = F.transform("edges", span)
    # going north or south from an inner point one meets an edge, so the edges' columns are all there are
    return poled.select(
        "id", "polygon", "edges", "north", F.array_distinct(F.flatten(F.transform("edges", columns))).alias("columns"),
        F.when(south == 1, -90.0).otherwise(F.array_min(F.transform(spans, lambda s: s["low"]))).alias("y_min"),
        F.when(F.col("north") == 1, 90.0).otherwise(F.array_max(F.transform(spans, lambda s: s["high"]))).alias("y_max"))


_COLUMNS = int(360 / CELL)


def _row(c: Column) -> Column:
    return F.floor(c / CELL).cast("int")


def crossings(edges: Column, lon: Column, lat: Column) -> Column:
    """How many edges the meridian crosses between a point and the north pole.

    With s the distance of an end from the meridian's plane, an edge crosses the plane where the signs differ, at
    A |sB| + B |sA|; that counts if it lies on the point's side of the earth's axis and north of the point."""
    def crosses(e: Column) -> Column:
        to1, to2 = F.radians(e["x1"] - lon), F.radians(e["x2"] - lon)
        s1, s2 = e["cos1"] * F.sin(to1), e["cos2"] * F.sin(to2)
        ahead = F.abs(s2) * e["cos1"] * F.cos(to1) + F.abs(s1) * e["cos2"] * F.cos(to2)
        up = F.abs(s2) * e["sin1"] + F.abs(s1) * e["sin2"]
        north = (ahead > 0) & (up * F.cos(F.radians(lat)) > ahead * F.sin(F.radians(lat)))
        return F.when(((s1 > 0) != (s2 > 0)) & north, 1).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda acc, e: acc + crosses(e))


def point_in_polygon(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """(point columns, id) for every shape a point lies in, on the sphere; a point in several polygons of a shape comes several times.

    A point is inside if the meridian to the north pole crosses an odd number of edges, or an even one where the pole itself is
    inside: right over the poles and across the date line. Polygons are spread over the grid cells they can touch and joined on
    the cell, an equi join; a cell row carries the latitudes only. The edges of a polygon come by its number to
    the points that are left.
    """
    polygons = polygon_edges(shapes)
    cells = polygons.select("id", "polygon", "y_min", "y_max", F.explode("columns").alias("cx")).select(
        "*", F.explode(F.sequence(_row(F.col("y_min")), _row(F.col("y_max")))).alias("cy"))
    near = points.withColumns({
        "cx": F.pmod(_row(F.pmod(F.col("lon") + 180, F.lit(360.0))), F.lit(_COLUMNS)).cast("int"), "cy": _row(F.col("lat"))}).join(
        small_or_shuffled(cells), ["cx", "cy"]).where("lat between y_min - 1e-9 and y_max + 1e-9")
    rings = small_or_shuffled(polygons.select("id", "polygon", "edges", "north"))
    found = near.join(rings, ["id", "polygon"])
    return found.where((crossings(F.col("edges"), F.col("lon"), F.col("lat")) + F.col("north")) % 2 == 1).select(*points.columns, "id")


def angular_distance(lon: Column, lat: Column, lon0: float, lat0: float) -> Column:
    """Great-circle distance in radians."""
    dlat, dlon = F.radians(lat - lat0) / 2, F.radians(lon - lon0) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat)) * math.cos(math.radians(lat0)) * F.sin(dlon) * F.sin(dlon)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def within_radius(points: DataFrame, lon0: float, lat0: float, radius: float = VIEW_RADIUS) -> DataFrame:
    return points.withColumn("distance", angular_distance(F.col("lon"), F.col("lat"), lon0, lat0)).where(F.col("distance") <= radius)


def ring_boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.min("lon").alias("x_min"), F.min("lat").alias("y_min"), F.max("lon").alias("x_max"), F.max("lat").alias("y_max"))


def box_overlap(rings: DataFrame, boxes: list[dict]) -> DataFrame:
    """Which map boxes each ring's box touches; the boxes are a handful and travel in the plan."""
    table = F.array(*[F.struct(*[F.lit(b[k]).alias(k) for k in ("name", "lon_min", "lat_min", "lon_max", "lat_max")]) for b in boxes])
    touching = F.filter(table, lambda b: ~(
        (F.col("x_max") < b["lon_min"]) | (F.col("x_min") > b["lon_max"]) | (F.col("y_max") < b["lat_min"]) | (F.col("y_min") > b["lat_max"])))
    return rings.withColumn("box", F.explode(touching)).withColumn("box", F.col("box.name"))


def project(lon: Column, lat: Column, box: dict, width: float) -> tuple[Column, Column]:
    """Map x, y in a box drawn `width` wide; longitude shrinks with the cosine of the middle latitude."""
    c = math.cos(math.radians((box["lat_min"] + box["lat_max"]) / 2))
    k = width / ((box["lon_max"] - box["lon_min"]) * c)
    return (lon - box["lon_min"]) * k * c, (box["lat_max"] - lat) * k


def snap(c: Column, step: float = SNAP_STEP) -> Column:
    return F.round(F.floor(c / step + 0.5) * step, 2)


class _Thinning(Automaton):
    """The last kept point. A segment that one ring fills is entered either from a snapped point too close to its first point, of
    which there are few, or from anywhere else (no number): then its first point is kept."""

    start = (math.nan, math.nan)

    def __init__(self, min_distance: float, step: float):
        self.min_distance, self.reach, self.step_size = min_distance, math.ceil(min_distance / step) + 1, step

    def entries(self, row: tuple) -> np.ndarray:
        near = np.arange(-self.reach, self.reach + 1)
        points = np.array([(_snapped(row[0] + i * self.step_size, self.step_size), _snapped(row[1] + j * self.step_size, self.step_size))
                           for i in near for j in near])
        return np.concatenate([points[np.hypot(*(points - row).T) < self.min_distance], [self.start]])

    def advance(self, states: np.ndarray, row: tuple) -> np.ndarray:
        close = np.hypot(row[0] - states[:, 0], row[1] - states[:, 1]) < self.min_distance
        return np.where(close[:, None], states, np.array([row], float))

    def leave(self, entries: np.ndarray, ends: np.ndarray, state: tuple, rows: int) -> tuple:
        same = np.flatnonzero((entries == np.array(state)).all(1))
        return tuple(ends[same[0] if len(same) else -1].tolist())

    def step(self, state: tuple, row: tuple) -> tuple[tuple, tuple]:
        if math.hypot(row[0] - state[0], row[1] - state[1]) < self.min_distance:
            return state, (False,)
        return (row[0], row[1]), (True,)


def _snapped(v: float, step: float) -> float:
    return round(math.floor(v / step + 0.5) * step, 2) + 0.0


def thin_rings(points: DataFrame, key: str, order: str, min_distance: float = MIN_DISTANCE, parts: int | None = None) -> DataFrame:
    """Snapped ring points, each at least `min_distance` from the last kept one; rings are closed and
    those left with fewer than four points dropped. Greedy, so it replays points in order: two passes over the points."""
    # adding zero turns -0.0 into 0.0
    snapped = points.select(key, order, (snap(F.col("lon")) + 0.0).alias("px"), (snap(F.col("lat")) + 0.0).alias("py"))
    kept = compose(snapped, [key], [order, "px", "py"], {"x": F.col("px"), "y": F.col("py")}, _Thinning(min_distance, SNAP_STEP),
                   "keep boolean", parts).where("keep")
    xy = F.struct(F.col("px").alias("x"), F.col("py").alias("y"))
    rings = kept.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(xy, order).alias("head"), F.max_by(xy, order).alias("tail"), F.max(order).alias("end")
    ).where(F.col("n") >= MIN_RING)
    closing = rings.where(F.col("head") != F.col("tail")).select(
        key, (F.col("end") + 1).alias(order), F.col("head.x").alias("px"), F.col("head.y").alias("py"))
    return kept.join(rings.select(key), key, "left_semi").select(key, order, "px", "py").unionByName(closing).withColumnsRenamed(
        {"px": "lon", "py": "lat"})


def pin_lookup(fills: DataFrame, set_pins: DataFrame, slot_pins: DataFrame) -> DataFrame:
    """A slot's own pin, else its set's pin."""
    own = slot_pins.toDF("set_id", "slot", "slot_lat", "slot_lon")
    of_set = set_pins.toDF("set_id", "set_lat", "set_lon")
    return fills.join(small_or_shuffled(own), ["set_id", "slot"], "left").join(small_or_shuffled(of_set), "set_id", "left").withColumns({
        "lat": F.coalesce("slot_lat", "set_lat"), "lon": F.coalesce("slot_lon", "set_lon")}).where(F.col("lat").isNotNull()).drop(
        "slot_lat", "slot_lon", "set_lat", "set_lon")
