"""Containment on the sphere: poles, the date line, and turned copies of one polygon."""

import math
import random

import numpy as np

from curatorium.operators import geo

SHAPE = "id string, p array<array<array<array<double>>>>"


def inside(spark, points, shapes):
    got = geo.point_in_polygon(spark.createDataFrame(points, "n int, lon double, lat double"), spark.createDataFrame(shapes, SHAPE))
    return sorted((r["n"], r["id"]) for r in got.collect())


def closed(ring):
    return [list(map(float, p)) for p in [*ring, ring[0]]]


def test_poles_and_date_line(spark):
    shapes = [
        ("north", [[closed([(0, 70), (90, 70), (180, 70), (-90, 70)])]]),
        ("south", [[closed([(10, -60), (100, -60), (-170, -60), (-80, -60)])]]),
        ("line", [[closed([(170, -10), (-170, -10), (-170, 10), (170, 10)]), closed([(178, -2), (-178, -2), (-178, 2), (178, 2)])]]),
        ("two", [[closed([(0, 0), (10, 0), (10, 10), (0, 10)])], [closed([(30, 0), (40, 0), (40, 10), (30, 10)])]]),
    ]
    points = [(0, 45.0, 90.0), (1, 33.0, 80.0), (2, 45.0, 71.0), (3, 0.0, 69.0), (4, 0.0, -90.0), (5, 55.0, -70.0), (6, 55.0, -50.0),
              (7, 180.0, 5.0), (8, -180.0, 5.0), (9, 179.0, 0.0), (10, 165.0, 0.0), (11, -175.0, -9.0), (12, -0.5, 3.0), (13, 5.0, 10.02), (14, 35.0, 5.0),
              (15, 20.0, 5.0), (16, -135.0, 89.9), (17, 540.0, 5.0)]
    # the arc between two points at 70 degrees runs north of 70, so 71 at 45 degrees east is outside; 10.02 at 5 degrees is inside
    assert inside(spark, points, shapes) == [
        (0, "north"), (1, "north"), (4, "south"), (5, "south"), (7, "line"), (8, "line"), (11, "line"), (13, "two"), (14, "two"), (16, "north"), (17, "line")]


def test_turning_the_sphere_changes_nothing(spark):
    draw = random.Random(4)
    ring = [(a, 20 + 12 * draw.random()) for a in sorted(draw.uniform(0, 360) for _ in range(9))]  # around a centre, by angle and distance
    spots = [(draw.uniform(0, 360), draw.uniform(0, 60)) for _ in range(150)]

    def vector(angle, away):
        a, d = math.radians(angle), math.radians(away)
        return np.array([math.sin(d) * math.cos(a), math.sin(d) * math.sin(a), math.cos(d)])

    def turned(v, m):
        x, y, z = m @ v
        return math.degrees(math.atan2(y, x)), math.degrees(math.asin(max(-1, min(1, z))))

    want = None
    for _ in range(8):
        m, _ = np.linalg.qr(np.array([[draw.gauss(0, 1) for _ in range(3)] for _ in range(3)]))
        m = m * np.sign(np.linalg.det(m))
        shape = [("x", [[closed([turned(vector(*p), m) for p in ring])]])]
        got = inside(spark, [(i, *turned(vector(*p), m)) for i, p in enumerate(spots)], shape)
        want = want or got
        assert got == want
    assert 20 < len(want) < 130
