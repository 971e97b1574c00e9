"""Crowded spots: equal to brute force, few questions, whole cells only where they lie inside."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from curbline.operators import features
from curbline.operators.quadtree import METRES_PER_DEGREE, Quadtree
from curbline.session import cut

CASE = "case_enquiry_id long, latitude double, longitude double, neighborhood string, department string, open_dt timestamp, closed_dt timestamp"


def metres(a, b):
    (y, x), (v, u) = a, b
    p, q = math.radians(y), math.radians(v)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(u - x) / 2) ** 2
    return 2 * METRES_PER_DEGREE * 180 / math.pi * math.asin(math.sqrt(h))


def spot(draw, n, lat, lon, spread):
    """Places within ``spread`` metres north, south, east and west."""
    wide = METRES_PER_DEGREE * math.cos(math.radians(lat))
    out = set()
    while len(out) < n:
        x = lon + draw.uniform(-spread, spread) / wide
        out.add((lat + draw.uniform(-spread, spread) / METRES_PER_DEGREE, x - 360 if x >= 180 else x + 360 if x < -180 else x))
    return sorted(out)


@pytest.mark.parametrize("lat, lon", [(42.36, -71.06), (-10.0, 179.9999), (71.0, -180.0), (0.0, 0.0), (88.0, 12.0)])
def test_near_equals_brute_force(spark, lat, lon):
    draw = random.Random(lat)
    points = spot(draw, 260, lat, lon, 40) + spot(draw, 60, lat, lon, 0.01) + spot(draw, 30, lat + 0.1, lon, 200)
    tree = Quadtree(cut(spark.createDataFrame(points, "lat double, lon double")), 30.0, many=4)
    singles, cells = tree.near()
    assert len(tree.crowded) > 3
    of_cell = {}
    for r in tree.keys_of_places().collect():
        of_cell.setdefault(r["k"], set()).add((r["lat"], r["lon"]))
    got = {p: [] for p in points}
    for r in singles.collect():
        got[r["lat"], r["lon"]].append((r["near_lat"], r["near_lon"]))
    for r in cells.collect():
        got[r["lat"], r["lon"]] += of_cell.get(r["k"], ())
    for p in points:
        assert len(got[p]) == len(set(got[p]))
        assert set(got[p]) == {q for q in points if metres(p, q) <= 30}


def cases(spark, draw, points, n):
    rows = []
    for k in range(n):
        y, x = draw.choice(points)
        rows.append((k, y, x, "N", "D", dt.datetime(2024, 1, 1) + dt.timedelta(hours=draw.randrange(5000)), None))
    rows += [(n, None, 1.0, "N", "D", dt.datetime(2024, 1, 1), None), (n + 1, *points[0], "N", "D", None, None)]
    return rows, spark.createDataFrame(rows, CASE)


def test_repeats_in_a_crowded_spot_equal_brute_force(spark):
    draw = random.Random(7)
    points = spot(draw, 150, 42.36, -71.06, 35) + spot(draw, 10, 42.4, -71.1, 60)
    rows, frame = cases(spark, draw, points, 700)
    got = {
        r["case_enquiry_id"]: r["prev_repeat_90d_30m"]
        for r in features.workload_counts(frame, ("place",), many=6).collect()
    }
    for k, y, x, _, _, at, _ in rows[:700]:
        want = sum(
            1 for _, v, u, _, _, t, _ in rows[:700]
            if at - dt.timedelta(days=90) <= t < at and metres((y, x), (v, u)) <= 30
        )
        assert got.get(k, 0) == want
    plain = features.workload_counts(frame, ("place",)).collect()
    assert {r[0]: r[1] for r in plain} == got


def test_questions_in_a_crowded_spot_are_few(spark):
    """20 000 places within 30 m of each other: not 20 000 questions for each place."""
    draw = random.Random(3)
    points = spot(draw, 20_000, 42.36, -71.06, 10)
    tree = Quadtree(cut(spark.createDataFrame(points, "lat double, lon double")), 30.0)
    singles, cells = tree.near()
    assert singles.count() + cells.count() < 20_000 * 20  # all lie within the circle: a few cells each
    wide = spot(draw, 20_000, 42.36, -71.06, 30)
    tree = Quadtree(cut(spark.createDataFrame(wide, "lat double, lon double")), 30.0, many=16)
    keys = [x.groupBy("lat", "lon").count().agg(F.max("count"), F.avg("count")).first() for x in tree.near()]
    assert sum(k[1] for k in keys) < 1200 and max(k[0] for k in keys) < 2000


def test_ordinary_places_ask_no_cell(spark):
    points = spot(random.Random(1), 50, 10, 10, 500)
    keys, cells = features.near_keys(cut(spark.createDataFrame(points, "lat double, lon double")), 30.0)
    assert cells is None and keys.where("k LIKE 'cell%'").isEmpty()
    assert features.near_keys(cut(spark.createDataFrame([], "lat double, lon double")), 30.0)[0].isEmpty()
