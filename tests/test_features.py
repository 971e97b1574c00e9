import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from curbline.functions.numeric import EARTH_RADIUS_M
from curbline.operators import features

ID = "case_enquiry_id"
DAY = dt.timedelta(days=1)


def distance(a, b):
    (la, lo), (lb, lp) = a, b
    p, q = math.radians(la), math.radians(lb)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lp - lo) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(h))


def make(n=300, seed=1, lat=42.3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rnd.random() < 0.33
        opened = dt.datetime(2024, 1, 1) + DAY * rnd.randrange(120) + dt.timedelta(hours=rnd.choice([0, 0, 5]))
        closed = None if rnd.random() < 0.4 else opened + dt.timedelta(hours=rnd.choice([-5, 0, 30, 900]))
        place = (lat, -71.1) if hot else (lat + rnd.randrange(12) * 0.0001, -71.1 + rnd.randrange(12) * 0.0001)
        if rnd.random() < 0.05:
            place = (None, None)
        hood = None if rnd.random() < 0.05 else "A" if hot else rnd.choice("BC")
        rows.append((i, hood, rnd.choice(["x", "y"]), opened, closed, *place))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, f"{ID} long, neighborhood string, department string, open_dt timestamp, closed_dt timestamp, latitude double, longitude double")


def brute(rows):
    out = {}
    for i, n, d, t, _c, la, lo in rows:
        before = [r for r in rows if r[3] < t]
        out[i] = (
            sum(r[1] == n and n is not None and r[3] >= t - 14 * DAY and (r[4] is None or r[4] > t) for r in before),
            sum(r[2] == d and r[3] >= t - 30 * DAY for r in before),
            sum(la is not None and r[5] is not None and r[3] >= t - 90 * DAY and distance((la, lo), (r[5], r[6])) <= 30 for r in before),
        )
    return out


@pytest.mark.parametrize("hot_rows", [1_000_000, 150, 1])
def test_counts_match_brute_force(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(features.count_open, "__defaults__", (hot_rows,))
    rows = make()
    got = features.workload_counts(frame(spark, rows)).collect()
    want = brute(rows)
    found = {r[ID]: (r.neigh_open_14d, r.dept_pressure_30d, r.prev_repeat_90d_30m) for r in got}
    assert {i: found.get(i, (0, 0, 0)) for i in want} == want


def test_hot_key_table_beyond_the_broadcast_size(spark, monkeypatch):
    monkeypatch.setattr(features, "SMALL_ROWS", 0)
    monkeypatch.setattr(features.count_open, "__defaults__", (1,))
    rows = make(120, 5)
    found = {r[ID]: r.prev_repeat_90d_30m for r in features.prev_repeat(frame(spark, rows)).collect()}
    assert found == {i: w[2] for i, w in brute(rows).items()}


def test_place_pairs_add_up_to_the_counts(spark):
    rows = make(200, 9)
    pairs = features.place_repeats(frame(spark, rows)).agg(F.sum("n_pairs")).first()[0]
    assert pairs == sum(w[2] for w in brute(rows).values())


@pytest.mark.parametrize("lat", [0.0, 42.3, -60.0, 85.0])
def test_near_places(spark, lat):
    rnd = random.Random(4)
    pts = list({(lat + rnd.uniform(-1, 1) * 0.0008, rnd.choice([0.0, 179.9999, -179.9999]) + rnd.uniform(-1, 1) * 0.00009) for _ in range(80)})
    got = features.near_places(spark.createDataFrame(pts, "lat double, lon double"), 30.0).collect()
    want = {(a, b) for a in pts for b in pts if distance(a, b) <= 30.0}
    assert {((r.lat, r.lon), (r.near_lat, r.near_lon)) for r in got} == want and len(got) == len(want)


def test_label_and_open_view(spark):
    cases = frame(spark, make(50, 2)).withColumn("case_status", F.when(F.col("closed_dt").isNull(), "Open").otherwise("Closed"))
    cases = cases.withColumns({"on_time": F.lit("ONTIME"), "reason": F.lit("r")})
    assert features.train_features(cases).agg(F.min("y_priority")).first()[0] == 1
    assert features.open_features(cases).count() == cases.where("case_status = 'Open'").count()
