"""A cover of cells gives the answer of the full ray test, with few tests."""

import json
import random

from pyspark.sql import functions as F

from curbline.operators import cover, geo

STAR = """transform(sequence(0, {n}), i -> array(
    {x} + (0.3 + 0.1 * sin(7 * (i % {n}) * 2 * pi() / {n})) * cos((i % {n}) * 2 * pi() / {n}),
    {y} + (0.3 + 0.1 * sin(7 * (i % {n}) * 2 * pi() / {n})) * sin((i % {n}) * 2 * pi() / {n})))"""


def stars(spark, many, n, wide):
    """Star-shaped rings of n + 1 points, one in each square of a field ``wide`` squares across."""
    ring = STAR.format(n=n, x=f"(id % {wide})", y=f"(id DIV {wide})")
    shape = spark.range(many).selectExpr("concat('S', id) AS name", f"array({ring}) AS rings")
    return geo.ref_neighborhoods(shape.select("name", F.to_json(F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates"))).alias("geometry")))


def names(df):
    return sorted((r["latitude"] or 0.0, r["longitude"] or 0.0, r["polygon_name"] or "") for r in df.collect())


def test_a_thousand_polygons_of_five_thousand_points(spark):
    polygons = stars(spark, 1000, 5000, 40)
    rng = random.Random(9)
    field = [(rng.uniform(-0.5, 25.5), rng.uniform(-0.5, 40.5)) for _ in range(60_000)]
    places = spark.createDataFrame(field, "latitude double, longitude double")
    over = cover.cover(polygons)
    asked = cover.located(places, over)
    tests, whole = asked.where("NOT whole").count(), asked.where("whole").count()
    assert tests < 6_000 and whole > 10_000
    assert over.rows.agg(F.sum(F.size("edges"))).first()[0] < 1000 * 5000 * 1.5  # an edge lies in about one row
    some = places.limit(1500)
    assert names(cover.tag(some, over)) == names(geo.tag_polygon(some, polygons))


def test_odd_shapes_equal_the_full_test(spark):
    rng = random.Random(3)
    square = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    hole = [[0.25, 0.25], [0.75, 0.25], [0.75, 0.75], [0.25, 0.75], [0.25, 0.25]]
    shapes = {
        "holed": [square, hole],
        "open": [[[2, 0], [3, 0.1], [3.2, 1], [2, 1.1]]],
        "flat": [[[0, 2], [5, 2], [0, 2]]],
        "point": [[[4, 4]]],
        "bow": [[[-3, -3], [-1, -1], [-1, -3], [-3, -1], [-3, -3]]],
        "wild": [(lambda p: [*p, p[0]])([[rng.uniform(-4, 6), rng.uniform(-4, 6)] for _ in range(40)])],
        "sliver": [[[-50, 3], [70, 3.001], [70, 3.002], [-50, 3]]],
        "empty": [],
    }
    rows = [(name, json.dumps({"type": "Polygon", "coordinates": rings})) for name, rings in shapes.items()]
    polygons = geo.ref_neighborhoods(spark.createDataFrame([*rows, ("a second", rows[0][1])], "name string, geometry string"))
    grid = [x / 4 for x in range(-16, 25)]
    places = [(y, x) for y in grid for x in grid] + [(rng.uniform(-4, 6), rng.uniform(-4, 6)) for _ in range(3000)]
    places += [(3.0005, rng.uniform(-60, 80)) for _ in range(50)] + [(None, 1.0), (1.0, None), (0.5, 0.1), (0.5, 0.1)]
    frame = spark.createDataFrame(places, "latitude double, longitude double")
    for each in [F.lit(True), *[F.col("neighborhood_name") == n.upper() for n in shapes]]:
        these = polygons.where(each)
        assert names(cover.tag(frame, cover.cover(these))) == names(geo.tag_polygon(frame, these))


def test_empty_tables(spark):
    none = stars(spark, 0, 5, 1)
    places = spark.createDataFrame([(0.0, 0.0), (None, None)], "latitude double, longitude double")
    assert names(cover.tag(places, cover.cover(none))) == [(0.0, 0.0, ""), (0.0, 0.0, "")]
    assert cover.tag(places.limit(0), cover.cover(stars(spark, 2, 5, 2))).count() == 0
