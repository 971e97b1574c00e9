import datetime as dt

import pytest
from pyspark.sql import functions as F

from curbline.functions import clock, labels, numeric, text
from curbline.operators import filters, geo, metrics, model, requests

D = dt.date


def volume(spark, days):
    return spark.createDataFrame(list(days.items()), "date date, daily_volume long")


def test_weeks_end_on_monday(spark):
    v = volume(spark, {D(2024, 1, 1): 1, D(2024, 1, 2): 2, D(2024, 1, 8): 4, D(2024, 1, 9): 8, D(2024, 1, 10): 0})
    sound = {r.week_label: r.volume for r in metrics.weekly_history(v, parity=False).collect()}
    assert sound == {D(2024, 1, 1): 1, D(2024, 1, 8): 6}  # the week to the 15th is not complete
    parity = {r.week_label: r.volume for r in metrics.weekly_history(v).collect()}
    assert parity == sound
    full = volume(spark, {D(2024, 1, 2): 2, D(2024, 1, 8): 4})
    assert metrics.weekly_history(full).count() == 0 and metrics.weekly_history(full, parity=False).count() == 1


def test_months_are_dense(spark):
    v = volume(spark, {D(2023, 11, 5): 3, D(2024, 2, 1): 4})
    got = [(r.month_start, r.volume) for r in metrics.monthly_volume(v).orderBy("month_start").collect()]
    assert got == [(D(2023, 11, 1), 3), (D(2023, 12, 1), 0), (D(2024, 1, 1), 0), (D(2024, 2, 1), 4)]
    assert metrics.monthly_volume(v.limit(0)).count() == 0


def months(spark, values):
    rows = [(D(2022 + (m // 12), m % 12 + 1, 1), v) for m, v in enumerate(values)]
    return spark.createDataFrame(rows, "month_start date, volume long")


def forecasts(df):
    return [(r.month_start, r.forecast, r.method) for r in metrics.forecast(df).orderBy("month_start").collect()]


def test_forecast_picks_the_method(spark):
    assert forecasts(months(spark, []).limit(0)) == []
    one = forecasts(months(spark, [7]))
    assert [f for _, f, _ in one] == [7] * 6 and one[0][2] == "trend" and one[0][0] == D(2022, 2, 1)
    falling = forecasts(months(spark, [9, 5]))
    assert [f for _, f, _ in falling] == [1, 0, 0, 0, 0, 0]
    seasonal = forecasts(months(spark, list(range(1, 13))))
    assert [f for _, f, _ in seasonal] == [1, 2, 3, 4, 5, 6] and seasonal[0][2] == "seasonal"


def test_forecast_uses_recent_months_only_without_a_long_series(spark):
    none, short, long = months(spark, [1]).limit(0), months(spark, [3]), months(spark, [8])
    assert {r.forecast for r in metrics.forecast(none, recent=short).collect()} == {3}
    assert {r.forecast for r in metrics.forecast(long, recent=short).collect()} == {8}


def test_seasonal_falls_back_to_last(spark):
    df = months(spark, [1, 2, 3])
    got = [r.forecast for r in metrics.seasonal_forecast(df).orderBy("month_start").collect()]
    assert got == [3] * 6


def test_month_of_year_flags(spark):
    got = {r.month_num: (r.month_total, r.has_data) for r in metrics.month_seasonality(volume(spark, {D(2024, 3, 1): 5})).collect()}
    assert got[3] == (5, True) and got[4] == (0, False) and len(got) == 12


def test_aggregates_of_nothing(spark):
    cols = "date date, neighborhood string, department string, reason string, source string, total_cases long, open_cases long, closed_cases long, sla_eligible_cases long, sla_met_cases long, avg_resolution_hrs double"
    empty = spark.createDataFrame([], cols)
    assert metrics.sla_rate(empty).first()[0] is None
    assert metrics.avg_resolution(empty).first().avg_resolution_days is None
    for df in (metrics.sla_by_dept(empty), metrics.volume_by(empty, "source"), metrics.resolution_by_source(empty), metrics.topic_seasonality(empty)):
        assert df.count() == 0


def test_source_means_differ(spark):
    cols = "date date, source string, closed_cases long, avg_resolution_hrs double"
    df = spark.createDataFrame([(D(2024, 1, 1), "app", 1, 10.0), (D(2024, 1, 2), "app", 3, 2.0)], cols)
    assert metrics.resolution_by_source(df).first().resolution_hours == 4.0
    assert metrics.resolution_by_source(df, weighted=False).first().resolution_hours == 12.0


def test_labels(spark):
    df = spark.createDataFrame([(" a ",), (" ",), (None,)], "x string")
    got = df.select(labels.norm_upper("x"), labels.norm_unknown("x"), labels.norm_missing("x"), labels.norm_none("x")).collect()
    miss = labels.MISSING_NEIGHBORHOOD
    assert [tuple(r) for r in got] == [("A", "a", "a", " a "), ("", "", miss, " "), (None, "Unknown", miss, "None")]


@pytest.mark.parametrize("s, band", [(0.9, "high"), (0.8999, "medium"), (0.7, "medium"), (0.69, "low"), (None, "low")])
def test_bands(spark, s, band):
    assert spark.createDataFrame([(s,)], "s double").select(labels.priority_band("s")).first()[0] == band


def test_safe_casts(spark):
    df = spark.createDataFrame([("TRUE", "2024-01-01"), ("yes", "x"), ("1", None), (" false ", "2024-02-30")], "b string, t string")
    got = [tuple(r) for r in df.select(numeric.safe_bool("b"), numeric.safe_ts("t")).collect()]
    assert got == [(True, dt.datetime(2024, 1, 1)), (None, None), (None, None), (False, None)]


def test_whole_days_truncate_toward_zero(spark):
    t = "timestamp'2024-01-02 00:00:00'"
    row = spark.sql(f"select {t} a, {t} + interval 47 hours b, {t} - interval 23 hours c, cast(null as timestamp) d")
    got = row.select(clock.whole_days("a", "b"), clock.whole_days("a", "c"), clock.whole_days("a", "d")).first()
    assert tuple(got) == (1, 0, None)


def test_local_dates_across_dst(spark):
    df = spark.createDataFrame([("2024-01-01 03:00:00",), ("2024-03-10 06:59:00",), ("2024-03-11 03:59:00",), ("2024-03-11 04:00:00",)], "t string")
    got = [r[0] for r in df.select(clock.local_date(F.col("t").cast("timestamp"))).collect()]
    assert got == [D(2023, 12, 31), D(2024, 3, 10), D(2024, 3, 10), D(2024, 3, 11)]


def test_clean_nan(spark):
    df = spark.createDataFrame([(float("nan"), [1.0, float("inf")], 1), (2.0, None, 2)], "x double, xs array<double>, n int")
    got = [tuple(r) for r in numeric.clean_nan(df).collect()]
    assert got == [(None, [1.0, None], 1), (2.0, None, 2)]


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"a": "x", "b": null, "c": 3}', '{"a":"x","c":"3"}'), ('[{"a": 1}, {"b": 2}]', '{"a":"1"}'),
        ("[]", "{}"), ('["s"]', "{}"), ("null", "{}"), ("oops", "{}"), (None, "{}"),
    ],
)
def test_entities(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "j string")
    assert df.select(text.sorted_json(text.entity_map("j"))).first()[0] == want


def test_strip_fences_and_fingerprint(spark):
    df = spark.createDataFrame([("```sql\nSELECT  1\n```",), ("SELECT\t1 ",)], "s string")
    bare = df.select(text.strip_fences("s").alias("s"))
    assert {r[0] for r in bare.select(text.fingerprint("s")).collect()} == {df.select(F.md5(F.lit("SELECT 1"))).first()[0]}


def points(spark):
    return spark.createDataFrame([(1, 42.30, -71.1), (2, 42.3005, -71.1), (3, None, None)], "case_enquiry_id long, latitude double, longitude double")


@pytest.mark.parametrize(
    "args, want", [((42.30, -71.1, 10), [1]), ((42.30, -71.1, 100), [1, 2]), ((0, 0, 10), [1, 2, 3]), (("x", -71.1, 10), [1, 2, 3]), ((None, None, None), [1, 2, 3])]
)
def test_near_falls_back(spark, args, want):
    assert sorted(r[0] for r in geo.near(points(spark), *args).collect()) == want


def test_polygon_with_hole_and_multipolygon(spark):
    hole = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]}'
    two = '{"type":"MultiPolygon","coordinates":[[[[10,10],[11,10],[11,11],[10,11],[10,10]]],[[[20,20],[21,20],[21,21],[20,21],[20,20]]]]}'
    polys = geo.ref_neighborhoods(spark.createDataFrame([("a", hole), ("b", two), ("", hole), (None, hole), (" ", hole)], "name string, geometry string"))
    assert sorted(r.neighborhood_name for r in polys.collect()) == ["", "A", "B"]
    pts = spark.createDataFrame([(0.5, 0.5), (1.5, 1.5), (20.5, 20.5), (5.0, 5.0), (None, None)], "latitude double, longitude double")
    named = polys.where("neighborhood_name <> ''")
    got = {(r.latitude, r.longitude): r.polygon_name for r in geo.tag_polygon(pts, named, cell=1.0).collect()}
    assert got == {(0.5, 0.5): "A", (1.5, 1.5): None, (20.5, 20.5): "B", (5.0, 5.0): None, (None, None): None}


def test_cascade_resets_an_invalid_reason(spark):
    pairs = spark.createDataFrame([("N", "r1", "d1"), ("N", "r2", "d2"), ("M", "r3", "d3")], "neighborhood string, reason string, department string")
    got = {r.list_name: (r.reason_selected, r.options) for r in filters.cascade(pairs, "N", "r3").collect()}
    assert got == {"reason": ("ALL", ["r1", "r2"]), "department": ("ALL", ["d1", "d2"])}


def test_keyset_drops_trivial_predicate(spark):
    df = spark.range(10).withColumnRenamed("id", "_id")
    for where in (None, "", "1=1"):
        assert [r[0] for r in filters.keyset_page(df, where, 3, 2).collect()] == [4, 5]
    assert filters.keyset_page(df, None, -5, 1000).count() == 10


def test_preview_of_nulls(spark):
    row = filters.preview(spark.createDataFrame([(1, None)], "a int, b string"), [F.asc("a")]).first()
    assert row.row_text == "a: 1, b: None" and row.row_json == '{"a":1,"b":null}'


@pytest.mark.parametrize("batch", [2, 7, 10_000])
def test_ttl_repeats_match_a_plain_loop(spark, batch):
    rows = [(k, (i * i * 37 + k * 11) % 20_000) for k in range(3) for i in range(200)]
    log = spark.createDataFrame([(f"SELECT {k}", t) for k, t in rows], "sql string, t long").select(
        "sql", F.timestamp_seconds("t").alias("ts"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted((r.hits, r.misses, r.expirations) for r in requests.ttl_repeats(log, 600).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for k in range(3):
        opened, hits, misses = None, 0, 0
        for t in sorted(t for q, t in rows if q == k):
            if opened is None or t > opened + 600:
                opened, misses = t, misses + 1
            else:
                hits += 1
        want.append((hits, misses, misses - 1))
    assert got == sorted(want)


def test_health_of_an_empty_window(spark):
    rows = spark.createDataFrame([], "y int, p double")
    drift = spark.createDataFrame([(0.9, 2, 2, True)], "drift_share double, n_features long, n_drifted long, dataset_drift boolean")
    row = model.health_row(rows, "y", "p", drift, "2024-01-02", "2024-01-01", "2024-01-02").first()
    assert (row.n_rows, row.decay_flag, row.drift_flag, row.auc) == (0, False, False, None)
    assert row.notes.startswith("No rows")


def test_health_within_thresholds(spark):
    rows = spark.createDataFrame([(1, 0.9)] * 13 + [(0, 0.1)] * 7, "y int, p double")
    none = spark.createDataFrame([], "drift_share double, n_features long, n_drifted long, dataset_drift boolean")
    row = model.health_row(rows, "y", "p", none, "2024-01-02", "2024-01-01", "2024-01-02").first()
    assert (row.decay_flag, row.drift_flag) == (False, False) and row.notes.endswith("within thresholds.")


def test_drift_of_equal_and_disjoint_frames(spark):
    a = spark.createDataFrame([(float(i), "x") for i in range(50)], "v double, c string")
    b = a.select((F.col("v") + 100).alias("v"), F.lit("y").alias("c"))
    same = {r.feature: r.distance for r in model.feature_drift(a, a, ["v"], ["c"]).collect()}
    apart = {r.feature: r.distance for r in model.feature_drift(a, b, ["v"], ["c"]).collect()}
    assert same == {"v": 0.0, "c": 0.0} and apart == {"v": 1.0, "c": pytest.approx(1.0)}


def test_drift_against_nothing(spark):
    a = spark.createDataFrame([(1.0, "x")], "v double, c string")
    rows = model.feature_drift(a, a.limit(0), ["v"], ["c"])
    assert {(r.distance, r.drifted) for r in rows.collect()} == {(None, None)}
    assert model.drift_summary(rows.limit(0)).first().drift_share is None


def test_importance_rollup(spark):
    df = spark.createDataFrame([("cat__reason_a", 1.0), ("cat__reason_b", 2.0), ("remainder__month", 0.5), ("other", 9.0)], "feature string, importance double")
    got = [(r.feature, r.importance) for r in model.rollup_importance(df).collect()]
    assert got == [("other", 9.0), ("reason", 3.0), ("month", 0.5)]
