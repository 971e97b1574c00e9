"""Cases in which rows were lost, counts overflowed or text was misread."""

import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbline import session
from curbline.functions import numeric, text
from curbline.operators import fairness, geo, maintain, metrics, model, ranking, requests, vectors, vocab
from curbline.session import cut, fresh_path
from curbline.operators.boosting import Settings
from curbline.sources import commits, files, geojson

CASE = "_id long, case_enquiry_id long, open_dt timestamp, note string, _ingested_at timestamp"
DAY = datetime(2020, 1, 15)


def by_month(spark, rows):
    path = fresh_path(spark, "by_month")
    maintain.create_months(spark.createDataFrame(rows, CASE), path)
    return path


def table(spark, path):
    return sorted((r["case_enquiry_id"], r["_id"], r["note"]) for r in commits.read(spark, path).collect())


def test_month_upsert_keeps_rows_without_a_date(spark):
    path = by_month(spark, [(1, 1, None, "a", DAY), (2, 2, None, "b", DAY), (3, 3, DAY, "c", DAY)])
    new = spark.createDataFrame([(9, 4, None, "new", DAY + timedelta(1))], CASE)
    for _ in range(2):  # a repeated batch changes nothing
        maintain.upsert_months(spark, path, new)
        assert table(spark, path) == [(1, 1, "a"), (2, 2, "b"), (3, 3, "c"), (4, 9, "new")]


def test_month_upsert_of_a_row_that_gets_a_date(spark):
    path = by_month(spark, [(1, 1, None, "a", DAY), (2, 2, None, "b", DAY)])
    batch = spark.createDataFrame([(9, 2, DAY, "dated", DAY + timedelta(1))], CASE)
    for _ in range(2):
        maintain.upsert_months(spark, path, batch)
        assert table(spark, path) == [(1, 1, "a"), (2, 2, "dated")]


def test_upsert_keeps_target_rows_without_key(spark):
    target = spark.createDataFrame([(1, None, DAY, "x", DAY), (2, None, DAY, "y", DAY), (3, 3, DAY, "z", DAY)], CASE)
    got = maintain.upsert(target, target.where("_id = 3").withColumn("note", F.lit("new")))
    assert sorted(r["note"] for r in got.collect()) == ["new", "x", "y"]


def test_rejected_load_leaves_the_old_table(spark, tmp_path):
    good, bad, out = str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "staging")
    spark.createDataFrame([('{"_id": 1}',), ('{"_id": 2}',)], "value string").write.text(good)
    spark.createDataFrame([("{broken",)] * 3 + [('{"_id": 7}',)], "value string").write.text(bad)
    files.load_staging(spark, good, out)
    with pytest.raises(ValueError, match="3 unreadable"):
        files.load_staging(spark, bad, out, max_bad=2)
    assert sorted(r["_id"] for r in spark.read.parquet(out).collect()) == [1, 2]
    assert files.load_staging(spark, bad, out, max_bad=3).count() == 1


@pytest.mark.parametrize("raw, want", [
    ('{"a":"1"}', {"a": "1"}), ('{"a":"1"} junk', {}), ('[{"a":"1"}]', {"a": "1"}), ('[{"a":"1"}] x', {}),
    ('[{"a":"1"}, {"b":"2"}]', {"a": "1"}), ('{"a":"1"}, {"b":"2"}', {}), (' {"a": null, "b": "x"} ', {"b": "x"}), ("[]", {}), (None, {}), ("[1]", {}),
])
def test_entities_with_text_after_the_end(spark, raw, want):
    frame = spark.createDataFrame([(raw,)], "raw string")
    assert frame.select(text.entity_map("raw").alias("m")).first()["m"] == want


def test_eval_rows_with_text_after_the_json_are_skipped(spark, tmp_path):
    (tmp_path / "e.csv").write_text('query|expected_json\na|{"k":"1"}\nb|{"k":"1"} tail\nc|{"k":\n')
    assert [r["query"] for r in files.read_eval(spark, str(tmp_path / "e.csv"), "|").collect()] == ["a"]


def test_fingerprint_collapses_white_space_of_any_script(spark):
    frame = spark.createDataFrame([(f"a{c}b",) for c in (" ", " ", "　", "\x1f", " \t ")] + [("ab",)], "sql string")
    keys = [r[0] for r in frame.select(text.fingerprint("sql")).collect()]
    assert len(set(keys[:5])) == 1 and keys[5] != keys[0]


def test_empty_geometry_is_none(spark):
    doc = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"a"},"geometry":{}},' \
          '{"type":"Feature","properties":{"name":"b"},"geometry":{"type":"Point"}},{"type":"Feature","properties":{"name":"c"},"geometry":null}]}'
    got = geojson.features_of(spark.createDataFrame([(doc,)], "value string")).collect()
    assert [r["name"] for r in got] == ["b"]


def test_nan_is_cleaned_at_any_depth(spark):
    frame = spark.sql("""SELECT named_struct('x', double('NaN'), 'y', array(double('Infinity'), 1.0D)) AS s,
        map('k', named_struct('z', double('-Infinity'), 'n', 3)) AS m, CAST(NULL AS STRUCT<x: DOUBLE>) AS none, 5 AS i""")
    row = numeric.clean_nan(frame).first()
    assert row["s"]["x"] is None and row["s"]["y"] == [None, 1.0]
    assert row["m"]["k"]["z"] is None and row["m"]["k"]["n"] == 3 and row["none"] is None and row["i"] == 5


def test_curve_of_counts_beyond_a_long(spark):
    big = 4_000_000_000
    points = spark.createDataFrame([(0.9, big, 0), (0.5, big, big), (0.1, 0, big)], "_s double, _pos long, _neg long")
    row = ranking.curve_of_counts(points, []).first()
    assert row["n_pos"] == row["n_neg"] == 2 * big
    assert row["roc_auc"] == pytest.approx(0.875) and row["pr_auc"] == pytest.approx((1 + 2 / 3) / 2)


def exchanges(df):
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan.split("Initial Plan")[0]))


def test_ranks_and_splits_do_not_shuffle_rows_for_small_sides(spark):
    rows = cut(spark.range(2000).select(
        F.col("id").alias("case_enquiry_id"), (F.col("id") % 97 / 97).alias("priority_score"), (F.col("id") % 2).cast("int").alias("label")
    ))
    assert exchanges(ranking.rank_overall(rows)) == 0
    assert exchanges(ranking.split(rows, "case_enquiry_id", "label")) <= 1  # the window's own


def test_alerts_of_several_snapshots(spark):
    rows = [(d, "source", g, 10, r, 0.5) for d, rates in (("2020-01-01", (0.9, 0.9, 0.5)), ("2020-02-01", (0.3, 0.3, 0.25))) for g, r in zip("abc", rates)]
    frame = spark.createDataFrame(rows, "d string, slice_type string, slice_group string, total_cases long, ontime_rate double, closed_rate double")
    frame = frame.withColumn("snapshot_date", F.to_date("d")).drop("d")
    both = fairness.bias_alerts(frame).collect()
    assert [(str(r["snapshot_date"]), r["slice_group"]) for r in both] == [("2020-01-01", "c")]
    assert fairness.bias_alerts(frame, day="2020-02-01").count() == 0


def test_filled_daily_read(spark):
    frame = spark.createDataFrame([("2020-01-02", None, None)], "d string, avg_resolution_hrs double, total_cases long")
    daily = frame.select(F.to_date("d").alias("date"), "avg_resolution_hrs", "total_cases").withColumns(
        {c: F.lit(None).cast("double") for c in ("open_cases", "closed_cases", "sla_eligible_cases", "sla_met_cases", "sla_compliance_pct")}
    )
    row = metrics.recent_metrics(daily, "2020-01-03 00:00:00", 30, fill=True).first()
    assert row["avg_resolution_hrs"] == 0 and row["total_cases"] == 0
    assert metrics.recent_metrics(daily, "2020-01-03 00:00:00", 30).first()["avg_resolution_hrs"] is None


def test_drift_share_is_null_without_a_side(spark):
    ref = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, c string")
    row = model.drift_summary(model.feature_drift(ref, ref.where("false"), ["x"], ["c"])).first()
    assert row["drift_share"] is None
    assert model.drift_summary(model.feature_drift(ref, ref, ["x"], ["c"])).first()["drift_share"] == 0.0


def plain_spans(times, ttl):
    hits = misses = expirations = 0
    end = None
    for t in sorted(times):
        if end is not None and t <= end:
            hits += 1
        else:
            misses += 1
            expirations += end is not None
            end = t + ttl
    return hits, misses, expirations


@pytest.mark.parametrize("chunk_rows", [1, 3, 1 << 16])
def test_repeats_to_the_microsecond_and_of_a_hot_key(spark, chunk_rows):
    draw = random.Random(3)
    ttl = 10_000_000
    logs = {
        "edge": [900_000, 900_000 + ttl, 900_001 + ttl],
        "hot": [draw.randrange(0, 3_000_000_000) for _ in range(3000)] + [5_000_000] * 4,
        "dense": list(range(0, 400_000_000, 333_333)),
        "sparse": [draw.randrange(0, 10**11) for _ in range(40)],
        "old": [-25_000_000, -14_999_999, -5_000_000, 0],
    }
    rows = [(f"SELECT  {k}", t) for k, ts in logs.items() for t in ts]
    log = spark.createDataFrame(rows, "sql string, us long").select("sql", F.timestamp_micros("us").alias("ts"))
    got = requests.ttl_repeats(log, 10, chunk_rows).collect()
    want = sorted(plain_spans(ts, ttl) for ts in logs.values())
    assert sorted((r["hits"], r["misses"], r["expirations"]) for r in got) == want


@pytest.mark.parametrize("k", [1, 3, 9])
def test_ties_at_the_last_place(spark, monkeypatch, k):
    values = [("c", i, [1.0, 0.0] if i % 2 else [0.6, 0.8]) for i in range(12)]
    asked = spark.createDataFrame([(1, "c", [1.0, 0.0])], "query_id long, column string, vector array<double>")
    known = spark.createDataFrame(values, "column string, value long, vector array<double>")
    want = ([1, 3, 5, 7, 9, 11] + [0, 2, 4, 6, 8, 10])[:k]
    for limit in ("BLOCK_ROWS", "SMALL_BYTES", None):
        if limit:
            monkeypatch.setattr(vectors, limit, 5)
        got = sorted((r["place"], r["value"]) for r in vectors.topk(asked, known, k).collect())
        assert [v for _, v in got] == want


def test_nested_vocabulary_and_stored_index(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"type": {"pot hole": "Pothole", "hole": "Pothole"}, "status": ["Open", "Closed"], "other": 3}')
    got = sorted(map(tuple, vocab.nested_vocabulary(spark, str(tmp_path / "v.json")).collect()))
    assert got == [("status", "Closed", "Closed"), ("status", "Open", "Open"), ("type", "hole", "Pothole"), ("type", "pot hole", "Pothole")]
    docs = spark.createDataFrame([(1, "Red car"), (2, "red bike")], "id long, t string")
    index = vocab.store_index(vocab.token_index(docs, "id", ["t"]), fresh_path(spark, "index"))
    assert [r["id"] for r in vocab.search(index, "id", ["RED", "bike"]).collect()] == [2]


def test_polygons_of_any_size(spark):
    def square(name, lat, lon, size):
        ring = [[lon, lat], [lon + size, lat], [lon + size, lat + size], [lon, lat + size], [lon, lat]]
        return name, '{"type":"Polygon","coordinates":[%s]}' % str(ring)

    shapes = spark.createDataFrame([square("world", -80.0, -170.0, 160.0), square("tiny", 42.0, -71.0, 1e-4), square("town", 42.0, -72.0, 1.5)], "name string, geometry string")
    points = spark.createDataFrame([(1, 42.00005, -70.99995), (2, 43.0, -71.5), (3, -79.0, -169.0), (4, 89.0, 0.0), (5, None, 1.0)], "id long, latitude double, longitude double")
    got = {r["id"]: r["polygon_name"] for r in geo.tag_polygon(points, geo.ref_neighborhoods(shapes)).collect()}
    assert got == {1: "TINY", 2: "TOWN", 3: "WORLD", 4: None, 5: None}


def training_rows(spark, n=600):
    draw = random.Random(5)
    rows = []
    for i in range(n):
        hood, dept = draw.choice("ABC"), draw.choice(["X", "Y", None])
        y = int(draw.random() < (0.9 if hood == "A" else 0.4))
        rows.append((i, hood, draw.choice("rs"), dept, draw.randrange(24), 1, 2, draw.randrange(50), 0, 3, y))
    cols = "case_enquiry_id long, neighborhood string, reason string, department string, " + ", ".join(f"{c} int" for c in model.NUMERIC)
    return spark.createDataFrame(rows, f"{cols}, y_priority int")


def test_training_chain(spark, monkeypatch):
    monkeypatch.setattr(model, "CANDIDATES", [("small", Settings(trees=3, depth=2)), ("large", Settings(trees=8, depth=4))])
    rows = training_rows(spark)
    run = model.train(rows)
    runs = {r["name"]: r["val_pr_auc"] for r in run.runs.collect()}
    assert run.best == max(runs, key=runs.get)
    weights = fairness.bias_weights(rows, "case_enquiry_id").select("case_enquiry_id", "sample_weight")
    assert run.rows.select("case_enquiry_id", "sample_weight").exceptAll(weights).count() == 0  # of all rows, before the split

    # The report, counted again in plain Python from the scored test part.
    report = {r["metric"]: r["value"] for r in run.report.collect()}
    scored = [(r["priority_score"], r["y_priority"]) for r in model.score(run.model, run.part("test")).collect()]
    tp, fp = (sum(s >= 0.5 and y == k for s, y in scored) for k in (1, 0))
    fn, tn = (sum(s < 0.5 and y == k for s, y in scored) for k in (1, 0))
    assert [report[k] for k in ("tp", "fp", "fn", "tn")] == [tp, fp, fn, tn]
    assert report["accuracy"] == pytest.approx((tp + tn) / len(scored)) and report["base_rate"] == pytest.approx((tp + fn) / len(scored))
    pos, neg = [s for s, y in scored if y], [s for s, y in scored if not y]
    assert report["roc_auc"] == pytest.approx(np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg]))

    path = model.publish(run.model, run.report, fresh_path(spark, "models"), "m", "gbt", "1", "t")
    again = {r["case_enquiry_id"]: r["priority_score"] for r in model.score(model.load(spark, path), rows).collect()}
    assert again == {r["case_enquiry_id"]: r["priority_score"] for r in model.score(run.model, rows).collect()}


def test_bias_report_has_overall_rows_and_gaps(spark):
    rows = spark.createDataFrame(
        [(h, "d", "r", s, y) for h, s, y in [("a", 0.9, 1), ("a", 0.2, 0), ("b", 0.9, 0), ("b", 0.1, 1), ("b", 0.8, 1)]],
        "neighborhood string, department string, reason string, score double, label int",
    )
    report = cut(model.bias_report(rows, "label", "score"))
    overall = report.where("slice_type = 'overall'").collect()
    assert len(overall) == 1 and overall[0]["n"] == 5 and overall[0]["accuracy"] == pytest.approx(0.6)
    gaps = {(r["slice_type"], r["metric"]): r for r in model.bias_gaps(report).collect()}
    assert len(gaps) == 18 and gaps["neighborhood", "accuracy"]["gap"] == pytest.approx(2 / 3)
    assert gaps["neighborhood", "accuracy"]["warning"].startswith("Potential disparity on slice 'neighborhood'")
    assert gaps["neighborhood", "roc_auc"]["gap"] > 0.1 and gaps["neighborhood", "roc_auc"]["warning"] is None


def test_release_removes_what_was_stored(spark, monkeypatch):
    monkeypatch.setattr(session, "_written", {})
    path = cut(spark.range(3)).inputFiles()[0]
    assert session.release(spark) == 1 and session.release(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
