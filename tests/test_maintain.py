import datetime as dt

import pytest
from pyspark.sql import functions as F

from curbline.operators import maintain
from curbline.schemas import CASE_COLUMNS
from curbline.session import fresh_path
from curbline.sources import commits, files, geojson

T0, T1, T2 = (dt.datetime(2024, 1, d) for d in (1, 2, 3))
SMALL = "_id long, case_enquiry_id long, case_status string, _ingested_at timestamp"


def ids(df):
    return sorted((r._id, r.case_enquiry_id, r.case_status) for r in df.collect())


def test_latest_breaks_ties_by_id_and_drops_null_keys(spark):
    df = spark.createDataFrame(
        [(1, 10, "a", T1), (2, 10, "b", T1), (3, 10, "c", T0), (4, None, "d", T1), (5, 11, "e", None)], SMALL
    )
    assert ids(maintain.latest_per_key(df)) == [(2, 10, "b"), (5, 11, "e")]


def test_latest_limits_rows_before_the_shuffle(spark):
    df = spark.range(1000).select(
        F.col("id").alias("_id"), (F.col("id") % 2).alias("case_enquiry_id"), F.lit("x").alias("case_status"),
        F.current_timestamp().alias("_ingested_at"),
    )
    plan = maintain.latest_per_key(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # partial and final


def test_upsert_rules(spark):
    target = spark.createDataFrame(
        [(1, 10, "old", T1), (2, 11, "old", None), (3, 12, "old", T2), (4, 13, "old", T0)], SMALL
    )
    batch = spark.createDataFrame(
        [(90, 10, "same", T1), (91, 11, "null stamp", T0), (92, 12, "stale", T1), (93, 14, "new", T0), (94, None, "no key", T2)],
        SMALL,
    )
    got = ids(maintain.upsert(target, batch))
    assert got == [(1, 10, "same"), (2, 11, "null stamp"), (3, 12, "old"), (4, 13, "old"), (93, 14, "new")]


def test_upsert_twice_changes_nothing(spark):
    target = spark.createDataFrame([(1, 10, "old", T0)], SMALL)
    batch = spark.createDataFrame([(5, 10, "x", T1), (6, 11, "y", T1)], SMALL)
    once = maintain.upsert(target, batch)
    assert ids(once) == ids(maintain.upsert(once, batch))


def test_upsert_months_rewrites_touched_months_only(spark):
    schema = SMALL + ", open_dt timestamp"
    jan, feb, mar = (dt.datetime(2024, m, 5) for m in (1, 2, 3))
    target = spark.createDataFrame([(1, 10, "a", T0, jan), (2, 11, "b", T0, feb), (3, 12, "c", T0, mar)], schema)
    path = fresh_path(spark, "months")
    before = maintain.create_months(target, path)
    # case 10 moves to March, a new case comes in March, February is not touched
    batch = spark.createDataFrame([(7, 10, "moved", T1, mar), (8, 13, "new", T1, mar)], schema)
    after = maintain.upsert_months(spark, path, batch)
    assert ids(commits.read(spark, path)) == [(1, 10, "moved"), (2, 11, "b"), (3, 12, "c"), (8, 13, "new")]
    assert after.folders["202402"] == before.folders["202402"] and after.folders["202401"] != before.folders["202401"]
    assert ids(commits.read(spark, path, parts=["202402"])) == [(2, 11, "b")]


def test_align_fills_missing_columns(spark):
    df = maintain.align(spark.createDataFrame([(1, "x")], "_id int, extra string"))
    assert df.columns == CASE_COLUMNS and dict(df.dtypes)["_id"] == "bigint"
    assert df.first().reason is None


def test_seed_actions_inserts_null_groups_and_skips_known(spark):
    day = dt.date(2024, 1, 2)
    cols = "snapshot_date date, slice_type string, slice_group string, ontime_rate double, median_ontime_rate double, gap_below_median double, status string"
    rows = [(day, "n", g, 0.5, 0.7, 0.2, "needs_attention") for g in ("A", "B", None)]
    alerts = spark.createDataFrame(rows + [(dt.date(2024, 1, 1), "n", "C", 0.1, 0.7, 0.6, "needs_attention")], cols)
    actions = spark.createDataFrame([(day, "n", "A"), (day, "n", None)], "snapshot_date date, slice_type string, slice_group string")
    got = maintain.seed_actions(alerts, actions, "2024-01-02 05:00:00", "2024-01-02").collect()
    assert sorted(str(r.slice_group) for r in got) == ["B", "None"]
    assert got[0].issue_summary == "ontime_rate=50.0%; median=70.0%; gap=20.0pts below median"


def test_append_metrics_requires_flags(spark):
    row = spark.createDataFrame([(None,)], "n_rows long")
    for name, kind in (("run_timestamp", "timestamp"), ("window_start", "timestamp"), ("window_end", "timestamp")):
        row = row.withColumn(name, F.lit(T0).cast(kind))
    for f in maintain.metrics_schema().fields:
        if f.name not in row.columns:
            row = row.withColumn(f.name, F.lit(None).cast(f.dataType))
    with pytest.raises(Exception, match="is required"):
        maintain.append_metrics(row, fresh_path(spark, "mm"))


def test_staging_tolerates_few_bad_rows(spark):
    path, out = fresh_path(spark, "in"), fresh_path(spark, "out")
    lines = ['{"_id": 1, "case_enquiry_id": 5}', "{broken", '{"_id": 2}', '{"_id": "x"}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    got = files.load_staging(spark, path, out, max_bad=2)
    assert sorted(r._id for r in got.collect()) == [1, 2]
    with pytest.raises(ValueError):
        files.load_staging(spark, path, fresh_path(spark, "out2"), max_bad=1)


def test_jsonl_stamp_and_count(spark):
    path = fresh_path(spark, "jsonl")
    df = spark.createDataFrame([(1, None), (2, "x")], "_id long, reason string")
    assert files.write_jsonl(df, path, "2024-01-02 03:04:05.678") == 2
    back = files.read_cases_jsonl(spark, path).collect()
    assert {r._ingested_at for r in back} == {dt.datetime(2024, 1, 2, 3, 4, 5)}
    assert files.write_jsonl(df.limit(0), fresh_path(spark, "empty"), "2024-01-02") == 0


@pytest.mark.parametrize(
    "doc, want",
    [
        ('{"type":"Feature","properties":{"Name":"A"},"geometry":{"type":"Point","coordinates":[1,2]}}', ["A"]),
        (
            '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"","NEIGHBORHOOD":"B"},"geometry":{"type":"Point","coordinates":[1,2]}},'
            '{"type":"Feature","properties":{"name":"gone"},"geometry":null},{"type":"Feature","properties":null,"geometry":{"type":"Point","coordinates":[1,2]}}]}',
            ["", "B"],
        ),
    ],
)
def test_geojson_names(spark, doc, want):
    docs = spark.createDataFrame([(doc,)], "value string")
    assert sorted(r.name for r in geojson.features_of(docs).collect()) == want


def test_geojson_rejects_other_documents(spark):
    with pytest.raises(Exception, match="not a GeoJSON"):
        geojson.features_of(spark.createDataFrame([('{"type":"Topology"}',)], "value string")).collect()


def test_eval_file_skips_bad_json(spark):
    path = fresh_path(spark, "eval")
    rows = ["query|expected_json", 'a|{"k": "v"}', "b|{bad", 'c|{"k": null}']
    spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1).write.text(path)
    assert sorted(r.query for r in files.read_eval(spark, path, "|").collect()) == ["a", "c"]
