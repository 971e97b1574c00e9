import datetime as dt
import random

from pyspark.sql import functions as F

from curbline.operators import maintain
from curbline.session import fresh_path
from curbline.sources import commits
from curbline.streaming import jobs

LOG = "ts timestamp, path string, latency_ms double, failed boolean"
CASE = "_id long, case_enquiry_id long, case_status string, _ingested_at timestamp, open_dt timestamp"


def add(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).parquet(folder)


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_metrics_arrive_in_batches_and_late_rows_are_dropped(spark):
    src, out, state = (fresh_path(spark, n) for n in ("src", "out", "state"))

    def run():
        df = jobs.request_metrics(stream(spark, LOG, src), "path", late="2 hours", with_p95=True)
        jobs.write_updates(df, out, state).awaitTermination()

    add(spark, [(at(1, 1), "/a", 10.0, False), (at(1, 2), "/a", 30.0, True)], LOG, src)
    run()
    add(spark, [(at(1, 5), "/a", 20.0, False), (at(5), "/a", 1.0, False)], LOG, src)
    run()
    add(spark, [(at(1, 6), "/a", 999.0, True)], LOG, src)  # its day is closed by now
    run()
    rows = jobs.latest_updates(spark, out, ["window_start", "path"]).orderBy("window_start").collect()
    assert [(r.window_start.day, r.n, r.avg_latency_ms) for r in rows] == [(1, 3, 20.0), (5, 1, 1.0)]
    assert rows[0].p95_latency_ms == 30.0


def test_windows_of_panes_and_compaction(spark):
    src, out, state = (fresh_path(spark, n) for n in ("src", "out", "state"))
    draw = random.Random(4)
    rows = [(at(draw.randrange(1, 4), draw.randrange(24)), f"/{k % 2}", float(draw.randrange(1009)), k % 5 == 0) for k in range(6000)]
    keys = ["pane_start", "path"]
    for part in range(3):
        add(spark, [r for r in rows if r[0].day == part + 1], LOG, src)
        jobs.write_updates(jobs.pane_metrics(stream(spark, LOG, src), "path", "3 hours"), out, state).awaitTermination()
        if part == 1:
            before = sorted(map(tuple, jobs.latest_updates(spark, out, keys).drop("sketch").collect()))
            last = jobs.compact(spark, out, keys)
            assert sorted(map(tuple, jobs.latest_updates(spark, out, keys).drop("sketch").collect())) == before
            assert jobs.compact(spark, out, keys) == last
            assert [n for n in commits.names(spark, out) if n.startswith("batch_id")] == []
    panes = jobs.latest_updates(spark, out, keys)
    assert len(commits.names(spark, f"{out}/_compacted")) == 1 and panes.count() == 3 * 8 * 2
    files = {f.split("/")[-2] for f in panes.inputFiles()}
    assert f"upto={last}" in files and len(files) > 1  # the compaction, and the batches since
    got = jobs.windows_of(panes, "path", "1 day", "6 hours").collect()
    hours = dt.timedelta(hours=24)
    assert len(got) > 20
    for r in got:
        some = sorted(x[2] for x in rows if x[1] == r["path"] and r["window_start"] <= x[0] < r["window_start"] + hours)
        assert r["n"] == len(some) and abs(r["avg_latency_ms"] - sum(some) / len(some)) < 1e-9
        below, upto = sum(x < r["p95_latency_ms"] for x in some), sum(x <= r["p95_latency_ms"] for x in some)
        assert below <= 0.96 * len(some) + 1 and upto >= 0.94 * len(some) - 1


def test_stream_upsert_equals_batches(spark):
    src, path, state = (fresh_path(spark, n) for n in ("src", "table", "state"))
    target = spark.createDataFrame([(1, 10, "old", at(2), at(1)), (2, 11, "old", None, at(1))], CASE)
    maintain.create_months(target, path)
    arrivals = [
        [(5, 10, "stale", at(1), at(1)), (6, 12, "new", at(3), at(2))],
        [(7, 12, "newer", at(4), at(2)), (8, 11, "set", at(1), at(1)), (9, 12, "tie", at(4), at(2))],
    ]
    want = target
    for rows in arrivals:
        add(spark, rows, CASE, src)
        jobs.upsert_by_month(stream(spark, CASE, src), path, state).awaitTermination()
        want = maintain.upsert(want, spark.createDataFrame(rows, CASE))
    got = sorted(map(tuple, commits.read(spark, path).select("_id", "case_enquiry_id", "case_status").collect()))
    assert got == sorted(map(tuple, want.select("_id", "case_enquiry_id", "case_status").collect()))
    assert got == [(1, 10, "old"), (2, 11, "set"), (6, 12, "tie")]
    assert commits.manifest(spark, path).senders == {state: 1}


def test_dedup_across_batches(spark):
    src, out, state = (fresh_path(spark, n) for n in ("src", "out", "state"))
    for rows in ([(1, 10, "a", at(1), at(1)), (2, 10, "b", at(1), at(1))], [(3, 10, "c", at(2), at(3)), (4, 11, "d", at(2), at(3))]):
        add(spark, rows, CASE, src)
        q = (
            jobs.dedup(stream(spark, CASE, src)).select("case_enquiry_id").writeStream.format("parquet")
            .option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        q.awaitTermination()
    ids = [r[0] for r in spark.read.parquet(out).orderBy(F.col("case_enquiry_id")).collect()]
    assert ids == [10, 11]
