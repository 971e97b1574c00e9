import random

import pytest
from pyspark.sql import functions as F

from curbline.operators import fairness, ordered, ranking, requests


def scores(spark, values):
    rows = [(i, float(s), int(y)) for i, (s, y) in enumerate(values)]
    return spark.createDataFrame(rows, "case_enquiry_id long, priority_score double, label int")


def brute_auc(values):
    pos = [s for s, y in values if y]
    neg = [s for s, y in values if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(values):
    total, ap, tp, seen = sum(y for _, y in values), 0.0, 0, 0
    for s in sorted({s for s, _ in values}, reverse=True):
        here = [y for t, y in values if t == s]
        tp, seen = tp + sum(here), seen + len(here)
        ap += sum(here) / total * tp / seen
    return ap


@pytest.mark.parametrize("levels", [3, 40, 10_000])
def test_curve_matches_brute_force(spark, levels):
    rnd = random.Random(levels)
    # a third of the rows share one score
    values = [(0.5 if rnd.random() < 0.33 else rnd.randrange(levels) / levels, int(rnd.random() < 0.3)) for _ in range(400)]
    got = ranking.curve_metrics(scores(spark, values), "label", "priority_score").first()
    assert got.roc_auc == pytest.approx(brute_auc(values))
    assert got.pr_auc == pytest.approx(brute_ap(values))


def test_auc_ignores_monotone_maps(spark):
    values = [(i % 17 / 17, i % 3 == 0) for i in range(200)]
    df = scores(spark, values)
    a = ranking.curve_metrics(df, "label", "priority_score").first()
    b = ranking.curve_metrics(df.withColumn("priority_score", F.exp("priority_score")), "label", "priority_score").first()
    assert (a.roc_auc, a.pr_auc) == pytest.approx((b.roc_auc, b.pr_auc))


def test_single_class_groups(spark):
    df = spark.createDataFrame(
        [("one", 0.3, 1), ("pos", 0.3, 1), ("pos", 0.4, 1), ("neg", 0.1, 0), ("neg", 0.2, 0), (None, 0.1, 0), (None, 0.9, 1)],
        "g string, s double, y int",
    )
    got = {r.g: r for r in ranking.curve_metrics(df, "y", "s", ["g"]).collect()}
    assert got["one"].roc_auc is None and got["one"].pr_auc_loose is None
    assert got["pos"].pr_auc is None and got["pos"].pr_auc_loose == 1.0
    assert got["neg"].pr_auc is None and got["neg"].pr_auc_loose == 0.0
    assert got[None].roc_auc == 1.0


@pytest.mark.parametrize("n", [1, 2, 19, 20, 40, 100])
def test_rank_segment_threshold_edges(spark, n):
    values = [((i * 7 % 5) / 5, i % 2) for i in range(n)]
    ranked = ranking.rank_and_segment(scores(spark, values))
    want = sorted(range(n), key=lambda i: (-values[i][0], i))
    got = sorted(ranked.collect(), key=lambda r: r.rank_overall)
    assert [r.case_enquiry_id for r in got] == want
    assert sum(r.segment == "CRITICAL" for r in got) == max(1, int(0.05 * n))
    place = max(1, int(0.05 * n) - 1)
    t = ranking.critical_threshold(ranked).first().critical_threshold
    assert t == (values[want[place]][0] if place < n else None)
    p = {r.k: r.precision_at_k for r in ranking.precision_at(ranked, "label").collect()}
    top = max(1, int(n * 0.1))
    assert p[0.1] == pytest.approx(sum(values[i][1] for i in want[:top]) / top)


def test_rank_of_empty_frame(spark):
    assert ranking.rank_and_segment(scores(spark, [(0.1, 1)]).limit(0)).count() == 0


def test_running_totals_span_partitions_of_a_hot_group(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice(["a", "b", None]), i, rnd.randrange(10)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i long, x long")
    got = ordered.running_totals(df, ["g"], [F.asc("i")], {"upto": "x"}).collect()
    want, sums = {}, {}
    for g, i, x in rows:
        sums[g] = sums.get(g, 0) + x
        want[i] = sums[g]
    assert {r.i: r.upto for r in got} == want


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 100])
def test_p95_is_nearest_rank(spark, n):
    values = [float((i * 13) % 7) for i in range(n)]
    log = spark.createDataFrame([("a", v) for v in values], "step string, latency_ms double")
    want = sorted(values)[max(int(n * 0.95) - 1, 0)]
    assert requests.p95(log).first()[0] == want
    assert requests.p95(log, ["step"]).first().p95_latency_ms == want


def test_p95_of_nothing(spark):
    log = spark.createDataFrame([], "event_id long, ts timestamp, path string, status_code int, latency_ms double, error string")
    row = requests.request_summary(log).first()
    assert (row.total_requests, row.p95_latency_ms, row.error_rate, row.last_error_ts) == (0, 0.0, 0.0, None)


def test_split_sizes_per_label(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    sizes = {(r.y, r.part): r["count"] for r in ranking.split(df, "k", "y").groupBy("y", "part").count().collect()}
    assert sizes == {(0, "train"): 450, (0, "validation"): 150, (0, "test"): 150, (1, "train"): 150, (1, "validation"): 50, (1, "test"): 50}


def test_best_run_first_wins_ties(spark):
    runs = spark.createDataFrame([(0, "a", 0.9, 0.1), (1, "b", 0.9, 0.9), (2, "c", None, 1.0)], "run_index int, name string, val_pr_auc double, val_roc_auc double")
    assert ranking.best_run(runs).first().name == "a"


def test_queue_of_unknown_department_is_empty(spark):
    df = scores(spark, [(0.1, 1)]).withColumn("department", F.lit("A")).withColumn("segment", F.lit("CRITICAL"))
    queue = ranking.work_queue(df, "Z")
    assert queue.count() == 0
    assert ranking.queue_stats(queue).first().n_rows == 0


def test_rates_with_empty_denominators(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "label int, s double")
    row = fairness.clf_metrics(df, "label", "s").first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (1.0, 0.0, 0.0, 0.0)


def test_threshold_counts_as_positive(spark):
    row = fairness.confusion(spark.createDataFrame([(1, 0.5), (1, 0.4999)], "y int, s double"), "y", "s").first()
    assert (row.tp, row.fn) == (1, 1)


def test_disparity_limits(spark):
    m = spark.createDataFrame([("d", "a", 0.5, None), ("d", "b", 0.75, 0.3)], "slice_type string, slice_group string, accuracy double, recall double")
    strict = {r.metric: r for r in fairness.disparities(m, ("accuracy", "recall"), threshold=0.25).collect()}
    assert strict["accuracy"].warning is None and strict["recall"].gap == 0.0
    incl = {r.metric: r for r in fairness.disparities(m, ("accuracy",), threshold=0.25, inclusive=True).collect()}
    assert incl["accuracy"].warning.startswith("Potential disparity on slice 'd' for metric 'accuracy': range=0.250")


def test_bias_weights_caps(spark):
    rows = [(i, "a", "x", "r") for i in range(97)] + [(97, None, "y", "s"), (98, "b", "y", "r"), (99, "c", "x", "s")]
    df = spark.createDataFrame(rows, "k long, neighborhood string, department string, reason string")
    got = {r.k: r.sample_weight for r in fairness.bias_weights(df, "k").collect()}
    raw = {i: 1.0 for i in range(97)} | {97: 27.0, 98: 9.0, 99: 9.0}
    mean = sum(raw.values()) / 100
    assert got[0] == pytest.approx(1 / mean) and got[97] == 5.0 and got[98] == pytest.approx(min(9 / mean, 5))


def test_promotion_gate(spark):
    def frame(x):
        return spark.createDataFrame([(x,)], "pr_auc double")

    def verdict(new, old):
        return fairness.promotion_gate(frame(new), frame(old), "pr_auc").first().promoted

    assert verdict(0.90, 0.90) and verdict(0.896, 0.90) and not verdict(0.89, 0.90)
    assert verdict(None, 0.9) and verdict(0.9, None)
    assert fairness.promotion_gate(frame(0.5), frame(0.9).limit(0), "pr_auc").first().promoted


def test_slice_rates_and_median(spark):
    rows = [("A", "D", "S", "ONTIME ", "closed"), ("A", "D", "S", "OVERDUE", "Open"), (None, "D", " ", "ontime", "CLOSED")]
    df = spark.createDataFrame(rows, "neighborhood string, department string, source string, on_time string, case_status string").withColumn(
        "_ingested_at", F.lit("2024-01-01").cast("timestamp"))
    got = {(r.slice_type, r.slice_group): r for r in fairness.slice_metrics(df, "2024-01-10").collect()}
    assert set(got) == {("neighborhood", "A"), ("department", "D"), ("source", "S"), ("source", " ")}
    assert got[("department", "D")].ontime_rate == pytest.approx(2 / 3) and got[("department", "D")].closed_rate == pytest.approx(2 / 3)
    m = spark.createDataFrame([("t", x) for x in (0.1, 0.2, 0.3, 0.4)], "slice_type string, ontime_rate double")
    assert fairness.slice_medians(m).first().median_ontime_rate == 0.2
