"""Queries for ranking quality, features, the model, vectors, places and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.operators import boosting, cover, fairness, features, filters, geo, maintain, metrics, model, ordered, ranking, vectors
from curbline.operators.maintain import append_metrics
from curbline.plans.catalog_cases import dist_sql
from curbline.plans.catalog_metrics import rounded
from curbline.plans.catalog_tables import CORE, read_polygons, undated, undated_sql, upsert_sql
from curbline.plans.registry import query
from curbline.plans.views import AS_OF, BATCH_ORDER, SECOND_INGEST
from curbline.session import cut, fresh_path, settle
from curbline.sources import commits
from curbline.streaming import jobs

# --- ranking ----------------------------------------------------------------


@query("w02_rank_overall", "SELECT case_enquiry_id, rank_overall FROM ranked")
def _(v):
    return ranking.rank_overall(v.scores).select("case_enquiry_id", "rank_overall")


@query("w03_segment", "SELECT case_enquiry_id, rank_overall, segment FROM ranked")
def _(v):
    return v.ranked.select("case_enquiry_id", "rank_overall", "segment")


@query("w04_precision_at", " UNION ALL ".join(
    f"SELECT {k}::DOUBLE AS k, round(avg(label) FILTER (rank_overall <= greatest(1, floor(n_all * {k}::DOUBLE))), 6) AS precision_at_k FROM ranked"
    for k in (0.01, 0.05, 0.1)))
def _(v):
    return rounded(ranking.precision_of(v.scores, "label"), "precision_at_k")


@query("w05_critical_threshold", """SELECT max(priority_score) FILTER (rank_overall = greatest(1, floor(n_all * 0.05::DOUBLE) - 1) + 1) AS critical_threshold FROM ranked""")
def _(v):
    return ranking.threshold_of(v.scores)


def curve_sql(src: str, by: str = "", name: str = "curve") -> str:
    """CTEs for ROC-AUC and average precision of (label, priority_score) in ``src``."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
{name}_pts AS (SELECT {keys}priority_score AS s, sum(label) AS pos, sum(1 - label) AS neg FROM {src} GROUP BY {keys}s),
{name}_run AS (SELECT *, sum(pos) OVER ({part}ORDER BY s DESC) AS tp, sum(neg) OVER ({part}ORDER BY s DESC) AS fp FROM {name}_pts),
{name} AS (SELECT {keys}CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (tp - pos / 2::DOUBLE)) / (sum(pos) * sum(neg)) END AS roc_auc,
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (tp::DOUBLE / (tp + fp))) / sum(pos) END AS pr_auc,
  CASE WHEN sum(pos) + sum(neg) >= 2 THEN coalesce(sum(pos * (tp::DOUBLE / (tp + fp))) / nullif(sum(pos), 0), 0) END AS pr_auc_loose
  FROM {name}_run {group})"""


AUCS = ("roc_auc", "pr_auc", "pr_auc_loose")
AUC_COLS = "n_pos, n_neg, " + ", ".join(f"round({c}, 6) AS {c}" for c in AUCS)


@query("w06_w07_curve", f"SELECT {AUC_COLS} FROM curve", curve_sql("scores"))
def _(v):
    return rounded(ranking.curve_metrics(v.scores, "label", "priority_score"), *AUCS)


@query("w06_roc_auc_by_reason", "SELECT reason, round(roc_auc, 6) AS roc_auc FROM curve", curve_sql("scores", "reason"))
def _(v):
    rows = ranking.curve_metrics(v.scores, "label", "priority_score", ["reason"])
    return rounded(rows.select("reason", "roc_auc"), "roc_auc")


@query("w07_avg_precision_by_neighborhood", "SELECT neighborhood, round(pr_auc, 6) AS pr_auc FROM curve", curve_sql("scores", "neighborhood"))
def _(v):
    rows = ranking.curve_metrics(v.scores, "label", "priority_score", ["neighborhood"])
    return rounded(rows.select("neighborhood", "pr_auc"), "pr_auc")


WEIGHT_SQL = """
lab AS (SELECT case_enquiry_id, coalesce(neighborhood, 'None') AS neighborhood, coalesce(department, 'None') AS department, coalesce(reason, 'None') AS reason FROM scores),
n AS (SELECT neighborhood, count(*) AS c FROM lab GROUP BY 1), d AS (SELECT department, count(*) AS c FROM lab GROUP BY 1), r AS (SELECT reason, count(*) AS c FROM lab GROUP BY 1),
w AS (SELECT case_enquiry_id, least((SELECT max(c) FROM n) / n.c::DOUBLE, 3) * least((SELECT max(c) FROM d) / d.c::DOUBLE, 3)
  * least((SELECT max(c) FROM r) / r.c::DOUBLE, 3) AS raw FROM lab JOIN n USING (neighborhood) JOIN d USING (department) JOIN r USING (reason))"""


@query("w08_bias_weights", "SELECT case_enquiry_id, round(least(raw / (SELECT avg(raw) FROM w), 5), 6) AS sample_weight FROM w", WEIGHT_SQL)
def _(v):
    return rounded(fairness.bias_weights(v.scores, "case_enquiry_id").select("case_enquiry_id", "sample_weight"), "sample_weight")


@query("j05_group_frequency", """SELECT case_enquiry_id, n FROM scores JOIN (SELECT department, count(*) AS n FROM scores GROUP BY 1) USING (department)""")
def _(v):
    sizes = cut(v.scores.groupBy("department").agg(F.count("*").alias("n")))  # small, and known to be
    return v.scores.join(sizes, "department").select("case_enquiry_id", "n")


SPLIT_SQL = """
split AS (SELECT *, CASE WHEN r <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.8::DOUBLE) THEN 'validation' ELSE 'test' END AS part
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', case_enquiry_id, '42')), case_enquiry_id) AS r,
    count(*) OVER (PARTITION BY label) AS n FROM scores))"""


@query("w14_split", "SELECT case_enquiry_id, label, part FROM split", SPLIT_SQL)
def _(v):
    return ranking.split(v.scores, "case_enquiry_id", "label").select("case_enquiry_id", "label", "part")


@query("a28_class_balance", "SELECT round(avg(label), 6) AS class_balance FROM scores")
def _(v):
    return rounded(model.class_balance(v.scores, "label"), "class_balance")


def conf_sql(src: str, by: str = "") -> str:
    return f"""SELECT {by}{',' if by else ''} count(*) FILTER (label = 1 AND priority_score >= 0.5) AS tp, count(*) FILTER (label = 0 AND priority_score >= 0.5) AS fp,
    count(*) FILTER (label = 0 AND priority_score < 0.5) AS tn, count(*) FILTER (label = 1 AND priority_score < 0.5) AS fn FROM {src} {'GROUP BY ' + by if by else ''}"""


RATE_SQL = """tp + fp + tn + fn AS n, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision,
    round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1"""
RATES = fairness.RATE_METRICS


@query("a29_confusion", conf_sql("scores"))
def _(v):
    return fairness.confusion(v.scores, "label", "priority_score")


@query("a30_clf_metrics", f"SELECT {RATE_SQL} FROM ({conf_sql('scores')})")
def _(v):
    return rounded(fairness.clf_metrics(v.scores, "label", "priority_score"), *RATES)


def slices_sql(src: str, name: str = "sl") -> str:
    return f"""
{name} AS (SELECT 'neighborhood' AS slice_type, coalesce(neighborhood, 'None') AS slice_group, label, priority_score FROM {src}
  UNION ALL SELECT 'department', coalesce(department, 'None'), label, priority_score FROM {src}
  UNION ALL SELECT 'reason', coalesce(reason, 'None'), label, priority_score FROM {src}),
{name}_m AS (SELECT slice_type, slice_group, tp + fp + tn + fn AS n, (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision,
  coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM ({conf_sql(name, 'slice_type, slice_group')}))"""


RATE_COLS = ", ".join(f"round({m}, 6) AS {m}" for m in RATES)


@query("a31_clf_by_slice", f"SELECT slice_type, slice_group, n, {RATE_COLS} FROM sl_m", slices_sql("scores"))
def _(v):
    return rounded(fairness.clf_metrics_by_slice(v.scores, "label", "priority_score"), *RATES)


def gap_sql(src: str, cols=tuple(RATES)) -> str:
    one = " UNION ALL ".join(f"SELECT slice_type, '{m}' AS metric, {m} AS v FROM {src} WHERE {m} IS NOT NULL" for m in cols)
    return f"gaps AS (SELECT slice_type, metric, min(v) AS lo, max(v) AS hi, max(v) - min(v) AS gap FROM ({one}) GROUP BY 1, 2)"


def gap_select(test: str) -> str:
    return f"""SELECT slice_type || '_' || metric || '_gap' AS gap_name, slice_type, metric, round(lo, 6) AS min_value, round(hi, 6) AS max_value, round(gap, 6) AS gap,
    CASE WHEN gap {test} THEN printf('Potential disparity on slice ''%s'' for metric ''%s'': range=%.3f (min=%.3f, max=%.3f)', slice_type, metric, gap, lo, hi) END AS warning FROM gaps"""


GAP_COLS = ("min_value", "max_value", "gap")


@query("a32_disparities", gap_select("> 0.1"), slices_sql("scores") + ",\n" + gap_sql("sl_m"))
def _(v):
    by_slice = fairness.clf_metrics_by_slice(v.scores, "label", "priority_score")
    return rounded(fairness.disparities(by_slice), *GAP_COLS)


@query("a32_disparities_inclusive", gap_select(">= 0.2"), slices_sql("scores") + ",\n" + gap_sql("sl_m"))
def _(v):
    by_slice = fairness.clf_metrics_by_slice(v.scores, "label", "priority_score")
    return rounded(fairness.disparities(by_slice, threshold=0.2, inclusive=True), *GAP_COLS)


@query("a32_auc_gaps", gap_select("> 0.1"), slices_sql("scores") + "," + curve_sql("sl", "slice_type, slice_group") + ",\n" + gap_sql("curve", ("roc_auc", "pr_auc")))
def _(v):
    rows = fairness.model_slices(v.scores, "label", "priority_score")
    curve = ranking.curve_metrics(rows, "label", "priority_score", ["slice_type", "slice_group"])
    return rounded(fairness.disparities(curve, ("roc_auc", "pr_auc")), *GAP_COLS)


@query("a33_rmse", "SELECT round(sqrt(avg(pow(least(greatest(priority_score, 0), 1) - label, 2))), 6) AS rmse FROM scores")
def _(v):
    return rounded(model.rmse(v.scores, "label", "priority_score"), "rmse")


RUN_SQL = curve_sql("scores", "department") + """,
runs AS (SELECT CAST(row_number() OVER (ORDER BY department) AS INTEGER) AS run_index, department AS name, round(pr_auc, 6) AS val_pr_auc, round(roc_auc, 6) AS val_roc_auc FROM curve)"""


def run_log(v):
    """Each department's scores stand for one experiment run."""
    c = ranking.curve_metrics(v.scores, "label", "priority_score", ["department"])
    c = ordered.global_rank(c, [F.asc("department")], "run_index")
    return rounded(c.select(F.col("run_index").cast("int"), F.col("department").alias("name"), F.col("pr_auc").alias("val_pr_auc"), F.col("roc_auc").alias("val_roc_auc")), "val_pr_auc", "val_roc_auc")


@query("k04_best_run", "SELECT run_index, name, val_pr_auc, val_roc_auc FROM runs ORDER BY val_pr_auc DESC, run_index LIMIT 1", RUN_SQL)
def _(v):
    return ranking.best_run(run_log(v))


@query("k05_compare_runs", "SELECT name, val_pr_auc, val_roc_auc FROM runs", RUN_SQL)
def _(v):
    return ranking.compare_runs(run_log(v))


@query("a38_rollup_importance", """SELECT feature, round(sum(importance), 6) AS importance FROM (
    SELECT 'neighborhood' AS feature, count(*) / 1000.0::DOUBLE AS importance FROM cases
    UNION ALL SELECT 'reason', count(*) / 500.0::DOUBLE FROM cases UNION ALL SELECT 'month', count(*) / 250.0::DOUBLE FROM cases
    UNION ALL SELECT 'bias', count(*) / 100.0::DOUBLE FROM cases) GROUP BY 1""")
def _(v):
    def part(name, scale):
        return v.cases.groupBy(name.alias("feature")).agg((F.count("*") / scale).alias("importance"))

    hood = F.concat(F.lit("cat__neighborhood_"), F.coalesce("neighborhood", F.lit("None")))
    rows = [part(hood, 1000), part(F.concat(F.lit("cat__reason_"), "reason"), 500), part(F.lit("remainder__month"), 250), part(F.lit("bias"), 100)]
    return rounded(model.rollup_importance(reduce(DataFrame.unionByName, rows)), "importance")


# --- features ---------------------------------------------------------------

PIN_SQL = f"""
pins AS MATERIALIZED (SELECT case_enquiry_id, latitude AS lat, longitude AS lon, open_dt FROM cases WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
places AS MATERIALIZED (SELECT DISTINCT lat, lon FROM pins),
pairs AS MATERIALIZED (SELECT a.lat, a.lon, b.lat AS near_lat, b.lon AS near_lon FROM places a JOIN places b
  ON b.lat BETWEEN a.lat - 0.0003 AND a.lat + 0.0003 AND b.lon BETWEEN a.lon - 0.0005 AND a.lon + 0.0005
  WHERE {dist_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 30),
repeats AS (SELECT p.case_enquiry_id, p.lat, p.lon, q.near_lat, q.near_lon FROM pins p JOIN pairs USING (lat, lon)
  JOIN (SELECT lat AS near_lat, lon AS near_lon, open_dt AS t FROM pins) q USING (near_lat, near_lon)
  WHERE q.t < p.open_dt AND q.t >= p.open_dt - INTERVAL 90 DAY)"""
COUNT_SQL = PIN_SQL + """,
f1 AS (SELECT a.case_enquiry_id, count(b.case_enquiry_id) AS neigh_open_14d FROM cases a LEFT JOIN cases b ON a.neighborhood = b.neighborhood
  AND b.open_dt < a.open_dt AND b.open_dt >= a.open_dt - INTERVAL 14 DAY AND (b.closed_dt IS NULL OR b.closed_dt > a.open_dt) GROUP BY 1),
f2 AS (SELECT c.case_enquiry_id, count(r.case_enquiry_id) AS prev_repeat_90d_30m FROM cases c LEFT JOIN repeats r ON c.case_enquiry_id = r.case_enquiry_id GROUP BY 1),
f3 AS (SELECT a.case_enquiry_id, count(b.case_enquiry_id) AS dept_pressure_30d FROM cases a LEFT JOIN cases b ON a.department = b.department
  AND b.open_dt < a.open_dt AND b.open_dt >= a.open_dt - INTERVAL 30 DAY GROUP BY 1),
feat AS (SELECT *, CAST(hour(lt) AS INTEGER) AS hour_of_day, CAST(dayofweek(lt) + 1 AS INTEGER) AS day_of_week, CAST(month(lt) AS INTEGER) AS month,
  CAST(on_time = 'ONTIME' AS INTEGER) AS y_priority
  FROM (SELECT *, (open_dt AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS lt FROM cases)
  JOIN f1 USING (case_enquiry_id) JOIN f2 USING (case_enquiry_id) JOIN f3 USING (case_enquiry_id))"""
FEATURE_COLS = ", ".join(features.FEATURES)


@query("j10_place_repeats", "SELECT lat, lon, near_lat, near_lon, count(*) AS n_pairs FROM repeats GROUP BY ALL", PIN_SQL)
def _(v):
    return features.place_repeats(v.cases)


@query("f01_neigh_open_14d", "SELECT case_enquiry_id, neigh_open_14d FROM f1", COUNT_SQL)
def _(v):
    return features.neigh_open_14d(v.cases)


@query("f02_prev_repeat", "SELECT case_enquiry_id, prev_repeat_90d_30m FROM f2", COUNT_SQL)
def _(v):
    return features.prev_repeat(v.cases)


@query("f03_dept_pressure", "SELECT case_enquiry_id, dept_pressure_30d FROM f3", COUNT_SQL)
def _(v):
    return features.dept_pressure(v.cases)


@query("f04_calendar", """SELECT case_enquiry_id, CAST(hour(lt) AS INTEGER) AS hour_of_day, CAST(dayofweek(lt) + 1 AS INTEGER) AS day_of_week, CAST(month(lt) AS INTEGER) AS month
    FROM (SELECT *, (open_dt AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS lt FROM cases)""")
def _(v):
    return features.calendar_features(v.cases).select("case_enquiry_id", "hour_of_day", "day_of_week", "month")


@query("f05_train_features", f"SELECT case_enquiry_id, y_priority, {FEATURE_COLS} FROM feat", COUNT_SQL)
def _(v):
    return features.train_features(v.cases)


@query("f06_open_features", f"SELECT case_enquiry_id, {FEATURE_COLS}, latitude, longitude FROM feat WHERE case_status = 'Open'", COUNT_SQL)
def _(v):
    return features.open_features(v.cases)


@query("j11_tag_polygon", """SELECT case_enquiry_id, CASE WHEN k < 23 THEN 'CELL ' || k END AS polygon_name FROM (
    SELECT case_enquiry_id, CASE WHEN latitude IS NOT NULL THEN (_id % 83) // 17 + 5 * ((_id % 79) // 16) END AS k FROM cases)""")
def _(v):
    polygons = geo.ref_neighborhoods(read_polygons(v))
    return geo.tag_polygon(v.cases, polygons).select("case_enquiry_id", "polygon_name")


@query("j11_tag_by_cover", """SELECT case_enquiry_id, CASE WHEN k < 23 THEN 'CELL ' || k END AS polygon_name FROM (
    SELECT case_enquiry_id, CASE WHEN latitude IS NOT NULL THEN (_id % 83) // 17 + 5 * ((_id % 79) // 16) END AS k FROM cases)""")
def _(v):
    polygons = geo.ref_neighborhoods(read_polygons(v))
    return cover.tag(v.cases, cover.cover(polygons)).select("case_enquiry_id", "polygon_name")


# --- model ------------------------------------------------------------------


@query("m01_encode", "SELECT feature, total FROM (" + " UNION ALL ".join(
    [f"SELECT 'cat__{c}_' || coalesce({c}, 'None') AS feature, count(*)::DOUBLE AS total FROM feat GROUP BY 1" for c in model.CATEGORICAL]
    + [f"SELECT 'remainder__{c}', sum({c})::DOUBLE FROM feat" for c in model.NUMERIC]) + ")", COUNT_SQL)
def _(v):
    return model.encoded_totals(cut(features.train_features(v.cases)))


_chains: dict[tuple[str, str], model.Chain] = {}


def chain(v) -> model.Chain:
    """One training run per session and set of tables; all model queries read it."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir)
    if key not in _chains:
        _chains[key] = model.train(cut(features.train_features(v.cases)))
    return _chains[key]


def published(v):
    """The run's model, saved and loaded back."""
    run = chain(v)
    path = model.publish(run.model, run.report, fresh_path(v.spark, "models"), "priority", "gbt", "20010810000000", "tbl_train_features")
    return path, model.load(v.spark, path)


def within_unit(*cols: str):
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(c).between(0, 1), F.lit(False)) for c in cols])


RUN_METRICS = ("val_roc_auc", "val_pr_auc", "val_p_at_5", "val_accuracy", "val_precision", "val_recall", "val_f1")


@query("m02_fit_candidates")
def _(v):
    return chain(v).runs


@query("m02_run_log", "SELECT * FROM (VALUES (0::INTEGER, 'gbt_baseline', 'gbt', true), (1, 'gbt_regularized', 'gbt', true)) t(run_index, name, algo, in_range)")
def _(v):
    return chain(v).runs.select("run_index", "name", "algo", within_unit(*RUN_METRICS).alias("in_range"))


@query("m03_best_candidate")
def _(v):
    return ranking.best_run(chain(v).runs)


@query("m03_best_is_first", "SELECT true AS is_best, 1::BIGINT AS n_rows")
def _(v):
    best = ranking.best_run(chain(v).runs)
    top = chain(v).runs.agg(F.max("val_pr_auc")).scalar()
    return best.agg(
        F.bool_and((F.col("val_pr_auc") == top) & (F.col("name") == chain(v).best)).alias("is_best"), F.count("*").alias("n_rows")
    )


@query("m04_final_report")
def _(v):
    return chain(v).report


@query("m04_report_counts", """SELECT count(*) AS n_test, CAST(sum(label) AS BIGINT) AS n_positive, round(avg(label), 6) AS base_rate, 15::BIGINT AS n_metrics, true AS in_range
    FROM split WHERE part = 'test'""", SPLIT_SQL)
def _(v):
    value = lambda *names: F.sum(F.when(F.col("metric").isin(*names), F.col("value")))
    counts = ("tp", "fp", "tn", "fn")
    return chain(v).report.agg(
        value(*counts).cast("bigint").alias("n_test"),
        value("tp", "fn").cast("bigint").alias("n_positive"),
        F.round(value("base_rate"), 6).alias("base_rate"),
        F.count("*").alias("n_metrics"),
        F.bool_and(F.col("metric").isin(*counts) | within_unit("value")).alias("in_range"),
    )


@query("m07_score_open")
def _(v):
    return model.score_open(chain(v).model, features.open_features(v.cases))


@query("m07_open_ranks", """SELECT count(*) AS n_open, 1::BIGINT AS first_rank, count(*) AS last_rank, count(*) AS n_ranks,
    CAST(greatest(1, floor(0.05::DOUBLE * count(*))) AS BIGINT) AS n_critical, true AS in_range FROM cases WHERE case_status = 'Open'""")
def _(v):
    scored = cut(model.score_open(chain(v).model, features.open_features(v.cases)))
    return scored.agg(
        F.count("*").alias("n_open"), F.min("rank_overall").alias("first_rank"), F.max("rank_overall").alias("last_rank"),
        F.count_distinct("rank_overall").alias("n_ranks"), F.count_if(F.col("segment") == "CRITICAL").alias("n_critical"),
        F.bool_and(within_unit("priority_score")).alias("in_range"),
    )


def newest_open(v):
    newest = filters.latest_n(v.cases.where("case_status = 'Open'"), 10).select("case_enquiry_id")
    return features.open_features(v.cases).join(newest, "case_enquiry_id", "left_semi")


@query("m08_score_some")
def _(v):
    return model.score(chain(v).model, newest_open(v)).select("case_enquiry_id", "priority_score")


@query("m08_same_as_batch", "SELECT 10::BIGINT AS n_scored, 0::BIGINT AS n_differing")
def _(v):
    some = model.score(chain(v).model, newest_open(v)).select("case_enquiry_id", F.col("priority_score").alias("alone"))
    batch = model.score_open(chain(v).model, features.open_features(v.cases)).select("case_enquiry_id", "priority_score")
    both = some.join(batch, "case_enquiry_id")
    return both.agg(F.count("*").alias("n_scored"), F.count_if(F.abs(F.col("alone") - F.col("priority_score")) > 1e-9).alias("n_differing"))


@query("m12_importance")
def _(v):
    return model.rollup_importance(model.importance(chain(v).model, v.spark))


@query("m12_importance_sum", "SELECT 9::BIGINT AS n_features, 1.0::DOUBLE AS total")
def _(v):
    rows = model.rollup_importance(model.importance(chain(v).model, v.spark))
    return rows.agg(F.count("*").alias("n_features"), F.round(F.sum("importance"), 6).alias("total"))


@query("m12_sensitivity")
def _(v):
    return model.sensitivity(chain(v).model, chain(v).part("test"))


@query("m12_additive", """SELECT count(*) AS n_rows, 0::BIGINT AS n_differing, (SELECT 9::BIGINT) AS n_features FROM split WHERE part = 'test'""", SPLIT_SQL)
def _(v):
    run = chain(v)
    rows = model.attributed(run.model, run.part("test"), ["case_enquiry_id"])
    total = F.aggregate("attributions", F.lit(boosting.expected(run.model)), lambda a, x: a + x)
    names = run.model.numbers + run.model.categories
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_if(F.abs(total - F.col("raw")) > 1e-6).alias("n_differing"),
        F.lit(len(names)).cast("bigint").alias("n_features"),
    )


@query("m12_permutation_importance")
def _(v):
    return model.permutation_importance(chain(v).model, chain(v).part("test"))


GATE_CTES = curve_sql("(SELECT * FROM scores WHERE open_dt >= TIMESTAMP '2000-01-01')", name="new") + "," + curve_sql(
    "(SELECT * FROM scores WHERE open_dt < TIMESTAMP '2000-01-01')", name="old")


def promotion(v):
    since = F.col("open_dt") >= F.lit("2000-01-01").cast("timestamp")
    new, old = (ranking.curve_metrics(v.scores.where(c), "label", "priority_score") for c in (since, ~since))
    return fairness.promotion_gate(new, old, "pr_auc")


@query("m05_promotion_gate", """SELECT round(n.pr_auc, 6) AS new_value, round(o.pr_auc, 6) AS base_value, round(n.pr_auc - o.pr_auc, 6) AS delta,
    NOT (n.pr_auc - o.pr_auc < -0.005) AS promoted FROM new n, old o""", GATE_CTES)
def _(v):
    return rounded(promotion(v), "new_value", "base_value", "delta")


GATE_SQL = slices_sql("scores") + ",\n" + gap_sql("sl_m") + """,
checked AS (SELECT slice_type || '_' || metric || '_gap' AS gap_name, gap, CASE WHEN metric IN ('accuracy', 'recall') THEN 0.06::DOUBLE END AS gap_limit FROM gaps)"""


def checked_gaps(v):
    gaps = cut(fairness.disparities(fairness.clf_metrics_by_slice(v.scores, "label", "priority_score")))
    limits = gaps.where(F.col("metric").isin("accuracy", "recall")).select("gap_name", F.lit(0.06).alias("gap_limit"))
    return fairness.fairness_gate(gaps, limits)


@query("m06_fairness_gate", "SELECT gap_name, round(gap, 6) AS gap, gap_limit, coalesce(gap <= gap_limit, true) AS passed FROM checked", GATE_SQL)
def _(v):
    return rounded(checked_gaps(v), "gap")


@query("m06_gate_verdict", """SELECT bool_and(coalesce(gap <= gap_limit, true)) AS passed, count(*) FILTER (NOT coalesce(gap <= gap_limit, true)) AS n_failed FROM checked""", GATE_SQL)
def _(v):
    return fairness.gate_verdict(checked_gaps(v))


@query("m06_gate_verdict_with_metric", """SELECT bool_and(coalesce(gap <= gap_limit, true)) AND (SELECT NOT (n.pr_auc - o.pr_auc < -0.005) FROM new n, old o) AS passed,
    count(*) FILTER (NOT coalesce(gap <= gap_limit, true)) AS n_failed FROM checked""", GATE_SQL.strip() + "," + GATE_CTES)
def _(v):
    return fairness.gate_verdict(checked_gaps(v), promotion(v))


@query("m09_balance_drift", """SELECT round(avg(label), 6) AS class_balance, round(abs(avg(label) - 0.65), 6) AS balance_diff, abs(avg(label) - 0.65) > 0.10 AS balance_drift FROM scores""")
def _(v):
    return rounded(model.balance_drift(v.scores, "label"), "class_balance", "balance_diff")


DRIFT_SQL = """
sides AS (SELECT *, CAST(ts < TIMESTAMP '2024-01-16' AS INTEGER) AS r FROM events),
nums AS (SELECT 'value' AS feature, value AS x, r FROM sides UNION ALL SELECT 'user_id', user_id, r FROM sides),
numc AS (SELECT feature, x, sum(r) AS r, sum(1 - r) AS c FROM nums GROUP BY 1, 2),
ks AS (SELECT feature, max(abs(cr / nr::DOUBLE - cc / nc::DOUBLE)) AS distance FROM (
  SELECT *, sum(r) OVER (PARTITION BY feature ORDER BY x) AS cr, sum(c) OVER (PARTITION BY feature ORDER BY x) AS cc,
    sum(r) OVER (PARTITION BY feature) AS nr, sum(c) OVER (PARTITION BY feature) AS nc FROM numc) GROUP BY 1),
cats AS (SELECT event_type AS x, sum(r) / (SELECT sum(r) FROM sides)::DOUBLE AS p, sum(1 - r) / (SELECT sum(1 - r) FROM sides)::DOUBLE AS q FROM sides GROUP BY 1),
js AS (SELECT 'event_type' AS feature, sqrt(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS distance FROM cats),
drift AS (SELECT * FROM ks UNION ALL SELECT * FROM js),
drifts AS (SELECT count(*) FILTER (distance > 0.1) / count(*)::DOUBLE AS drift_share, count(*) AS n_features, count(*) FILTER (distance > 0.1) AS n_drifted FROM drift)"""


def events_drift(v):
    e = v.table("events")
    first = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return model.feature_drift(e.where(first), e.where(~first), ["value", "user_id"], ["event_type"])


@query("m10_feature_drift", "SELECT feature, round(distance, 6) AS distance, distance > 0.1 AS drifted FROM drift", DRIFT_SQL)
def _(v):
    return rounded(events_drift(v), "distance")


HEALTH_SQL = f"""
win AS (SELECT label, priority_score FROM scores WHERE open_dt BETWEEN TIMESTAMP '2001-07-11' AND TIMESTAMP '{AS_OF}'),
{curve_sql('win').strip()},
{DRIFT_SQL.strip()},
h AS (SELECT (SELECT count(*) FROM win) AS n_rows, (SELECT roc_auc FROM curve) AS auc, (SELECT sqrt(avg(pow(priority_score - label, 2))) FROM win) AS rmse,
  (SELECT avg(label) FROM win) AS cb, drift_share, n_features, n_drifted, drift_share >= 0.5 AS dataset_drift FROM drifts)"""


@query("m11_health_row", f"""SELECT TIMESTAMP '{AS_OF}' AS run_timestamp, TIMESTAMP '2001-07-11' AS window_start, TIMESTAMP '{AS_OF}' AS window_end, n_rows, round(auc, 6) AS auc,
    round(rmse, 6) AS rmse, auc < 0.8 OR rmse > 0.3 AS decay_flag, abs(cb - 0.65) > 0.1 OR drift_share >= 0.3 OR dataset_drift AS drift_flag, round(cb, 6) AS class_balance,
    round(drift_share, 6) AS drift_share, n_features, n_drifted, dataset_drift,
    concat_ws(' ', CASE WHEN auc < 0.8 THEN printf('AUC below threshold (%.3f < 0.800).', auc) END,
      CASE WHEN rmse > 0.3 THEN printf('RMSE above threshold (%.3f > 0.300).', rmse) END,
      CASE WHEN abs(cb - 0.65) > 0.1 THEN printf('Class balance drift detected (current=%.3f, baseline=0.650, diff=%.3f > 0.100).', cb, abs(cb - 0.65)) END,
      CASE WHEN drift_share >= 0.3 OR dataset_drift THEN printf('Evidently feature drift detected (drift_share=%.3f ≥ 0.300, n_drifted=%d/%d, dataset_drift=%s).', drift_share, n_drifted, n_features,
        CASE WHEN dataset_drift THEN 'True' ELSE 'False' END) END) AS notes
    FROM h""", HEALTH_SQL)
def _(v):
    window = filters.labelled_window(v.scores, "2001-07-11", AS_OF, "open_dt", "priority_score", "label")
    row = model.health_row(window, "label", "priority_score", model.drift_summary(events_drift(v)), AS_OF, "2001-07-11 00:00:00", AS_OF)
    return rounded(row, "auc", "rmse", "class_balance", "drift_share")


@query("t10_append_metrics", """SELECT n_rows, round(auc, 6) AS auc, n_drifted FROM h UNION ALL SELECT n_rows, round(auc, 6), n_drifted FROM h""", HEALTH_SQL)
def _(v):
    path = fresh_path(v.spark, "model_metrics")
    window = filters.labelled_window(v.scores, "2001-07-11", AS_OF, "open_dt", "priority_score", "label")
    row = cut(model.health_row(window, "label", "priority_score", model.drift_summary(events_drift(v)), AS_OF, "2001-07-11 00:00:00", AS_OF))
    append_metrics(row, path)
    append_metrics(row, path)
    return rounded(v.spark.read.parquet(path).select("n_rows", "auc", "n_drifted"), "auc")


@query("m13_publish", """SELECT 'priority' AS model_name, 'tbl_train_features' AS feature_table, 15::BIGINT AS n_metrics,
    (SELECT count(*) FROM cases WHERE case_status = 'Open') AS n_scored, 0::BIGINT AS n_differing""")
def _(v):
    path, loaded = published(v)
    opened = cut(features.open_features(v.cases))
    before = model.score(chain(v).model, opened).select("case_enquiry_id", F.col("priority_score").alias("before"))
    after = model.score(loaded, opened).select("case_enquiry_id", "priority_score")
    same = cut(before.join(after, "case_enquiry_id").agg(
        F.count("*").alias("n_scored"), F.count_if(F.col("before") != F.col("priority_score")).alias("n_differing")
    ))
    schema = "metric string, value double, model_name string, feature_table string"
    meta = v.spark.read.schema(schema).json(f"{path}/metadata").groupBy("model_name", "feature_table").agg(F.count("*").alias("n_metrics"))
    return meta.withColumn("n_scored", same.select("n_scored").scalar()).withColumn("n_differing", same.select("n_differing").scalar())


def test_part(v):
    return cut(ranking.split(v.scores, "case_enquiry_id", "label").where("part = 'test'"))


M14_SQL = SPLIT_SQL.strip() + """,
tst AS (SELECT * FROM split WHERE part = 'test'),""" + slices_sql("tst", "sl3") + """,
sl AS (SELECT * FROM sl3 UNION ALL SELECT 'overall', 'overall', label, priority_score FROM tst),
sl_m AS (SELECT slice_type, slice_group, tp + fp + tn + fn AS n, (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision,
  coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1
  FROM (""" + conf_sql("sl", "slice_type, slice_group") + ")), " + curve_sql("sl", "slice_type, slice_group") + """,
m14 AS (SELECT * FROM sl_m JOIN curve USING (slice_type, slice_group))"""


@query("m14_bias_report", f"SELECT slice_type, slice_group, n, {RATE_COLS}, {AUC_COLS} FROM m14", M14_SQL)
def _(v):
    return rounded(model.bias_report(test_part(v), "label", "priority_score"), *RATES, *AUCS)


@query("m14_bias_gaps", gap_select("> 0.1 AND metric NOT IN ('roc_auc', 'pr_auc')"),
       M14_SQL + ",\ngrp AS (SELECT * FROM m14 WHERE slice_type <> 'overall'),\n" + gap_sql("grp", (*RATES, "roc_auc", "pr_auc")))
def _(v):
    return rounded(model.bias_gaps(cut(model.bias_report(test_part(v), "label", "priority_score"))), *GAP_COLS)


# --- vectors ----------------------------------------------------------------


@query("v01_vector_table", """SELECT "column", value, CAST(i AS INTEGER) AS i, round(x, 6) AS x FROM (
    SELECT "column", value, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS i FROM vectors)""")
def _(v):
    return v.vectors.select("column", "value", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("v02_topk", "SELECT query_id, CAST(place AS INTEGER) AS place, value, round(raw, 4) AS score FROM matches WHERE place <= 5 AND raw >= 0.1")
def _(v):
    return vectors.topk(v.lookups, v.vectors, 5, 0.1)


@query("j08_best_match", "SELECT query_id, value, round(raw, 4) AS score FROM matches WHERE place = 1")
def _(v):
    return vectors.topk(v.lookups, v.vectors, 1, -1.0).select("query_id", "value", "score")


@query("k06_partial_topk", "SELECT query_id, CAST(place AS INTEGER) AS place, value FROM matches WHERE place <= 3 AND raw >= 0.3")
def _(v):
    return vectors.topk(v.lookups, v.vectors, 3, 0.3).select("query_id", "place", "value")


FAQ_ID = "CASE WHEN label < 5 THEN vec_id {0} 2 ELSE 1000000 + vec_id {0} 4 END"
FAQ_SQL = f"""
parts AS (SELECT {FAQ_ID.format('//')} AS id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM unit),
means AS (SELECT id, list(x ORDER BY i) AS m FROM (SELECT id, i, avg(x) AS x FROM parts GROUP BY 1, 2) GROUP BY 1),
faqs AS (SELECT id, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS w FROM means),
best AS (SELECT vec_id, id, round(dot, 4) AS score FROM (SELECT vec_id, id, list_dot_product(v, w) AS dot,
  row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(v, w) DESC, id) AS place FROM unit JOIN faqs ON true) WHERE place = 1 AND dot >= 0.5)"""


@query("v03_faq_answer", """SELECT vec_id AS query_id, id AS faq_id, score, CASE WHEN score >= 0.7 THEN 'Answer ' || id
    WHEN score >= 0.5 THEN 'Answer ' || id || chr(10) || chr(10) || 'Call for more.' ELSE 'Please call.' END AS answer_text
    FROM unit LEFT JOIN best USING (vec_id)""", FAQ_SQL)
def _(v):
    # questions are the mean vectors of two or four entries
    e = v.table("embeddings").join(v.vectors.select(F.col("value").alias("vec_id"), "vector"), "vec_id")
    cells = e.select(F.expr(FAQ_ID.format("div")).alias("id"), F.posexplode("vector").alias("i", "x"))
    means = cells.groupBy("id", "i").agg(F.avg("x").alias("x")).groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m")
    )
    faqs = means.select("id", F.concat(F.lit("Answer "), "id").alias("answer"), "m", F.lit("faq").alias("c"))
    ask = e.select(F.col("vec_id").alias("query_id"), F.lit("faq").alias("column"), "vector")
    table = vectors.vector_table(faqs, "c", "id", "m")
    return vectors.faq_answer(ask, faqs, table, "Call for more.", "Please call.")


@query("v04_hints", """SELECT query_id // 5 AS request_id, string_agg("column" || '=' || value, ', ' ORDER BY "column" || '=' || value) AS hints
    FROM matches WHERE place = 1 AND raw >= 0.1 GROUP BY 1""")
def _(v):
    entities = v.lookups.select(
        F.expr("query_id div 5").alias("request_id"), F.col("query_id").alias("entity_id"), "column", "vector"
    )
    return vectors.hints(entities, v.vectors).withColumn("hints", F.array_join("hints", ", "))


KNOWN = [f"c{i}" for i in range(9)]
GROUND_SQL = """
grounded AS (SELECT q.query_id AS entity_id, q."column", 'raw ' || q.query_id AS raw, coalesce(CAST(m.value AS VARCHAR), 'raw ' || q.query_id) AS grounded,
  m.value IS NOT NULL AS matched FROM lookups q LEFT JOIN (SELECT * FROM matches WHERE place = 1 AND raw >= 0.4 AND "column" <> 'c9') m ON m.query_id = q.query_id)"""


def grounded(v):
    entities = v.lookups.select(
        F.col("query_id").alias("entity_id"), "column", F.concat(F.lit("raw "), "query_id").alias("raw"), "vector"
    )
    return vectors.ground(entities, v.vectors, KNOWN)


@query("v05_ground", 'SELECT entity_id, "column", raw, grounded, matched FROM grounded', GROUND_SQL)
def _(v):
    return grounded(v)


ACCURACY_SQL = """SELECT count(*) AS n_cases, count(*) FILTER (ok) AS n_passed, round(avg(CAST(ok AS INTEGER)) * 100, 6) AS accuracy_pct FROM (
    SELECT m.query_id // 2 AS case_id, bool_and(g.grounded = CAST(m.value AS VARCHAR)) AS ok FROM matches m JOIN grounded g ON g.entity_id = m.query_id WHERE m.place = 1 GROUP BY 1)"""


def accuracy(v):
    """Expected: the best value of each entity whatever its score, two entities per case."""
    case, key = F.expr("query_id div 2").alias("case_id"), F.col("query_id").cast("string").alias("key")
    gold = vectors.topk(v.lookups, v.vectors, 1, -1.0).select(case, key, F.col("value").cast("string").alias("value"))
    got = grounded(v).withColumnRenamed("entity_id", "query_id").select(case, key, F.col("grounded").alias("value"))
    return rounded(vectors.retrieval_accuracy(got, gold), "accuracy_pct")


@query("v06_retrieval_accuracy", ACCURACY_SQL, GROUND_SQL)
def _(v):
    return accuracy(v)


@query("j09_expected_vs_predicted", """SELECT m.query_id, g.grounded = CAST(m.value AS VARCHAR) AS agrees FROM matches m JOIN grounded g ON g.entity_id = m.query_id WHERE m.place = 1""", GROUND_SQL)
def _(v):
    gold = vectors.topk(v.lookups, v.vectors, 1, -1.0)
    return gold.join(grounded(v).withColumnRenamed("entity_id", "query_id"), "query_id").select(
        "query_id", (F.col("grounded") == F.col("value").cast("string")).alias("agrees")
    )


# --- streams ----------------------------------------------------------------


def event_stream(v, failed):
    rows = jobs.read_files(v.spark, v.sf_dir, "events.parquet", "ts")
    path = F.expr("concat('/p', user_id % 8)")
    return rows.select("ts", path.alias("path"), F.col("event_type").alias("step"), F.col("value").alias("latency_ms"), failed.alias("failed"))


def run_metrics(v, by, failed, **windows):
    out, state = fresh_path(v.spark, "stream_out"), fresh_path(v.spark, "stream_state")
    jobs.write_updates(jobs.request_metrics(event_stream(v, failed), by, **windows), out, state).awaitTermination()
    rows = jobs.latest_updates(v.spark, out, ["window_start", by])
    return rounded(rows.select("window_start", by, "n", "avg_latency_ms", "error_rate"), "avg_latency_ms", "error_rate")


@query("r01_stream_by_path", """SELECT date_trunc('day', ts) AS window_start, '/p' || (user_id % 8) AS path, count(*) AS n, round(avg(value), 6) AS avg_latency_ms,
    round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS error_rate FROM events GROUP BY 1, 2""")
def _(v):
    return run_metrics(v, "path", F.col("event_type") == "error")


@query("r01_stream_by_step_sliding", """SELECT window_start, step, count(*) AS n, round(avg(value), 6) AS avg_latency_ms, round(count(*) FILTER (value >= 100) / count(*)::DOUBLE, 6) AS error_rate
    FROM (SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(h) AS window_start, event_type AS step, value FROM events, (VALUES (0), (12)) t(h)) GROUP BY 1, 2""")
def _(v):
    return run_metrics(v, "step", F.col("value") >= 100, width="1 day", slide="12 hours")


@query("r01_stream_p95", """SELECT date_trunc('day', ts) AS window_start, '/p' || (user_id % 8) AS path, quantile_disc(value, 0.95) AS p95_latency_ms FROM events GROUP BY 1, 2""")
def _(v):
    # far fewer rows per window than the sketch keeps, so it is exact here
    out, state = fresh_path(v.spark, "stream_out"), fresh_path(v.spark, "stream_state")
    rows = jobs.request_metrics(event_stream(v, F.col("event_type") == "error"), "path", with_p95=True)
    jobs.write_updates(rows, out, state, jobs.ONCE).awaitTermination()
    return jobs.latest_updates(v.spark, out, ["window_start", "path"]).select("window_start", "path", "p95_latency_ms")


@query("r01_stream_sliding_panes", """SELECT window_start, step, count(*) AS n, round(avg(value), 6) AS avg_latency_ms, round(count(*) FILTER (value >= 100) / count(*)::DOUBLE, 6) AS error_rate, true AS p95_close
    FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(h) AS window_start, event_type AS step, value FROM events, (VALUES (0), (6), (12), (18)) t(h)) GROUP BY 1, 2""")
def _(v):
    out, state = fresh_path(v.spark, "panes"), fresh_path(v.spark, "stream_state")
    jobs.write_updates(jobs.pane_metrics(event_stream(v, F.col("value") >= 100), "step", "6 hours"), out, state).awaitTermination()
    jobs.compact(v.spark, out, ["pane_start", "step"])
    rows = cut(jobs.windows_of(jobs.latest_updates(v.spark, out, ["pane_start", "step"]), "step", "1 day", "6 hours"))
    # The share of the window's values below the sketch's answer, and up to it, must hold 0.95 between them.
    every = v.table("events").select(
        F.window(F.col("ts").cast("timestamp"), "1 day", "6 hours")["start"].alias("window_start"), F.col("event_type").alias("step"), "value"
    )
    ranks = every.join(rows.select("window_start", "step", "p95_latency_ms"), ["window_start", "step"]).groupBy("window_start", "step").agg(
        F.avg((F.col("value") < F.col("p95_latency_ms")).cast("int")).alias("below"), F.avg((F.col("value") <= F.col("p95_latency_ms")).cast("int")).alias("upto")
    )
    close = (F.col("below") <= 0.97) & (F.col("upto") >= 0.93)
    return rounded(rows.join(ranks, ["window_start", "step"]).select(
        "window_start", "step", "n", "avg_latency_ms", "error_rate", close.alias("p95_close")
    ), "avg_latency_ms", "error_rate")


_FIRST = upsert_sql("target", "(SELECT * FROM staging WHERE _ingested_at < TIMESTAMP '2001-08-01')")
_SECOND = upsert_sql("v1", "(SELECT * FROM staging WHERE _ingested_at > TIMESTAMP '2001-08-01')")


def arrive(rows, folder):
    rows.write.mode("append").option("ignoreNullFields", "false").option("compression", "gzip").json(folder)
    settle(rows.sparkSession)


def upserted(v, target, staging):
    """The table by month after two arrivals, each one stream run; between runs no version but the newest is kept."""
    from curbline.schemas import CASE_SCHEMA

    folder, table, state = (fresh_path(v.spark, n) for n in ("arrivals", "by_month", "state"))
    maintain.create_months(target, table)
    settle(v.spark)
    second = F.col("_ingested_at") == F.lit(SECOND_INGEST).cast("timestamp")
    for part in (~second, second):
        arrive(staging.where(part), folder)
        stream = v.spark.readStream.schema(CASE_SCHEMA).json(folder)
        jobs.upsert_by_month(stream, table, state, order=BATCH_ORDER).awaitTermination()
        commits.vacuum(v.spark, table)
    return commits.read(v.spark, table).select(*CORE)


@query("r02_stream_upsert", _SECOND, f"v1 AS ({_FIRST})")
def _(v):
    return upserted(v, v.target, v.staging)


_UNDATED = undated_sql("staging", 5)


@query("r02_stream_upsert_by_month", upsert_sql("v1", f"(SELECT * FROM {_UNDATED} WHERE _ingested_at > TIMESTAMP '2001-08-01')"),
       f"v1 AS ({upsert_sql(undated_sql('target', 7), f'(SELECT * FROM {_UNDATED} WHERE _ingested_at < TIMESTAMP {chr(39)}2001-08-01{chr(39)})')})")
def _(v):
    return upserted(v, undated(v.target, 7), undated(v.staging, 5))


@query("r03_stream_dedup", "SELECT DISTINCT case_enquiry_id FROM staging")
def _(v):
    from curbline.schemas import CASE_SCHEMA

    folder, out, state = (fresh_path(v.spark, n) for n in ("arrivals", "deduped", "state"))
    arrive(v.staging, folder)
    stream = v.spark.readStream.schema(CASE_SCHEMA).json(folder)
    (
        jobs.dedup(stream).select("case_enquiry_id").writeStream.outputMode("append").format("parquet")
        .option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        .awaitTermination()
    )
    return v.spark.read.parquet(out)
