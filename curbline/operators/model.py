"""Priority model: encode, train, score, explain, monitor."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.functions.labels import norm_none
from curbline.functions.numeric import clamp01, ratio
from curbline.operators import boosting, fairness, ordered, ranking
from curbline.operators.boosting import Settings
from curbline.session import cut

CATEGORICAL = ["neighborhood", "reason", "department"]
NUMERIC = [
    "hour_of_day", "day_of_week", "month",
    "neigh_open_14d", "prev_repeat_90d_30m", "dept_pressure_30d",
]
LABEL = "y_priority"
SCORE = "priority_score"

# The two candidate settings, in the order they are tried.
CANDIDATES = [
    ("gbt_baseline", Settings(rate=0.08, depth=8, bins=255, l2=0.0)),
    ("gbt_regularized", Settings(rate=0.05, depth=8, bins=255, l2=0.5)),
]

# The settings of the long runs, without early stop.
LONG_CANDIDATES = [
    ("long_baseline", Settings(trees=300, depth=5, leaves=32, rate=0.05, rows_share=0.8, columns_share=0.8, l2=1.0, leaf_rows=1, leaf_weight=1.0, stop=0)),
    ("long_deeper", Settings(trees=500, depth=7, leaves=128, rate=0.03, rows_share=0.9, columns_share=0.9, l2=1.0, leaf_rows=1, leaf_weight=2.0, stop=0)),
]

# Monitoring thresholds.
MIN_AUC, MAX_RMSE, MAX_BALANCE_DRIFT, DRIFT_SHARE_LIMIT = 0.80, 0.30, 0.10, 0.30
BASELINE_POS_RATE = 0.65
DRIFT_DISTANCE = 0.1


def clean_inputs(df: DataFrame) -> DataFrame:
    """Null categories become ``None``, numbers become doubles."""
    return df.withColumns(
        {c: norm_none(c) for c in CATEGORICAL} | {c: F.col(c).cast("double") for c in NUMERIC}
    )


def feature_pipeline() -> list:
    """Stages: one-hot categories (an unknown one is all zeros), then the numbers."""
    index = [f"{c}_ix" for c in CATEGORICAL]
    hot = [f"cat__{c}" for c in CATEGORICAL]
    return [
        StringIndexer(inputCols=CATEGORICAL, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
        # the extra slot of unseen categories is dropped: it encodes as zeros
        OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True),
        VectorAssembler(inputCols=hot + NUMERIC, outputCol="features", handleInvalid="keep"),
    ]


def encoded_totals(df: DataFrame) -> DataFrame:
    """Sum of every encoded feature column, named after its source."""
    fitted = Pipeline(stages=feature_pipeline()).fit(clean_inputs(df))
    names = feature_names(fitted)
    # One vector sum over the (sparse) rows; only its total is spread out. The
    # summarizer carries means, so the sum is rounded.
    total = fitted.transform(clean_inputs(df)).agg(Summarizer.sum(F.col("features")).alias("sums"))
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)
    return total.select(F.posexplode(vector_to_array("sums")).alias("i", "total")).select(
        named.alias("feature"), F.round("total", 6).alias("total")
    )


def feature_names(fitted: PipelineModel) -> list[str]:
    labels = fitted.stages[0].labelsArray
    hot = [f"cat__{c}_{v}" for c, values in zip(CATEGORICAL, labels) for v in values]
    return hot + [f"remainder__{n}" for n in NUMERIC]


def fit(train: DataFrame, settings: Settings, weight: str | None = None, seed: int = 42, key: str = "case_enquiry_id") -> boosting.Model:
    return boosting.fit(clean_inputs(train), NUMERIC, CATEGORICAL, LABEL, key, settings, weight, seed)


def score(model: boosting.Model, df: DataFrame) -> DataFrame:
    """The frame with its positive-class probability as ``priority_score``."""
    p = boosting.probability(model).alias(SCORE)
    clean = clean_inputs(df.withColumns({f"_in_{c}": F.col(c) for c in CATEGORICAL + NUMERIC}))
    kept = [F.col(f"_in_{c}").alias(c) if c in CATEGORICAL + NUMERIC else F.col(c) for c in df.columns if c != SCORE]
    return clean.select(*kept, p)


def score_open(model: boosting.Model, open_cases: DataFrame) -> DataFrame:
    """Scored, ranked and segmented open cases."""
    cols = [
        "case_enquiry_id", *CATEGORICAL, "neigh_open_14d", "prev_repeat_90d_30m",
        "dept_pressure_30d", "latitude", "longitude", SCORE,
    ]
    return ranking.rank_and_segment(score(model, open_cases).select(*cols))


def evaluate(scored: DataFrame, label: str = LABEL) -> DataFrame:
    """One row: AUC, average precision, precision at 5 %, and rates at 0.5."""
    curve = ranking.curve_metrics(scored, label, SCORE)
    top = ranking.precision_of(scored, label, (0.05,))
    rates = fairness.clf_metrics(scored, label, SCORE)
    auc = curve.select(F.struct("roc_auc", "pr_auc")).scalar()
    return rates.withColumn("_c", auc).withColumn(
        "precision_at_k", top.select("precision_at_k").scalar()
    ).select("_c.roc_auc", "_c.pr_auc", "precision_at_k", *rates.columns)


def fit_candidates(train: DataFrame, validation: DataFrame, weight: str | None = None, candidates: list | None = None):
    """Fit every candidate (CANDIDATES unless given), validate it, and log one row per run.

    Returns (models by name, run log).
    """
    tried, runs = candidates or CANDIDATES, []
    with ThreadPoolExecutor(len(tried)) as pool:  # the small jobs of one leave room for those of another
        models = dict(zip([name for name, _ in tried], pool.map(lambda c: fit(train, c[1], weight), tried)))
    for i, (name, settings) in enumerate(tried):
        m = evaluate(cut(score(models[name], validation)))
        runs.append(
            m.select(
                F.lit(i).alias("run_index"), F.lit(name).alias("name"),
                F.lit("gbt").alias("algo"), F.lit(str(settings)).alias("params"),
                F.col("roc_auc").alias("val_roc_auc"), F.col("pr_auc").alias("val_pr_auc"),
                F.col("precision_at_k").alias("val_p_at_5"), F.col("accuracy").alias("val_accuracy"),
                F.col("precision").alias("val_precision"), F.col("recall").alias("val_recall"),
                F.col("f1").alias("val_f1"),
            )
        )
    return models, reduce(DataFrame.unionByName, runs)


def final_report(model: boosting.Model, test: DataFrame) -> DataFrame:
    """Test metrics as (metric, value) rows."""
    scored = cut(score(model, test))
    curve = ranking.curve_metrics(scored, LABEL, SCORE).select("roc_auc", "pr_auc")
    counts = fairness.confusion(scored, LABEL, SCORE)
    rates = fairness.rates(counts).drop("n")
    at = ranking.precision_of(scored, LABEL).select(
        F.format_string("precision_at_%.0f_pct", F.col("k") * 100).alias("metric"),
        F.col("precision_at_k").alias("value"),
    )
    base = scored.agg(F.avg(LABEL).alias("base_rate"))
    wide = [curve, counts, rates, ranking.threshold_of(scored), base]
    return reduce(DataFrame.unionByName, [_long(f) for f in wide]).unionByName(at)


def _long(row: DataFrame) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns]
    return row.select(F.inline(F.array(*pairs)))


def importance(model: boosting.Model, spark) -> DataFrame:
    """Each encoded column's share of the gains of the fitted trees; their number is bounded by the columns."""
    return spark.createDataFrame(list(boosting.gains(model).items()), "feature string, importance double")


def attributed(model: boosting.Model, df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, raw score and Shapley values per encoded column (``boosting.split_columns``) of every row."""
    return boosting.attributed(model, clean_inputs(df), keep)


def sensitivity(model: boosting.Model, df: DataFrame, key: str = "case_enquiry_id") -> DataFrame:
    """Mean size of the Shapley values, summed over the encoded columns of each feature, largest first."""
    return rollup_importance(boosting.mean_attributions(model, clean_inputs(df), key))


def rollup_importance(df: DataFrame) -> DataFrame:
    """Encoded columns summed back to their source feature, largest first."""
    f = F.col("feature")
    source = F.lit(None).cast("string")
    for c in CATEGORICAL:
        source = F.coalesce(source, F.when(f.startswith(f"cat__{c}"), F.lit(c)))
    plain = F.when(f.startswith("remainder__"), F.element_at(F.split(f, "__", 2), 2)).otherwise(f)
    return (
        df.groupBy(F.coalesce(source, plain).alias("feature"))
        .agg(F.sum("importance").alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def permutation_importance(model: boosting.Model, df: DataFrame, key: str = "case_enquiry_id", seed: int = 42) -> DataFrame:
    """Drop in average precision after one column is shuffled, per column.

    A column is shuffled by giving each row the value of another one, a different
    distance away in one hash order for each column. That order is made and
    stored once.
    """
    base = ranking.curve_metrics(score(model, df), LABEL, SCORE).agg(F.max("pr_auc")).scalar()
    columns = CATEGORICAL + NUMERIC
    rows = cut(ordered.global_rank(df, [F.xxhash64(F.col(key), F.lit(seed)).asc(), F.asc(key)], "_at"))
    n = rows.count()
    out = []
    for i, c in enumerate(columns):
        step = max(1, n * (i + 1) // (len(columns) + 1))
        values = rows.select(((F.col("_at") + step - 1) % n + 1).alias("_to"), F.col(c).alias("_value"))
        shuffled = rows.join(values, F.col("_at") == F.col("_to")).drop(c).withColumnRenamed("_value", c)
        m = ranking.curve_metrics(score(model, shuffled.select(*df.columns)), LABEL, SCORE)
        out.append(m.select(F.lit(c).alias("feature"), (base - F.col("pr_auc")).alias("importance")))
    return reduce(DataFrame.unionByName, out).orderBy(F.desc("importance"))


@dataclass
class Chain:
    """What one training run leaves: its rows with part and weight, the run log, the chosen model, its test report."""

    rows: DataFrame
    runs: DataFrame
    best: str
    model: boosting.Model
    report: DataFrame

    def part(self, name: str) -> DataFrame:
        return self.rows.where(F.col("part") == name).drop("part")


def train(features: DataFrame, key: str = "case_enquiry_id", weight: str = "sample_weight", candidates: list | None = None) -> Chain:
    """Weights on all rows, split, weighted fit of every candidate, the best one
    fitted again with weights on train and validation, and its report on test."""
    weights = fairness.bias_weights(features, key).select(key, weight)
    rows = cut(ranking.split(features, key, LABEL).join(weights, key))
    chain = Chain(rows, rows, "", None, rows)
    _models, runs = fit_candidates(chain.part("train"), chain.part("validation"), weight, candidates)
    chain.runs = cut(runs)
    chain.best = ranking.best_run(chain.runs).first()["name"]
    both = rows.where(F.col("part").isin("train", "validation")).drop("part")
    chain.model = fit(both, dict(candidates or CANDIDATES)[chain.best], weight, key=key)
    chain.report = cut(final_report(chain.model, chain.part("test")))
    return chain


def load(spark, path: str) -> boosting.Model:
    """The model that ``publish`` saved."""
    return boosting.Model.of_json(spark.read.text(f"{path}/model", wholetext=True).first()[0])


def publish(model: boosting.Model, report: DataFrame, root: str, name: str, algo: str, stamp: str, table: str) -> str:
    """Save the model under name_algo_timestamp with its metrics beside it."""
    path = f"{root}/{name}_{algo}_{stamp}"
    saved = report.sparkSession.createDataFrame([(model.to_json(),)], "value string")
    saved.coalesce(1).write.mode("overwrite").text(f"{path}/model")
    report.withColumns({"model_name": F.lit(name), "feature_table": F.lit(table)}).repartition(1).write.mode(
        "overwrite"
    ).json(f"{path}/metadata")
    return path


OVERALL = "overall"


def bias_report(scored: DataFrame, label: str, score_col: str, dims=tuple(fairness.MODEL_SLICES)) -> DataFrame:
    """Rates and ranking quality of every slice, and of all rows (slice ``overall``), in one frame."""
    by = ["slice_type", "slice_group"]
    every = scored.withColumn(OVERALL, F.lit(OVERALL))
    rows = fairness.model_slices(every, label, score_col, (*dims, OVERALL))
    rates = fairness.rates(fairness.confusion(rows, label, score_col, by=by), by)
    curve = ranking.curve_metrics(rows, label, score_col, by)
    return rates.join(curve, by, "left")


def bias_gaps(report: DataFrame) -> DataFrame:
    """Gaps of all six metrics over the groups of each slice; large gaps of the rates carry a warning."""
    groups = report.where(F.col("slice_type") != OVERALL)
    curves = fairness.disparities(groups, ("roc_auc", "pr_auc")).withColumn("warning", F.lit(None).cast("string"))
    return fairness.disparities(groups).unionByName(curves)


# --- monitoring -------------------------------------------------------------


def rmse(df: DataFrame, label: str, score_col: str) -> DataFrame:
    err = F.pow(clamp01(score_col) - F.col(label), 2)
    return df.agg(F.sqrt(F.avg(err)).alias("rmse"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.avg(label).alias("class_balance"))


def balance_drift(df: DataFrame, label: str, base: float = BASELINE_POS_RATE, limit: float = MAX_BALANCE_DRIFT) -> DataFrame:
    diff = F.abs(F.col("class_balance") - base)
    return class_balance(df, label).select(
        "class_balance", diff.alias("balance_diff"), (diff > limit).alias("balance_drift")
    )


def feature_drift(ref: DataFrame, cur: DataFrame, numeric: list[str], categorical: list[str], limit: float = DRIFT_DISTANCE) -> DataFrame:
    """Distance of every common feature between two frames.

    Numbers: two-sample Kolmogorov-Smirnov distance. Categories: Jensen-Shannon
    distance (base 2). Values are counted first, so the order statistics run
    over distinct values.
    """
    def long(df: DataFrame, side: str, cols: list[str], kind: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("v")) for c in cols])
        r, c = (F.lit(1), F.lit(0)) if side == "ref" else (F.lit(0), F.lit(1))
        return df.select(F.inline(pairs)).where(F.col("v").isNotNull()).select(
            "feature", "v", r.alias("r"), c.alias("c")
        )

    def counted(cols: list[str], kind: str) -> DataFrame:
        return (
            long(ref, "ref", cols, kind)
            .unionByName(long(cur, "cur", cols, kind))
            .groupBy("feature", "v")
            .agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
        )

    parts = []
    if numeric:
        run = ordered.running_totals(
            counted(numeric, "double"), ["feature"], [F.asc("v")], {"cr": "r", "cc": "c"}
        )
        total = cut(run.groupBy("feature").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc")))  # a row per feature
        gap = F.abs(ratio("cr", "nr") - ratio("cc", "nc"))
        parts.append(run.join(total, "feature").groupBy("feature").agg(F.max(gap).alias("distance")))
    if categorical:
        seen = counted(categorical, "string")
        total = cut(seen.groupBy("feature").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc")))
        p, q = ratio("r", "nr"), ratio("c", "nc")
        m = (p + q) / 2

        def part(x: Column) -> Column:
            # null when one side has no rows at all
            return F.when(x > 0, x * F.log2(F.try_divide(x, m))).when(x == 0, 0.0)

        js = F.sum((part(p) + part(q)) / 2)
        parts.append(
            seen.join(total, "feature").groupBy("feature").agg(
                F.when(js.isNotNull(), F.sqrt(F.greatest(js, F.lit(0.0)))).alias("distance")
            )
        )
    return reduce(DataFrame.unionByName, parts).withColumn("drifted", F.col("distance") > limit)


def drift_summary(drift: DataFrame) -> DataFrame:
    """Share of drifted features; null when a side has no rows or no feature is common."""
    n, bad = F.count("*"), F.count_if("drifted")
    share = F.when(F.count("distance") > 0, ratio(bad, n))
    return drift.agg(
        share.alias("drift_share"), n.alias("n_features"), bad.alias("n_drifted"),
        (share >= 0.5).alias("dataset_drift"),
    )


def health_row(labelled: DataFrame, label: str, score_col: str, drift: DataFrame, run_ts, start, end) -> DataFrame:
    """One monitoring row with verdicts and note text."""
    clamped = labelled.withColumn(score_col, clamp01(score_col))
    auc = ranking.curve_metrics(clamped, label, score_col).agg(F.max("roc_auc")).scalar()
    base = labelled.agg(
        F.count("*").alias("n_rows"),
        F.sqrt(F.avg(F.pow(clamp01(score_col) - F.col(label), 2))).alias("rmse"),
        F.avg(label).alias("class_balance"),
    ).withColumn("auc", auc)
    fields = ["drift_share", "n_features", "n_drifted", "dataset_drift"]
    d = drift.agg(F.max(F.struct(*fields))).scalar()  # one row or none
    df = base.withColumn("_d", d).select("*", *[F.col(f"_d.{f}") for f in fields])

    diff = F.abs(F.col("class_balance") - BASELINE_POS_RATE)
    # The note texts.
    checks = [
        (F.col("auc") < MIN_AUC, F.format_string(f"AUC below threshold (%.3f < {MIN_AUC:.3f}).", "auc")),
        (F.col("rmse") > MAX_RMSE, F.format_string(f"RMSE above threshold (%.3f > {MAX_RMSE:.3f}).", "rmse")),
        (
            diff > MAX_BALANCE_DRIFT,
            F.format_string(
                f"Class balance drift detected (current=%.3f, baseline={BASELINE_POS_RATE:.3f}, "
                f"diff=%.3f > {MAX_BALANCE_DRIFT:.3f}).", "class_balance", diff,
            ),
        ),
        (
            (F.col("drift_share") >= DRIFT_SHARE_LIMIT) | F.col("dataset_drift"),
            F.format_string(
                f"Evidently feature drift detected (drift_share=%.3f ≥ {DRIFT_SHARE_LIMIT:.3f}, n_drifted=%d/%d, dataset_drift=%s).",
                "drift_share", "n_drifted", "n_features", F.initcap(F.col("dataset_drift").cast("string")),
            ),
        ),
    ]
    some = F.col("n_rows") > 0
    hit = [F.coalesce(some & c, F.lit(False)) for c, _ in checks]
    text = F.concat_ws(" ", *[F.when(h, t) for h, (_, t) in zip(hit, checks)])
    notes = (
        F.when(~some, "No rows in monitoring window. Possibly no recent scoring runs.")
        .when(text == "", "Model metrics and drift signals within thresholds.")
        .otherwise(text)
    )
    ts = lambda v: F.lit(v).cast("timestamp")
    return df.select(
        ts(run_ts).alias("run_timestamp"), ts(start).alias("window_start"), ts(end).alias("window_end"),
        "n_rows", "auc", "rmse", (hit[0] | hit[1]).alias("decay_flag"), (hit[2] | hit[3]).alias("drift_flag"),
        "class_balance", "drift_share", "n_features", "n_drifted", "dataset_drift", notes.alias("notes"),
    )
