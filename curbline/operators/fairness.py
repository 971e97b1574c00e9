"""Slice monitoring, classification metrics by group, disparities and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curbline.functions import clock
from curbline.functions.labels import norm_none
from curbline.functions.numeric import ratio, ratio_or_zero
from curbline.session import cut

# Fixed values.
SLICES = ["neighborhood", "department", "source"]
MODEL_SLICES = ["neighborhood", "department", "reason"]
RATE_METRICS = ["accuracy", "precision", "recall", "f1"]
MAX_DIM_WEIGHT, MAX_WEIGHT = 3.0, 5.0


def unpivot(df: DataFrame, dims: list[str], keep: list[Column], norm=None) -> DataFrame:
    """One row per (row, dimension) in a single pass: slice_type, slice_group, ``keep``."""
    norm = norm or (lambda c: F.col(c).cast("string"))
    pairs = F.array(
        *[F.struct(F.lit(d).alias("slice_type"), norm(d).alias("slice_group")) for d in dims]
    )
    return df.select(*keep, F.inline(pairs))


def slice_metrics(cases: DataFrame, as_of, days: int = 30, dims=tuple(SLICES)) -> DataFrame:
    """On-time and closed rates of every slice of the last ``days`` of ingest.

    One scan serves all dimensions; null slice values are left out per dimension.
    """
    recent = cases.where(F.col("_ingested_at") >= clock.days_before(as_of, days))
    flags = [
        (F.upper(F.trim("on_time")) == "ONTIME").alias("_ontime"),
        (F.initcap(F.trim("case_status")) == "Closed").alias("_closed"),
    ]
    return (
        unpivot(recent, list(dims), flags)
        .where(F.col("slice_group").isNotNull())
        .groupBy("slice_type", "slice_group")
        .agg(
            F.count("*").alias("total_cases"),
            F.count_if("_ontime").alias("_on"),
            F.count_if("_closed").alias("_cl"),
        )
        .select(
            F.to_date(clock.instant(as_of)).alias("snapshot_date"),
            "slice_type",
            "slice_group",
            "total_cases",
            ratio("_on", "total_cases").alias("ontime_rate"),
            ratio("_cl", "total_cases").alias("closed_rate"),
        )
    )


def slice_medians(metrics: DataFrame, by: tuple[str, ...] = ("slice_type",)) -> DataFrame:
    """Median rate per slice type, or per ``by``, as for a frame of several snapshots."""
    return metrics.groupBy(*by).agg(F.percentile_approx("ontime_rate", 0.5, 10000).alias("median_ontime_rate"))


def join_medians(metrics: DataFrame, medians: DataFrame) -> DataFrame:
    keys = [c for c in medians.columns if c != "median_ontime_rate"]
    return metrics.join(medians, keys).withColumn("gap_below_median", F.col("median_ontime_rate") - F.col("ontime_rate"))


def bias_alerts(metrics: DataFrame, gap: float = 0.10, day=None) -> DataFrame:
    """Slices more than ``gap`` (absolute) below the median of their type and snapshot.

    ``day`` takes one snapshot of a frame that holds several."""
    if day is not None:
        metrics = metrics.where(F.col("snapshot_date") == F.lit(day).cast("date"))
    metrics = cut(metrics)  # a row per slice, read for the medians and the join
    low = F.col("ontime_rate") < F.col("median_ontime_rate") - F.lit(gap)
    return (
        join_medians(metrics, slice_medians(metrics, ("snapshot_date", "slice_type")))
        .where(low)
        .select(
            "snapshot_date", "slice_type", "slice_group", "total_cases", "ontime_rate",
            "closed_rate", "median_ontime_rate", "gap_below_median",
            F.when(low, "needs_attention").otherwise("ok").alias("status"),
        )
    )


def alert_count(alerts: DataFrame, day) -> DataFrame:
    hit = (F.col("snapshot_date") == F.lit(day).cast("date")) & (F.col("status") == "needs_attention")
    n = F.count_if(hit)
    return alerts.agg(n.alias("n_alerts"), (n > 0).alias("has_alerts"))


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5, by=None) -> DataFrame:
    """Counts at ``score >= threshold``."""
    y, p = F.col(label) == 1, F.col(score) >= threshold
    return df.groupBy(*(by or [])).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(y & ~p).alias("fn"),
    )


def rates(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1; an empty denominator gives 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        *(by or []),
        (tp + fp + tn + fn).alias("n"),
        ratio_or_zero(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tp, tp + fn).alias("recall"),
        ratio_or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def clf_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    return rates(confusion(df, label, score, threshold))


def model_slices(df: DataFrame, label: str, score: str, dims=tuple(MODEL_SLICES)) -> DataFrame:
    """Label and score once per slice dimension; a null key is the group ``None``."""
    return unpivot(df, list(dims), [F.col(label), F.col(score)], norm_none)


def clf_metrics_by_slice(df: DataFrame, label: str, score: str, dims=tuple(MODEL_SLICES)) -> DataFrame:
    by = ["slice_type", "slice_group"]
    return rates(confusion(model_slices(df, label, score, dims), label, score, by=by), by)


def disparities(
    by_slice: DataFrame, metrics=tuple(RATE_METRICS), threshold: float = 0.1, inclusive: bool = False
) -> DataFrame:
    """Largest minus smallest value per dimension and metric, with warning text.

    The check report warns above 0.1; the second one from 0.2 on
    (``inclusive=True``). Null values take no part.
    """
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]
    )
    span = (
        by_slice.select("slice_type", F.inline(pairs))
        .where(F.col("v").isNotNull())
        .groupBy("slice_type", "metric")
        .agg(F.min("v").alias("min_value"), F.max("v").alias("max_value"))
        .withColumn("gap", F.col("max_value") - F.col("min_value"))
    )
    big = F.col("gap") >= threshold if inclusive else F.col("gap") > threshold
    # Fixed value: the warning text.
    text = F.format_string(
        "Potential disparity on slice '%s' for metric '%s': range=%.3f (min=%.3f, max=%.3f)",
        "slice_type", "metric", "gap", "min_value", "max_value",
    )
    return span.select(
        F.concat_ws("_", "slice_type", "metric", F.lit("gap")).alias("gap_name"),
        "slice_type", "metric", "min_value", "max_value", "gap",
        F.when(big, text).alias("warning"),
    )


def promotion_gate(new: DataFrame, base: DataFrame, metric: str, max_drop: float = 0.005) -> DataFrame:
    """One row: reject when the metric fell by more than ``max_drop``.

    A missing value on either side passes.
    """
    old = base.agg(F.max(metric)).scalar()
    delta = F.col("new_value") - F.col("base_value")
    return (
        new.agg(F.max(metric).alias("new_value"))
        .withColumn("base_value", old)
        .withColumn("delta", delta)
        .withColumn("promoted", ~F.coalesce(F.col("delta") < -max_drop, F.lit(False)))
    )


def fairness_gate(gaps: DataFrame, limits: DataFrame) -> DataFrame:
    """Per gap its limit and whether it passes; a gap without a limit passes."""
    return gaps.join(limits, "gap_name", "left").select(
        "gap_name", "gap", "gap_limit",
        F.coalesce(F.col("gap") <= F.col("gap_limit"), F.lit(True)).alias("passed"),
    )


def gate_verdict(checked: DataFrame, promotion: DataFrame | None = None) -> DataFrame:
    """One row: passed when every gap is within its limit and, if the promotion
    row is given, the metric did not drop too far."""
    promoted = F.lit(True)
    if promotion is not None:
        promoted = F.coalesce(promotion.agg(F.bool_and("promoted")).scalar(), F.lit(True))
    fine = F.coalesce(F.bool_and("passed"), F.lit(True))
    return checked.agg(fine.alias("passed"), F.count_if(~F.col("passed")).alias("n_failed")).select(
        (F.col("passed") & promoted).alias("passed"), "n_failed"
    )


def bias_weights(df: DataFrame, key: str, dims=tuple(MODEL_SLICES)) -> DataFrame:
    """Inverse-frequency sample weights.

    Per dimension ``min(largest / own, 3)``; their product over its mean,
    capped at 5. The mean comes from the counts of the label combinations, so
    the rows themselves are read once and joined to small tables.
    """
    labelled = df.select(key, *[norm_none(d).alias(d) for d in dims])
    combos = cut(labelled.groupBy(*dims).agg(F.count("*").alias("_c")))
    sizes = (
        unpivot(combos, list(dims), [F.col("_c")])
        .groupBy("slice_type", "slice_group")
        .agg(F.sum("_c").alias("_n"))
    )
    largest = F.max("_n").over(W.partitionBy("slice_type"))  # a row per label
    weight = F.least(largest / F.col("_n"), F.lit(MAX_DIM_WEIGHT))
    per_label = cut(sizes.select("slice_type", "slice_group", weight.alias("_w")))
    raw = combos
    product = F.lit(1.0)
    for i, d in enumerate(dims):
        own = per_label.where(F.col("slice_type") == d)
        raw = raw.join(own.select(F.col("slice_group").alias(d), F.col("_w").alias(f"_w{i}")), d)
        product = product * F.col(f"_w{i}")
    raw = cut(raw.select(*dims, "_c", product.alias("_raw")))
    mean = raw.agg(F.sum(F.col("_raw") * F.col("_c")) / F.sum("_c")).scalar()
    capped = F.least(F.col("_raw") / mean, F.lit(MAX_WEIGHT))
    return labelled.join(raw.select(*dims, capped.alias("sample_weight")), list(dims))
