"""Priority ranking, segments, top lists and ranking quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curbline.functions.numeric import ratio
from curbline.operators import ordered, selection
from curbline.session import cut

ID = "case_enquiry_id"
SCORE = "priority_score"


def _best_first() -> list[Column]:
    return [F.desc_nulls_last(SCORE), F.asc(ID)]


def rank_overall(scores: DataFrame) -> DataFrame:
    """Rank by score, best first; ties by case id."""
    return ordered.global_rank(scores, _best_first())


def share_rows(n: Column, share: float) -> Column:
    """``max(1, int(share * n))``."""
    return F.greatest(F.lit(1), F.floor(n * F.lit(share)))


def segment(ranked: DataFrame, share: float = 0.05) -> DataFrame:
    """CRITICAL for the first share of the ranks, SECONDARY for the rest."""
    cut_at = ranked.agg(share_rows(F.count("*"), share)).scalar()
    return ranked.withColumn(
        "segment", F.when(F.col("rank_overall") <= cut_at, "CRITICAL").otherwise("SECONDARY")
    )


def rank_and_segment(scores: DataFrame, share: float = 0.05) -> DataFrame:
    return segment(rank_overall(scores), share)


def precision_at(ranked: DataFrame, label: str, shares=(0.01, 0.05, 0.10)) -> DataFrame:
    """Mean label of the top shares of a ranked frame, all in one pass."""
    n = ranked.agg(F.count("*")).scalar()
    rank = F.col("rank_overall")
    row = ranked.agg(
        *[
            F.avg(F.when(rank <= share_rows(n, s), F.col(label))).alias(f"p{i}")
            for i, s in enumerate(shares)
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(float(s)).alias("k"), F.col(f"p{i}").alias("precision_at_k"))
            for i, s in enumerate(shares)
        ]
    )
    return row.select(F.inline(rows))


def critical_threshold(ranked: DataFrame, share: float = 0.05) -> DataFrame:
    """Score at 0-based place ``max(1, int(share * n) - 1)`` of the descending list."""
    n = ranked.agg(F.count("*")).scalar()
    place = F.greatest(F.lit(1), F.floor(n * F.lit(share)) - 1)
    hit = F.when(F.col("rank_overall") == place + 1, F.col(SCORE))
    return ranked.agg(F.max(hit).alias("critical_threshold"))


def top_rows(scores: DataFrame, shares: list[float]) -> list[int]:
    n = scores.count()
    return [max(1, int(n * s)) for s in shares]


def precision_of(scores: DataFrame, label: str, shares=(0.01, 0.05, 0.10)) -> DataFrame:
    """:func:`precision_at` of a frame that is not ranked, by the rows at the borders: nothing is sorted."""
    ends = selection.borders(scores, SCORE, ID, top_rows(scores, list(shares)))
    mean = [F.avg(F.when(e.reached(SCORE, ID), F.col(label)) if e else F.lit(None).cast("double")) for e in ends]
    rows = F.array(*[F.struct(F.lit(float(s)).alias("k"), F.col(f"p{i}").alias("precision_at_k")) for i, s in enumerate(shares)])
    return scores.agg(*[m.alias(f"p{i}") for i, m in enumerate(mean)]).select(F.inline(rows))


def threshold_of(scores: DataFrame, share: float = 0.05) -> DataFrame:
    """:func:`critical_threshold` of a frame that is not ranked."""
    n = scores.count()
    (end,) = selection.borders(scores, SCORE, ID, [max(1, int(n * share) - 1) + 1])
    kinds = {selection._NAN: float("nan"), selection._HIGH: float("inf"), selection._LOW: float("-inf")}
    value = None if end is None else end.score if end.score is not None else kinds.get(end.kind)
    return scores.sparkSession.createDataFrame([(value,)], "critical_threshold double")


def curve_metrics(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Tie-aware ROC-AUC and average precision, for the frame or per group.

    ``roc_auc`` and ``pr_auc`` are null for a single class. ``pr_auc_loose``
    follows the second report: null only below two rows, 0 without positives.
    """
    by = by or []
    y = F.col(label).cast("bigint")
    points = (
        df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("_s"))
        .agg(F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg"))
    )
    return curve_of_counts(points, by)


def curve_of_counts(points: DataFrame, by: list[str]) -> DataFrame:
    """The curve metrics of ``_s`` (score), ``_pos`` and ``_neg`` (its counts).

    Products of counts are doubles: two counts above 3e9 overflow a long.
    """
    run = ordered.running_totals(points, by, [F.desc("_s")], {"_tp": "_pos", "_fp": "_neg"})
    sums = run.groupBy(*by).agg(
        F.sum("_pos").alias("n_pos"),
        F.sum("_neg").alias("n_neg"),
        # area of the step between two thresholds
        F.sum(F.col("_neg").cast("double") * (F.col("_tp") - F.col("_pos") / 2)).alias("_area"),
        F.sum(F.col("_pos").cast("double") * (F.col("_tp") / (F.col("_tp") + F.col("_fp")))).alias("_gain"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    ap = ratio("_gain", "n_pos")
    loose = F.when(F.col("n_pos") + F.col("n_neg") >= 2, F.coalesce(ap, F.lit(0.0)))
    return sums.select(
        *by,
        "n_pos",
        "n_neg",
        F.when(both, ratio("_area", F.col("n_pos").cast("double") * F.col("n_neg"))).alias("roc_auc"),
        F.when(both, ap).alias("pr_auc"),
        loose.alias("pr_auc_loose"),
    )


def split(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Stratified 60/20/20 split: rows of a label in md5 order, cut at 60 % and 80 %."""
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    ranked = ordered.rank_within(df.withColumn("_h", h), [label], [F.asc("_h"), F.asc(key)], "_r")
    size = cut(df.groupBy(label).agg(F.count("*").alias("_n")).withColumnRenamed(label, "_label"))  # a row per label
    place = F.col("_r")
    part = (
        F.when(place <= F.floor(F.col("_n") * 0.6), "train")
        .when(place <= F.floor(F.col("_n") * 0.8), "validation")
        .otherwise("test")
    )
    return (
        ranked.join(size, F.col(label).eqNullSafe(F.col("_label")))
        .withColumn("part", part)
        .drop("_h", "_r", "_n", "_label")
    )


def top_cases(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(*_best_first()).limit(n)


def work_queue(df: DataFrame, department: str, n: int = 100) -> DataFrame:
    """Best rows of one department; an unknown one gives no rows."""
    return top_cases(df.where(F.col("department") == department), n)


def work_queues(df: DataFrame, n: int = 100) -> DataFrame:
    """The queue of every department. The rank limit also runs before the shuffle."""
    w = W.partitionBy("department").orderBy(*_best_first())
    return (
        df.where(F.col("department").isNotNull())
        .withColumn("queue_rank", F.row_number().over(w))
        .where(F.col("queue_rank") <= n)
    )


def queue_stats(queue: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, critical rows and mean score of the (already limited) queue."""
    return queue.groupBy(*(by or [])).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("segment") == "CRITICAL").alias("n_critical"),
        F.avg(SCORE).alias("avg_score"),
    )


def best_run(runs: DataFrame) -> DataFrame:
    """Run with the highest validation PR-AUC; the earlier one wins a tie."""
    pick = F.max_by(
        F.struct("run_index", "name", "val_pr_auc", "val_roc_auc"),
        F.struct("val_pr_auc", -F.col("run_index")),
    )
    return runs.where(F.col("val_pr_auc").isNotNull()).agg(pick.alias("r")).select("r.*")


def compare_runs(runs: DataFrame) -> DataFrame:
    return runs.select("name", "val_pr_auc", "val_roc_auc").orderBy("name")
