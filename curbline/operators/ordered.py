"""Exact order statistics without a single-task window.

Rows are range-partitioned on the whole sort order, so one group, or one run
of ties, may span many partitions. Each partition works on its own rows and
the partitions are joined by their totals: one small row per (group,
partition). The ranged rows are stored because both steps must see the same
partition borders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curbline.session import cut

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row number below


def global_rank(df: DataFrame, order: list[Column], out: str = "rank_overall") -> DataFrame:
    """1..n over the whole frame; ``order`` must be a total order."""
    pos = cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    slice_ = F.shiftright("_pos", _ROW_BITS)
    sizes = pos.groupBy(slice_.alias("_slice")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    # Stored first: the planner then knows how small it is and leaves the rows where they lie.
    starts = cut(sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    row = F.col("_pos").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        pos.withColumn("_slice", slice_)
        .join(starts, "_slice")
        .withColumn(out, F.col("_start") + row + 1)
        .drop("_slice", "_pos", "_start")
    )


def running_totals(
    df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str]
) -> DataFrame:
    """Add running sums within each group; ``sums`` maps new name to column.

    ``order`` must be a total order within the group.
    """
    keys = [F.col(b) for b in by]
    ranged = cut(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    local = W.partitionBy("_slice", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inner = ranged.withColumns({f"_in_{o}": F.sum(c).over(local) for o, c in sums.items()})

    totals = ranged.groupBy("_slice", *by).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = cut(totals.select(
        F.col("_slice").alias("_slice_r"),
        *[F.col(b).alias(f"_r_{b}") for b in by],
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_st_{o}") for o in sums],
    ))
    same = [F.col("_slice") == F.col("_slice_r")]
    same += [F.col(b).eqNullSafe(F.col(f"_r_{b}")) for b in by]
    joined = inner.join(starts, reduce(lambda a, b: a & b, same))
    return joined.select(
        *df.columns, *[(F.col(f"_in_{o}") + F.col(f"_st_{o}")).alias(o) for o in sums]
    )


def rank_within(df: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    """1..n within each group; no group has to fit in one task."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_totals(one, by, order, {out: "_one"}).drop("_one")


def nearest_rank(df: DataFrame, by: list[str], value: str, fraction: float, out: str) -> DataFrame:
    """Per group the ascending element number ``max(int(fraction * n), 1)``.

    Works on distinct values with their counts, so repeated values cost one row.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    run = running_totals(counts, by, [F.asc("_v")], {"_upto": "_c"})
    size = run.groupBy(*by).agg(F.max("_upto").alias("_n"))
    wanted = F.greatest(F.floor(F.col("_n") * F.lit(fraction)), F.lit(1))
    if by:
        renamed = cut(size.select(*[F.col(b).alias(f"_r_{b}") for b in by], "_n"))
        same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_r_{b}")) for b in by])
        hit = run.join(renamed, same).where(F.col("_upto") >= wanted)
        return hit.groupBy(*by).agg(F.min("_v").alias(out))
    total = size.select(wanted).scalar()
    return run.where(F.col("_upto") >= total).agg(F.min("_v").alias(out))
