"""Predicates, projections and option lists over cases and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.functions import clock
from curbline.functions.labels import norm_upper
from curbline.functions.numeric import half_even
from curbline.session import cut

ALL = "ALL"


def recent_window(cases: DataFrame, as_of, days: int | None = 28) -> DataFrame:
    """Cases opened since UTC midnight ``days`` ago; ``None`` is the full extract."""
    if days is None:
        return cases
    return cases.where(F.col("open_dt") >= F.date_trunc("day", clock.days_before(as_of, days)))


def keyset_page(df: DataFrame, where: str | None, start_after: int, limit: int) -> DataFrame:
    """The next page by ``_id``; an empty or ``1=1`` predicate is dropped."""
    if where and where.strip() and where.strip() != "1=1":
        df = df.where(where)
    return df.where(F.col("_id") > start_after).orderBy("_id").limit(limit)


def id_ranges(df: DataFrame, n: int) -> DataFrame:
    """Bulk form of paging: the frame in ``n`` partitions of consecutive ids."""
    return df.repartitionByRange(n, "_id").sortWithinPartitions("_id")


def latest_n(df: DataFrame, n: int = 5000) -> DataFrame:
    return df.orderBy(F.desc("open_dt"), F.asc("case_enquiry_id")).limit(n)


def bounded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest seeded hash of the key."""
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(h, F.col(key)).limit(n)


def labelled_window(df: DataFrame, start, end, ts: str, pred: str, label: str) -> DataFrame:
    """Rows predicted in [start, end] with both prediction and label."""
    return df.where(
        F.col(ts).between(clock.instant(start), clock.instant(end))
        & F.col(pred).isNotNull()
        & F.col(label).isNotNull()
    )


def overdue_open(cases: DataFrame, as_of, days: int = 365) -> DataFrame:
    """Open cases of the last ``days`` whose SLA deadline has passed."""
    now = clock.instant(as_of)
    first = F.to_timestamp(F.date_sub(F.to_date(now), days))
    return cases.where(
        (F.col("open_dt") >= first)
        & (F.col("case_status") == "Open")
        & F.col("sla_target_dt").isNotNull()
        & (F.col("sla_target_dt") < now)
    )


def with_age(df: DataFrame, as_of) -> DataFrame:
    """``days_open`` and, as the page defines it, ``overdue_hours`` since opening."""
    return df.withColumn(
        "days_open", half_even(clock.days_between("open_dt", clock.instant(as_of)), 1)
    ).withColumn("overdue_hours", half_even(F.col("days_open") * 24, 1))


def with_sla_lateness(df: DataFrame, as_of) -> DataFrame:
    """Days past the SLA target, the sound variant of lateness."""
    late = clock.days_between("sla_target_dt", clock.instant(as_of))
    return df.withColumn("days_overdue", half_even(late, 1))


def slice_filter(df: DataFrame, **selected: str) -> DataFrame:
    """Equality filters; ``ALL`` leaves a dimension open."""
    for name, value in selected.items():
        if value != ALL:
            df = df.where(F.col(name) == value)
    return df


def id_search(df: DataFrame, pattern: str) -> DataFrame:
    return df.where(F.col("case_enquiry_id").cast("string").rlike(pattern))


def case_durations(cases: DataFrame, parity: bool = True) -> DataFrame:
    """Serving table of whole days from open to close.

    With ``parity`` the column ``case_enquiry_id`` holds ``_id`` as text, as the
    served table does; otherwise the case id itself.
    """
    return cases.select(
        F.col("_id" if parity else "case_enquiry_id").cast("string").alias("case_enquiry_id"),
        norm_upper("department").alias("department"),
        norm_upper("reason").alias("reason"),
        norm_upper("type").alias("type"),
        clock.local_date("open_dt").alias("open_date_local"),
        "open_dt",
        "closed_dt",
        clock.whole_days("open_dt", "closed_dt").alias("days_to_close"),
    )


def options(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def combos(df: DataFrame) -> DataFrame:
    cols = ["neighborhood", "reason", "department"]
    return df.select(*cols).na.drop().dropDuplicates()


def cascade(pairs: DataFrame, neighborhood: str = ALL, reason: str = ALL) -> DataFrame:
    """Options that remain for a selection, one row per option list.

    Reasons depend on the neighbourhood, departments on both; a reason that is
    not valid for the neighbourhood counts as ``ALL``.
    """
    pairs = cut(pairs)  # distinct label combinations, read by every list
    in_hood = slice_filter(pairs, neighborhood=neighborhood)
    valid = F.lit(True) if reason == ALL else in_hood.agg(
        F.coalesce(F.bool_or(F.col("reason") == reason), F.lit(False))
    ).scalar()
    in_both = in_hood if reason == ALL else in_hood.where(~valid | (F.col("reason") == reason))
    chosen = F.when(valid, F.lit(reason)).otherwise(F.lit(ALL))

    def as_list(df: DataFrame, col: str, name: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_set(col)).alias("options")).select(
            F.lit(name).alias("list_name"), chosen.alias("reason_selected"), "options"
        )

    return as_list(in_hood, "reason", "reason").unionByName(
        as_list(in_both, "department", "department")
    )


def common_features(ref: DataFrame, cur: DataFrame, drop: set[str]) -> tuple[DataFrame, DataFrame]:
    """Both frames cut to their sorted common feature columns."""
    shared = sorted((set(ref.columns) & set(cur.columns)) - drop)
    return ref.select(*shared), cur.select(*shared)


def preview(df: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    """First rows as JSON plus the ``k: v`` text used when there is one row."""
    text = F.concat_ws(
        ", ",
        *[
            F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("None")))
            for c in df.columns
        ],
    )
    return df.orderBy(*order).limit(n).select(
        F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row_json"),
        text.alias("row_text"),
    )
