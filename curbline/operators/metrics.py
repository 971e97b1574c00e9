"""Serving aggregates and the numbers behind the dashboard pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curbline.functions import clock
from curbline.functions.labels import MISSING_NEIGHBORHOOD, norm_missing, norm_unknown, norm_upper
from curbline.functions.numeric import half_even, ratio, safe_bool
from curbline.session import cut

DAILY_KEYS = ["date", "neighborhood", "department", "reason", "source"]


# --- serving tables ---------------------------------------------------------


def dashboard_daily(cases: DataFrame) -> DataFrame:
    """Counts by open date (UTC), place, department, type, reason and status.

    ``on_time_count`` is the sound count. ``on_time_count_parity`` reads the
    word as a boolean, which never succeeds, so it is always 0.
    """
    return (
        cases.where(F.col("case_enquiry_id").isNotNull())
        .groupBy(
            F.to_date("open_dt").alias("open_date"),
            "neighborhood", "department", "type", "reason", "case_status",
        )
        .agg(
            F.count("*").alias("case_count"),
            F.count_if(F.col("on_time") == "ONTIME").alias("on_time_count"),
            F.count_if(F.coalesce(safe_bool("on_time"), F.lit(False))).alias("on_time_count_parity"),
        )
    )


def weekly_counts(cases: DataFrame, dims: list[str], upper: tuple[str, ...] = ("type", "department")) -> DataFrame:
    """Cases per local week (from Monday) and dimension; ``upper`` ones normalised."""
    keys = [(norm_upper(d) if d in upper else F.col(d)).alias(d) for d in dims]
    return cases.groupBy(clock.local_week("open_dt").alias("week_start"), *keys).agg(
        F.count("*").alias("n")
    )


# The numbers of a daily row.
DAILY_NUMBERS = [
    "total_cases", "open_cases", "closed_cases", "sla_eligible_cases", "sla_met_cases",
    "avg_resolution_hrs", "sla_compliance_pct",
]


def daily_metrics(cases: DataFrame) -> DataFrame:
    """The daily table all dashboard pages read."""
    closed = F.col("case_status") == "Closed"
    eligible = F.col("sla_target_dt").isNotNull()
    hours = F.when(
        closed & F.col("closed_dt").isNotNull(), clock.days_between("open_dt", "closed_dt") * 24
    )
    return (
        cases.groupBy(F.to_date("open_dt").alias("date"), *DAILY_KEYS[1:])
        .agg(
            F.count("*").alias("total_cases"),
            F.count_if(~closed).alias("open_cases"),
            F.count_if(closed).alias("closed_cases"),
            F.count_if(eligible).alias("sla_eligible_cases"),
            F.count_if(eligible & (F.col("on_time") == "ONTIME")).alias("sla_met_cases"),
            F.avg(hours).alias("avg_resolution_hrs"),
        )
        .withColumn("sla_compliance_pct", ratio("sla_met_cases", "sla_eligible_cases") * 100)
    )


def recent_metrics(daily: DataFrame, as_of, days: int, fill: bool = False) -> DataFrame:
    """Days of the window; ``fill`` makes null counts and averages 0, as the pages show them."""
    rows = daily.where(F.col("date") >= F.date_sub(F.to_date(clock.instant(as_of)), days))
    return rows.fillna(0, DAILY_NUMBERS) if fill else rows


# --- scores -----------------------------------------------------------------


def critical_top(scores: DataFrame, dim: str, n: int = 5) -> DataFrame:
    """Labels with most critical cases."""
    return (
        scores.where((F.col("segment") == "CRITICAL") & F.col(dim).isNotNull())
        .groupBy(dim)
        .agg(F.count("*").alias("n_critical"))
        .orderBy(F.desc("n_critical"), dim)
        .limit(n)
    )


def neighborhood_perf(scores: DataFrame) -> DataFrame:
    """Open and critical cases, mean score and critical share by neighbourhood."""
    return (
        scores.groupBy(norm_missing("neighborhood").alias("neighborhood"))
        .agg(
            F.count("case_enquiry_id").alias("total_open"),
            F.count_if(F.col("segment") == "CRITICAL").alias("num_crit"),
            F.avg("priority_score").alias("avg_score"),
        )
        .withColumn("critical_share", F.coalesce(ratio("num_crit", "total_open") * 100, F.lit(0.0)))
        .withColumn("is_unknown", F.col("neighborhood") == MISSING_NEIGHBORHOOD)
        .orderBy("is_unknown", F.desc("avg_score"), "neighborhood")
    )


def perf_totals(perf: DataFrame) -> DataFrame:
    return perf.agg(
        F.count("*").alias("n_groups"),
        F.sum("total_open").alias("total_open"),
        F.sum("num_crit").alias("num_crit"),
    )


def slice_kpis(scores: DataFrame, top: int = 10) -> DataFrame:
    """Rows of the slice, size of its top list, and that size as share of the rows.

    The page calls the list size "critical"; ``num_segment_critical`` counts the
    critical segment itself.
    """
    n = F.col("total_open")
    share = F.when(n > 0, F.col("num_crit") / n * 100).otherwise(0.0)
    return (
        scores.agg(
            F.count("*").alias("total_open"),
            F.count_if(F.col("segment") == "CRITICAL").alias("num_segment_critical"),
        )
        .withColumn("num_crit", F.least(F.lit(top), n))
        .withColumn("crit_share", F.format_string("%.1f", share))
    )


# --- SLA and resolution -----------------------------------------------------


def sla_rate(daily: DataFrame) -> DataFrame:
    met, eligible = F.sum("sla_met_cases"), F.sum("sla_eligible_cases")
    return daily.agg((ratio(met, eligible) * 100).alias("overall_sla_rate"))


def sla_by_dept(daily: DataFrame, n: int = 10) -> DataFrame:
    """SLA rate of the departments with most eligible cases."""
    return (
        daily.groupBy(norm_unknown("department").alias("department"))
        .agg(
            F.sum("sla_eligible_cases").alias("n_eligible"),
            F.sum("sla_met_cases").alias("n_met"),
        )
        .where("n_eligible > 0")
        .orderBy(F.desc("n_eligible"), "department")
        .limit(n)
        .select("department", "n_eligible", half_even(F.col("n_met") / F.col("n_eligible") * 100, 1).alias("sla_rate"))
    )


def _resolution() -> list[Column]:
    return [
        F.sum(F.col("avg_resolution_hrs") * F.col("closed_cases")).alias("_hours"),
        F.sum("closed_cases").alias("_closed"),
    ]


def avg_resolution(daily: DataFrame) -> DataFrame:
    """Case-weighted mean resolution time."""
    hours = ratio("_hours", "_closed")
    return daily.agg(*_resolution()).select(
        hours.alias("avg_resolution_hours"), (hours / 24).alias("avg_resolution_days")
    )


def resolution_by_reason(daily: DataFrame, n: int = 15) -> DataFrame:
    """Slowest reasons."""
    return (
        daily.groupBy(norm_unknown("reason").alias("reason"))
        .agg(*_resolution())
        .where("_closed > 0")
        .withColumn("h", F.coalesce(F.col("_hours"), F.lit(0.0)) / F.col("_closed"))
        .orderBy(F.desc("h"), "reason")
        .limit(n)
        .select("reason", half_even("h", 1).alias("resolution_hours"))
    )


def resolution_by_source(daily: DataFrame, weighted: bool = True, n: int = 10) -> DataFrame:
    """Mean resolution hours by source.

    ``weighted=False`` gives what the page shows: the sum of the daily averages.
    """
    total = F.coalesce(F.sum("avg_resolution_hrs"), F.lit(0.0)).alias("_sum")
    value = F.coalesce(F.col("_hours"), F.lit(0.0)) / F.col("_closed") if weighted else F.col("_sum")
    return (
        daily.groupBy(norm_unknown("source").alias("source"))
        .agg(total, *_resolution())
        .where("_closed > 0")
        .withColumn("h", value)
        .orderBy(F.desc("h"), "source")
        .limit(n)
        .select("source", half_even("h", 1).alias("resolution_hours"))
    )


def overdue_by_neigh(overdue: DataFrame) -> DataFrame:
    return (
        overdue.groupBy(norm_unknown("neighborhood").alias("neighborhood"))
        .agg(F.count("case_enquiry_id").alias("n_overdue"))
        .orderBy(F.desc("n_overdue"), "neighborhood")
    )


def overdue_top(overdue: DataFrame, n: int = 100) -> DataFrame:
    """Oldest overdue cases (needs ``days_open``)."""
    return (
        overdue.orderBy(F.desc("days_open"), "case_enquiry_id")
        .limit(n)
        .select(
            "case_enquiry_id",
            norm_unknown("neighborhood").alias("neighborhood"),
            "reason", "department", "source", "days_open", "overdue_hours",
        )
    )


# --- volume -----------------------------------------------------------------


def volume_by(daily: DataFrame, dim: str, n: int = 10) -> DataFrame:
    return (
        daily.groupBy(norm_unknown(dim).alias(dim))
        .agg(F.sum("total_cases").alias("n_cases"))
        .where("n_cases > 0")
        .orderBy(F.desc("n_cases"), dim)
        .limit(n)
    )


def volume_all(daily: DataFrame, dims: list[str], n: int = 10) -> DataFrame:
    """Top lists of several dimensions from one scan (a label per row and dimension)."""
    pairs = F.array(
        *[F.struct(F.lit(d).alias("dim"), norm_unknown(d).alias("label")) for d in dims]
    )
    best = W.partitionBy("dim").orderBy(F.desc("n_cases"), "label")
    return (
        daily.select("total_cases", F.inline(pairs))
        .groupBy("dim", "label")
        .agg(F.sum("total_cases").alias("n_cases"))
        .where("n_cases > 0")
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= n)
    )


def daily_volume(daily: DataFrame) -> DataFrame:
    return (
        daily.where(F.col("date").isNotNull())
        .groupBy("date")
        .agg(F.sum("total_cases").alias("daily_volume"))
    )


def weekly_history(volume: DataFrame, weeks: int = 52, parity: bool = True) -> DataFrame:
    """Tuesday-to-Monday weeks labelled by their closing Monday; zero weeks removed.

    ``parity`` drops the last week unless the data run six days past its label;
    otherwise the last week is dropped only when its Monday is not reached.
    """
    volume = cut(volume)  # a row per day, read three times below
    binned = (
        volume.groupBy(clock.closing_monday("date").alias("week_label"))
        .agg(F.sum("daily_volume").alias("volume"))
        .where("volume > 0")
    )
    last_day = volume.agg(F.max("date")).scalar()
    last_week = binned.agg(F.max("week_label")).scalar()
    margin = 6 if parity else 0
    complete = last_day >= F.date_add(F.col("week_label"), margin)
    return (
        binned.where((F.col("week_label") < last_week) | complete)
        .orderBy(F.desc("week_label"))
        .limit(weeks)
    )


def monthly_volume(volume: DataFrame) -> DataFrame:
    """Totals of every month from the first to the last; empty months are 0."""
    month = clock.month_start("date")
    sums = volume.groupBy(month.alias("month_start")).agg(F.sum("daily_volume").alias("volume"))
    calendar = sums.agg(
        F.min("month_start").alias("a"), F.max("month_start").alias("b")
    ).where(F.col("a").isNotNull()).select(
        F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month_start")
    )
    return calendar.join(sums, "month_start", "left").select(
        "month_start", F.coalesce("volume", F.lit(0)).alias("volume")
    )


def month_seasonality(volume: DataFrame) -> DataFrame:
    """Totals for the months 1 to 12 with a flag for months that have data."""
    sums = volume.groupBy(F.month("date").alias("month_num")).agg(F.sum("daily_volume").alias("v"))
    months = volume.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month_num"))
    total = F.coalesce("v", F.lit(0))
    return months.join(sums, "month_num", "left").select(
        "month_num", total.alias("month_total"), (total > 0).alias("has_data")
    )


def top_topics(daily: DataFrame, n: int = 5) -> DataFrame:
    return (
        daily.where(F.col("date").isNotNull())
        .groupBy(norm_unknown("reason").alias("reason"))
        .agg(F.sum("total_cases").alias("n_cases"))
        .orderBy(F.desc("n_cases"), "reason")
        .limit(n)
    )


def topic_seasonality(daily: DataFrame, n: int = 5) -> DataFrame:
    """Month-of-year totals (m1..m12) of the most frequent reasons."""
    by_month = (
        daily.where(F.col("date").isNotNull())
        .groupBy(norm_unknown("reason").alias("reason"))
        .agg(
            F.sum("total_cases").alias("_all"),
            *[
                F.coalesce(F.sum(F.when(F.month("date") == m, F.col("total_cases"))), F.lit(0)).alias(f"m{m}")
                for m in range(1, 13)
            ],
        )
    )
    return by_month.orderBy(F.desc("_all"), "reason").limit(n).drop("_all")


# --- forecast ---------------------------------------------------------------


def _ahead(months: DataFrame, k: int) -> DataFrame:
    """The next ``k`` months after the last one, with last and previous volume."""
    last = months.agg(
        F.max("month_start").alias("m"),
        F.max_by("volume", "month_start").alias("last_volume"),
        F.count("*").alias("n_months"),
    ).where("n_months > 0")
    prev = months.where(
        F.col("month_start") == F.add_months(months.agg(F.max("month_start")).scalar(), -1)
    ).agg(F.max("volume")).scalar()
    return last.withColumn("prev_volume", prev).select(
        "m", "last_volume", "prev_volume", "n_months",
        F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"),
    ).withColumn("month_start", F.add_months("m", F.col("step")))


def trend_forecast(months: DataFrame, k: int = 6) -> DataFrame:
    """Last value plus the last change per step, not below zero."""
    return _trend(cut(months), k)


def seasonal_forecast(months: DataFrame, k: int = 6) -> DataFrame:
    """Same month of last year, or the last value when it is not known."""
    return _seasonal(cut(months), k)


def _trend(months: DataFrame, k: int) -> DataFrame:
    delta = F.coalesce(F.col("last_volume") - F.col("prev_volume"), F.lit(0))
    value = F.col("last_volume") + delta * F.col("step")
    return _ahead(months, k).select(
        "month_start",
        F.greatest(F.lit(0), half_even(value.cast("double")).cast("bigint")).alias("forecast"),
    )


def _seasonal(months: DataFrame, k: int) -> DataFrame:
    past = months.select(
        F.add_months("month_start", 12).alias("month_start"), F.col("volume").alias("past")
    )
    value = F.coalesce("past", "last_volume")
    return _ahead(months, k).join(past, "month_start", "left").select(
        "month_start",
        F.greatest(F.lit(0), half_even(value.cast("double")).cast("bigint")).alias("forecast"),
    )


def forecast(months: DataFrame, k: int = 6, recent: DataFrame | None = None) -> DataFrame:
    """Seasonal from twelve months on, trend below; no months, no rows.

    ``recent`` months stand in when the long series is empty.
    """
    months = cut(months)  # a row per month, read by both methods
    if recent is not None:
        none = months.agg(F.count("*") == 0).scalar()
        months = cut(months.unionByName(recent.where(none)))
    n = months.agg(F.count("*")).scalar()
    return (
        _seasonal(months, k).where(n >= 12).withColumn("method", F.lit("seasonal"))
        .unionByName(_trend(months, k).where(n < 12).withColumn("method", F.lit("trend")))
    )


# --- sources ----------------------------------------------------------------


def profile(cases: DataFrame) -> DataFrame:
    is_open = F.col("case_status") == "Open"
    return cases.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(cases.columns)).alias("n_columns"),
        F.min("open_dt").alias("first_open"),
        F.max("open_dt").alias("last_open"),
        F.count_distinct("neighborhood").alias("n_neighborhoods"),
        F.count_distinct("type").alias("n_types"),
        F.count_if(is_open).alias("n_open"),
        F.count_if(F.col("case_status") == "Closed").alias("n_closed"),
    )


def ingest_audit(cases: DataFrame, page_size: int = 5000) -> DataFrame:
    n = F.count("*")
    return cases.agg(
        n.alias("n_rows"),
        F.ceil(n / page_size).alias("n_pages"),
        F.min("_id").alias("min_id"),
        F.max("_id").alias("max_id"),
        F.max("_ingested_at").alias("ingested_at"),
    )


def freshness(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and latest date of each source."""
    out = None
    for name, (df, col) in sources.items():
        row = df.agg(F.count("*").alias("n_rows"), F.max(F.to_date(col)).alias("latest_date"))
        row = row.select(F.lit(name).alias("table_name"), "n_rows", "latest_date")
        out = row if out is None else out.unionByName(row)
    return out
