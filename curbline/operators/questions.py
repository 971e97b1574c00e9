"""Ad-hoc questions about the case table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.functions import clock

LIST_COLUMNS = ["case_enquiry_id", "neighborhood", "reason", "department", "open_dt"]


def open_on_street(cases: DataFrame, reason: str, street: str) -> DataFrame:
    return cases.where(
        (F.col("case_status") == "Open")
        & (F.col("reason") == reason)
        & F.col("location_street_name").ilike(f"%{street}%")
    ).select(*LIST_COLUMNS, "location_street_name")


def most_overdue(cases: DataFrame, dim: str = "department") -> DataFrame:
    """Label with the highest overdue share."""
    late = F.avg((F.col("on_time") == "OVERDUE").cast("int")).alias("overdue_share")
    return cases.groupBy(dim).agg(late).orderBy(F.desc("overdue_share"), dim).limit(1)


def open_longer_than(cases: DataFrame, as_of, days: int = 100) -> DataFrame:
    age = F.date_diff(F.to_date(clock.instant(as_of)), F.to_date("open_dt"))
    return cases.where((F.col("case_status") == "Open") & (age > days)).select(
        *LIST_COLUMNS, age.alias("days_open")
    )


def not_from_source_without_place(cases: DataFrame, source: str) -> DataFrame:
    """Other source (an unknown one counts as other) and no location."""
    return cases.where(~F.col("source").eqNullSafe(source) & F.col("location").isNull()).select(
        *LIST_COLUMNS, "source"
    )


def busiest_hour(cases: DataFrame, reason: str) -> DataFrame:
    return (
        cases.where(F.col("reason") == reason)
        .groupBy(F.hour("open_dt").alias("hour_of_day"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "hour_of_day")
        .limit(1)
    )


def by_place_and_month(cases: DataFrame, reason: str, year: int) -> DataFrame:
    first, after = F.lit(f"{year}-01-01").cast("timestamp"), F.lit(f"{year + 1}-01-01").cast("timestamp")
    return (
        cases.where((F.col("reason") == reason) & (F.col("open_dt") >= first) & (F.col("open_dt") < after))
        .groupBy("neighborhood", F.month("open_dt").alias("month"))
        .agg(F.count("*").alias("n"))
    )


def count_of_type(cases: DataFrame, type_: str, neighborhood: str, as_of, days: int = 7) -> DataFrame:
    """Cases of a type in a neighbourhood: in all, and of the last days."""
    recent = F.col("open_dt") >= clock.days_before(as_of, days)
    return cases.where((F.col("type") == type_) & (F.col("neighborhood") == neighborhood)).agg(
        F.count("*").alias("n_all"), F.count_if(recent).alias("n_recent")
    )


def open_in(cases: DataFrame, neighborhood: str) -> DataFrame:
    return cases.where(
        (F.col("neighborhood") == neighborhood) & (F.col("case_status") == "Open")
    ).select(*LIST_COLUMNS)


def mean_resolution(cases: DataFrame) -> DataFrame:
    hours = F.timestamp_diff("HOUR", F.col("open_dt"), F.col("closed_dt"))
    return cases.agg(F.avg(hours).alias("avg_hours"), F.count("closed_dt").alias("n_closed"))


def ranking(cases: DataFrame, dim: str, k: int = 10) -> DataFrame:
    return (
        cases.where(F.col(dim).isNotNull())
        .groupBy(dim)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), dim)
        .limit(k)
    )
