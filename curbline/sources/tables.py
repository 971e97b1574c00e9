"""Create-if-missing table definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.schemas import CASE_DDL

# Fairness tables and their partition columns. ``action_date`` is
# derived from the time stamp because Parquet tables partition by columns only.
FAIRNESS_TABLES = {
    "slice_metrics": (
        "snapshot_date DATE, slice_type STRING, slice_group STRING, total_cases BIGINT, "
        "ontime_rate DOUBLE, closed_rate DOUBLE",
        "snapshot_date",
    ),
    "bias_alerts": (
        "snapshot_date DATE, slice_type STRING, slice_group STRING, total_cases BIGINT, "
        "ontime_rate DOUBLE, closed_rate DOUBLE, median_ontime_rate DOUBLE, "
        "gap_below_median DOUBLE, status STRING",
        "snapshot_date",
    ),
    "bias_actions": (
        "action_timestamp TIMESTAMP, snapshot_date DATE, slice_type STRING, slice_group STRING, "
        "issue_summary STRING, action_taken STRING, expected_tradeoff STRING, owner STRING, "
        "action_date DATE",
        "action_date",
    ),
}


def ensure_table(spark: SparkSession, name: str, columns: str, part: str, location: str) -> None:
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"PARTITIONED BY ({part}) LOCATION '{location}'"
    )


def ensure_case_table(spark: SparkSession, name: str, location: str) -> None:
    """The case table, partitioned by the date of ``_ingested_at``."""
    ensure_table(spark, name, f"{CASE_DDL}, ingest_date DATE", "ingest_date", location)


def ensure_fairness_tables(spark: SparkSession, prefix: str, location: str) -> dict[str, str]:
    names = {}
    for table, (columns, part) in FAIRNESS_TABLES.items():
        names[table] = f"{prefix}{table}"
        ensure_table(spark, names[table], columns, part, f"{location}/{table}")
    return names


def append_cases(df: DataFrame, name: str) -> None:
    """Insert cases by column position, partition last. Rows are spread by the
    partition value plus the key, so one large ingest day has many writers."""
    table = df.sparkSession.table(name)
    stamped = df.withColumn("ingest_date", F.to_date("_ingested_at"))
    stamped.select(*table.columns).repartitionByRange("ingest_date", "_id").write.insertInto(name)
