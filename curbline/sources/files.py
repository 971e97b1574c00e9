"""File readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbline.functions import clock
from curbline.functions.text import one_object
from curbline.schemas import CASE_SCHEMA
from curbline.session import cut

BAD = "_corrupt_record"


def read_cases_jsonl(spark: SparkSession, path: str, schema: T.StructType = CASE_SCHEMA) -> DataFrame:
    """JSON lines with a fixed schema; unreadable lines keep their text in
    ``_corrupt_record``."""
    with_bad = T.StructType(schema.fields + [T.StructField(BAD, T.StringType())])
    return (
        spark.read.schema(with_bad)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD)
        .json(path)
    )


def load_staging(spark: SparkSession, path: str, out: str, max_bad: int = 50) -> DataFrame:
    """Truncate-and-load the good rows; fail when more than ``max_bad`` are bad.

    Bad rows are counted while the good ones are written to a fresh folder, so
    the input is read once, and a rejected load leaves the old table as it was.
    """
    seen = Observation()
    rows = read_cases_jsonl(spark, path).observe(seen, F.count(BAD).alias("bad"))
    good = cut(rows.where(F.col(BAD).isNull()).drop(BAD))
    if seen.get["bad"] > max_bad:
        raise ValueError(f"{seen.get['bad']} unreadable rows, at most {max_bad} allowed")
    good.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def write_jsonl(df: DataFrame, path: str, ingested_at) -> int:
    """Stamp one ``_ingested_at`` (whole seconds), write every row, return the count."""
    seen = Observation()
    stamp = F.date_trunc("second", clock.instant(ingested_at))
    stamped = df.withColumn("_ingested_at", stamp).observe(seen, F.count(F.lit(1)).alias("n"))
    stamped.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def overwrite_table(df: DataFrame, path: str) -> None:
    """Replace a table. The frame must not read the same path."""
    df.write.mode("overwrite").parquet(path)


def write_clustered(df: DataFrame, part: str | Column, keys: list[str], path: str, part_name: str | None = None) -> None:
    """Partitioned table, sorted by the cluster keys inside each file.

    Rows are range-partitioned on partition value and keys, so a very large
    partition value is written by several tasks and small ones share a task.
    """
    name = part_name or part
    c = F.col(part) if isinstance(part, str) else part
    (
        df.withColumn(name, c)
        .repartitionByRange(name, *keys)
        .sortWithinPartitions(name, *keys)
        .write.mode("overwrite")
        .partitionBy(name)
        .parquet(path)
    )


def write_report(df: DataFrame, path: str) -> None:
    """A report (already aggregated to a few rows) as one JSON file.

    The rows are made in parallel and then brought together."""
    df.repartition(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_eval(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Evaluation cases. With ``|`` the second column is JSON and rows whose
    JSON cannot be read, text after its end included, are skipped."""
    if sep != "|":
        return spark.read.schema("query string, column string, expected string").csv(
            path, header=True, sep=sep
        )
    raw = spark.read.schema("query string, expected_json string").csv(
        path, header=True, sep=sep, quote=""
    )
    expected = one_object(F.trim("expected_json"))
    return raw.where(expected.isNotNull()).select("query", expected.alias("expected"))


def faq_table(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Questions and answers with the text they are searched by."""
    raw = spark.read.schema(
        "id string, question string, answer string, keywords array<string>"
    ).json(path, multiLine=multiline)
    words = F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " ")
    return raw.withColumn("search_text", F.concat("question", F.lit(" "), words))
