"""Vocabulary of canonical values, canonicalisation, keyword index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.functions.text import tokens
from curbline.session import cut


def vocabulary(official: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(column, phrase, value): every official value names itself, plus synonyms.

    official: column, value; synonyms: column, phrase, value. A synonym may
    point outside the official values; a phrase listed twice keeps its synonym.
    """
    rows = official.select("column", F.col("value").alias("phrase"), "value", F.lit(0).alias("p"))
    rows = rows.unionByName(synonyms.select("column", "phrase", "value", F.lit(1).alias("p")))
    return (
        rows.where(F.col("phrase").isNotNull())
        .groupBy("column", "phrase")
        .agg(F.max_by("value", F.struct("p", "value")).alias("value"))
    )


def official_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct non-null values of several columns in one pass."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]
    )
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()


def canonicalise(df: DataFrame, vocab: DataFrame, column: str, out: str) -> DataFrame:
    """Exact phrase lookup of one column; the raw value stays when unknown."""
    # Stored first: its size is then known, and a small one leaves the rows where they lie.
    words = cut(vocab.where(F.col("column") == column).select(
        F.col("phrase").alias("_phrase"), F.col("value").alias("_value")
    ))
    return (
        df.join(words, F.col(column) == F.col("_phrase"), "left")
        .withColumn(out, F.coalesce("_value", column))
        .drop("_phrase", "_value")
    )


def token_index(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Distinct (token, key) pairs of the text columns."""
    words = F.array_distinct(tokens(F.concat_ws(" ", *cols)))
    return df.select(F.explode(words).alias("token"), key)


def store_index(index: DataFrame, path: str) -> DataFrame:
    """Write the index in order of token, so that a search reads few row groups."""
    index.repartitionByRange(*[F.col(c) for c in index.columns]).sortWithinPartitions(*index.columns).write.mode("overwrite").parquet(path)
    return index.sparkSession.read.parquet(path)


def nested_vocabulary(spark, path: str) -> DataFrame:
    """Vocabulary of a JSON document: per column an object phrase -> value, or a plain list of values.

    A list maps every value to itself; values that are not text are taken as written.
    """
    doc = spark.read.text(path, wholetext=True)
    columns = doc.select(F.explode(F.from_json("value", "map<string,string>")).alias("column", "body"))
    body = F.trim("body")
    pairs = F.when(body.startswith("{"), F.map_entries(F.from_json(body, "map<string,string>"))).when(
        body.startswith("["),
        F.transform(F.from_json(body, "array<string>"), lambda x: F.struct(x.alias("key"), x.alias("value"))),
    )
    return columns.select("column", F.inline(pairs)).select("column", F.col("key").alias("phrase"), "value").where("value IS NOT NULL")


def search(index: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """Keys whose text has all terms."""
    wanted = sorted({t.lower() for t in terms})
    return (
        index.where(F.col("token").isin(wanted))
        .groupBy(key)
        .agg(F.count_distinct("token").alias("_n"))
        .where(F.col("_n") == len(wanted))
        .select(key)
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
