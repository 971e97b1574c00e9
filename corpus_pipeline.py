"""The corpus pipeline: identify the language, drop copies, mix the sources, pack sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next stage's docs. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curbline.llm import fingerprints, language, mixing, packing, signature_join
from curbline.llm.common import crc_mod, whole
from curbline.session import cut, fresh_path

#: Trained models, hashed order and best fit have no SQL form.
ORACLE_SQL = None

_KEY, _ROW, _GUESS = "__stage_key", "__stage_row", "__stage_lang"


def _key(*columns: Column) -> Column:
    return F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def _only(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """Rows whose key is kept, and of rows of one key the first by a hash of the row."""
    keyed = docs.withColumn(_KEY, key).join(kept.select(F.col(_KEY)).hint("merge"), _KEY, "left_semi")
    first = W.partitionBy(_KEY).orderBy(F.xxhash64(*[F.col(c) for c in docs.columns]))
    return keyed.withColumn(_ROW, F.row_number().over(first)).where(F.col(_ROW) == 1).select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go. A null ``lang`` becomes the language found.

    With no labelled text to learn from, no language can be told apart: all
    documents with a letter stay, and their ``lang`` too. Empty and null texts
    have no letter; repeated rows stay or go together.
    """
    learn = docs.where(crc_mod("doc_id", 4) != 2)
    model = language.train(learn)
    if not model.families:
        return docs.where(language.has_letter("text"))
    guessed = docs.withColumn(_GUESS, language.guess_column(model)["lang"]).where(F.col(_GUESS) != language.UNKNOWN)
    return guessed.withColumn("lang", F.coalesce("lang", _GUESS)).select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest id; null and empty texts are one text, a null id is the smallest.

    Of rows with one id and one text, one stays, whichever a hash of the row puts first.
    """
    kept = fingerprints.exact_dedup(docs).where("kept").select(_key(F.col("doc_id"), F.col("text_sha256")).alias(_KEY))
    return _only(docs, _key(F.col("doc_id"), F.sha2(whole("text"), 256)), kept)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id (a null id comes last); texts without words stay.

    Of rows with one id and one text, one stays.
    """
    groups = signature_join.join(docs)
    first = groups.where("component IS NOT NULL").groupBy("component").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first")
    )
    kept = first.select(_key(F.col("first.id"), F.col("first.h")).alias(_KEY))
    wordless = ~whole("text").rlike(r"[^\x20\x09-\x0D]")
    one = _only(docs.where(~wordless), _key(F.col("doc_id"), F.xxhash64(whole("text"))), kept)
    return one.unionByName(docs.where(wordless))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy that it takes, the text cut where it takes part of one.

    Documents without words are taken by no mix and go; repeated rows are rows of
    their own; null is a source.
    """
    stored = cut(docs.withColumn(_ROW, F.monotonically_increasing_id()))
    rows = cut(stored.select(
        F.col(_ROW).alias("_row"), F.col("source").alias("_source"), mixing.n_words("text").alias("_size"),
        F.xxhash64("doc_id", whole("text")).alias("_draw"),
    ))
    known, drawn = mixing.mix(rows)
    taken = drawn.join(known.select(F.col("_row").alias("_r"), "_size"), F.col("_row") == F.col("_r")).select(
        F.col("_row").alias(_KEY), F.when(F.col("words") < F.col("_size"), F.col("words")).alias("__stage_words")
    )
    part = F.col("__stage_words").isNotNull()
    copies = stored.join(taken.hint("merge"), F.col(_ROW) == F.col(_KEY)).withColumn(
        "text", mixing.first_words(F.col("text"), F.col("__stage_words"))
    )
    if "n_chars" in docs.columns:
        copies = copies.withColumn("n_chars", F.when(part, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return copies.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences; a null text is empty, each row is a document."""
    return packing.pack(packing.pieces(docs, packing.vocabulary()))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
