"""A keyword index that grows by segments: adding documents writes one segment and reads none.

A segment holds, for each word, the ids of its documents in blocks: block b has the ids
from b * ``WIDTH`` to the next multiple, sorted, with the smallest and largest of them, so
a word that is in every document is many rows of bounded size. Rows lie in order of
(word, block) and pages are short, so a filter on both reads few pages. Under the word ''
a segment lists all its documents. A document that is added again is answered by its
newest segment only; one whose text is null or without words is thereby taken out.

A search starts with the rarest word and reads of the others only the blocks where its
ids lie. Segments of like size are merged when there are ``FAN`` of them, so their
number stays logarithmic and a document is rewritten a logarithmic number of times.
Additions, merges and searches see whole versions (:mod:`curbline.sources.commits`).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.operators.vocab import token_index
from curbline.session import cut
from curbline.sources import commits

#: Ids of a block, and segments of like size that are merged into one.
WIDTH, FAN = 4096, 4
#: The most ranges of blocks that a filter names; beyond it, neighbouring ranges become one.
RANGES = 64
#: The most blocks of the rarest word that are looked at on the driver to make the filter.
BLOCKS = 100_000
#: Short pages, so that a filter leaves most of a file unread.
PAGES = {"parquet.page.row.count.limit": 64, "parquet.enable.dictionary": "false"}
ALL = ""


def _blocks(pairs: DataFrame) -> DataFrame:
    """Posting rows of distinct (segment, token, id): ids of a block in order, with their bounds."""
    ids = F.array_sort(F.collect_list("id"))
    return (
        pairs.groupBy("segment", "token", F.floor(F.col("id") / F.lit(WIDTH)).alias("block"))
        .agg(ids.alias("ids"))
        .select(
            "token", "block", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("low"),
            F.element_at("ids", -1).alias("high"), "ids", "segment",
        )
    )


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("segment", "token", "block").sortWithinPartitions("segment", "token", "block")


def _pairs(docs: DataFrame, key: str, cols: list[str], segment: str) -> DataFrame:
    """(segment, token, id) of documents, '' for each of them; documents without an id are left out.

    An id must be an integer; several rows of one id are one document with the words of all.
    """
    docs = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), *[F.col(c).alias(f"_{c}") for c in cols])
    words = token_index(docs, "id", [f"_{c}" for c in cols]).where(F.col("token") != ALL)
    return words.unionByName(docs.select(F.lit(ALL).alias("token"), "id")).distinct().withColumn("segment", F.lit(segment))


def _name(number: int) -> str:
    return f"{number:012d}"


def create(docs: DataFrame, key: str, cols: list[str], path: str) -> commits.Manifest:
    """A new index of the text columns, with one segment."""
    return commits.create(_ordered(_blocks(_pairs(docs, key, cols, _name(0)))), path, "segment", **PAGES)


def add(docs: DataFrame, key: str, cols: list[str], path: str, sender: tuple[str, int] | None = None) -> commits.Manifest:
    """Add documents, or put them in place of the ones with their ids, as one segment.

    ``sender`` and its number make a repeated addition change nothing.
    """
    spark = docs.sparkSession

    def attempt() -> commits.Manifest:
        base = commits.manifest(spark, path)
        if sender and base.senders.get(sender[0], -1) >= sender[1]:
            return base
        rows = _ordered(_blocks(_pairs(docs, key, cols, _name(base.version + 1))))
        return commits.commit(spark, path, base, commits.write_files(rows, path, "segment", **PAGES), sender)

    return commits.retried(attempt)


def sizes(spark: SparkSession, path: str, at: commits.Manifest | None = None) -> dict[str, int]:
    """Documents of each segment, oldest first; as many entries as there are segments."""
    rows = commits.rows_of(spark, path, at or commits.manifest(spark, path)).where(F.col("token") == ALL)
    return {r["segment"]: r["docs"] for r in rows.groupBy("segment").agg(F.sum("n").alias("docs")).orderBy("segment").collect()}


def due(docs: dict[str, int], fan: int = FAN) -> list[str]:
    """The segments to merge next: the fewest newest ones of which ``fan`` are of the largest size, in powers of ``fan``."""
    names = list(docs)
    size = {name: int(math.log(max(n, 1), fan) + 1e-9) for name, n in docs.items()}
    for i in range(len(names) - fan, -1, -1):
        run = [size[name] for name in names[i:]]
        if run.count(max(run)) >= fan:
            return names[i:]
    return []


def merge(spark: SparkSession, path: str, fan: int = FAN) -> commits.Manifest:
    """Merge segments until none are due; a document keeps the words of its newest one."""

    def attempt() -> commits.Manifest:
        base = commits.manifest(spark, path)
        while run := due(sizes(spark, path, base), fan):
            rows = commits.rows_of(spark, path, base, run)
            pairs = rows.select("segment", "token", F.explode("ids").alias("id"))
            newest = pairs.where(F.col("token") == ALL).groupBy("id").agg(F.max("segment").alias("segment"))
            kept = pairs.join(newest, ["id", "segment"], "left_semi").withColumn("segment", F.lit(run[-1]))
            written = commits.write_files(_ordered(_blocks(kept)), path, "segment", **PAGES)
            base = commits.commit(spark, path, base, {s: None for s in run} | written)
        return base

    return commits.retried(attempt)


def ranges_of(blocks: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold the sorted blocks, with the widest gaps between them."""
    gaps = sorted(range(1, len(blocks)), key=lambda i: (blocks[i - 1] - blocks[i], i))[: most - 1]  # widest first
    starts = [0, *sorted(i for i in gaps if blocks[i] - blocks[i - 1] > 1)]
    return [(blocks[i], blocks[j - 1]) for i, j in zip(starts, [*starts[1:], len(blocks)])] if blocks else []


def _within(ranges: list[tuple[int, int]]) -> Column:
    return reduce(Column.__or__, [F.col("block").between(a, b) for a, b in ranges])


def postings(spark: SparkSession, path: str, at: commits.Manifest, token: str, ranges: list[tuple[int, int]] | None) -> DataFrame:
    """Blocks of one word, those of ``ranges`` only if given."""
    rows = commits.rows_of(spark, path, at).where(F.col("token") == token)
    return (rows if ranges is None else rows.where(_within(ranges))).select("segment", "block", "low", "high", "ids")


def search(spark: SparkSession, path: str, terms: list[str], key: str = "id") -> DataFrame:
    """Ids of the documents that have all terms, whatever their case; none for no terms.

    The words' counts are read first, without their ids. The rarest word's blocks then meet
    those of the next one by (segment, block), and only ids between the bounds of both are
    compared. The rows of the answer are checked against the document lists of newer segments.
    """
    at = commits.manifest(spark, path)
    wanted = sorted({t.lower() for t in terms} - {ALL})
    counted = commits.rows_of(spark, path, at).where(F.col("token").isin(wanted))
    found = counted.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).orderBy("n", "token").collect()
    if not wanted or len(found) < len(wanted):
        return spark.createDataFrame([], f"`{key}` bigint")
    ranges = None
    hits = postings(spark, path, at, found[0]["token"], None)
    if found[0]["blocks"] <= BLOCKS:
        hits = cut(hits)
        ranges = ranges_of([r[0] for r in hits.select("block").distinct().orderBy("block").collect()])
    for word in found[1:]:
        other = postings(spark, path, at, word["token"], ranges).toDF("segment", "block", "_low", "_high", "_ids")
        both = F.array_intersect("ids", "_ids")
        hits = (
            hits.join(other, ["segment", "block"])
            .where((F.col("low") <= F.col("_high")) & (F.col("_low") <= F.col("high")))
            .select("segment", "block", both.alias("ids"))
            .where(F.size("ids") > 0)
            .select("segment", "block", F.get("ids", F.lit(0)).alias("low"), F.element_at("ids", -1).alias("high"), "ids")
        )
    answer = hits.select("segment", "block", "ids")
    if len(at.folders) > 1:
        newer = postings(spark, path, at, ALL, ranges).select(
            F.col("segment").alias("_segment"), F.col("block").alias("_block"), F.col("ids").alias("_ids")
        )
        listed = answer.join(newer, (F.col("block") == F.col("_block")) & (F.col("segment") < F.col("_segment")), "left")
        replaced = F.flatten(F.collect_list("_ids"))  # at most a block's ids for each newer segment
        answer = (
            listed.groupBy("segment", "block").agg(F.first("ids").alias("ids"), replaced.alias("_ids"))
            .select(F.array_except("ids", "_ids").alias("ids"))
        )
    return answer.select(F.explode("ids").alias(key))
