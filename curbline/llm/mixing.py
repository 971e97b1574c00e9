"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source lie in an order given by a hash of the row. Its part of the
mix is that order, gone through as often as the target asks, cut after the
target's words and laid out in blocks of BLOCK_WORDS. A binary tree over the
output shards splits the block counts of all sources: each node draws, without
replacement, how many blocks of each source go left; many sources are drawn in
chunks, first the chunks' totals, then the sources in each. A shard then takes the
next so many blocks of each source's permuted blocks, so shards never overlap
and every block goes somewhere, and shuffles what it got.

Defined results: a null text has size 0; sources are ranked by code point, null
is a source and comes last; a source without words has target 0; documents
without words are taken 0 times; repeated rows are rows of their own; an empty
table gives an empty mix; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.llm.common import attach, total_of, whole
from curbline.operators.ordered import global_rank, running_totals
from curbline.session import cut

#: Weights by rank of the source, repeating; a target is REPEATS times its source's size at most.
WEIGHTS, REPEATS = (1, 2, 3), 3
#: Words of a block and of a shard; shards number LEAST_SHARDS at least.
BLOCK_WORDS, SHARD_WORDS, LEAST_SHARDS = 1 << 14, 1 << 26, 16
SEED = 20260101
#: Sources whose blocks one task splits, about, and halvings of the shards that it does.
SOURCES_AT_ONCE, DEPTH = 4096, 8
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("bigint")


def _key(source: str) -> Column:
    """The source as a key that tells null from every text."""
    return F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source of ``_key, _source, _size``: its size, weight and target in words."""
    sums = sizes.groupBy("_key").agg(F.first("_source").alias("_source"), F.sum("_size").alias("_all"), F.count("*").alias("_n"))
    ranked = global_rank(sums, [F.col("_source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    table = cut(ranked.withColumn("_weight", weight))
    total = float(table.agg(F.sum("_all")).first()[0] or 0)
    # Raise the common level until no source below its cap would pass it.
    cap, level, capped = F.col("_all") * float(repeats), 0.0, -1
    while True:
        at_cap = cap <= F.col("_weight") * level if capped >= 0 else F.lit(False)
        found = table.agg(
            F.count_if(at_cap).alias("n"),
            F.sum(F.when(at_cap, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(at_cap, 0.0).otherwise(F.col("_weight"))).alias("free"),
        ).first()
        if found["n"] == capped:
            break
        capped = found["n"]
        if not found["free"]:
            level = float("inf")
            break
        level = (total - found["held"]) / found["free"]
    return table.select("_key", "_all", "_n", F.least(cap, F.col("_weight") * F.lit(level)).alias("_target"))


def _leaves(low: int, high: int, depth: int) -> list[tuple[int, int]]:
    """Ranges of shards below a node after ``depth`` halvings, or where one shard is left."""
    if not depth or high - low == 1:
        return [(low, high)]
    middle = (low + high) // 2
    return _leaves(low, middle, depth - 1) + _leaves(middle, high, depth - 1)


def _tree(
    quotas: np.ndarray, shards: int, seed: int | list[int], sizes: np.ndarray | None = None, low: int = 0, depth: int = 64
) -> np.ndarray:
    """Blocks of each source (columns) for each range of :func:`_leaves` (rows) of the node of ``shards`` from ``low``.

    ``sizes`` are the blocks of the ranges; without them each range gets about as many as it has shards.
    """
    leaves = _leaves(low, low + shards, depth)
    if sizes is None:
        sizes = _even(int(quotas.sum()), low, low + shards, depth)
    begins = np.array([a for a, _ in leaves])
    sums = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros((len(leaves), len(quotas)), np.int64)
    todo = [(0, len(leaves), quotas)]  # ranges and what they hold together
    while todo:
        first, last, here = todo.pop()
        if last - first == 1:
            out[first] = here
            continue
        a, b = leaves[first][0], leaves[last - 1][1]
        half = int(np.searchsorted(begins, (a + b) // 2))
        draw = np.random.default_rng([*np.atleast_1d(seed), a, b])
        left = draw.multivariate_hypergeometric(here, int(sums[half] - sums[first]), method="marginals")
        todo += [(first, half, left), (half, last, here - left)]
    return out


def _even(blocks: int, low: int, high: int, depth: int = 64) -> np.ndarray:
    """Blocks of each range of :func:`_leaves`, halved down the tree."""
    if not depth or high - low == 1:
        return np.array([blocks], np.int64)
    middle = (low + high) // 2
    left = blocks * (middle - low) // (high - low)
    return np.concatenate([_even(left, low, middle, depth - 1), _even(blocks - left, middle, high, depth - 1)])


def _permuted(seed: int):
    """Adds the order of a source's blocks: block b is at b * step + start modulo their number; back is the inverse of step."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back, start = [], []
            for key, n in zip(batch.column("_key").to_pylist(), batch.column("_blocks").to_pylist()):
                draw = np.random.default_rng([seed, *key.encode()])
                step = max(1, int(n * draw.uniform(0.3, 0.7)))
                while gcd(step, n) != 1:
                    step += 1
                back.append(pow(step, -1, n) if n > 1 else 0)
                start.append(int(draw.integers(0, n)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(back, pa.int64()), pa.array(start, pa.int64())], names=[*batch.schema.names, "_back", "_start"]
            )

    return add


def allocate(quotas: DataFrame, shards: int, seed: int = SEED, at_once: int = SOURCES_AT_ONCE, depth: int = DEPTH) -> DataFrame:
    """``_key, _block, shard`` of every block of ``_key, _blocks``, which has one row per source.

    The tree over the shards is drawn in tiers of ``depth`` halvings. A tier takes rows (node, source, blocks),
    with no row where a source has no block, and gives those of the next one, so a task holds the blocks of
    2^depth nodes for about ``at_once`` sources, however many shards and sources there are. Sources are dealt by
    hash into chunks of about that many; in each node a first tree splits the totals of the chunks, then each
    chunk's own tree splits its sources with the sizes drawn for it: together one draw over all sources.
    """
    wanted = quotas.where("_blocks > 0").select("_key", "_blocks")
    chunks = max(1, -(-wanted.count() // at_once))
    rows = (
        wanted.mapInArrow(_permuted(seed), "_key string, _blocks bigint, _back bigint, _start bigint")
        .withColumns({
            "_chunk": F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(chunks)), "_n": F.col("_blocks"),
            "_from": F.lit(0).cast("bigint"), "_low": F.lit(0).cast("bigint"), "_high": F.lit(shards).cast("bigint"),
        })
    )
    columns = ["_key", "_blocks", "_back", "_start", "_chunk", "_n", "_from", "_low", "_high"]
    kinds = ", ".join(f"{c} {'string' if c == '_key' else 'bigint'}" for c in columns)

    def first(table: pa.Table) -> pa.Table:
        table = table.sort_by("_chunk")
        low, high = table.column("_low")[0].as_py(), table.column("_high")[0].as_py()
        drawn = _tree(table.column("_blocks").to_numpy(), high - low, seed, None, low, depth)
        lists = pa.array(drawn.T.tolist(), pa.list_(pa.int64()))
        return pa.table({"_low": table.column("_low"), "_chunk": table.column("_chunk"), "_sizes": lists})

    def split(table: pa.Table, drawn: pa.Table) -> pa.Table:
        table = table.sort_by("_key")
        low, high, chunk = [table.column(c)[0].as_py() for c in ("_low", "_high", "_chunk")]
        sizes = np.array(drawn.column("_sizes")[0].as_py(), np.int64)
        parts = _tree(table.column("_blocks").to_numpy(), high - low, [seed, chunk], sizes, low, depth)
        begin = table.column("_from").to_numpy() + np.cumsum(parts, axis=0) - parts
        s, k = np.nonzero(parts)
        leaves = np.array(_leaves(low, high, depth), np.int64)
        taken = table.take(pa.array(k))
        new = {"_blocks": parts[s, k], "_from": begin[s, k], "_low": leaves[s, 0], "_high": leaves[s, 1]}
        return pa.table({c: pa.array(new[c]) if c in new else taken.column(c) for c in columns})

    for left in range((max(shards - 1, 0)).bit_length(), 0, -depth):
        totals = rows.groupBy("_low", "_high", "_chunk").agg(F.sum("_blocks").alias("_blocks"))
        drawn = totals.groupBy("_low").applyInArrow(first, "_low bigint, _chunk bigint, _sizes array<bigint>")
        rows = rows.groupBy("_low", "_chunk").cogroup(drawn.groupBy("_low", "_chunk")).applyInArrow(split, kinds)
        if left > depth:
            rows = cut(rows)
    place = rows.select(
        "_key", F.col("_low").cast("int").alias("shard"), "_n", "_back", "_start",
        F.explode(F.sequence("_from", F.col("_from") + F.col("_blocks") - 1)).alias("_place"),
    )
    return place.select("_key", "shard", F.pmod((F.col("_place") - F.col("_start")) * F.col("_back"), F.col("_n")).alias("_block"))


def mix(
    rows: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS, block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS, least_shards: int = LEAST_SHARDS, seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """Plan a mix of stored rows ``_row`` (unique), ``_source``, ``_size``, ``_draw``.

    ``_draw`` is a hash of what the row holds, so that the order, and with it the
    mix, does not depend on how the rows are stored; only equal rows may swap.

    Returns the rows with ``_all`` and ``_target`` of their source, and the drawn
    copies: ``_row, epoch, words`` (from the start of the text), ``shard, place``.
    """
    keyed = rows.withColumn("_key", _key("_source"))
    by_source = cut(targets(keyed, weights, repeats).withColumn("_take", F.floor(F.col("_target") + 0.5)).withColumn(
        "_blocks", F.ceil(F.col("_take") / block_words)
    ))
    total = total_of(by_source, "_n")
    shards = max(least_shards, -(-total_of(by_source, "_take") // shard_words))
    known = cut(attach(keyed, by_source.select("_key", "_n", "_all", "_target", "_take"), "_key", "_n", total, ["_row"]))
    order = [F.xxhash64("_draw", F.lit(seed)), F.col("_draw"), F.col("_row")]
    ordered = running_totals(
        known.where("_size > 0").select("_row", "_draw", "_key", "_size", "_all", "_take"), ["_key"], order, {"_upto": "_size"}
    )
    begin = F.col("epoch") * F.col("_all") + F.col("_upto") - F.col("_size")
    copies = (
        ordered.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn("words", F.least(F.col("_size"), F.col("_take") - begin))
        .where(F.col("words") > 0)
        .select("_row", "_draw", "epoch", "words", "_key", F.floor(begin / block_words).alias("_block"))
    )
    drawn = copies.join(allocate(by_source, shards, seed), ["_key", "_block"]).select(
        "_row", "epoch", "words", "shard", F.xxhash64("_draw", "epoch", F.lit(seed + 1)).alias("place")
    )
    return known, drawn


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its so-manieth word; all of it where ``words`` is null."""

    @F.arrow_udf("string")
    def head(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import re

        word = re.compile(WORD)
        for texts, counts in batches:
            out = []
            for t, n in zip(texts.to_pylist(), counts.to_pylist()):
                end = None
                if t is not None and n is not None:
                    for _, m in zip(range(n), word.finditer(t)):
                        end = m.end()
                out.append(t[:end] if end is not None else None)
            yield pa.array(out, pa.string())

    return F.when(words.isNull(), text).otherwise(head(F.when(words.isNotNull(), text), words))


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mix per document; ``shards`` lists its copies as shard:epoch:words, empty if none is taken."""
    rows = cut(docs.select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), n_words("text").alias("_size"),
        F.xxhash64("doc_id", whole("text")).alias("_draw"),
    ).withColumn("_row", F.monotonically_increasing_id()))
    known, drawn = mix(rows)
    # A document has REPEATS copies at most, so the list of its shards is short.
    parts = F.array_sort(F.collect_list(F.struct("shard", "epoch", "words")))
    taken = drawn.groupBy(F.col("_row").alias("_r")).agg(F.sum("words").alias("_taken"), parts.alias("_parts"))
    shards = F.array_join(F.transform("_parts", lambda p: F.concat_ws(":", *[p[c].cast("string") for c in ("shard", "epoch", "words")])), ",")
    return known.join(taken, F.col("_row") == F.col("_r"), "left").select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_all").alias("source_size"),
        F.col("_target").alias("target"), F.coalesce("_taken", F.lit(0).cast("bigint")).alias("taken"),
        F.coalesce(shards, F.lit("")).alias("shards"),
    )
