"""Exact dedup by composable polynomial fingerprints.

A text is hashed in chunks of CHUNK bytes as polynomials modulo two primes. The
hash of a whole is the sum of its chunks' hashes, each shifted by the base to
the power of the bytes after it, so chunks of a long text are hashed by many
tasks and summed in any order. Rows of equal fingerprint and length are then
compared chunk by chunk: per chunk number the smallest and the largest bytes of
the group must be equal. That comparison is an aggregate, so a group of any
size meets as one row per task. Groups that differ somewhere are split by the
SHA-256 of the text.

Defined results: null counts as the empty text; of equal texts the row with the
largest id stays, of rows equal in both one; a null id is smaller than any
other; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.llm.common import attach, bounded_batches, total_of, whole
from curbline.session import cut

#: Bytes of a chunk; 2^16 products of a byte and a 31-bit power sum to less than 2^63.
CHUNK = 1 << 16
#: Prime moduli below 2^31, and a base for each.
MODULI = ((2147483647, 911382323), (2147483629, 972663749))


def _powers(n: int, mod: int, base: int) -> np.ndarray:
    """base^(n-1) ... base^0 modulo mod."""
    out = np.ones(1, np.int64)
    while len(out) < n:  # double: the upper half is the lower one times the next power
        step = int(out[0]) * base % mod
        out = np.concatenate([out * step % mod, out])
    return out[-n:] if n else out[:0]


class Hasher:
    """Hash of up to CHUNK bytes; ``moduli`` can be made small to force collisions."""

    def __init__(self, moduli=MODULI, chunk: int = CHUNK):
        self.moduli, self.chunk = moduli, chunk
        self.powers = [_powers(chunk, *m) for m in moduli]

    def one(self, data: np.ndarray) -> tuple[int, ...]:
        wide = data.astype(np.int64) + 1
        n = len(wide)
        return tuple(int(wide @ p[self.chunk - n :]) % m for p, (m, _) in zip(self.powers, self.moduli)) if n else (0, 0)

    def shifted(self, data: np.ndarray, after: int) -> tuple[int, ...]:
        """What a chunk with ``after`` bytes behind it adds to the hash of the whole."""
        return tuple(h * pow(b, after, m) % m for h, (m, b) in zip(self.one(data), self.moduli))

    def total(self, data: np.ndarray) -> tuple[int, ...]:
        n, sums = len(data), [0, 0]
        for at in range(0, n, self.chunk):
            piece = data[at : at + self.chunk]
            sums = [(s + h) % m for s, h, (m, _) in zip(sums, self.shifted(piece, n - at - len(piece)), self.moduli)]
        return tuple(sums)


def _bytes(column: pa.Array, i: int) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), np.uint8)


def _print(batches: Iterator[pa.RecordBatch], moduli, chunk: int) -> Iterator[pa.RecordBatch]:
    """Add the hash of the whole text; for texts that one task may hash alone."""
    hasher = Hasher(moduli, chunk)
    for batch in batches:
        text = batch.column("_text")
        sums = np.array([hasher.total(_bytes(text, i)) for i in range(batch.num_rows)], np.int64).reshape(-1, 2)
        arrays = [c for c, name in zip(batch.columns, batch.schema.names) if name != "_drop"]
        names = [n for n in batch.schema.names if n != "_drop"]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=[*names, "_h1", "_h2"])


def _pieces(batches: Iterator[pa.RecordBatch], chunk: int, rows: int = 64) -> Iterator[pa.RecordBatch]:
    """One row per chunk of ``_text``: the other columns, ``_seq``, and ``_piece``."""
    for batch in batches:
        text = batch.column("_text")
        keep = [n for n in batch.schema.names if n != "_text"]
        at = [(i, k) for i in range(batch.num_rows) for k in range(max(1, -(-len(text[i].as_buffer()) // chunk)))]
        for start in range(0, len(at), rows):
            part = at[start : start + rows]
            index = pa.array([i for i, _ in part], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n).take(index) for n in keep],
                    pa.array([k for _, k in part], pa.int64()),
                    pa.array([text[i].as_buffer()[k * chunk : (k + 1) * chunk].to_pybytes() for i, k in part], pa.binary()),
                ],
                names=[*keep, "_seq", "_piece"],
            )


def _shift(batches: Iterator[pa.RecordBatch], moduli, chunk: int) -> Iterator[pa.RecordBatch]:
    """The shifted hash of each chunk row."""
    hasher = Hasher(moduli, chunk)
    for batch in batches:
        piece, size, seq = batch.column("_piece"), batch.column("_bytes").to_pylist(), batch.column("_seq").to_pylist()
        sums = np.array(
            [hasher.shifted(d := _bytes(piece, i), size[i] - seq[i] * chunk - len(d)) for i in range(batch.num_rows)], np.int64
        ).reshape(-1, 2)
        keep = [n for n in batch.schema.names if n not in ("_piece", "_seq")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in keep], pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=[*keep, "_h1", "_h2"]
        )


def prints(texts: DataFrame, moduli=MODULI, chunk: int = CHUNK) -> DataFrame:
    """``_id, _sha, _bytes, _h1, _h2`` of each row of ``_id, _sha, _bytes, _text``.

    Texts of one chunk are hashed where they lie; the chunks of longer ones are
    dealt out, hashed apart and summed.
    """
    kind = texts.schema["_id"].dataType.simpleString()
    cols = f"_id {kind}, _sha string, _bytes bigint"
    short = texts.where(F.col("_bytes") <= chunk)
    long = texts.where(F.col("_bytes") > chunk).withColumn("_doc", F.monotonically_increasing_id())
    in_place = short.mapInArrow(partial(_print, moduli=moduli, chunk=chunk), f"{cols}, _text string, _h1 bigint, _h2 bigint")
    chunks = long.select("_id", "_sha", "_bytes", "_doc", "_text").mapInArrow(
        partial(_pieces, chunk=chunk), f"{cols}, _doc bigint, _seq bigint, _piece binary"
    )
    hashed = chunks.repartition("_doc", "_seq").mapInArrow(
        partial(_shift, moduli=moduli, chunk=chunk), f"{cols}, _doc bigint, _h1 bigint, _h2 bigint"
    )
    summed = hashed.groupBy("_doc").agg(
        F.first("_id").alias("_id"),
        F.first("_sha").alias("_sha"),
        F.first("_bytes").alias("_bytes"),
        *[(F.sum(f"_h{i + 1}") % m).alias(f"_h{i + 1}") for i, (m, _) in enumerate(moduli)],
    )
    names = ["_id", "_sha", "_bytes", "_h1", "_h2"]
    return in_place.select(names).unionByName(summed.select(names))


def _class(extra=None):
    key = F.concat_ws(":", "_bytes", "_h1", "_h2")
    return key if extra is None else F.concat_ws(":", key, extra)


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", moduli=MODULI, chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: id, ``text_sha256``, ``keep_id``, ``group_size``, ``kept``."""
    bounded_batches(docs)
    texts = docs.select(F.col(id).alias("_id"), whole(text).alias("_text")).select(
        "_id", F.sha2("_text", 256).alias("_sha"), F.octet_length("_text").cast("bigint").alias("_bytes"), "_text"
    )
    rows = cut(prints(texts, moduli, chunk).withColumn("_row", F.monotonically_increasing_id()).withColumn("_class", _class()))
    sizes = cut(rows.groupBy("_class").agg(F.count("*").alias("_n")))
    total = total_of(sizes, "_n")

    # Chunkwise comparison of every group of two or more.
    again = texts.select(F.monotonically_increasing_id().alias("_row"), "_text").mapInArrow(
        partial(_print, moduli=moduli, chunk=chunk), "_row bigint, _text string, _h1 bigint, _h2 bigint"
    ).withColumn("_bytes", F.octet_length("_text")).select(_class().alias("_class"), "_row", "_text")
    # Rows of a class have the same text, so they are told apart by a number.
    members = attach(again, sizes.where("_n > 1"), "_class", "_n", total, ["_row"], merge=True) if total else again.withColumn("_n", F.lit(None))
    differ = (
        members.where(F.col("_n").isNotNull())
        .select("_class", "_text")
        .mapInArrow(partial(_pieces, chunk=chunk), "_class string, _seq bigint, _piece binary")
        .groupBy("_class", "_seq")
        .agg(F.min("_piece").alias("_lo"), F.max("_piece").alias("_hi"))
        .where(F.col("_lo") != F.col("_hi"))
        .select("_class")
        .distinct()
    )
    collided = cut(differ.join(sizes, "_class"))
    split = attach(rows, collided, "_class", "_n", total, ["_row"]).withColumn(
        "_class", F.when(F.col("_n").isNotNull(), _class(F.col("_sha"))).otherwise(F.col("_class"))
    ).drop("_n") if total_of(collided, "_n") else rows

    best = cut(
        split.groupBy("_class").agg(F.max(F.struct("_id", "_row")).alias("_best"), F.count("*").alias("group_size"))
    )
    return attach(split, best, "_class", "group_size", total, ["_row"]).select(
        F.col("_id").alias(id),
        F.col("_best._id").alias("keep_id"),
        "group_size",
        (F.col("_best._row") == F.col("_row")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return exact_dedup(docs)
