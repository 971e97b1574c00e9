"""A quality classifier on document statistics.

Each whole text becomes a few counts and shares. Random Fourier features of the
standardised statistics approximate a Gaussian kernel; the normal equations of a
ridge fit are summed by partition, then by row of the matrix, and only the small
total is solved on the driver. An isotonic curve over the raw scores of a part
held back from the fit turns them into probabilities; it is fitted on counts
per score cell, whose number is fixed.

Defined results: a null text is the empty text; empty texts are scored like any
other; labels other than 0 and 1 are not learned; several labels of one id count as their
mean; with no label at all every score is 0.5; repeated rows get equal scores;
a null id counts as the empty text in the held-out test and has no label;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.llm.common import bounded_batches, crc_mod, whole
from curbline.llm.text_arrays import Words, mix, parts
from curbline.session import cut

#: Number of random features, ridge strength per learned row, kernel width in standard deviations.
FEATURES, RIDGE, KERNEL = 256, 1e-4, 3.0
#: One row in CALIBRATE of those learned from is kept for the isotonic curve, which has CELLS cells.
CALIBRATE, CELLS = 5, 2000
SEED = 20260101

_UPPER, _LOWER, _DIGIT, _MARK, _END, _PUNCT, _WIDE = range(1, 8)
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[[ord(c) for c in "#$%&*+<=>@\\^_`{|}~/"]] = _MARK
_CLASS[[ord(c) for c in "!?."]] = _END
_CLASS[[ord(c) for c in "\"'(),-:;[]"]] = _PUNCT
_CLASS[128:] = _WIDE
N_STATISTICS = 19


def _per_text(at: np.ndarray, n: int, weight=None) -> np.ndarray:
    return np.bincount(at, weights=weight, minlength=n).astype(float)


def statistics(words: Words, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics per text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    text = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(text * 8 + _CLASS[data], minlength=n * 8).reshape(n, 8)
    starts, ends, at = words.find(data, offsets)
    hashes = words.hashes(data, starts, ends)
    length = (ends - starts).astype(float)
    count = _per_text(at, n)
    upper = np.concatenate([[0], np.cumsum(_CLASS[data] == _UPPER)])
    lower = np.concatenate([[0], np.cumsum(_CLASS[data] == _LOWER)])
    loud = ((upper[ends] - upper[starts]) > 1) & (lower[ends] == lower[starts])
    marked = _CLASS[data[ends - 1]] == _MARK if len(ends) else np.zeros(0, bool)
    # first of each (text, word)
    order = np.lexsort((hashes, at))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (at[order][1:] != at[order][:-1])
    runs = np.diff(np.concatenate([np.flatnonzero(new), [len(order)]]))
    kinds_of_word = _per_text(at[order][new], n)
    most = np.zeros(n)
    np.maximum.at(most, at[order][new], runs)
    # lines, told apart by the sum of their words' hashes
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    line = newline[starts] if len(starts) else starts
    lines = _per_text(text[data == 10], n) + (size > 0)
    first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (at[1:] != at[:-1])])) if len(line) else line
    with np.errstate(over="ignore"):
        sums = mix(np.add.reduceat(hashes, first)) if len(first) else hashes
    where = at[first] if len(first) else at
    order = np.lexsort((sums, where))
    again = np.zeros(len(order), bool)
    again[1:] = (sums[order][1:] == sums[order][:-1]) & (where[order][1:] == where[order][:-1])
    repeated = _per_text(where[order], n, again)
    full = np.maximum(_per_text(where, n), 1)
    per_byte, per_word = np.maximum(size, 1), np.maximum(count, 1)
    mean = _per_text(at, n, length) / per_word
    return np.column_stack([
        np.log1p(size), np.log1p(count),
        kinds[:, 1:] / per_byte[:, None],
        mean, np.sqrt(np.maximum(_per_text(at, n, length * length) / per_word - mean * mean, 0)),
        _per_text(at, n, loud) / per_word, _per_text(at, n, marked) / per_word,
        kinds_of_word / per_word, np.log1p(kinds_of_word) / np.log1p(per_word), most / per_word,
        np.log1p(lines), repeated / full, np.minimum(count / np.maximum(lines, 1), 200) / 200,
    ])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        blocks = [statistics(words, data, offsets) for _, _, data, offsets in parts(batch.column("_text"))]
        x = np.concatenate(blocks) if blocks else np.zeros((0, N_STATISTICS))
        keep = [n for n in batch.schema.names if n != "_text"]
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_STATISTICS).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], lists], names=[*keep, "_x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _fourier(x: np.ndarray, mean: np.ndarray, std: np.ndarray, features: int) -> np.ndarray:
    """Random Fourier features, and a constant."""
    draw = np.random.default_rng(SEED)
    w = draw.normal(0, 1 / KERNEL, (x.shape[1], features))
    b = draw.uniform(0, 2 * np.pi, features)
    scaled = np.clip((x - mean) / std, -8, 8)
    return np.hstack([np.sqrt(2 / features) * np.cos(scaled @ w + b), np.ones((len(x), 1))])


def _normal_equations(rows: DataFrame, mean, std, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over all rows: sums by partition, then by row of the matrix."""
    d = features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((d, d + 1)), False
        for batch in batches:
            if batch.num_rows:
                any_rows = True
                z = _fourier(_matrix(batch.column("_x")), mean, std, features)
                y = batch.column("_y").to_numpy(zero_copy_only=False)
                total += z.T @ np.hstack([z, y[:, None]])
        if any_rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["_row", "_sum"]
            )

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(r, float) for r in sorted(table.column("_sum").to_pylist())], axis=0)
        return pa.table({"_row": table.column("_row")[:1], "_sum": pa.array([total.tobytes()], pa.binary())})

    parts_ = rows.select("_x", "_y").mapInArrow(sums, "_row int, _sum binary")
    got = parts_.groupBy("_row").applyInArrow(add, "_row int, _sum binary").collect()
    total = np.zeros((d, d + 1))
    for r in got:
        total[r["_row"]] = np.frombuffer(r["_sum"], float)
    return total[:, :d], total[:, d]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in order of x; centres and heights of the pools."""
    pools: list[list[float]] = []  # height, weight, centre
    for a, b, w in zip(x, y, weight):
        pools.append([b, w, a])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            h, v, c = pools.pop()
            q = pools[-1]
            total = q[1] + v
            pools[-1] = [(q[0] * q[1] + h * v) / total, total, (q[2] * q[1] + c * v) / total]
    return np.array([p[2] for p in pools]), np.array([p[0] for p in pools])


def classify(
    docs: DataFrame, labels: DataFrame, held_out, id: str = "doc_id", text: str = "text", label: str = "quality", features: int = FEATURES
) -> DataFrame:
    """``id, held_out, score`` of every row; ``held_out`` marks rows whose labels are not used."""
    bounded_batches(docs)
    kind = docs.schema[id].dataType.simpleString()
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull())
        .groupBy(F.col(id).alias("_lid")).agg(F.avg(label).alias("_y"))
    )
    rows = docs.select(F.col(id).alias("_id"), held_out.alias("_held"), whole(text).alias("_text")).mapInArrow(
        _statistics, f"_id {kind}, _held boolean, _x array<double>"
    )
    stats = cut(rows.join(known, F.col("_id") == F.col("_lid"), "left").select(
        "_id", "_held", "_x", F.when(~F.col("_held"), F.col("_y")).alias("_y")
    ))
    learn = stats.where("_y IS NOT NULL")
    moments = learn.agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(F.col("_x")[i]) for i in range(N_STATISTICS)]).alias("mean"),
        F.array(*[F.stddev_pop(F.col("_x")[i]) for i in range(N_STATISTICS)]).alias("std"),
    ).first()
    if not moments["n"]:
        return stats.select(F.col("_id").alias(id), F.col("_held").alias("held_out"), F.lit(0.5).alias("score"))
    mean, std = np.array(moments["mean"]), np.maximum(np.array(moments["std"]), 1e-9)

    part = F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(CALIBRATE)) == 0
    fit_rows, check_rows = learn.where(~part), learn.where(part)
    if not (fit_rows.head(1) and check_rows.head(1)):  # too few rows to part
        fit_rows = check_rows = learn
    left, right = _normal_equations(fit_rows, mean, std, features)
    ridge = RIDGE * left[-1, -1] * np.eye(features + 1)
    ridge[-1, -1] = 1e-9
    weights = np.linalg.solve(left + ridge, right)

    @F.arrow_udf("double")
    def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array(_fourier(_matrix(x), mean, std, features) @ weights if len(x) else np.zeros(0))

    cell = F.least(F.greatest(F.floor((F.col("_raw") + 0.5) * (CELLS / 2.0)), F.lit(0)), F.lit(CELLS - 1))
    cells = (
        check_rows.select("_y", raw("_x").alias("_raw"))
        .groupBy(cell.alias("cell")).agg(F.avg("_raw").alias("x"), F.avg("_y").alias("y"), F.count("*").alias("n"))
        .orderBy("cell").collect()
    )
    centre, height = isotonic(*[np.array([float(r[c]) for r in cells]) for c in ("x", "y", "n")])

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            r = _fourier(_matrix(x), mean, std, features) @ weights if len(x) else np.zeros(0)
            # a trace of the raw score keeps the order where the curve is flat
            yield pa.array(np.clip(0.999 * np.interp(r, centre, height) + 0.001 / (1 + np.exp(-np.clip(r, -30, 30))), 0, 1))

    return stats.select(F.col("_id").alias(id), F.col("_held").alias("held_out"), score("_x").alias("score"))


def op9(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = classify(docs, labels, crc_mod("doc_id", 3) == 1)
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
