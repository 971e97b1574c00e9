"""Periodic runs of words, found with multi-scale minimizers.

A run is a stretch of words with smallest period q that holds ``Rule.least``
words and ``Rule.times`` periods at least and that no neighbour extends. Periods
up to DIRECT words are found by scanning the text against itself at each lag. For
longer ones, scale P (a power of two) has the periods in (P/2, P]: each window of
P/2 positions keeps the positions whose P words have the smallest hash. Inside a
run the same windows repeat a period later, and P words are equal there at
multiples of the period only, so neighbouring kept positions of one hash are one
period apart. Such pairs are seeds: each is extended to both sides by comparing
words, so a wrong seed costs time and finds nothing. A run that is found with a
multiple of its period as well is kept with the smallest.

The text is worked on where it lies: no rows are shuffled, and a task holds the
words of a few texts (numbers, not strings).

Defined results: null is the empty text; a text without words has no run, null
columns for its greatest one, and the digests of the empty string; repeated rows
and rows of one id are each looked at alone; a null id counts as the empty text
where :func:`op11` makes its changes; extra columns are not read; an empty table
gives an empty result. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.llm.common import bounded_batches, tidy, whole
from curbline.llm.text_arrays import Words, mix, parts

#: Periods up to so many words are found by direct scans; a power of two.
DIRECT = 16
#: Words hashed, or written to a digest, at a time.
CHUNK = 1 << 18
_SHIFT = np.uint64(29)


@dataclass(frozen=True)
class Rule:
    """A run holds ``least`` words and ``times`` periods at least; ``times`` is 4 or more."""

    least: int = 6
    times: int = 4

    def enough(self, length, period):
        return (length >= self.least) & (length >= self.times * period)


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edge = np.diff(same.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by running minima of blocks from both sides."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, x.max(), x.dtype)
    padded[:n] = x
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _kept(x: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the minimum of a window they lie in (ties: each)."""
    low = _window_min(x, width)
    # the largest of the minima of the windows over a position equals its value if one of them is its own
    edge = np.zeros(width - 1, low.dtype)
    high = ~_window_min(~np.concatenate([edge, low, edge]), width)
    return np.flatnonzero(high == x)


def _reach(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words on from ``at`` (``step`` 1), or before it (-1), equal those ``lag`` later."""
    done, some = 0, 64
    most = len(ids) - lag - at if step > 0 else at
    while done < most:
        some = min(some, most - done)
        a = at + done if step > 0 else at - done - some
        differ = ids[a : a + some] != ids[a + lag : a + lag + some]
        if differ.any():
            first = int(differ.argmax()) if step > 0 else int(differ[::-1].argmax())
            return done + first
        done += some
        some *= 4
    return done


def _seeded(ids: np.ndarray, grams: np.ndarray, scale: int) -> Iterator[tuple[int, int, int]]:
    """Start, length and period of the stretches that the seeds of one scale grow to."""
    kept = _kept(grams, scale // 2)
    value = grams[kept]
    order = np.argsort(value, kind="stable")
    kept, value = kept[order], value[order]
    lag = kept[1:] - kept[:-1]
    seed = (value[1:] == value[:-1]) & (lag > scale // 2) & (lag <= scale)
    at, lag = kept[:-1][seed], lag[seed]
    order = np.lexsort((at, lag))
    period, end = 0, 0
    for a, q in zip(at[order].tolist(), lag[order].tolist()):
        if q == period and a + q < end:
            continue  # inside the stretch found last
        ahead, before = _reach(ids, a, q, 1), _reach(ids, a, q, -1)
        period, end = q, a + ahead + q
        yield a - before, end - a + before, q


def runs(ids: np.ndarray, longest: int, rule: Rule = Rule()) -> np.ndarray:
    """Rows start, length, period of all runs, in order of start, then period.

    ``ids`` are the words of one text, or of several with a value of its own after
    each, and ``longest`` is the number of words of the longest one.
    """
    found = []
    for q in range(1, min(DIRECT, longest // rule.times) + 1):
        starts, ends = _stretches(ids[q:] == ids[:-q])
        length = ends - starts + q
        enough = rule.enough(length, q)
        if enough.any():
            found.append(np.column_stack([starts, length, np.full(len(starts), q)])[enough])
    grams, scale = ids, 1
    while rule.times * (scale // 2 + 1) <= longest:  # the periods of the next scale fit
        if scale > DIRECT:
            some = [r for r in _seeded(ids, grams, scale) if rule.enough(r[1], r[2])]
            if some:
                found.append(np.array(some, np.int64))
        # hashes of twice as many words from those of two neighbours
        grams = mix(grams[: len(grams) - scale] * np.uint64(0x9FB21C651E98DF25) + (grams[scale:] ^ (grams[scale:] >> _SHIFT)))
        scale *= 2
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found).astype(np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)  # of one stretch, the smallest period
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _find(data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and hash of each word; hashes are made in chunks of words."""
    starts, ends, at = words.find(data, offsets)
    hashes = np.zeros(len(starts), np.uint64)
    for a in range(0, len(starts), CHUNK):
        s, e = starts[a : a + CHUNK], ends[a : a + CHUNK]
        first = int(s[0])
        hashes[a : a + CHUNK] = words.hashes(data[first : int(e[-1])], s - first, e - first)
    return starts, ends, at, hashes


def _dropped(n: int, found: np.ndarray) -> np.ndarray:
    """Words that a run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, found[:, 0] + found[:, 2], 1)
    np.add.at(step, found[:, 0] + found[:, 1], -1)
    return np.cumsum(step[:n]) > 0


def collapse(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    """The words with one space between them, a chunk at a time."""
    for a in range(0, len(starts), CHUNK):
        s, size = starts[a : a + CHUNK], (ends - starts)[a : a + CHUNK] + 1
        last = np.cumsum(size)
        from_ = np.arange(last[-1]) + np.repeat(s - (last - size), size)
        from_[last - 1] = 0
        out = data[from_]
        out[last - 1] = 0x20
        yield (out[:-1] if a + CHUNK >= len(starts) else out).tobytes()


def repeated_tail(h: int, n: int) -> np.ndarray:
    """Word numbers after the change that :func:`op11` makes to a tenth of the texts."""
    order = np.arange(n)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        order[a:] = a + (order[a:] - a) % p
    return order


_COLUMNS = {
    "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(),
    "runs_sha256": pa.string(), "collapsed_sha256": pa.string(),
}


def _summary(found: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple:
    """The result row of one text; ``starts`` and ``ends`` of its words in order."""
    best = (None,) * 4
    if len(found):
        s, n, q = max(found.tolist(), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        best = (s, n, q, 1000 * n // q)
    listed = hashlib.sha256()
    for a in range(0, len(found), CHUNK):
        listed.update("".join(f"{s},{n},{q}\n" for s, n, q in found[a : a + CHUNK].tolist()).encode())
    digest = hashlib.sha256()
    if len(found):
        left = ~_dropped(len(starts), found)
        starts, ends = starts[left], ends[left]
    for piece in collapse(data, starts, ends):
        digest.update(piece)
    return len(found), *best, listed.hexdigest(), digest.hexdigest()


def _scan(data: np.ndarray, offsets: np.ndarray, change: list[int] | None, rule: Rule, words: Words) -> list[tuple]:
    """Result rows of the texts of a block."""
    starts, ends, at, hashes = _find(data, offsets, words)
    n_texts = len(offsets) - 1
    counts = np.bincount(at, minlength=n_texts)
    first = np.cumsum(counts) - counts
    if change:
        for k in range(n_texts):
            a, b = first[k], first[k] + counts[k]
            order = repeated_tail(change[k], b - a)
            starts[a:b], ends[a:b], hashes[a:b] = starts[a:b][order], ends[a:b][order], hashes[a:b][order]
    # texts end to end, each followed by a value that no other place has
    size = counts + 1
    place = np.cumsum(size) - size
    ids = np.zeros(len(hashes) + n_texts, np.uint64)
    ids[np.arange(len(hashes)) + at] = hashes
    ids[place + counts] = mix(np.arange(1, n_texts + 1, dtype=np.uint64) << np.uint64(32))
    found = runs(ids, int(counts.max(initial=0)), rule)
    cuts = np.searchsorted(found[:, 0], np.append(place, len(ids)))
    out = []
    for k in range(n_texts):
        own = found[cuts[k] : cuts[k + 1]] - [place[k], 0, 0]
        a, b = first[k], first[k] + counts[k]
        out.append(_summary(own, data, starts[a:b], ends[a:b]))
    return out


def detect(docs: DataFrame, id: str = "doc_id", text: str = "text", rule: Rule = Rule(), changed: bool = False) -> DataFrame:
    """A row per document: id, n_runs, the run of the greatest exponent, and digests of all runs and of the text without repeats.

    ``changed`` first repeats the tail of a tenth of the texts, as :func:`repeated_tail` says.
    """
    if rule.times < 4:
        raise ValueError("runs are found from four periods on")
    bounded_batches(docs)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            key = batch.column("_key").to_pylist() if changed else []
            rows = []
            for a, b, data, offsets in parts(batch.column("_text"), 1 << 20):
                rows += _scan(data, offsets, [zlib.crc32(k.encode()) for k in key[a:b]], rule, words)
            columns = list(zip(*rows)) or [()] * len(_COLUMNS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *[pa.array(c, t) for c, t in zip(columns, _COLUMNS.values())]], names=["_id", *_COLUMNS]
            )

    rows = docs.select(F.col(id).alias("_id"), whole(id).alias("_key"), whole(text).alias("_text"))
    schema = ", ".join(f"{c} {'string' if t == pa.string() else 'bigint'}" for c, t in _COLUMNS.items())
    return rows.mapInArrow(tidy(run), f"_id {kind}, {schema}").withColumnRenamed("_id", id)


def op11(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return detect(docs, changed=True)
