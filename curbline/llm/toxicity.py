"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are lower-cased runs of letters and digits, hashed into ``Settings.buckets``.
Their log-odds between toxic and other learned texts have an informative Dirichlet
prior, the token counts of the whole corpus, so rare tokens stay near zero; a token
counts for (or against) toxicity only as far as its credible bound goes, and each
token costs ``Settings.drift``. In every text the scan of Ruzzo and Tompa finds all
maximal scoring segments in linear time. Segment scores of clean texts follow an
extreme-value law: its scale comes from the token scores (Karlin and Altschul), its
place from learned clean texts. A segment is significant when its p-value is small;
a text's evidence is the best sum statistic over its r best segments, and a rising
curve over evidence, fitted on learned texts that the log-odds have not seen, turns
it into a probability.

Labels are learned from a bounded sample of different texts (``Settings.sample`` a
class); token counts of the prior cover all rows, and all rows are scored where they
lie. What reaches the driver has a row per bucket and class, or per learned text, at most.

Defined results: a null text is the empty text, which has no evidence; labels other
than 0 and 1 are not learned; texts with several labels are toxic when half of these
are; with no toxic label, or no other one, every score is the share of toxic labels
(0 without any); repeated rows get equal scores; rows with a null id are scored and
not learned; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.llm.common import bounded_batches, crc_mod, tidy, whole
from curbline.llm.text_arrays import LOWER, Words, parts
from curbline.session import cut

SEED = 20260113
#: Most segments of a text that the sum statistic adds up.
SUMMED = 64

_TOKEN = LOWER.copy()
_TOKEN[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


@dataclass(frozen=True)
class Settings:
    """``sample``: learned texts of each class; one in ``check`` of them is kept for the curve.

    ``prior``: weight of the corpus in tokens; ``bound``: standard deviations of the credible
    bound; ``drift``: cost of a token; ``alpha``: largest p-value of a significant passage.
    """

    sample: int = 20_000
    check: int = 4
    buckets: int = 1 << 18
    prior: float = 50_000.0
    bound: float = 1.645
    drift: float = 0.5
    alpha: float = 0.01


@dataclass(frozen=True)
class Model:
    """Token scores, the law of segment scores (``lam``, ``k``), and the curve."""

    settings: Settings
    token: np.ndarray
    lam: float = 0.0
    k: float = 1.0
    base: float = 0.0
    at: np.ndarray = field(default_factory=lambda: np.zeros(0))
    height: np.ndarray = field(default_factory=lambda: np.zeros(0))


def tokens(words: Words, data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Start, end, text number and bucket of each token of a block of texts."""
    lowered = _TOKEN[data]
    starts, ends, at = words.find(lowered, offsets)
    bucket = np.zeros(len(starts), np.int64)
    step = 1 << 18
    for a in range(0, len(starts), step):  # a long text is hashed a part at a time
        s, e = starts[a : a + step], ends[a : a + step]
        hashes = words.hashes(lowered[s[0] : e[-1]], s - s[0], e - s[0])
        bucket[a : a + step] = (hashes % np.uint64(buckets)).astype(np.int64)
    return starts, ends, at, bucket


def _counts(rows: DataFrame, buckets: int, classes: int) -> np.ndarray:
    """Texts with a token of each bucket by the class ``_y`` (0 to classes - 1) of the text, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(buckets * classes, np.int64)
        for batch in batches:
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            for a, _, data, offsets in parts(batch.column("_text")):
                _, _, at, bucket = tokens(words, data, offsets, buckets)
                each = np.unique(at * buckets + bucket)  # a token repeated in a text says it once
                total += np.bincount(each % buckets * classes + y[a + each // buckets], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    cells = rows.select("_text", F.col("_y").cast("int").alias("_y")).mapInArrow(tidy(run), "cell bigint, n bigint")
    got = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # a row per bucket and class at most
    out = np.zeros(buckets * classes)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(buckets, classes)


def token_scores(clean: np.ndarray, toxic: np.ndarray, corpus: np.ndarray, settings: Settings) -> np.ndarray:
    """Credible log-odds of each bucket, less the drift."""
    prior = settings.prior * (corpus + 0.5) / (corpus + 0.5).sum()
    odds, variance = [], 0
    for n in (toxic, clean):
        mass = n + prior
        odds.append(np.log(mass) - np.log(np.maximum(n.sum() + settings.prior - mass, 1e-9)))
        variance = variance + 1 / mass
    delta, spread = odds[0] - odds[1], settings.bound * np.sqrt(variance)
    return np.where(delta > 0, np.maximum(delta - spread, 0), np.minimum(delta + spread, 0)) - settings.drift


def scale_of(token: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(lam * token)) = 1; 0 when no token scores above zero."""
    up = share > 0
    token, share = token[up], share[up]
    if not len(token) or token.max() <= 0:
        return 0.0
    low, high = 0.0, 1.0
    value = lambda x: float((share * np.exp(np.minimum(x * token, 700))).sum()) - 1
    while value(high) < 0:
        low, high = high, 2 * high
    if not low:  # the root lies below 1: the sum dips below 1 right of 0
        low = high
        while low > 1e-9 and value(low) >= 0:
            low /= 2
        if low <= 1e-9:
            return 0.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in order, in linear time."""
    left: list[float] = []  # sum before the segment
    right: list[float] = []  # sum up to its end
    spans: list[tuple[int, int]] = []
    smaller: list[int] = []  # the nearest earlier segment with a smaller sum before it
    total = 0.0
    for i, s in enumerate(score.tolist()):
        before, total = total, total + s
        if s <= 0:
            continue
        start, j = i, len(left) - 1
        while True:
            while j >= 0 and left[j] >= before:
                j = smaller[j]
            if j < 0 or right[j] >= total:
                break
            start, before = spans[j][0], left[j]
            del left[j:], right[j:], spans[j:], smaller[j:]
            j -= 1
        left.append(before)
        right.append(total)
        spans.append((start, i + 1))
        smaller.append(j)
    return [(a, b, r - l) for (a, b), l, r in zip(spans, left, right)]


def evidence(scores: list[float], m: int, lam: float, k: float) -> float:
    """The best -log p of the sum statistics of the 1, 2, ... highest segments of a text of ``m`` tokens."""
    best = total = 0.0
    place = math.log(max(k * m, 1e-300))
    for r, s in enumerate(sorted(scores, reverse=True)[:SUMMED], 1):
        total += lam * s - place
        if lam * s <= place or total <= 0:
            break
        if r == 1:
            logp = -total if total > 30 else math.log(-math.expm1(-math.exp(-total)))
        else:
            logp = (r - 1) * math.log(total) - total - math.lgamma(r + 1) - math.lgamma(r)
        best = max(best, -logp - (r - 1) * math.log(2))  # the price of having chosen r
    return best


def rising_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the best rising curve over points in order of x: flat on each pool, straight between pools."""
    pools: list[list[float]] = []  # height, weight, first and last x
    for a, b, w in zip(x.tolist(), y.tolist(), weight.tolist()):
        pools.append([b, w, a, a])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            h, v, _, last = pools.pop()
            q = pools[-1]
            pools[-1] = [(q[0] * q[1] + h * v) / (q[1] + v), q[1] + v, q[2], last]
    return np.array([c for p in pools for c in p[2:]]), np.array([p[0] for p in pools for _ in range(2)])


def _segments(model: Model, words: Words, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]], int]]:
    """For each text: first byte, end byte and score of its maximal segments, and its number of tokens."""
    for a, b, data, offsets in parts(column):
        starts, ends, at, bucket = tokens(words, data, offsets, model.settings.buckets)
        score = model.token[bucket]
        counts = np.bincount(at, minlength=b - a)
        first = np.cumsum(counts) - counts
        found: dict[int, list] = {}
        if len(score):
            up = score > 0
            edge = np.ones(len(score), bool)  # stretches of one sign in one text are one step
            edge[1:] = (up[1:] != up[:-1]) | (at[1:] != at[:-1])
            edge = np.flatnonzero(edge)
            sums, of, last = np.add.reduceat(score, edge), at[edge], np.append(edge[1:], len(score))
            for t in np.unique(at[up]).tolist():
                lo, hi = np.searchsorted(of, [t, t + 1])
                found[t] = [
                    (int(starts[edge[lo + x]] - offsets[t]), int(ends[last[lo + y - 1] - 1] - offsets[t]), s)
                    for x, y, s in maximal_segments(sums[lo:hi])
                ]
        for t in range(b - a):
            yield a + t, found.get(t, []), int(counts[t])


def _learned(docs: DataFrame, labels: DataFrame, held_out, id: str, text: str, label: str, sample: int) -> tuple[DataFrame, dict]:
    """Stored different texts ``_text, _y`` of both classes, about ``sample`` of each, and the number there is of each."""
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull())
        .groupBy(F.col(id).alias("_lid")).agg(F.avg(label).alias("_mean"))
    )
    rows = docs.where(~held_out & F.col(id).isNotNull()).select(F.col(id).alias("_id"), F.xxhash64(whole(text)).alias("_h"))
    kinds = cut(
        rows.join(known, F.col("_id") == F.col("_lid")).groupBy("_h")
        .agg((F.avg("_mean") >= 0.5).cast("int").alias("_y"), F.min("_id").alias("_id"))
    )
    sizes = {r["_y"]: r["n"] for r in kinds.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("_y") == 1, F.lit(sample / max(sizes.get(1, 0), 1))).otherwise(F.lit(sample / max(sizes.get(0, 0), 1)))
    chance = F.pmod(F.xxhash64("_h", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    drawn = cut(kinds.where(chance < rate).select(F.col("_id").alias("_did"), F.col("_h").alias("_dh"), "_y"))
    texts = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("_id"), whole(text).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    # bounded by 2 * sample rows of three numbers
    taken = texts.join(F.broadcast(drawn), (F.col("_id") == F.col("_did")) & (F.col("_h") == F.col("_dh")))
    return cut(taken.dropDuplicates(["_h"]).select("_h", "_text", "_y")), sizes


def _found(rows: DataFrame, model: Model) -> list[tuple[int, int, int, list[float]]]:
    """Class, number in the sample, tokens and segment scores of learned texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            m, scores = [], []
            for _, segments, n in _segments(model, words, batch.column("_text")):
                m.append(n)
                scores.append(sorted((s for *_, s in segments), reverse=True)[:SUMMED])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_y"), pa.array(m, pa.int64()), pa.array(scores, pa.list_(pa.float64()))], names=["y", "m", "s"]
            )

    return [tuple(r) for r in rows.select("_text", "_y").mapInArrow(tidy(run), "y int, m bigint, s array<double>").collect()]


def train(
    docs: DataFrame, labels: DataFrame, held_out, id: str = "doc_id", text: str = "text", label: str = "toxic",
    settings: Settings = Settings(),
) -> Model:
    """Learn from the labels of rows that ``held_out`` does not mark."""
    bounded_batches(docs)
    learned, sizes = _learned(docs, labels, held_out, id, text, label, settings.sample)
    none = np.zeros(settings.buckets)
    if not (sizes.get(0) and sizes.get(1)):
        return Model(settings, none, base=float(bool(sizes.get(1))))
    part = F.pmod(F.xxhash64("_h", F.lit(SEED + 1)), F.lit(settings.check)) == 0
    fit, check = learned.where(~part), learned.where(part)
    classes = lambda rows: {r[0] for r in rows.select("_y").distinct().collect()}
    if classes(fit) != {0, 1} or classes(check) != {0, 1}:  # too few to part
        fit = check = learned
    corpus = _counts(docs.select(whole(text).alias("_text"), F.lit(0).alias("_y")), settings.buckets, 1)[:, 0]
    clean, toxic = _counts(fit, settings.buckets, 2).T
    token = token_scores(clean, toxic, corpus, settings)
    share = clean + settings.prior * corpus / max(corpus.sum(), 1)
    base = sizes[1] / (sizes[0] + sizes[1])
    lam = scale_of(token, share / max(share.sum(), 1e-9))
    if not lam:
        return Model(settings, token, base=base)
    model = Model(settings, token, lam, 1.0, base)
    rows = _found(check, model)  # bounded by the sample
    at_clean = [(m, s[0] if s else 0.0) for y, m, s in rows if y == 0 and m]
    # The likeliest place of the extreme-value law of scale 1 / lam.
    k = len(at_clean) / max(sum(m * math.exp(-lam * s) for m, s in at_clean), 1e-300) if at_clean else 1.0
    e = np.array([evidence(s, m, lam, k) for _, m, s in rows])
    y = np.array([r[0] for r in rows], float)
    drawn = [max(int((y == c).sum()), 1) for c in (0, 1)]
    weight = np.where(y == 1, sizes[1] / drawn[1], sizes[0] / drawn[0])
    order = np.argsort(e, kind="stable")
    value, first = np.unique(e[order], return_index=True)  # texts of equal evidence are one point
    total = np.add.reduceat(weight[order], first)
    at, height = rising_curve(value, np.add.reduceat((weight * y)[order], first) / total, total)
    return Model(settings, token, lam, k, base, at, height)


def _probability(model: Model, e: np.ndarray) -> np.ndarray:
    if not len(model.at):
        return np.full(len(e), model.base)
    # a trace of the evidence keeps the order where the curve is flat
    return np.clip(0.999 * np.interp(e, model.at, model.height) + 0.001 * e / (1 + e), 0, 1)


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", keep: tuple = ()) -> DataFrame:
    """``id``, the columns of ``keep``, ``score`` and ``passages`` of every row.

    A passage is a significant segment: start and end in the text (code points, end exclusive),
    its score and p-value; they are in order of their start.
    """
    bounded_batches(docs)
    rows = docs.select(F.col(id).alias("_id"), *keep, whole(text).alias("_text"))
    others = [c for c in rows.columns if c != "_text"]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = Words(), sent.value
        for batch in batches:
            column = batch.column("_text")
            e, passages = np.zeros(len(column)), []
            for t, segments, m in _segments(model, words, column):
                found = []
                if segments and model.lam:
                    e[t] = evidence([s for *_, s in segments], m, model.lam, model.k)
                    p = [-math.expm1(-model.k * m * math.exp(-model.lam * s)) for *_, s in segments]
                    kept = [(a, b, s, x) for (a, b, s), x in zip(segments, p) if x <= model.settings.alpha]
                    if kept:
                        data = np.frombuffer(column[t].as_py().encode(), np.uint8)
                        point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                        found = [{"start": int(point[a]), "end": int(point[b]), "score": s, "p": x} for a, b, s, x in kept]
                passages.append(found)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others], pa.array(_probability(model, e)), pa.array(passages, kind)],
                names=[*others, "score", "passages"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema)
    out = rows.mapInArrow(tidy(run), f"{schema}, score double, passages array<struct<start: bigint, end: bigint, score: double, p: double>>")
    return out.withColumnRenamed("_id", id)


def op12(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = crc_mod("doc_id", 5) == 0
    model = train(docs, labels, held)
    return score(docs.withColumn("held_out", held), model, keep=("held_out",)).select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "passages"
    )
