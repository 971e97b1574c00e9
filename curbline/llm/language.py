"""Language identification: the family first, then the language within it.

Features are counts of byte n-grams of the letters of the whole text, hashed,
square-rooted and scaled to length 1. Linear support vector machines, one
against one, vote first for a language family; within the family, one against
one again, for the language: a text never meets the machines of other families.
Labels beyond the table of families form families of their own by what their texts
have in common, about as many as the square root of their number, so the machines
stay few. They are fitted on a bounded sample of the labelled rows, chosen by a hash
of the text; the prediction runs over all rows, a bounded number at a time. More
than ``MOST_LABELS`` labels are an error: such a column does not hold languages.

Defined results: a null text, or one without a letter, is UNKNOWN with score 0;
with no labelled rows every text is; with one language every text with letters
is that, score 1. Repeated rows get equal predictions; a null id counts as the
empty text in the held-out test; extra columns stay as they are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curbline.llm.common import bounded_batches, crc_mod, release, tidy, whole
from curbline.llm.text_arrays import LOWER, parts
from curbline.session import cut

UNKNOWN = "und"
#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
}
#: Width of the hashed features.
WIDTH = 2048
#: Labelled texts to fit on: so many in all at most, the same number for each language, but one at least.
SAMPLE_ROWS = 6000
#: Labels at most, and other labels than those of the table that stay families of their own.
MOST_LABELS, ALONE = 1000, 4
#: Texts whose features are made at a time.
BLOCK_ROWS = 256

_LETTER = LOWER.copy()
_LETTER[: ord("A")] = _LETTER[ord("Z") + 1 : ord("a")] = _LETTER[ord("z") + 1 : 128] = 32


def features(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Rows of features, a block at a time."""
    for a, b, data, offsets in parts(column, rows=BLOCK_ROWS):
        rows = b - a
        if not len(data):
            yield np.zeros((rows, width), np.float32)
            continue
        letters = _LETTER[data].astype(np.uint32)
        text = np.repeat(np.arange(rows), np.diff(offsets))
        counts = np.zeros(rows * width)
        gram = np.zeros(len(letters), np.uint32)
        for n in range(1, 4):
            m = len(letters) - n + 1
            if m <= 0:
                break
            gram = gram[:m] * np.uint32(257) + letters[n - 1 :]
            spread = (gram * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(16)
            at = text[:m] * width + (spread % np.uint32(width))
            inside = text[:m] == text[n - 1 :]
            counts += np.bincount(at[inside], minlength=rows * width)
        x = np.sqrt(counts.reshape(rows, width))
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        yield (x / np.maximum(norm, 1e-9)).astype(np.float32)


def fit_machine(x: np.ndarray | list[np.ndarray], y: np.ndarray, c: float = 10.0, rounds: int = 120) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradient steps.

    Rows may come as blocks, end to end; they are read where they lie and not copied.
    """
    blocks = x if isinstance(x, list) else [x]
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    weight = (share * c).astype(np.float32)
    ends = np.cumsum([len(x) for x in blocks])
    width = blocks[0].shape[1] + 1

    def margins(w: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ w[:-1] for x in blocks]) + w[-1]

    def total(v: np.ndarray) -> np.ndarray:
        return np.append(sum(x.T @ v[e - len(x) : e] for x, e in zip(blocks, ends)), v.sum())

    u = np.full(width, 1 / np.sqrt(width), np.float32)
    size = 0.0
    for _ in range(10):  # largest curvature by power iteration
        u = total(weight * margins(u))
        size = float(np.linalg.norm(u))
        u /= np.float32(max(size, 1e-12))
    step = np.float32(1.0 / (2.2 * size + 1e-3))
    w = z = np.zeros(width, np.float32)
    t = 1.0
    for _ in range(rounds):
        gap = np.maximum(np.float32(0), 1 - y * margins(z))
        new = z - step * (np.float32(1e-3) * z - 2 * total(weight * y * gap))
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z = new + np.float32((old - 1) / t) * (new - w)
        w = new
    return w


@dataclass
class Hierarchy:
    """Families, the machine of each pair of families, and of each pair of languages in one."""

    families: dict[str, list[str]] = field(default_factory=dict)
    machines: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def _vote(self, names: list[str], margins: dict) -> tuple[np.ndarray, np.ndarray]:
        """Winner's position among names and its least probability against another."""
        rows = len(next(iter(margins.values()))) if margins else 0
        votes = np.zeros((rows, len(names)))
        worst = np.ones((rows, len(names)))
        for i, j in combinations(range(len(names)), 2):
            p = 1 / (1 + np.exp(-4 * np.clip(margins[names[i], names[j]], -20, 20)))
            votes[:, i] += p
            votes[:, j] += 1 - p
            worst[:, i] = np.minimum(worst[:, i], p)
            worst[:, j] = np.minimum(worst[:, j], 1 - p)
        best = votes.argmax(axis=1)
        return best, worst[np.arange(rows), best]

    def _margins(self, names: list[str], x: np.ndarray) -> dict:
        return {k: x @ self.machines[k][:-1] + self.machines[k][-1] for k in combinations(names, 2)}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        rows, names = len(x), list(self.families)
        if not names:
            return [UNKNOWN] * rows, np.zeros(rows)
        family, p = self._vote(names, self._margins(names, x)) if len(names) > 1 else (np.zeros(rows, int), np.ones(rows))
        out, score = np.empty(rows, object), p.copy()
        for k, name in enumerate(names):
            here = np.flatnonzero(family == k)
            own = self.families[name]
            if len(own) == 1:
                out[here] = own[0]
            elif len(here):
                best, q = self._vote(own, self._margins(own, x[here]))
                out[here] = np.array(own, object)[best]
                score[here] *= q
        return list(out), score


def _families(x: np.ndarray, labels: np.ndarray) -> dict[str, str]:
    """The family of each label: from the table, or by clusters of the labels' mean features."""
    known = {code: name for name, codes in FAMILIES.items() for code in codes}
    others = sorted({lang for lang in labels if lang not in known})
    out = {lang: known[lang] for lang in sorted(set(labels)) if lang in known}
    if len(others) <= ALONE:
        return out | {lang: f"={lang}" for lang in others}
    centre = np.stack([x[labels == lang].mean(axis=0) for lang in others])
    chosen = [0]  # farthest first
    while len(chosen) < math.ceil(math.sqrt(len(others))):
        gap = ((centre[:, None] - centre[chosen]) ** 2).sum(-1).min(axis=1)
        chosen.append(int(gap.argmax()))
    means = centre[chosen]
    for _ in range(10):
        near = ((centre[:, None] - means) ** 2).sum(-1).argmin(axis=1)
        means = np.stack([centre[near == k].mean(axis=0) if (near == k).any() else means[k] for k in range(len(means))])
    return out | {lang: f"={others[chosen[k]]}" for lang, k in zip(others, near.tolist())}


def fit(x: np.ndarray, labels: np.ndarray) -> Hierarchy:
    """The machines of the labelled rows; rows in order of their label are not copied."""
    order = np.argsort(labels, kind="stable")
    if (order[1:] < order[:-1]).any():
        x, labels = x[order], labels[order]
    names, first, count = np.unique(labels, return_index=True, return_counts=True)
    rows = {lang: x[a : a + n] for lang, a, n in zip(names.tolist(), first.tolist(), count.tolist())}
    known = _families(x, labels)
    model = Hierarchy()
    for lang in rows:
        model.families.setdefault(known[lang], []).append(lang)

    def pair(a: str, b: str, own_a: list[str], own_b: list[str]) -> None:
        blocks = [rows[lang] for lang in own_a + own_b]
        y = np.repeat([1.0] * len(own_a) + [-1.0] * len(own_b), [len(block) for block in blocks])
        model.machines[a, b] = fit_machine(blocks, y).astype(np.float32)

    for a, b in combinations(model.families, 2):
        pair(a, b, model.families[a], model.families[b])
    for own in model.families.values():
        for a, b in combinations(own, 2):
            pair(a, b, [a], [b])
    return model


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def sample(labelled: DataFrame, text: str = "text", label: str = "lang", rows: int = SAMPLE_ROWS) -> DataFrame | None:
    """``_label, _hash, _text``: for each label its ``rows`` / labels different texts of smallest hash, or all; None without a label."""
    spark = labelled.sparkSession
    usable = labelled.where(F.col(label).isNotNull() & has_letter(text)).select(
        F.col(label).cast("string").alias("_label"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash")
    )
    pairs = cut(usable.select("_label", "_hash").distinct())
    counts = [(r["_label"], r["count"]) for r in pairs.groupBy("_label").count().limit(MOST_LABELS + 1).collect()]
    if not counts:
        return None
    if len(counts) > MOST_LABELS:
        raise ValueError(f"{label} has more than {MOST_LABELS} labels")
    each = max(1, rows // len(counts))
    # A few more than enough pass by their rate, so that no label is ranked whole.
    spare = each + 10 * each**0.5 + 20
    rates = spark.createDataFrame([(c, min(1.0, spare / n)) for c, n in counts], "_l string, _rate double")
    chance = F.pmod(F.xxhash64("_hash", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = pairs.join(F.broadcast(rates), F.col("_label") == F.col("_l")).where(chance < F.col("_rate"))
    rank = F.row_number().over(W.partitionBy("_label").orderBy(chance, "_hash"))
    chosen = some.withColumn("_rank", rank).where(F.col("_rank") <= each).select(F.col("_label").alias("_l"), F.col("_hash").alias("_h"))
    mine = usable.join(F.broadcast(cut(chosen)), (F.col("_label") == F.col("_l")) & (F.col("_hash") == F.col("_h")), "left_semi")
    return mine.groupBy("_label", "_hash").agg(F.min("_text").alias("_text"))


def train(labelled: DataFrame, text: str = "text", label: str = "lang", rows: int = SAMPLE_ROWS, width: int = WIDTH) -> Hierarchy:
    """Fit on a sample of ``rows`` different texts at most, spread evenly over the labels (one row each in ``counts``)."""
    bounded_batches(labelled)
    chosen = sample(labelled, text, label, rows)
    if chosen is None:
        return Hierarchy()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [zlib.compress(row.tobytes(), 1) for block in features(batch.column("_text"), width) for row in block]
            yield pa.RecordBatch.from_arrays([batch.column("_label"), batch.column("_hash"), pa.array(x, pa.binary())], names=["_label", "_hash", "_x"])

    # most features are zero, so packed rows are a fraction of the fit's matrix; the same fit whatever the order of rows
    got = chosen.mapInArrow(tidy(vectors), "_label string, _hash bigint, _x binary").toArrow()
    got = got.sort_by([("_label", "ascending"), ("_hash", "ascending")])
    labels = np.array(got.column("_label").to_pylist(), object)
    x = np.empty((len(got), width), np.float32)
    for k, row in enumerate(got.column("_x")):
        x[k] = np.frombuffer(zlib.decompress(row.as_buffer()), np.float32)
    del got
    release()
    model = fit(x, labels)
    del x
    release()
    return model


def guess_column(model: Hierarchy, text: str = "text", width: int = WIDTH) -> Column:
    """The prediction as one column: struct of lang and score."""

    def guesses(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            langs, scores = [], []
            for x in features(column, width):
                lang, score = model.predict(x)
                langs += lang
                scores.append(score)
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    @F.arrow_udf("struct<lang:string,score:double>")
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(guesses)(batches)

    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    # Not deterministic for the planner: a filter on the result must not evaluate it a second time.
    return F.when(has_letter(text), guess.asNondeterministic()(whole(text))).otherwise(unknown)


def predict(docs: DataFrame, model: Hierarchy, text: str = "text", width: int = WIDTH) -> DataFrame:
    """Docs with ``lang_pred`` and ``score``, which replace columns of those names."""
    bounded_batches(docs)
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    guessed = docs.select(*others, guess_column(model, text, width).alias("__guess"))
    return guessed.select(*others, F.col("__guess.lang").alias("lang_pred"), F.col("__guess.score").alias("score"))


def op5(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    model = train(rows.where(~F.col("held_out")))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
