"""Segments against their definition, counts and scores against plain loops, held-out accuracy, odd rows."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from curbline.llm import toxicity as T
from curbline.llm.common import crc_mod
from curbline.llm.text_arrays import Words, parts
from pyspark.sql import functions as F

SMALL = T.Settings(buckets=1 << 16, sample=5000, prior=200.0)
SCHEMA = "doc_id bigint, text string, score int, passages string"


def plain_segments(score):
    """By definition: the best segment (shortest, then first), then the same left and right of it."""

    def search(a, b):
        best = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += score[j]
                if total > 0 and (best is None or (total, -(j - i)) > (best[0], -(best[2] - best[1] - 1))):
                    best = (total, i, j + 1)
        if best is None:
            return []
        s, i, j = best
        return search(a, i) + [(i, j, s)] + search(j, b)

    return search(0, len(score))


def test_segments_equal_their_definition():
    draw = random.Random(1)
    for _ in range(400):
        score = [draw.choice([-5, -3, -2, -1, 1, 2, 4]) + draw.random() / 100 for _ in range(draw.randrange(0, 25))]
        got = T.maximal_segments(np.array(score))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in plain_segments(score)]
        assert all(abs(s - sum(score[a:b])) < 1e-9 for a, b, s in got)


def test_segments_take_linear_time():
    for score in (np.tile([1.0, -1.5], 200_000), np.concatenate([np.tile([1.0, -0.9], 100_000), np.tile([1.0, -1.1], 100_000)])):
        assert T.maximal_segments(score)


def plain_tokens(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[a-z0-9\u0080-\U0010FFFF]+", lowered)


def bucket(token, buckets):
    for _, _, data, offsets in parts(pa.array([token])):
        return int(T.tokens(Words(), data, offsets, buckets)[3][0])


def test_counts_and_scores_equal_plain_ones(spark, monkeypatch):
    texts = ["Bad bad WORDS, here", "fine words_here; b2 né", None, "", "x" * 50, "bad né"]
    y = [1, 0, 0, 1, 0, 1]
    docs = spark.createDataFrame(list(zip(texts, y)), "_text string, _y int").withColumn("_text", F.coalesce("_text", F.lit("")))
    got = T._counts(docs.repartition(3), 1 << 12, 2)
    want = np.zeros((1 << 12, 2))
    for t, c in zip(texts, y):
        for b in {bucket(w, 1 << 12) for w in plain_tokens(t)}:
            want[b, c] += 1
    assert (got == want).all()
    settings = T.Settings(prior=100.0, buckets=4)
    clean, toxic, corpus = np.array([50.0, 40, 10, 0]), np.array([5.0, 4, 1, 20]), np.array([55.0, 44, 11, 20])
    token = T.token_scores(clean, toxic, corpus, settings)
    for w in range(4):
        a = 100 * (corpus[w] + 0.5) / (corpus.sum() + 2)
        i, j = toxic[w] + a, clean[w] + a
        delta = math.log(i / (toxic.sum() + 100 - i)) - math.log(j / (clean.sum() + 100 - j))
        spread = 1.645 * math.sqrt(1 / i + 1 / j)
        shrunk = max(delta - spread, 0) if delta > 0 else min(delta + spread, 0)
        assert token[w] == pytest.approx(shrunk - 0.5)
    assert token[3] > 0 > token[0]
    share = np.array([0.5, 0.3, 0.19, 0.01])
    lam = T.scale_of(token, share)
    assert (share * np.exp(lam * token)).sum() == pytest.approx(1) and lam > 0
    assert T.scale_of(np.full(4, -0.5), share) == 0


def test_evidence_grows_and_falls():
    assert T.evidence([], 100, 1.0, 0.1) == 0 and T.evidence([2.0], 100, 1.0, 0.1) == 0
    one, two = T.evidence([8.0], 100, 1.0, 0.1), T.evidence([8.0, 7.0], 100, 1.0, 0.1)
    assert 0 < one < two and T.evidence([8.0], 1000, 1.0, 0.1) < one
    assert one == pytest.approx(-math.log(1 - math.exp(-math.exp(-(8 - math.log(10))))))
    assert T.evidence([5000.0] * 200, 10, 5.0, 0.1) < math.inf


def auc(score, y):
    rank = np.empty(len(score))
    rank[np.argsort(score)] = np.arange(1, len(score) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    docs, labels = [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]
    got = T.op12(spark, docs, labels)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.drop("passages").collect()
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    s, y, p = np.array([(r["score"], toxic[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in toxic]).T
    assert auc(s, y) > 0.95 and p[y == 1].mean() > 0.88 and p[y == 0].mean() < 0.01


def corpus(n=400):
    draw = random.Random(5)
    fine, bad = [f"word{k}" for k in range(60)], ["grot", "snark", "vile"]
    rows, labels = [], []
    for k in range(n):
        words = [draw.choice(fine) for _ in range(draw.randrange(20, 60))]
        if k % 4 == 0:
            at = draw.randrange(len(words))
            words[at:at] = [draw.choice(bad) for _ in range(6)]
        rows.append((k, " ".join(words), 0, "x"))
        labels.append((k, k % 2, int(k % 4 == 0)))
    return rows, labels


LABELS = "doc_id bigint, quality int, toxic int"


def test_passages_and_odd_rows(spark):
    rows, labels = corpus()
    odd = [(1000, None, 0, "x"), (1001, "", 0, "x"), (None, "grot snark vile grot vile", 0, "x"), (1002, "word1 " * 100_000, 0, "x"),
           (1003, "word1 é word2. " * 30 + "GROT, snark vile grot snark vile!" + " word3 word4" * 30, 0, "x"), (4, rows[4][1], 0, "x")]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    known = spark.createDataFrame(labels + [(1000, 0, 1), (None, 0, 1), (4, 0, None), (1002, 0, 7)], LABELS)
    model = T.train(docs, known, F.lit(False), settings=SMALL)
    got = {r["doc_id"]: r for r in T.score(docs, model).collect()}
    assert T.score(docs, model).count() == len(rows) + len(odd)
    assert [(k, got[k]["score"]) for k in range(400) if (got[k]["score"] >= 0.5) != (k % 4 == 0)] == []
    assert got[1000]["score"] == got[1001]["score"] < 0.1 > got[1002]["score"] and got[None]["score"] > 0.5
    text = odd[4][1]
    (passage,) = got[1003]["passages"]
    assert text[passage["start"] : passage["end"]] == "GROT, snark vile grot snark vile" and passage["p"] < 0.01
    assert T.score(docs.where("false"), model).collect() == []


def test_missing_labels(spark):
    rows, labels = corpus(40)
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    for some, want in ((known.where("false"), 0.0), (known.where("toxic = 0"), 0.0), (known.where("toxic = 1"), 1.0)):
        model = T.train(docs, some, F.lit(False), settings=SMALL)
        assert {r["score"] for r in T.score(docs, model).collect()} == {want}
    empty = T.op12(spark, docs.where("false"), known)
    assert empty.collect() == []


def test_held_out_labels_and_copies_do_not_count(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels, LABELS)
    held = crc_mod("doc_id", 5) == 0
    flipped = known.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = [{r["doc_id"]: r["score"] for r in T.op12(spark, docs, x).collect()} for x in (known, flipped)]
    assert one == two
    # copies of a text under many ids are learned once
    more = spark.createDataFrame([(5000 + k, rows[1][1], 0, "x") for k in range(500)], SCHEMA)
    also = spark.createDataFrame([(5000 + k, 0, 0) for k in range(500)], LABELS)
    texts, sizes = T._learned(docs.unionByName(more), known.unionByName(also), F.lit(False), "doc_id", "text", "toxic", 5000)
    assert sizes == {0: 150, 1: 50} and texts.count() == 200
    few, _ = T._learned(docs, known, F.lit(False), "doc_id", "text", "toxic", 20)
    assert few.count() < 80


def test_rising_curve():
    at, height = T.rising_curve(np.arange(8.0), np.array([0, 1, 0, 0, 1, 1, 0.5, 1]), np.ones(8))
    assert np.allclose(at, [0, 0, 1, 3, 4, 6, 7, 7]) and np.allclose(height, [0, 0, 1 / 3, 1 / 3, 2.5 / 3, 2.5 / 3, 1, 1])
