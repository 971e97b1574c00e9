"""Pieces, ids and packing against plain loops."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from curbline.llm import packing as K

SCHEMA = "doc_id bigint, text string, length string, sequence_id int"


@pytest.fixture(scope="module")
def tokenizer():
    return K.Encoder(K.vocabulary())


def ids_of(tokenizer, text):
    return tokenizer.tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_tokenizers(tokenizer):
    draw = random.Random(1)
    texts = [
        "", " ", "'", "it's 'tis don't I'LL  we'll''s x's\n\n a\tb  c \n", "a b  c²½ ŉ日本 <|endoftext|> x", " ''s' s",
        "a\x1cb", "it'sé 'é 're5", "\r\n\r\n x  \n", "×÷ a", "x" * 3000, "\x00", "“quoted” text",
    ]
    texts += ["".join(draw.choice("a'sdtrevml 5\n\t.é ß-Zſ") for _ in range(draw.randrange(40))) for _ in range(3000)]
    texts += ["".join(draw.choice("a 's5\n«²日×") for _ in range(12)) for _ in range(300)]
    got = list(tokenizer.encode(pa.array(texts)))
    for t, g in zip(texts, got, strict=True):
        assert g.tolist() == ids_of(tokenizer, t), repr(t)


def test_remembered_words_are_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED", 3)
    texts = ["one two three four", "five six", "one two"]
    for t in texts:
        assert next(tokenizer.encode(pa.array([t]))).tolist() == ids_of(tokenizer, t)


def test_pack_of_whole_documents(spark, tokenizer):
    draw = random.Random(2)
    texts = [" ".join(draw.choice(["alpha", "beta", "gamma,"]) for _ in range(draw.randrange(1, 900))) for _ in range(200)]
    texts += [None, "", "word " * 12_000, " ".join(["a"] * 1023), " ".join(["a"] * 1024), "日本語 " * 50]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, "no id")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = K.op7(spark, docs)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = got.collect()
    want = []
    for i, t in rows:
        ids = [*ids_of(tokenizer, t or ""), 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(w[3] for w in want) // 1024)
    assert len(bins) <= 1.02 * least + 1


def test_empty_table(spark):
    assert K.op7(spark, spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_every_limit_holds(by):
    draw = np.random.default_rng(3)
    lengths = draw.integers(1, 100, 2000)
    limits = K.Limits(tokens=128, documents=4, cost=6000 if by == "dot" else 10_000, by=by)
    lengths = lengths[lengths**2 <= limits.cost]
    bins, offsets = K.best_fit(lengths, limits)
    for b in np.unique(bins):
        here = lengths[bins == b]
        assert here.sum() <= 128 and len(here) <= 4 and (here**2).sum() <= limits.cost
        order = np.argsort(offsets[bins == b])
        assert (offsets[bins == b][order] == np.cumsum(here[order]) - here[order]).all()


def test_packing_is_near_the_bound():
    lengths = np.random.default_rng(4).integers(1, 1024, 8000)
    bins, _ = K.best_fit(lengths, K.Limits())
    assert bins.max() + 1 <= 1.01 * lengths.sum() / 1024


def test_limits_bind_in_the_job(spark):
    rows = spark.createDataFrame([(i, 10 + i % 90) for i in range(500)], "doc_id bigint, length bigint")
    got = K.pack(rows, K.Limits(tokens=128, documents=2, cost=128 * 128), group=64).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append(r["length"])
    assert len(got) == 500 and all(len(b) <= 2 and sum(b) <= 128 for b in bins.values())
    with pytest.raises(Exception, match="over the limits"):
        K.pack(rows, K.Limits(tokens=128, cost=50)).collect()
