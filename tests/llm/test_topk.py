"""Exact scores and ties against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from curbline.llm import topk as K

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string"


def brute(rows, k=5, every=50):
    def whole(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]

    good = [(i, whole(v)) for i, v in rows if i is not None and whole(v) is not None]
    asks = {}
    for (i, q), (_, v) in zip(good, [r for r in rows if r[0] is not None and whole(r[1]) is not None]):
        if i % every == 0 and (i not in asks or v < asks[i][1]):
            asks[i] = (q, v)
    out = []
    for i, (q, _) in asks.items():
        scored = sorted(((sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i), key=lambda s: (-s[0], s[1]))
        out += [(i, r, j, s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows):
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    got = K.op8(spark, frame)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


def test_ties_nulls_and_odd_vectors(spark):
    draw = random.Random(2)
    rows = [(i, [draw.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(6)]) for i in range(260)]
    rows += [
        (300, None), (350, [1.0, None]), (400, [float("nan")] * 6), (450, [float("inf")] + [0.0] * 5), (500, []),
        (550, [1.0, 2.0]), (None, [1.0] * 6), (600, [0.0] * 6), (-50, [0.25] * 9), (7, [1.0] * 6), (7, [1.0] * 6), (50, rows[50][1]),
    ]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("wide, block", [(1, 8), (1 << 20, 1 << 22)])
def test_block_sizes_do_not_matter(spark, monkeypatch, wide, block):
    monkeypatch.setattr(K, "CANDIDATE_BLOCK", block * 8)
    monkeypatch.setattr(K, "QUERY_BLOCK", wide * 8)
    draw = random.Random(4)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(8)]) for i in range(150)]
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    floats = [(r["vec_id"], list(r["embedding"])) for r in frame.collect()]
    got = sorted(map(tuple, K.search(frame, F.col("vec_id") % 25 == 0).collect()))
    assert got == brute(floats, every=25)


def test_few_rows_and_huge_values(spark):
    assert run(spark, [(50, [1.0])]) == []
    assert run(spark, [(50, [1.0]), (1, [2.0])]) == [(50, 1, 1, 131072)]
    assert run(spark, [(50, [1e30]), (1, [1e30]), (2, [2e30])]) == [(50, 1, 1, 2**63 - 1), (50, 2, 2, 2**63 - 1)]
    assert run(spark, []) == []
