import random

import numpy as np
import pytest

from curbline.operators import vectors, vocab


def table(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"column string, value {kind}, vector array<double>")


def ask(spark, rows):
    return spark.createDataFrame(rows, "query_id long, column string, vector array<double>")


@pytest.mark.parametrize("block", [4096, 7])
def test_topk_matches_brute_force_with_a_hot_column(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    rnd = np.random.default_rng(1)
    col = lambda i: "hot" if i % 3 else f"c{i % 5}"
    v = [(col(i), i, rnd.normal(size=6).round(2).tolist()) for i in range(60)]
    v.append(("hot", 1000, v[1][2]))  # an exact copy: the smaller value wins
    q = [(i, col(i), rnd.normal(size=6).round(2).tolist()) for i in range(50)] + [(99, "none", [1.0] * 6)]
    got = {(r.query_id, r.place): (r.value, r.score) for r in vectors.topk(ask(spark, q), table(spark, v), 3, 0.5).collect()}
    want = {}
    for qi, c, x in q:
        best = sorted(((-float(np.dot(x, y)), val) for cc, val, y in v if cc == c))[:3]
        want |= {(qi, p + 1): (val, round(-s, 4)) for p, (s, val) in enumerate(best) if -s >= 0.5}
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-4) for k in want)


def test_k_larger_than_the_column(spark):
    v = table(spark, [("c", 1, [1.0, 0.0]), ("c", 2, [0.0, 1.0])])
    assert vectors.topk(ask(spark, [(1, "c", [1.0, 0.5])]), v, 9).count() == 2


def test_unit_length(spark):
    df = spark.createDataFrame([("c", 1, [3.0, 4.0]), ("c", 2, [0.0, 0.0])], "c string, v long, e array<float>")
    got = {r.value: r.vector for r in vectors.vector_table(df, "c", "v", "e").collect()}
    assert got == {1: pytest.approx([0.6, 0.8]), 2: [0.0, 0.0]}


@pytest.mark.parametrize("score, text", [(0.49, "default"), (0.5, "A\n\nmore"), (0.69, "A\n\nmore"), (0.7, "A")])
def test_answer_bands(spark, score, text):
    faqs = spark.createDataFrame([(1, "A")], "id long, answer string")
    row = vectors.faq_answer(ask(spark, [(1, "faq", [score])]), faqs, table(spark, [("faq", 1, [1.0])]), "more", "default").first()
    assert row.answer_text == text


def test_hints_quote_text_only(spark):
    entities = spark.createDataFrame([(1, 1, "n", [1.0]), (1, 2, "none", [1.0]), (1, 3, "n", [0.05])], "request_id long, entity_id long, column string, vector array<double>")
    assert vectors.hints(entities, table(spark, [("n", 7, [1.0])])).first().hints == ["n=7"]
    assert vectors.hints(entities, table(spark, [("n", "x", [1.0])], "string")).first().hints == ["n='x'"]


def test_grounding_keeps_raw_values(spark):
    entities = spark.createDataFrame(
        [(1, "n", "raw1", [1.0]), (2, "n", "raw2", [0.39]), (3, "other", "raw3", [1.0])], "entity_id long, column string, raw string, vector array<double>")
    v = table(spark, [("n", "X", [1.0]), ("other", "Y", [1.0])], "string")
    got = {r.entity_id: r.grounded for r in vectors.ground(entities, v, ["n"]).collect()}
    assert got == {1: "X", 2: "raw2", 3: "raw3"}


def test_accuracy_needs_every_key(spark):
    cols = "case_id long, key string, value string"
    gold = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (3, "a", "x")], cols)
    got = spark.createDataFrame([(1, "a", "x"), (1, "b", "no"), (2, "a", "x"), (2, "extra", "z")], cols)
    row = vectors.retrieval_accuracy(got, gold).first()
    assert (row.n_cases, row.n_passed) == (3, 1) and row.accuracy_pct == pytest.approx(100 / 3)


def test_vocabulary_synonyms_win(spark):
    official = spark.createDataFrame([("c", "GRN"), ("c", "ALL")], "column string, value string")
    synonyms = spark.createDataFrame([("c", "green", "GRNi"), ("c", "GRN", "GRNi")], "column string, phrase string, value string")
    words = vocab.vocabulary(official, synonyms)
    assert {(r.phrase, r.value) for r in words.collect()} == {("GRN", "GRNi"), ("ALL", "ALL"), ("green", "GRNi")}
    df = spark.createDataFrame([("green",), ("blue",), (None,)], "c string")
    assert [r.out for r in vocab.canonicalise(df, words, "c", "out").orderBy("c").collect()] == [None, "blue", "GRNi"]


def test_keyword_search(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choices(["tree", "Road", "light", "\n"], k=6))) for i in range(40)]
    index = vocab.token_index(spark.createDataFrame(docs, "id long, t string"), "id", ["t"])
    got = {r.id for r in vocab.search(index, "id", ["Tree", "road"]).collect()}
    assert got == {i for i, t in docs if {"tree", "road"} <= set(t.lower().split())}
