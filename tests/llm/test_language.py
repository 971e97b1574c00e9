"""Held-out accuracy, the two steps, and odd texts."""

from collections import Counter

import numpy as np
import pytest

from curbline.llm import language as L

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.op5(spark, docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert 0.15 < len(held) / len(rows) < 0.35
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_texts_and_repeats(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    schema = "doc_id bigint, text string, lang string, score string, lang_pred int"
    odd = [(9001, None, "en"), (9002, "", None), (9003, "123 !!! \n", "fr"), (None, "the and that", None), (9005, "le la les de " * 50_000, None)]
    odd += [(9006, "der die das", "de")] * 2
    docs = spark.createDataFrame([(*r, "x", 1) for r in odd], schema).unionByName(base, allowMissingColumns=True)
    got = L.op5(spark, docs).where("doc_id > 9000 OR doc_id IS NULL").collect()
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (9001, 9002, 9003)] == ["und"] * 3
    assert by_id[9005]["lang_pred"] == "fr" and by_id[None]["held_out"] is False
    same = [tuple(r) for r in got if r["doc_id"] == 9006]
    assert len(same) == 2 and same[0] == same[1]


@pytest.mark.parametrize("labels, want", [([], "und"), (["en"], "en"), (["xx", "yy"], None)])
def test_few_labels(spark, labels, want):
    docs = spark.createDataFrame(
        [(i * 4 + k, f"{w * 3} {w}", w) for i in range(6) for k, w in enumerate(labels)] + [(1000, "yy", None)],
        "doc_id bigint, text string, lang string",
    )
    model = L.train(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in L.predict(docs, model).collect()}
    assert got[1000] == (want or "yy")


def test_empty_table(spark):
    assert L.op5(spark, spark.createDataFrame([], "doc_id bigint, text string, lang string")).collect() == []


def test_family_first_then_language():
    draw = np.random.default_rng(1)
    centres = {"en": [4, 0, 1, 0], "de": [4, 0, 0, 1], "fr": [0, 4, 1, 0], "es": [0, 4, 0, 1]}
    x = np.vstack([draw.normal(c, 0.1, (50, 4)) for c in centres.values()]).astype(np.float32)
    labels = np.repeat(np.array(list(centres), object), 50)
    model = L.fit(x, labels)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert set(model.machines) == {("germanic", "romance"), ("de", "en"), ("es", "fr")}
    assert list(model.predict(x)[0]) == list(labels)


def test_features_do_not_cross_texts():
    import pyarrow as pa

    texts = ["abc", "", "Ä b", "x" * 5000, "abc"]
    together = np.vstack(list(L.features(pa.array(texts))))
    alone = np.vstack([np.vstack(list(L.features(pa.array([t])))) for t in texts])
    assert np.allclose(together, alone) and np.allclose(together[0], together[4])


def test_sample_is_of_different_texts(spark):
    from pyspark.sql import functions as F

    def drawn(labelled, rows):
        got = L.sample(labelled, rows=rows)
        return Counter((r["_label"], r["_text"]) for r in got.collect()) if got is not None else Counter()

    # A text with most of the rows is one text, and does not push the others out of its language.
    hot = spark.range(30_000).select(F.lit("the same words").alias("text"), F.lit("en").alias("lang"))
    others = spark.range(60).select(F.concat(F.lit("other "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    few = spark.createDataFrame([("der die das", "de"), ("le la les", "fr"), ("12", "xx"), (None, "yy"), ("abc", None)], "text string, lang string")
    labelled = hot.unionByName(others).unionByName(few)
    got = drawn(labelled, 60)
    assert max(got.values()) == 1 and Counter(lang for lang, _ in got) == {"en": 20, "de": 1, "fr": 1}
    assert got == drawn(labelled.repartition(7), 60)
    assert Counter(lang for lang, _ in drawn(labelled, 900)) == {"en": 61, "de": 1, "fr": 1}
    assert Counter(lang for lang, _ in drawn(labelled, 1)) == {"en": 1, "de": 1, "fr": 1}  # more labels than rows
    assert drawn(hot, 6) == {("en", "the same words"): 1}
    assert L.train(hot, rows=6).families == {"germanic": ["en"]}
    assert not drawn(few.where("lang IS NULL"), 6)


def plain_features(text, width):
    """Counts of n-grams one by one."""
    data = [b if b >= 128 or chr(b).isalpha() else 32 for b in bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())]
    x = np.zeros(width)
    for n in (1, 2, 3):
        for k in range(len(data) - n + 1):
            gram = 0
            for b in data[k : k + n]:
                gram = (gram * 257 + b) % (1 << 32)
            x[((gram * 2654435761 + n * 40503) % (1 << 32) >> 16) % width] += 1
    x = np.sqrt(x)
    return x / max(np.sqrt((x * x).sum()), 1e-9)


def test_features_equal_plain_counts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(L, "BLOCK_ROWS", 2)
    texts = ["The cat, 12 Öl!", "", "a", "ab", "żółw i ŻÓŁW", "x" * 300]
    got = np.concatenate(list(L.features(pa.array(texts), 64)))
    assert np.allclose(got, [plain_features(t, 64) for t in texts], atol=1e-6)


def test_machine_reaches_the_least_loss():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(80, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.3 * draw.normal(size=80) > 0, 1.0, -1.0)
    z = np.hstack([x, np.ones((80, 1))])
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())

    def loss(w):
        return 0.5e-3 * w @ w + 10 * (share * np.maximum(0, 1 - y * (z @ w)) ** 2).sum()

    w = np.zeros(6)
    for _ in range(20_000):  # plain gradient steps
        gap = np.maximum(0, 1 - y * (z @ w))
        w = w - 0.01 * (1e-3 * w - 2 * z.T @ (10 * share * y * gap))
    assert loss(L.fit_machine(x, y, rounds=600)) < loss(w) * 1.01 + 1e-4


def test_machine_of_blocks_equals_that_of_all_rows():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(90, 6)).astype(np.float32)
    y = np.where(x[:, 0] > 0, 1.0, -1.0)
    assert np.allclose(L.fit_machine(x, y), L.fit_machine([x[:10], x[10:11], x[11:]], y), atol=1e-4)


def test_fit_does_not_copy_its_rows():
    import tracemalloc

    draw = np.random.default_rng(5)
    labels = np.repeat(np.array(["de", "en", "es", "fr"], object), 500)
    x = draw.random((2000, L.WIDTH), np.float32)
    tracemalloc.start()
    model = L.fit(x, labels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < x.nbytes / 4  # twice x.nbytes before
    back = np.arange(len(x))[::-1]
    other = L.fit(x[back], labels[back])
    assert other.families == model.families and set(other.machines) == set(model.machines)


def test_many_labels_and_their_families(spark):
    draw = np.random.default_rng(9)
    centre = {f"q{k:03d}": draw.normal(size=40) + 8 * np.eye(40)[k % 12] for k in range(100)}
    labels = np.array([lang for lang in centre for _ in range(4)], object)
    x = np.stack([centre[lang] + 0.05 * draw.normal(size=40) for lang in labels]).astype(np.float32)
    model = L.fit(x, labels)
    assert len(model.families) <= 10 and len(model.machines) < 1000
    got, score = model.predict(x)
    assert (np.array(got, object) == labels).mean() > 0.97 and ((score >= 0) & (score <= 1)).all()
    rows = spark.range(L.MOST_LABELS + 5).selectExpr("id as doc_id", "concat('text ', id) as text", "cast(id as string) as lang")
    with pytest.raises(ValueError):
        L.train(rows)
