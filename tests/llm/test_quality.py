"""Held-out ranking, the fit, the curve, and odd rows."""

import numpy as np

from curbline.llm import quality as Q
from curbline.llm.text_arrays import Words, parts

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_ranking(spark):
    docs, labels = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]
    got = Q.op9(spark, docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["score"], quality[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and quality.get(r["doc_id"]) is not None]
    s, y, p = np.array(held).T
    assert auc(s, y) > 0.93 and (p == y).mean() > 0.93


def test_labels_of_held_out_rows_are_not_used(spark):
    from pyspark.sql import functions as F

    from curbline.llm.common import crc_mod

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(crc_mod("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = [{r["doc_id"]: round(r["score"], 9) for r in Q.op9(spark, docs, x).collect()} for x in (labels, flipped)]
    assert one == two


def test_odd_rows(spark):
    schema, label = "doc_id bigint, text string, quality int, score string", "doc_id bigint, quality int, toxic int"
    docs = spark.createDataFrame(
        [(i, "fine words in a row." if i % 2 else "#### $$$$", 0, "x") for i in range(60)]
        + [(100, None, 0, "x"), (101, "", 0, "x"), (None, "text", 0, "x"), (102, "w " * 100_000, 0, "x"), (3, "fine words in a row.", 0, "x")],
        schema,
    )
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(60)] + [(3, 1, 0), (100, None, 0), (None, 1, 0), (101, 7, 0)], label
    )
    got = Q.op9(spark, docs, labels).collect()
    assert len(got) == 65 and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[1] > 0.7 > 0.3 > score[0]
    assert {r["score"] for r in Q.op9(spark, docs, labels.where("false")).collect()} == {0.5}
    assert Q.op9(spark, docs.where("false"), labels).collect() == []
    one = Q.op9(spark, docs, labels.where("quality = 1")).collect()
    assert all(r["predicted"] == 1 for r in one if r["doc_id"] in (1, 5))


def test_isotonic_is_the_best_rising_curve():
    x = np.arange(8.0)
    centre, height = Q.isotonic(x, np.array([0, 1, 0, 0, 1, 1, 0.5, 1]), np.ones(8))
    assert (np.diff(height) > 0).all()
    assert np.allclose(height, [0, 1 / 3, 2.5 / 3, 1]) and np.allclose(centre, [0, 2, 5, 7])


def test_statistics_of_texts_together_and_alone():
    import pyarrow as pa

    texts = ["One two, two!", "", "LOUD NOISE\nLOUD NOISE\n", "  ", "é ü 12 $$", "x" * 4000]
    words = Words()
    together = np.vstack([Q.statistics(words, d, o) for _, _, d, o in parts(pa.array(texts))])
    alone = np.vstack([Q.statistics(words, d, o) for t in texts for _, _, d, o in parts(pa.array([t]))])
    assert together.shape[1] == Q.N_STATISTICS and np.allclose(together, alone) and np.isfinite(together).all()
    assert together[2, -2] == 0.5  # one of two lines is a repeat


def test_kernel_is_near_gaussian():
    x = np.random.default_rng(1).normal(size=(40, Q.N_STATISTICS))
    z = Q._fourier(x, np.zeros(Q.N_STATISTICS), np.ones(Q.N_STATISTICS), 8192)[:, :-1]
    true = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * Q.KERNEL**2))
    assert np.abs(z @ z.T - true).max() < 0.1


SPACES = b" \t\n\x0b\x0c\r"


def plain_statistics(text):
    """The statistics with loops over bytes and lists of words."""
    import re
    from collections import Counter

    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    groups = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*+<=>@\\^_`{|}~/", b"!?.", b"\"'(),-:;[]"]
    shares = [sum(b in g for b in data) for g in groups] + [sum(b > 127 for b in data)]
    n, size = len(words), len(data)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / max(n, 1)
    spread = max(sum(k * k for k in lengths) / max(n, 1) - mean * mean, 0) ** 0.5
    loud = sum(sum(65 <= b <= 90 for b in w) > 1 and not any(97 <= b <= 122 for b in w) for w in words)
    marked = sum(w[-1] in groups[3] for w in words)
    counts = Counter(words)
    lines = data.count(b"\n") + (size > 0)
    # Lines are told apart by the words on them, in any order.
    full = [tuple(sorted(ws)) for ws in (re.findall(rb"[^\x20\x09-\x0D]+", line) for line in data.split(b"\n")) if ws]
    return [
        np.log1p(size), np.log1p(n), *[s / max(size, 1) for s in shares], mean, spread, loud / max(n, 1), marked / max(n, 1),
        len(counts) / max(n, 1), np.log1p(len(counts)) / np.log1p(max(n, 1)), max(counts.values(), default=0) / max(n, 1),
        np.log1p(lines), (len(full) - len(set(full))) / max(len(full), 1), min(n / max(lines, 1), 200) / 200,
    ]


def test_statistics_equal_plain_loops():
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    draw = random.Random(4)
    alphabet = "aB9 \n\t.!#/é漢\r\x0b\U0001f600-x"
    texts = ["", None, "\n", "A\n\nb A\nA b", *["".join(draw.choices(alphabet, k=draw.randrange(200))) for _ in range(300)]]
    texts += pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()[:150]
    words = Words()
    got = np.vstack([Q.statistics(words, d, o) for _, _, d, o in parts(pa.array([t or "" for t in texts]))])
    assert np.allclose(got, [plain_statistics(t) for t in texts])


def test_fit_and_score_equal_a_plain_fit(spark):
    """Statistics in loops, one dense matrix, one solve, one curve over cells, without Spark."""
    import random
    import zlib

    from pyspark.sql import functions as F

    draw, features = random.Random(2), 16
    texts = {i: " ".join(draw.choices(["word", "Two", "##", "9", "END.", "é"], weights=[i % 5 + 1, 2, 5 - i % 5, 1, 1, 1], k=draw.randrange(3, 40))) for i in range(400)}
    label = {i: int(draw.random() < (0.8 if i % 5 > 2 else 0.2)) for i in texts}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in texts}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    labels = spark.createDataFrame(list(label.items()), "doc_id bigint, quality int")
    ids = docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(Q.SEED)), F.lit(Q.CALIBRATE)) == 0).alias("part")).collect()
    part = {r["doc_id"]: r["part"] for r in ids}
    from curbline.llm.common import crc_mod

    got = {r["doc_id"]: r["score"] for r in Q.classify(docs, labels, crc_mod("doc_id", 3) == 1, features=features).collect()}

    x = np.array([plain_statistics(texts[i]) for i in texts])
    y = np.array([label[i] for i in texts], float)
    known = np.array([not held[i] for i in texts])
    check = known & np.array([part[i] for i in texts])
    fit = known & ~check
    mean, std = x[known].mean(0), np.maximum(x[known].std(0), 1e-9)
    z = Q._fourier(x, mean, std, features)
    ridge = Q.RIDGE * fit.sum() * np.eye(features + 1)
    ridge[-1, -1] = 1e-9
    raw = z @ np.linalg.solve(z[fit].T @ z[fit] + ridge, z[fit].T @ y[fit])
    cell = np.clip(np.floor((raw + 0.5) * Q.CELLS / 2), 0, Q.CELLS - 1)
    cells = [(raw[check & (cell == c)].mean(), y[check & (cell == c)].mean(), (check & (cell == c)).sum()) for c in np.unique(cell[check])]
    centre, height = Q.isotonic(*map(np.array, zip(*cells)))
    want = 0.999 * np.interp(raw, centre, height) + 0.001 / (1 + np.exp(-raw))
    assert np.allclose([got[i] for i in texts], np.clip(want, 0, 1), atol=1e-6)
