"""Groups of equal texts, with and without fingerprint collisions."""

import hashlib
import random

import numpy as np
import pytest

from curbline.llm import fingerprints as P


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(-1 if i is None else i)
    out = []
    for t, ids in groups.items():
        keep = max(ids)
        for k, i in enumerate(sorted(ids)):
            out.append((
                None if i < 0 else i, None if keep < 0 else keep, len(ids), k == len(ids) - 1, hashlib.sha256(t.encode()).hexdigest(),
            ))
    return sorted(out, key=repr)


@pytest.mark.parametrize("moduli, chunk", [(P.MODULI, P.CHUNK), (P.MODULI, 8), (((5, 2), (3, 2)), 4)])
def test_groups_equal_brute_force(spark, moduli, chunk):
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab\0é ") for _ in range(draw.randrange(12))) for _ in range(60)]
    rows = [(i, draw.choice(texts)) for i in range(300)] + [(300, None), (301, ""), (None, "ab"), (7, "dup"), (7, "dup"), (302, "x" * 300_000)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, kept string")
    got = P.exact_dedup(docs, moduli=moduli, chunk=chunk)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_chunks_sum_to_the_whole():
    data = np.frombuffer(random.Random(1).randbytes(1000), np.uint8)
    whole = P.Hasher(chunk=1 << 10).total(data)
    assert P.Hasher(chunk=64).total(data) == whole
    parts = [P.Hasher(chunk=64).shifted(data[a : a + 64], max(0, 1000 - a - 64)) for a in range(0, 1000, 64)]
    assert tuple(sum(p[k] for p in parts[::-1]) % m for k, (m, _) in enumerate(P.MODULI)) == whole
    plain = 0
    for b in data.tolist():
        plain = (plain * P.MODULI[0][1] + b + 1) % P.MODULI[0][0]
    assert plain == whole[0]


def test_empty_table(spark):
    assert P.op2(spark, spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_rows_of_a_hot_class_are_spread(spark, monkeypatch):
    from pyspark.sql import functions as F

    from curbline.llm import fingerprints

    seen, attach = [], fingerprints.attach

    def watched(rows, groups, key, size, total, salt, merge=False):
        if merge:
            most = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64(*salt)).alias("salts"))
            seen.extend((r["n"], r["salts"]) for r in most.collect())
        return attach(rows, groups, key, size, total, salt, merge)

    monkeypatch.setattr(fingerprints, "attach", watched)
    docs = spark.createDataFrame([(None if i % 3 else 5, "hot text") for i in range(300)] + [(i, f"t{i}") for i in range(600)], "doc_id bigint, text string")
    got = fingerprints.exact_dedup(docs).collect()
    assert max(n for n, _ in seen) == 300 and all(n == salts for n, salts in seen)
    assert len(got) == 900 and sum(r["kept"] for r in got) == 601
