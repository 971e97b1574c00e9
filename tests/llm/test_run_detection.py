"""Runs against brute force: hand-made, random and periodic texts, every scale."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from curbline.llm import run_detection as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, start int, _text string"


def brute_runs(w, least=6, times=4):
    n, found = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if length >= max(least, times * q):
                found.setdefault((s, length), q)  # smallest period first
    return sorted((s, n, q) for (s, n), q in found.items())


def brute(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(w)
    best = (None,) * 4
    if found:
        s, m, q = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, m, q, 1000 * m // q)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(left))


def ids(w):
    names = {x: k for k, x in enumerate(dict.fromkeys(w))}
    return R.mix(np.array([names[x] + 1 for x in w], np.uint64))


def periodic(draw, letters):
    out = []
    for _ in range(draw.randrange(1, 5)):
        out += [draw.choice(letters) for _ in range(draw.randrange(0, 12))]
        unit = [draw.choice(letters) for _ in range(draw.randrange(1, 90))]
        m = draw.randrange(1, 7 * len(unit))
        out += (unit * 8)[:m]
    return out


@pytest.mark.parametrize("letters, direct", [("ab", 16), ("abc", 1), ([f"w{k}" for k in range(50)], 4), ("abcdefgh", 16)])
def test_runs_equal_brute_force(monkeypatch, letters, direct):
    monkeypatch.setattr(R, "DIRECT", direct)
    draw = random.Random(len(letters) + direct)
    for _ in range(150):
        w = periodic(draw, letters)
        assert [tuple(r) for r in R.runs(ids(w), len(w)).tolist()] == brute_runs(w)


def test_powers_fibonacci_and_thue_morse():
    fib, old = "a", "b"
    while len(fib) < 1500:
        fib, old = fib + old, fib
    thue = "a"
    for _ in range(9):
        thue += thue.translate(str.maketrans("ab", "ba"))
    for w in ("a" * 700, "ab" * 300 + "a", "abcab" * 120, fib, thue, (thue + "c") * 4, ("a" * 40 + "b") * 5, ("ab" * 30 + "c") * 4 + "a" * 9):
        assert [tuple(r) for r in R.runs(ids(w), len(w)).tolist()] == brute_runs(w)


@pytest.mark.parametrize("period", [2, 15, 16, 17, 31, 32, 33, 63, 64, 65, 127, 128, 129, 500, 1024, 1025])
def test_four_periods_are_enough(period):
    draw = random.Random(period)
    unit = [str(draw.randrange(10**6)) for _ in range(period)]
    w = ["x", *(unit * 4), "y", "z"]
    length = max(6, 4 * period)
    want = [(1, 4 * period, period)] if 4 * period >= length else []
    assert [tuple(r) for r in R.runs(ids(w), len(w)).tolist()] == want
    short = ["x", *(unit * 4)[:-1], "y"]
    assert R.runs(ids(short), len(short)).tolist() == []


def test_rows_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 7)
    draw = random.Random(3)
    texts = [" ".join(periodic(draw, "abcd")) for _ in range(200)]
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)]
    rows += [(900, None, 1, "x"), (901, "", 1, "x"), (902, " \t\n", 1, "x"), (None, "a b " * 9, 1, "x"), (5, texts[5], 1, "x"), (903, "é  è\x0bé\r\nè " * 4, 1, "x"), (904, "A a " * 5, 1, "x"), (905, "a b c " * 6, 1, "x")]
    changed = [k for k in range(1000, 3000) if zlib.crc32(str(k).encode()) % 10 == 0][:60]
    rows += [(k, " ".join(str(draw.randrange(1000)) for _ in range(draw.randrange(0, 400))), 1, "x") for k in changed]
    got = [tuple(r) for r in R.op11(spark, spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted((brute(k, t) for k, t, *_ in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 150


def test_whole_small_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in R.op11(spark, docs).collect())
    assert got == sorted(brute(r["doc_id"], r["text"]) for r in docs.collect())


def test_empty_table_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "w " * 400_000, 0, ""), (2, " ".join(str(k % 5000) for k in range(60_000)), 0, "")], SCHEMA)
    assert R.detect(docs.where("false")).collect() == []
    one, two = sorted(map(tuple, R.detect(docs).collect()))
    assert one[:6] == (1, 1, 0, 400_000, 1, 400_000_000) and two[:6] == (2, 1, 0, 60_000, 5000, 12_000)
    assert one[7] == hashlib.sha256(b"w").hexdigest()
    with pytest.raises(ValueError):
        R.detect(docs, rule=R.Rule(times=3))
