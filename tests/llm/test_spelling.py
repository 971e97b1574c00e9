"""Groups against all pairs, the trie against a plain search, counts against a plain loop."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from curbline.llm import spelling as S

SCHEMA = "doc_id bigint, text string, n int, word string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
TINY = S.Split(least=5, parts=1 << 30, rows=40)


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_counts(rows, drop=31):
    out = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if drop and h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 2}


def brute(counts, times=10):
    # candidates share a word with one letter taken out; near() decides
    by_hole = defaultdict(set)
    for w in counts:
        for v in {w, *[w[:k] + w[k + 1 :] for k in range(len(w))]}:
            by_hole[v].add(w)
    partners = defaultdict(set)
    for ws in by_hole.values():
        for a in ws:
            partners[a] |= {b for b in ws if near(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(partners[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(partners[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def variants(draw, n_words, letters="abcdeflnorstuzéß×É"):
    counts = {}
    for _ in range(n_words):
        w = "".join(draw.choice(letters) for _ in range(draw.randrange(7, 14)))
        counts[w] = draw.choice([2, 5, 30, 400, 5000])
        for _ in range(draw.randrange(0, 12)):
            k = draw.randrange(len(w))
            v = draw.choice([w[:k] + w[k + 1 :], w[:k] + draw.choice(letters) + w[k:], w[:k] + draw.choice(letters) + w[k + 1 :]])
            if len(v) >= 7:
                counts.setdefault(v, draw.choice([2, 3, 40]))
    return counts


def grouped(spark, counts, split):
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    return sorted((tuple(r) for r in S.group(words, split=split).collect()), key=repr)


@pytest.mark.parametrize("seed, split", [(1, S.Split()), (2, TINY), (3, S.Split(least=1, parts=1 << 30, rows=7))])
def test_groups_equal_all_pairs(spark, monkeypatch, seed, split):
    if seed > 1:
        for name, value in (("SEARCHED", 11), ("PAIRS", 13), ("COMPARED", 60)):
            monkeypatch.setattr(S, name, value)
    counts = variants(random.Random(seed), 120)
    counts |= {"a" * 300: 9, "a" * 301: 90, "a" * 256 + "b": 3, "a" * 257: 30, "a" * 255: 300, "a" * 256: 4000, "b" * 255 + "c": 2, "b" * 255 + "d": 20}
    # words of the same letters (and near ones of those), and of letters of one group
    draw = random.Random(11)
    for _ in range(40):
        w = draw.sample("abcdefz", 7)
        counts["".join(w)] = draw.choice([2, 30, 400])
        counts["".join(w).translate(str.maketrans(draw.choice(["az", "za", "ea"]), "za"))] = 5
        counts["".join(w) + "z"] = 7
    counts |= {"abcdefgh": 4, "abcdefhg": 8, "azzzzzz": 4, "zzzzzzz": 40, "aazzzzz": 400}
    assert grouped(spark, counts, split) == brute(counts)


def test_trie_reaches_what_the_budget_allows():
    draw = np.random.default_rng(4)
    vectors = draw.integers(0, 3, (300, S.LEVELS)).astype(np.uint8)
    vectors[:, 5:] = 1
    vectors[:4] = [[255] * S.LEVELS, [254] + [255] * (S.LEVELS - 1), [0] * S.LEVELS, [255] + [0] * (S.LEVELS - 1)]
    trie = S.Trie(vectors)
    got = set()
    for q, leaf, spent in trie.search(vectors):
        for a, x, s in zip(q.tolist(), leaf.tolist(), spent.tolist()):
            for b in trie.order[trie.first[x] : trie.first[x + 1]].tolist():
                assert (a, b) not in got
                got.add((a, b))
    want = set()
    for a in range(300):
        for b in range(300):
            d = vectors[b].astype(int) - vectors[a]
            nonzero = d[d != 0].tolist()
            if nonzero in ([], [1], [1, -1]):
                want.add((a, b))
    assert got == want


def test_each_reached_subtrie_is_asked():
    draw = random.Random(6)
    counts = list(variants(draw, 200))
    vectors = S._prefix(S.Letters(counts).vectors())
    nodes = Counter(v[:d] for v in vectors for d in range(S.LEVELS))
    heavy = {x: 1 for x, n in nodes.items() if n > 3 and len(x) < S.LEVELS}
    place = [S._subtrie(v, heavy) for v in vectors]
    asked = [{p, *S._reached(v, heavy)} for p, v in zip(place, vectors)]
    for a in range(len(counts)):
        for b in range(a):
            if near(counts[a], counts[b]):
                assert place[b] in asked[a] or place[a] in asked[b]
    assert max(len(x) for x in asked) < 1 + 2 * S.LEVELS**2


def test_counts_equal_plain_ones(spark, monkeypatch):
    for name, value in (("COUNTED", 20), ("PIECE", 64)):
        monkeypatch.setattr(S, name, value)
    draw = random.Random(9)
    base = ["reading", "Readings", "BÉTONNER", "straßenbahn", "x×y÷zabc", "ordinary", "words", "naıvely", "İstanbul", "a" * 200]
    rows = [(k, " ".join(draw.choice(base) + draw.choice(["", ".", "-", "2"]) for _ in range(60))) for k in range(60)]
    rows += [(None, None), (None, "reading reading"), (3, ""), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = {r["word"]: r["n"] for r in S.word_counts(docs, drop=31).where("n >= 2").collect()}
    assert got == plain_counts(rows) and len(got) > 10
    assert {tuple(r) for r in S.word_counts(docs).where("n >= 2").collect()} == set(plain_counts(rows, drop=0).items())


def test_whole_small_table_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute(plain_counts([(r["doc_id"], r["text"]) for r in docs.collect()]))
    got = S.op13(spark, docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert [t for _, t in got.dtypes] == ["string"] * 3 + ["bigint"] * 3
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_chain_of_forms_and_empty_tables(spark):
    chain = {"aaaaaaa": 2, "aaaaaaab": 20, "aaaaaaabc": 200, "aaaaaaabcd": 2000, "aaaaaaabcde": 19_999, "zzzzzzzz": 5}
    got = {r["word"]: (r["form"], r["root"]) for r in S.group(spark.createDataFrame(list(chain.items()), "word string, n bigint")).collect()}
    assert got["aaaaaaa"] == ("aaaaaaab", "aaaaaaabcd") and got["aaaaaaabcd"] == (None, "aaaaaaabcd") and got["zzzzzzzz"] == (None, "zzzzzzzz")
    docs = spark.createDataFrame([(1, None, 1, "x"), (2, "short on 1234567", 1, "x")], SCHEMA)
    assert S.op13(spark, docs).collect() == [] and S.op13(spark, docs.where("false")).collect() == []


def test_long_text_and_long_word(spark):
    docs = spark.createDataFrame([(1, "spelling " * 300_000 + "y" * 3_000_000 + " " + "y" * 3_000_000, 1, "x")], SCHEMA)
    rows = {r["word"]: r["n"] for r in S.group(S.word_counts(docs).where("n >= 2")).collect()}
    assert rows == {"spelling": 300_000, "y" * 3_000_000: 2}
