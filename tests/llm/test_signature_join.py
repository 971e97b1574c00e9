"""Components against all pairs, with hot groups, chains and small limits."""

import itertools
import random
import re

import numpy as np
import pytest

from curbline.llm import signature_join as S
from curbline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id bigint, text string, n int, component_id string"


def shingle_set(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def brute(rows, percent=80, width=5):
    sets = [shingle_set(t, width) for _, t in rows]
    place = list(range(len(rows)))

    def find(x):
        while place[x] != x:
            x = place[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                place[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def changed(draw, words, n):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return words


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    make = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(make(draw.randrange(1, 80))) for _ in range(60)]
    hot, passage = make(100), make(40)
    texts += [" ".join(changed(draw, hot, draw.randrange(0, 4))) for _ in range(120)]  # near copies, some linked only by way of others
    step = make(120)
    for _ in range(25):  # a chain
        step = changed(draw, step, 2)
        texts.append(" ".join(step))
    texts += [" ".join([*passage, *make(draw.randrange(4, 60))]) for _ in range(60)]  # a shared passage
    texts += [" ".join(hot).upper(), "  ".join(hot) + "\n", "one two", "ONE\ttwo", "one two three four", "", " \n", "é è é è é è é"]
    return list(enumerate(texts))


def run(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted((tuple(r)[0:1] + (r["n_shingles"], r["component_id"]) for r in S.join(docs, **more).collect()), key=repr)


@pytest.mark.parametrize("seed, limits", [(1, {}), (2, {"heavy_least": 3}), (3, {"heavy_least": 3, "small": True})])
def test_components_equal_all_pairs(spark, monkeypatch, seed, limits):
    if limits.pop("small", False):
        for name, value in (
            ("BLOCK", 7), ("BLOCK_MEMBERS", 300), ("TREE_ROWS", 40), ("COMPARED", 512), ("PAIRS_A_COPY", 3), ("POSTINGS", 50), ("COUNTED", 100), ("HEAVY_MOST", 5)
        ):
            monkeypatch.setattr(S, name, value)
    rows = corpus(seed) + [(None, None), (None, "one two"), (900, None), (5, "one two"), (7, "one two")]
    rows += [(901, corpus(seed)[70][1])] * 3
    assert run(spark, rows, **limits) == brute(rows)


def test_other_rule(spark):
    rows = corpus(4)
    rule = S.Rule(width=3, percent=60)
    assert run(spark, rows, rule=rule) == brute(rows, 60, 3)


def test_empty_table_and_wordless_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, ""), (None, " ")]) == [(1, 0, 1), (2, 0, 2), (None, 0, None)]
    docs = spark.createDataFrame([(4, "a " * 100_000, 1, "x"), (3, "a " * 99_000, 1, "x")], SCHEMA)
    assert sorted(map(tuple, S.op10(spark, docs).collect())) == [(3, 1, 3), (4, 1, 3)]


@pytest.mark.parametrize("sizes", [(300, 300, 300, 300), (150, 560, 1100, 2300)])
@pytest.mark.parametrize("percent", [80, 45])
def test_tree_loses_no_pair(sizes, percent):
    draw = np.random.default_rng(5)
    rule = S.Rule(percent=percent)
    base = [draw.integers(0, 1 << 60, n).astype(np.uint64) for n in sizes]
    sets = [np.unique(np.concatenate([b[: len(b) - draw.integers(0, len(b) // 5)], draw.integers(0, 1 << 60, 10).astype(np.uint64)])) for b in base for _ in range(15)]
    sets.sort(key=len)
    sizes = np.array([len(s) for s in sets])
    bits = S._signatures(sizes, np.concatenate(sets))
    width = np.array([len(b) for b in bits])
    x, y = S._by_width(bits, sizes, S._spare(bits, sizes), width, np.arange(len(sets)), rule)
    got = set(zip(x.tolist(), y.tolist()))
    want = {
        (a, b) for a, b in itertools.combinations(range(len(sets)), 2)
        if rule.reaches(len(np.intersect1d(sets[a], sets[b])), len(sets[a]) + len(sets[b]))
    }
    assert want <= got and len(got) < len(sets) * (len(sets) - 1) / 2 / 2


def test_components_of_random_links(spark):
    draw = random.Random(8)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(5, 5)] + [(1000, 1000 + k) for k in range(1, 200)]
    place = {}

    def find(x):
        while place.setdefault(x, x) != x:
            x = place[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            place[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in list(place)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("last", [0, 20])
def test_components_by_rounds_and_a_last_task(spark, monkeypatch, last):
    from curbline.llm import components as C

    links = [(k, k + 1) for k in range(0, 60)] + [(500, 500 + k) for k in range(1, 30)] + [(7, 7), (900, 901)]
    monkeypatch.setattr(C, "LAST", last)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(61)} | {500 + k: 500 for k in range(30)} | {900: 900, 901: 900}


def test_few_links_take_few_jobs(spark, monkeypatch):
    from curbline.llm import components as C

    stored = []
    monkeypatch.setattr(C, "cut", lambda frame, cut=C.cut: stored.append(1) or cut(frame))
    links = spark.createDataFrame([(k, k + 1) for k in range(200)], "a bigint, b bigint")
    assert {r["component"] for r in components(links).collect()} == {0}
    assert len(stored) <= 3  # two for each round of halving before


def test_overlaps_are_exact(monkeypatch):
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 400, draw.integers(1, 300)).astype(np.uint64)) for _ in range(30)]
    x, y = draw.integers(0, 30, 200), draw.integers(0, 30, 200)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y)]
    assert S._overlaps(sets, x, y).tolist() == want
    monkeypatch.setattr(S, "COMPARED", 256)
    assert S._overlaps(sets, x, y).tolist() == want
    apart = [np.array([k], np.uint64) for k in range(4)]
    assert S._overlaps(apart, np.array([0, 1]), np.array([2, 3])).tolist() == [0, 0]


def family(draw, members, size, changed):
    base = [f"b{draw.randrange(10**9)}" for _ in range(size)]
    return [" ".join(w if k not in cut else f"n{draw.randrange(10**9)}" for k, w in enumerate(base)) for cut in (set(draw.sample(range(size), changed)) for _ in range(members))]


def test_a_family_below_the_threshold_gives_few_rows(spark, monkeypatch):
    """400 texts, Jaccard about 0.75 for any two: no link, and no rows but links."""
    draw = random.Random(12)
    texts = family(draw, 400, 400, 6) + family(draw, 3, 200, 1)
    rows = []
    across = S._across
    monkeypatch.setattr(S, "_across", lambda *a: (lambda got: (rows.append(got.count()), got)[1])(across(*a)))
    got = run(spark, list(enumerate(texts)))
    assert got == brute(list(enumerate(texts)))
    assert rows and rows[0] < 400
