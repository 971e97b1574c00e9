"""Targets against plain resharing; what a mix takes; the splitting tree."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from curbline.llm import mixing as M
from curbline.session import cut
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, size string, target int"


def plain_targets(sizes):
    """Share by weight; cap; share the excess among the others; until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= set(over)
    return target


def check(rows, got):
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sizes = Counter()
    for (_, _, s), n in zip(rows, size):
        sizes[s] += n
    want = plain_targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, n) for (i, _, _), n in zip(rows, size))
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        copies = [tuple(map(int, c.split(":"))) for c in r["shards"].split(",") if c]
        assert sum(c[2] for c in copies) == r["taken"] and len({c[1] for c in copies}) == len(copies) <= 3
        assert all(c[2] <= r["size"] and 0 <= c[0] < M.LEAST_SHARDS for c in copies)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6


def test_mix_of_hot_small_and_empty_sources(spark):
    draw = random.Random(6)
    rows = [(i, " ".join(["w"] * draw.randrange(0, 30)), "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(600)]
    rows += [(1000, None, "hot"), (1001, "a b\x0bc", None), (1002, "", "void"), (1003, " ".join("x" * 3000), "z"), (1004, "x y", "\U0001f600"), (1005, "q r", "￮")]
    rows += [(1006, "same same", "z")] * 3
    docs = spark.createDataFrame([(*r, "e", 1) for r in rows], SCHEMA)
    got = M.op6(spark, docs).collect()
    check(rows, got)
    again = M.op6(spark, docs.orderBy("text").repartition(7)).collect()  # however the rows are stored
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_hot_source_of_many_sources(spark):
    rows = [(i, "a b c", f"s{i}" if i % 3 else "hot") for i in range(3000)]
    check(rows, M.op6(spark, spark.createDataFrame([(*r, "e", 1) for r in rows], SCHEMA)).collect())


def test_empty_table_and_no_words(spark):
    assert M.op6(spark, spark.createDataFrame([], SCHEMA)).collect() == []
    got = M.op6(spark, spark.createDataFrame([(1, " ", "s", "x", 1)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0.0, 0, "")]


def test_every_block_goes_to_one_shard(spark):
    quotas = spark.createDataFrame([("=a", 1000), ("=b", 1), ("=c", 37), ("=d", 0)], "_key string, _blocks bigint")
    rows = M.allocate(quotas, 8).collect()
    by_key, by_shard = defaultdict(list), Counter()
    for r in rows:
        by_key[r["_key"]].append(r["_block"])
        by_shard[r["shard"]] += 1
    assert {k: sorted(v) for k, v in by_key.items()} == {"=a": list(range(1000)), "=b": [0], "=c": list(range(37))}
    assert max(by_shard.values()) - min(by_shard.values()) <= 8


def test_tree_keeps_quotas_and_draws_as_expected():
    quotas = np.array([600, 300, 0, 60])
    first = np.mean([M._tree(quotas, 4, seed)[0] for seed in range(200)], axis=0)
    assert (M._tree(quotas, 4, 1).sum(axis=0) == quotas).all() and np.allclose(first, quotas / 4, rtol=0.1)


def test_copies_stay_within_shards(spark):
    rows = cut(spark.range(2000).select(F.col("id").alias("_row"), F.lit("s").alias("_source"), F.lit(10).cast("bigint").alias("_size"), F.xxhash64("id").alias("_draw")))
    known, drawn = M.mix(rows, weights=(1,), block_words=100, least_shards=4)
    got = drawn.groupBy("shard").agg(F.sum("words").alias("w")).collect()
    assert len(got) == 4 and sum(r["w"] for r in got) == 20_000 and max(r["w"] for r in got) <= 5200


def test_first_words(spark):
    frame = spark.createDataFrame([("  a b\tc ", 2), ("a", None), (None, 1), ("é ü", 1)], "t string, n bigint")
    got = [r[0] for r in frame.select(M.first_words(F.col("t"), F.col("n"))).collect()]
    assert got == ["  a b", "a", None, "é"]


def test_many_sources_are_split_in_chunks(spark):
    blocks = {f"={k:03}": k % 7 + 1 for k in range(200)}
    quotas = spark.createDataFrame(list(blocks.items()), "_key string, _blocks bigint")
    one, many = (M.allocate(quotas, 8, at_once=n) for n in (1000, 20))
    for got in (one.collect(), many.collect()):
        shards = Counter(r["shard"] for r in got)
        assert max(shards.values()) - min(shards.values()) <= 3
        held = defaultdict(list)
        for r in got:
            held[r["_key"]].append(r["_block"])
        assert {k: sorted(v) for k, v in held.items()} == {k: list(range(n)) for k, n in blocks.items()}
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, M.allocate(quotas.repartition(3), 8, at_once=20).collect()))
    # No task splits more than its chunk: the sources of a group as the plan deals them.
    dealt = quotas.groupBy(F.pmod(F.xxhash64("_key", F.lit(M.SEED)), F.lit(10))).count()
    assert dealt.agg(F.max("count")).first()[0] < 50
    # With the sizes given, rows and columns add up.
    by_source, given = np.array([3, 5, 9]), np.array([4, 4, 4, 5])
    drawn = M._tree(by_source, 4, [1, 2], given)
    assert (drawn.sum(axis=0) == by_source).all() and (drawn.sum(axis=1) == given).all()


def test_shards_hold_what_the_tree_drew(spark):
    draw = random.Random(8)
    rows = [(i, " ".join(["w"] * draw.randrange(1, 60)), f"s{i % 5}" if i % 3 else "hot") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    stored = cut(docs.select(F.col("doc_id").alias("_row"), F.col("source").alias("_source"), M.n_words("text").alias("_size"), F.xxhash64("doc_id").alias("_draw")))
    known, drawn = M.mix(stored, block_words=50, least_shards=8)
    words, epochs = Counter(), defaultdict(set)
    for r in drawn.join(known.select("_row", "_key"), "_row").collect():
        words[r["_key"], r["shard"]] += r["words"]
        assert r["epoch"] not in epochs[r["_row"]]  # a copy lies in one shard
        epochs[r["_row"]].add(r["epoch"])
    quotas = known.groupBy("_key").agg(F.ceil(F.floor(F.max("_target") + 0.5) / 50).alias("_blocks"))
    blocks = Counter((r["_key"], r["shard"]) for r in M.allocate(quotas, 8).collect())
    assert {k for k in words} <= {k for k in blocks}
    for k, n in blocks.items():  # a document belongs to the block it begins in, so a block's words differ by a document
        assert abs(words[k] - 50 * n) <= 60 * n + 50
    whole = sum(words.values())
    assert all(abs(sum(n for (_, s), n in words.items() if s == shard) - whole / 8) < 0.2 * whole / 8 for shard in range(8))


def test_many_shards_are_drawn_in_tiers(spark):
    shards = 100_000
    blocks = {f"={k:02}": 1 + k * k * 10 for k in range(50)} | {"=hot": 200_000}
    quotas = spark.createDataFrame(list(blocks.items()), "_key string, _blocks bigint")
    rows = cut(M.allocate(quotas, shards))
    held = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    want = M._even(sum(blocks.values()), 0, shards)
    assert [held.get(s, 0) for s in range(shards)] == want.tolist()
    got = {r["_key"]: (r["n"], r["d"], r["a"], r["z"]) for r in rows.groupBy("_key").agg(
        F.count("*").alias("n"), F.count_distinct("_block").alias("d"), F.min("_block").alias("a"), F.max("_block").alias("z")
    ).collect()}
    assert got == {k: (n, n, 0, n - 1) for k, n in blocks.items()}
    # The hot source fills its share of any part of the shards.
    part = rows.where("shard < 25000 AND _key = '=hot'").count()
    assert abs(part - 50_000) < 1_000


def test_tiers_draw_the_same_tree(spark):
    quotas = np.array([600, 300, 0, 60, 41])
    whole = M._tree(quotas, 37, 5)
    top = M._tree(quotas, 37, 5, depth=3)
    below = [M._tree(row, b - a, 5, None, a) for row, (a, b) in zip(top, M._leaves(0, 37, 3))]
    assert (np.vstack(below) == whole).all() and (whole.sum(axis=1) == M._even(1001, 0, 37)).all()
    frame = spark.createDataFrame([("=a", 700), ("=b", 41)], "_key string, _blocks bigint")
    one, three = [sorted(map(tuple, M.allocate(frame, 37, depth=d).collect())) for d in (64, 2)]
    assert [(k, s) for k, s, _ in one] != [] and len(one) == len(three) == 741
    assert Counter(s for _, s, _ in one) == Counter(s for _, s, _ in three)
    assert M.allocate(frame, 1).select("shard").distinct().collect()[0][0] == 0
