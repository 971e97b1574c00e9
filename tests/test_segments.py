"""The index of segments equals a plain one, and a search leaves most blocks of common words unread."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curbline.operators import segments
from curbline.session import fresh_path
from curbline.sources import commits

DOCS = "doc_id long, title string, text string"


def plain(docs, terms):
    wanted = {t.lower() for t in terms}
    return sorted(i for i, words in docs.items() if wanted and wanted <= words)


def found(spark, path, terms):
    return sorted(r[0] for r in segments.search(spark, path, terms, "doc_id").collect())


def test_additions_replacements_and_merges_equal_a_plain_index(spark):
    rng, path, docs = random.Random(4), fresh_path(spark, "index"), {}
    words = [f"w{i}" for i in range(12)]

    def batch(ids):
        rows = [(i, rng.choice(["The", None]), rng.choice([None, "", " ".join(rng.choices(words, k=5))])) for i in ids]
        docs.update({i: set(f"{a or ''} {b or ''}".lower().split()) for i, a, b in rows})
        return spark.createDataFrame([*rows, (None, "The", "w1")], DOCS)

    segments.create(batch(range(-20, 40)), "doc_id", ["title", "text"], path)
    asks = [["THE"], ["the", "w1"], ["w1", "w2", "w3"], ["w4", "nowhere"], [], ["w5", "W5"]]
    for ids in (range(30, 50), [1, 5000, 2**40], range(-5, 5), [7], [8], [1]):
        segments.add(batch(ids), "doc_id", ["title", "text"], path)
        before = [found(spark, path, a) for a in asks[:3]]
        assert before == [plain(docs, a) for a in asks[:3]]
        segments.merge(spark, path, fan=3)
    assert [found(spark, path, a) for a in asks] == [plain(docs, a) for a in asks]
    assert list(segments.sizes(spark, path).values()) == [60, 20, 3, 10, 3]  # the three of one document became one


def test_adding_writes_one_segment_and_a_repeat_nothing(spark):
    path = fresh_path(spark, "index")
    segments.create(spark.createDataFrame([(1, "a", "x")], DOCS), "doc_id", ["text"], path)
    old = commits.manifest(spark, path)
    more = spark.createDataFrame([(2, "b", "x y")], DOCS)
    new = segments.add(more, "doc_id", ["text"], path, ("feed", 3))
    assert {s: f for s, f in new.folders.items() if s in old.folders} == old.folders and len(new.folders) == 2
    assert segments.add(more, "doc_id", ["text"], path, ("feed", 3)).version == new.version
    assert found(spark, path, ["x"]) == [1, 2]


def rows_read(df):
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_a_rare_word_leaves_most_of_a_common_one_unread(spark):
    path, n = fresh_path(spark, "index"), 2_000_000
    docs = spark.range(n).selectExpr("id AS doc_id", "IF(id % 700001 = 5, 'common rare', 'common') AS text")
    segments.create(docs, "doc_id", ["text"], path)
    at = commits.manifest(spark, path)
    total = rows_read(segments.postings(spark, path, at, "common", None))
    assert total >= n // segments.WIDTH
    rare = [700001 * i + 5 for i in range(3)]
    assert found(spark, path, ["common", "rare"]) == rare
    ranges = segments.ranges_of([i // segments.WIDTH for i in rare])
    assert rows_read(segments.postings(spark, path, at, "common", ranges)) <= 3 * 2 * 64 < total


def test_empty_index(spark):
    path = fresh_path(spark, "index")
    segments.create(spark.createDataFrame([], DOCS), "doc_id", ["text"], path)
    assert found(spark, path, ["x"]) == [] and segments.sizes(spark, path) == {}
    segments.merge(spark, path)
    segments.add(spark.createDataFrame([(4, "", "x")], DOCS), "doc_id", ["text"], path)
    assert found(spark, path, ["x"]) == [4]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-50, 300), unique=True).map(sorted), st.integers(1, 8))
def test_ranges_hold_all_blocks_and_are_few(blocks, most):
    got = segments.ranges_of(blocks, most)
    assert len(got) <= most and all(any(a <= b <= z for a, z in got) for b in blocks)
    assert all(a[1] < b[0] for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("docs, run", [([9, 1, 1], 0), ([9, 1, 1, 1], 3), ([9, 9, 9, 1], 4), ([1, 3, 9, 27], 0)])
def test_which_segments_are_due(docs, run):
    assert len(segments.due({str(i): n for i, n in enumerate(docs)}, 3)) == run
