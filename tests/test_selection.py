"""Rows at places of an order against a plain sort: ties, nulls, infinities, skewed values, few cells."""

import math
import random

import pytest

from curbline.operators import ranking, selection

SCHEMA = "case_enquiry_id long, priority_score double, label int"


def order(r):
    x = r[1]
    kind = 0 if x is None else 2 if math.isnan(x) else 1
    return (-kind, -(x if kind == 1 else 0.0), r[0])


@pytest.mark.parametrize("cells, few", [(1 << 14, 10_000), (7, 5), (3, 1)])
def test_borders_equal_a_sort(spark, monkeypatch, cells, few):
    monkeypatch.setattr(selection, "CELLS", cells)
    monkeypatch.setattr(selection, "FEW", few)
    draw = random.Random(cells)
    values = [draw.random() for _ in range(80)] + [0.5] * 60 + [1e-300 * k for k in range(10)] + [1e300, -1e300]
    values += [None] * 9 + [float("nan")] * 3 + [float("inf")] * 4 + [float("-inf")] * 2
    draw.shuffle(values)
    ids = draw.sample(range(-(10**6), 10**18), len(values))
    rows = [(i, x, draw.randrange(2)) for i, x in zip(ids, values)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted(rows, key=order)
    places = [1, 4, 8, 9, 20, 75, 100, 140, len(rows) - 9, len(rows), len(rows) + 1]
    got = selection.borders(df, "priority_score", "case_enquiry_id", places)
    assert got[-1] is None and [b.id for b in got[:-1]] == [want[p - 1][0] for p in places[:-1]]
    for place, border in list(zip(places, got))[1:-1:3]:
        assert df.where(border.reached("priority_score", "case_enquiry_id")).count() == place


def test_precision_and_threshold_equal_the_ranked_ones(spark):
    draw = random.Random(5)
    df = spark.createDataFrame([(k, round(draw.random(), 2), draw.randrange(2)) for k in range(700)], SCHEMA)
    ranked = ranking.rank_overall(df)
    assert ranking.precision_of(df, "label").collect() == ranking.precision_at(ranked, "label").collect()
    for share in (0.05, 0.5):
        assert ranking.threshold_of(df, share).collect() == ranking.critical_threshold(ranked, share).collect()
    none = df.where("false")
    assert [r["precision_at_k"] for r in ranking.precision_of(none, "label").collect()] == [None] * 3
    assert ranking.threshold_of(none).collect()[0][0] is None
