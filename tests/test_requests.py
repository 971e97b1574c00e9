"""Spans of a time to live: step functions of chunks against a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbline.operators import requests as R


def plain(times, width, open_end=None):
    """End of the last span and how many were opened."""
    opens = 0
    for t in sorted(times):
        if open_end is None or t > open_end:
            open_end, opens = t + width, opens + 1
    return open_end, opens


def applied(steps, e):
    since, ends, opens = steps
    k = max(int(np.searchsorted(since, R._NEVER if e is None else e, "right")) - 1, 0)
    return (e if ends[k] == R._SAME else int(ends[k])), int(opens[k])


@pytest.mark.parametrize("width", [1, 7, 40, 1000])
def test_steps_and_their_composition(width):
    draw = random.Random(width)
    for _ in range(60):
        at = np.array(sorted(draw.sample(range(-300, 900), draw.randrange(3, 60))), np.int64)
        cuts = sorted({0, len(at), *[draw.randrange(len(at)) for _ in range(draw.randrange(0, 5))]})
        chunks = [R._steps(at[a:b], width) for a, b in zip(cuts, cuts[1:])]
        whole = chunks[0]
        for c in chunks[1:]:
            whole = R._composed(whole, c)
        assert len(whole[0]) <= len(at) + 1
        for e in [None, *range(-400, 1000, 13)]:
            assert applied(whole, e) == plain(at.tolist(), width, e)
            assert applied(R._steps(at, width), e) == plain(at.tolist(), width, e)


def test_a_hot_fingerprint_is_many_small_groups(spark, monkeypatch):
    draw = random.Random(2)
    hot = sorted(draw.sample(range(3_000_000), 5000))
    logs = {"hot": hot, **{f"k{k}": draw.sample(range(3_000_000), draw.randrange(1, 90)) for k in range(150)}}
    rows = [(f"SELECT {k}", t) for k, ts in logs.items() for t in ts]
    log = spark.createDataFrame(rows, "sql string, us long").select("sql", F.timestamp_micros("us").alias("ts"))
    got = R.ttl_repeats(log, ttl=1, chunk_rows=128).collect()
    want = []
    for ts in logs.values():
        _, opens = plain(ts, 1_000_000)
        want.append((len(ts) - opens, opens, opens - 1))
    assert sorted((r["hits"], r["misses"], r["expirations"]) for r in got) == sorted(want)
    assert R.ttl_repeats(log.where("false")).collect() == []
