"""Request, step and query log metrics.

Request log: event_id, ts, path, method, status_code, latency_ms, error.
Step log: event_id, ts, step, latency_ms, success, error.
Query log: ts, sql.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.functions.numeric import half_even, ratio_or_zero
from curbline.functions.text import fingerprint
from curbline.operators import ordered
from curbline.session import cut

MONITOR_PREFIX = "/monitor"
CHUNK_ROWS = 1 << 16  # different times of one fingerprint that a task looks at together
_NEVER, _SAME = -(1 << 62), 1 - (1 << 62)  # no span is open; the open span stays as it is


def user_requests(log: DataFrame) -> DataFrame:
    """Without the requests of the monitoring page itself."""
    return log.where(~F.col("path").startswith(MONITOR_PREFIX))


def last_n(log: DataFrame, n: int = 50) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def p95(log: DataFrame, by: list[str] | None = None, value: str = "latency_ms") -> DataFrame:
    """Nearest-rank 95th percentile, exact."""
    return ordered.nearest_rank(log, by or [], value, 0.95, "p95_latency_ms")


def p95_approx(log: DataFrame, by: list[str] | None = None, value: str = "latency_ms") -> DataFrame:
    """Sketch variant: one shuffle, bounded error."""
    return log.groupBy(*(by or [])).agg(
        F.percentile_approx(value, 0.95, 10000).alias("p95_latency_ms")
    )


def request_summary(log: DataFrame) -> DataFrame:
    """One row: volume, mean and p95 latency, error rate, last error."""
    failed = F.col("status_code") >= 400
    last = F.max_by(
        F.struct("ts", "path", "status_code", F.coalesce("error", F.lit("")).alias("message")),
        F.when(failed, F.struct("ts", "event_id")),
    ).alias("last")
    top = p95(log).select(F.max("p95_latency_ms")).scalar()
    return log.agg(
        F.count("*").alias("total_requests"),
        F.avg("latency_ms").alias("mean"),
        F.count_if(failed).alias("bad"),
        last,
    ).select(
        "total_requests",
        half_even(F.coalesce("mean", F.lit(0.0)), 1).alias("avg_latency_ms"),
        half_even(F.coalesce(top, F.lit(0.0)), 1).alias("p95_latency_ms"),
        half_even(ratio_or_zero("bad", "total_requests"), 3).alias("error_rate"),
        F.col("last.ts").alias("last_error_ts"),
        F.col("last.path").alias("last_error_path"),
        F.col("last.status_code").alias("last_error_status"),
        F.col("last.message").alias("last_error_message"),
    )


def by_path(log: DataFrame) -> DataFrame:
    n = F.count("*")
    return (
        log.groupBy("path")
        .agg(
            n.alias("n_requests"),
            F.avg("latency_ms").alias("avg_latency_ms"),
            (F.count_if(F.col("status_code") >= 400) / n).alias("error_rate"),
        )
        .orderBy(F.desc("n_requests"), "path")
    )


def by_step(steps: DataFrame) -> DataFrame:
    n = F.count("*")
    means = steps.groupBy("step").agg(
        n.alias("n_steps"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        (F.count_if(~F.col("success")) / n).alias("error_rate"),
    )
    return means.join(p95(steps, ["step"]), "step", "left").orderBy("step")


def hit_rates(log: DataFrame) -> DataFrame:
    """Hits, misses and hit percentage per fingerprint from logged outcomes."""
    hit = F.col("outcome") == "hit"
    return (
        log.groupBy(fingerprint("sql").alias("cache_key"))
        .agg(
            F.count_if(hit).alias("hits"),
            F.count_if(F.col("outcome") == "miss").alias("misses"),
        )
        .withColumn(
            "hit_rate_percent",
            half_even(ratio_or_zero("hits", F.col("hits") + F.col("misses")) * 100, 2),
        )
    )


def ttl_repeats(log: DataFrame, ttl: int = 3600, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Hits, misses and expirations per fingerprint for spans of ``ttl`` seconds.

    The first arrival of a fingerprint opens a span; arrivals up to ``ttl``
    seconds later, to the microsecond, are hits; the next one opens a new span.

    A fingerprint's different times are cut into chunks of ``chunk_rows`` at most. A
    chunk is a step function of the end of the span open before it: the end of the
    span open after it, and how many spans it opens. The functions of neighbouring
    chunks are put together, two by two, until one is left for each fingerprint: a
    composition has no more steps than its first function, so no group outgrows two
    chunks, and a hot fingerprint takes as many rounds as its chunks have doublings.
    """
    width = ttl * 1_000_000
    times = cut(
        log.groupBy(fingerprint("sql").alias("cache_key"), F.unix_micros("ts").alias("at"))
        .agg(F.count("*").alias("n"))
    )
    sizes = cut(times.groupBy("cache_key").agg(F.count("*").alias("rows")))
    seen = sizes.agg(F.sum("rows").alias("rows"), F.max("rows").alias("most")).first()
    chunked = times.withColumn("chunk", F.lit(0).cast("bigint"))
    if (seen["most"] or 0) > chunk_rows:
        hot = sizes.where(F.col("rows") > chunk_rows).select("cache_key")
        ranked = ordered.rank_within(times.join(hot, "cache_key", "left_semi"), ["cache_key"], [F.asc("at")], "place")
        chunked = times.join(hot, "cache_key", "left_anti").withColumn("chunk", F.lit(0).cast("bigint")).unionByName(
            ranked.withColumn("chunk", F.floor((F.col("place") - 1) / chunk_rows)).drop("place")
        )
    # A task takes the small fingerprints by the bucket; a full chunk is about a bucket of its own.
    buckets = max(1, -(-(seen["rows"] or 0) // chunk_rows))
    dealt = chunked.withColumn("bucket", F.pmod(F.xxhash64("cache_key", "chunk"), F.lit(buckets)))

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cache_key", "chunk", "at"])
        key, chunk, at, n = [pdf[c].to_numpy() for c in ("cache_key", "chunk", "at", "n")]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])]))
        rows = []
        for a, b in zip(first, [*first[1:], len(at)]):
            made = _only_start(_steps(at[a:b], width)) if chunk[a] == 0 else _steps(at[a:b], width)
            rows.append((key[a], chunk[a], int(n[a:b].sum()), *made))
        return pd.DataFrame(rows, columns=_MAP_COLUMNS)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf.itertuples(index=False), key=lambda r: r.chunk)
        one = rows[0]
        made, total = (one.since, one.ends, one.opens), one.arrivals
        if len(rows) == 2:
            made, total = _composed(made, (rows[1].since, rows[1].ends, rows[1].opens)), total + rows[1].arrivals
        return pd.DataFrame([(one.cache_key, one.chunk // 2, total, *made)], columns=_MAP_COLUMNS)

    maps = cut(dealt.groupBy("bucket").applyInPandas(steps, _MAP))
    last, done = -(-(seen["most"] or 0) // chunk_rows), [maps]
    if last > 1:  # fingerprints of one chunk are done
        several = sizes.where(F.col("rows") > chunk_rows).select("cache_key")
        done = [maps.join(several, "cache_key", "left_anti")]
        going = maps.join(several, "cache_key", "left_semi")
        while last > 1:
            pair = F.floor(F.col("chunk") / 2)
            going = cut(going.groupBy("cache_key", pair.alias("_pair")).applyInPandas(join, _MAP))
            last = -(-last // 2)
        done.append(going)
    found = [d.select("cache_key", F.col("arrivals").alias("n"), F.col("opens")[0].alias("misses")) for d in done]
    return reduce(DataFrame.unionByName, found).select(
        "cache_key", (F.col("n") - F.col("misses")).alias("hits"), "misses", (F.col("misses") - 1).alias("expirations")
    )


#: A chunk's step function: an open span that ends at ``since[j]`` or later, and before ``since[j + 1]``, becomes one
#: that ends at ``ends[j]`` (_SAME: stays as it is), and ``opens[j]`` spans are opened. The first ``since`` is _NEVER.
_MAP = "cache_key string, chunk bigint, arrivals bigint, since array<bigint>, ends array<bigint>, opens array<bigint>"
_MAP_COLUMNS = ["cache_key", "chunk", "arrivals", "since", "ends", "opens"]


def _steps(at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The step function of a chunk's different times, in order."""
    m = len(at)
    to = np.append(np.searchsorted(at, at + width, "right"), m)  # where the next span opens; m: nowhere
    opens, last = np.append(np.ones(m, np.int64), 0), np.arange(m + 1)
    while (to < m).any():  # doubling: each turn follows twice as many spans
        opens = opens + opens[to]
        last = np.where(to < m, last[to], last)
        to = to[to]
    since = np.concatenate([[_NEVER], at])
    ends = np.append(at[last[:m]] + width, _SAME)
    new = np.concatenate([[True], (ends[1:] != ends[:-1]) | (opens[1:] != opens[:-1])])
    return since[new], ends[new], opens[new]


def _only_start(steps: tuple) -> tuple:
    """Before the first chunk of a fingerprint no span is open."""
    return tuple(x[:1] for x in steps)


def _composed(one: tuple, two: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First ``one``, then ``two``."""
    since, ends, opens = one
    out_since, out_ends, out_opens = [], [], []
    goes = np.maximum(np.searchsorted(two[0], ends, "right") - 1, 0)
    for j in range(len(since)):
        if ends[j] != _SAME:
            k = goes[j]
            out_since.append(since[j])
            out_ends.append(ends[j] if two[1][k] == _SAME else two[1][k])
            out_opens.append(opens[j] + two[2][k])
        else:  # the last step: what was open stays, and meets all steps of ``two`` from there on
            k = max(int(np.searchsorted(two[0], since[j], "right")) - 1, 0)
            out_since += [since[j], *two[0][k + 1 :]]
            out_ends += list(two[1][k:])
            out_opens += list(opens[j] + two[2][k:])
    since, ends, opens = [np.array(x, np.int64) for x in (out_since, out_ends, out_opens)]
    new = np.concatenate([[True], (ends[1:] != ends[:-1]) | (opens[1:] != opens[:-1])])
    return since[new], ends[new], opens[new]
