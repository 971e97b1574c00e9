"""Joins that survive hot keys, and small column helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in HOT_SHARE, so there are HOT_SHARE hot keys at most.
HOT_SHARE = 1000


def whole(column: str = "text") -> Column:
    """The column as text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def bounded_batches(frame: DataFrame, size: str = "8m") -> None:
    """Have rows travel to Python in batches of about ``size``, unless the session says otherwise.

    The default counts rows, and ten thousand long texts are more than a task should hold.
    """
    conf, key = frame.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, "1") == "1":  # what an unset key answers
        conf.set(key, size)


def release() -> None:
    """Give memory that this process freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another allocator
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a task; when it ends, what it freed goes back to the system.

    Workers live on after their tasks, and the allocator would keep the most that any of them held.
    """

    def inner(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return inner


def total_of(groups: DataFrame, size: str) -> int:
    return groups.agg(F.sum(size)).first()[0] or 0


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, salt: list[str], merge: bool = False) -> DataFrame:
    """Left join of rows to ``groups`` (one row per key, ``size`` rows each, ``total`` in all).

    Groups above the hot share number HOT_SHARE at most, by construction, and are
    broadcast; their rows get a spread key for the shuffle that joins the rest, so
    no key brings more than total / HOT_SHARE rows to one task. ``salt`` names
    columns that differ between the rows of a group. Keys are longs or strings.
    ``merge`` joins the rest by sorting at every size, for rows too wide for a plan
    that changes when the groups outgrow a broadcast.
    """
    values = [c for c in groups.columns if c != key]
    at = max(total // HOT_SHARE, 1)
    hot = groups.where(F.col(size) > at).select(
        F.col(key).alias("_hk"), *[F.col(v).alias(f"_hot_{v}") for v in values]
    )
    cold = groups.where(F.col(size) <= at).select(
        F.col(key).alias("_ck"), *[F.col(v).alias(f"_cold_{v}") for v in values]
    )
    away = F.xxhash64(*salt).cast(groups.schema[key].dataType)
    spread = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left").withColumn(
        "_k", F.when(F.col("_hk").isNotNull(), away).otherwise(F.col(key))
    )
    return spread.join(cold.hint("merge") if merge else cold, F.col("_k") == F.col("_ck"), "left").select(
        *rows.columns,
        *[F.when(F.col("_hk").isNotNull(), F.col(f"_hot_{v}")).otherwise(F.col(f"_cold_{v}")).alias(v) for v in values],
    )
