"""Serving tables kept up to date from what an upsert changed, without a rebuild.

The case table is a committed one (:mod:`curbline.sources.commits`). Between two of its
versions only some folders differ: the rows of folders that went count -1, those of
folders that came count +1. Both are summed by the keys of the serving table where they
are read; when the sums meet, rows that a rewrite merely copied cancel, and what is left
are the changes. They are added to the serving table as signed rows, so only keys that changed
are written; a reader sums the rows of a key and leaves out keys without cases. A month
of more than ``FOLDERS`` additions is summed anew when the next one arrives.

All stored numbers are whole, durations as microseconds, so that what cancels does so
exactly; averages and rates are computed by the reader. The version of the case table
that a serving table stands for is part of its own manifest: a refresh that is
repeated, or that dies half way, counts nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.functions import clock
from curbline.functions.numeric import ratio, safe_bool
from curbline.operators.fairness import SLICES, unpivot
from curbline.operators.metrics import DAILY_KEYS, DAILY_NUMBERS
from curbline.session import cut
from curbline.sources import commits

#: A month with this many folders is summed into one by the next addition to it.
FOLDERS = 8
#: The sender under which a serving table keeps the version of the case table.
SOURCE = "cases"
WHOLE = "decimal(38,0)"


@dataclass(frozen=True)
class Rollup:
    """``prepare`` gives the columns that ``keys`` and ``sums`` (numbers of one row, whole) are made
    of; ``day`` is the key whose month is the partition; ``finish`` makes the table's columns of the sums.

    ``n``, the number of rows, is always among the sums."""

    prepare: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...]
    day: str
    sums: dict[str, Column]
    finish: Callable[[DataFrame], DataFrame]

    def signed(self, rows: DataFrame, sign: int) -> DataFrame:
        """Keys and numbers of each row, all times ``sign``."""
        numbers = {"n": F.lit(1)} | self.sums
        return self.prepare(rows).select(
            *self.keys, *[(F.coalesce(c.cast(WHOLE), F.lit(0)) * sign).cast(WHOLE).alias(name) for name, c in numbers.items()]
        )

    def summed(self, rows: DataFrame) -> DataFrame:
        """One row per key, with its month; keys whose numbers are all 0 are left out."""
        names = ["n", *self.sums]
        return (
            rows.groupBy(*self.keys).agg(*[F.sum(c).cast(WHOLE).alias(c) for c in names])
            .where(" OR ".join(f"{c} <> 0" for c in names))
            .withColumn("part_month", F.date_format(self.day, "yyyyMM"))
        )

    def ranged(self, rows: DataFrame) -> DataFrame:
        """In order of the month, so that a task writes files of few months; a large month is cut by its keys."""
        return rows.repartitionByRange("part_month", *self.keys)


def dashboard() -> Rollup:
    """The dashboard cube, as :func:`curbline.operators.metrics.dashboard_daily`."""
    keys = ("open_date", "neighborhood", "department", "type", "reason", "case_status")
    return Rollup(
        lambda cases: cases.where(F.col("case_enquiry_id").isNotNull()).withColumn("open_date", F.to_date("open_dt")),
        keys,
        "open_date",
        {
            "on_time_count": (F.col("on_time") == "ONTIME").cast("int"),
            "on_time_count_parity": safe_bool("on_time").cast("int"),
        },
        lambda sums: sums.select(
            *keys, F.col("n").cast("bigint").alias("case_count"),
            *[F.col(c).cast("bigint").alias(c) for c in ("on_time_count", "on_time_count_parity")],
        ),
    )


def daily() -> Rollup:
    """The daily table, as :func:`curbline.operators.metrics.daily_metrics`; its average is kept as sum and count."""
    closed, eligible = F.col("case_status") == "Closed", F.col("sla_target_dt").isNotNull()
    timed = closed & F.col("closed_dt").isNotNull() & F.col("open_dt").isNotNull()
    sums = {
        "open_cases": ~closed,
        "closed_cases": closed,
        "sla_eligible_cases": eligible,
        "sla_met_cases": eligible & (F.col("on_time") == "ONTIME"),
        "timed": timed,
    }

    def finish(rows: DataFrame) -> DataFrame:
        counts = {"total_cases": "n"} | {c: c for c in list(sums)[:4]}
        return rows.select(
            *DAILY_KEYS,
            *[F.col(old).cast("bigint").alias(new) for new, old in counts.items()],
            (F.try_divide(F.col("micros").cast("double"), F.col("timed").cast("double")) / 3_600_000_000).alias("avg_resolution_hrs"),
            (ratio("sla_met_cases", "sla_eligible_cases") * 100).alias("sla_compliance_pct"),
        ).select(*DAILY_KEYS, *DAILY_NUMBERS)

    span = F.when(timed, F.unix_micros("closed_dt") - F.unix_micros("open_dt"))
    return Rollup(
        lambda cases: cases.withColumn("date", F.to_date("open_dt")),
        tuple(DAILY_KEYS),
        "date",
        {name: c.cast("int") for name, c in sums.items()} | {"micros": span},
        finish,
    )


def slices() -> Rollup:
    """Slice counts by ingest stamp, of which a run has one; :func:`slice_rates` reads a window of them."""
    numbers = {
        "ontime": (F.upper(F.trim("on_time")) == "ONTIME").cast("int"),
        "closed": (F.initcap(F.trim("case_status")) == "Closed").cast("int"),
    }
    keep = [F.col("_ingested_at").alias("stamp"), F.col("on_time"), F.col("case_status")]
    return Rollup(
        lambda cases: unpivot(cases.where(F.col("_ingested_at").isNotNull()), SLICES, keep).where("slice_group IS NOT NULL"),
        ("stamp", "slice_type", "slice_group"),
        "stamp",
        numbers,
        lambda sums: sums.select("stamp", "slice_type", "slice_group", "n", "ontime", "closed"),
    )


def slice_rates(counts: DataFrame, as_of, days: int = 30) -> DataFrame:
    """The rates of :func:`curbline.operators.fairness.slice_metrics` from :func:`slices`, for any ``as_of``."""
    recent = counts.where(F.col("stamp") >= clock.days_before(as_of, days))
    return (
        recent.groupBy("slice_type", "slice_group").agg(*[F.sum(c).alias(c) for c in ("n", "ontime", "closed")])
        .select(
            F.to_date(clock.instant(as_of)).alias("snapshot_date"), "slice_type", "slice_group",
            F.col("n").cast("bigint").alias("total_cases"),
            ratio("ontime", F.col("n").cast("double")).alias("ontime_rate"),
            ratio("closed", F.col("n").cast("double")).alias("closed_rate"),
        )
    )


def create(spark: SparkSession, cases: str, path: str, rollup: Rollup) -> commits.Manifest:
    """The serving table of all rows of the committed case table at ``cases``."""
    base = commits.manifest(spark, cases)
    rows = rollup.summed(rollup.signed(commits.rows_of(spark, cases, base), 1))
    return commits.create(rollup.ranged(rows), path, "part_month", {SOURCE: base.version})


def changes(spark: SparkSession, cases: str, old: commits.Manifest, new: commits.Manifest, rollup: Rollup) -> DataFrame:
    """Signed sums of the keys that differ between two versions of the case table, from the folders that differ."""

    def only(a: commits.Manifest, b: commits.Manifest) -> commits.Manifest:
        left = {m: [f for f in some if f not in set(b.folders.get(m, []))] for m, some in a.folders.items()}
        return replace(a, folders={m: some for m, some in left.items() if some})

    gone = rollup.signed(commits.rows_of(spark, cases, only(old, new)), -1)
    come = rollup.signed(commits.rows_of(spark, cases, only(new, old)), 1)
    return rollup.summed(gone.unionByName(come))


def refresh(spark: SparkSession, cases: str, path: str, rollup: Rollup, most: int = FOLDERS) -> commits.Manifest:
    """Bring the serving table at ``path`` to the newest version of the case table.

    Nothing happens when it is there already. When the case table no longer keeps the version
    that the serving table stands for (see :func:`curbline.sources.commits.vacuum`), all is summed anew.
    """

    def attempt() -> commits.Manifest:
        base, new = commits.manifest(spark, path), commits.manifest(spark, cases)
        seen = base.senders[SOURCE]
        if seen >= new.version:
            return base
        at = (SOURCE, new.version)
        names = base.schema.names
        if seen not in commits.versions(spark, cases):
            everything = rollup.summed(rollup.signed(commits.rows_of(spark, cases, new), 1))
            written = commits.write_files(rollup.ranged(everything.select(names)), path, "part_month")
            return commits.commit(spark, path, base, {m: None for m in base.folders} | written, at)
        delta = cut(changes(spark, cases, commits.manifest(spark, cases, seen), new, rollup).select(names))
        touched = [r[0] or commits.NULL_PARTITION for r in delta.select("part_month").distinct().collect()]  # calendar months
        if not touched:
            return commits.commit(spark, path, base, {}, at)
        full = [m for m in touched if len(base.folders.get(m, [])) >= most]
        month = F.coalesce("part_month", F.lit(commits.NULL_PARTITION))
        written = commits.write_files(rollup.ranged(delta.where(~month.isin(full))), path, "part_month")
        merged: dict[str, str] = {}
        if full:
            stored = commits.rows_of(spark, path, base, full).unionByName(delta.where(month.isin(full)))
            merged = commits.write_files(rollup.ranged(rollup.summed(stored).select(names)), path, "part_month")
        return commits.commit(spark, path, base, {m: merged.get(m) for m in full}, at, written)

    return commits.retried(attempt)


def read(spark: SparkSession, path: str, rollup: Rollup, months: list[str] | None = None) -> DataFrame:
    """The serving table; ``months`` (yyyyMM) limits what is read to those."""
    stored = commits.read(spark, path, parts=months)
    return rollup.finish(rollup.summed(stored.drop("part_month")).where("n <> 0"))
