"""Table maintenance: dedup, upsert, refresh, append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from curbline.functions import clock
from curbline.schemas import CASE_SCHEMA, CHAT_COLUMNS, MODEL_METRICS
from curbline.session import cut, discard, settle
from curbline.sources import commits

KEY = "case_enquiry_id"
LATEST = ("_ingested_at", "_id")
#: Rows of table and batch that are merged at once: what the merge shuffles is on disk until it is written.
CHUNK_ROWS = 1 << 21


def latest_per_key(df: DataFrame, key: str = KEY, order: tuple[str, ...] = LATEST) -> DataFrame:
    """Newest row per non-null key.

    All rows of one run share their ingest stamp, so ``_id`` decides between
    them. The rank filter is applied before the shuffle too (WindowGroupLimit),
    so a key with very many copies sends one row per task.
    """
    newest = W.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return (
        df.where(F.col(key).isNotNull())
        .withColumn("_rn", F.row_number().over(newest))
        .where("_rn = 1")
        .drop("_rn")
    )


def align(df: DataFrame, schema: T.StructType = CASE_SCHEMA) -> DataFrame:
    """Exactly the given columns, in order; missing ones are null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def upsert(
    target: DataFrame,
    batch: DataFrame,
    key: str = KEY,
    cols: list[str] | None = None,
    order: tuple[str, ...] = LATEST,
    keep: tuple[str, ...] = ("_id",),
) -> DataFrame:
    """Merge a batch into the target and return the new target.

    A matched row takes the batch values (all but the key and ``keep``) when its
    own ``_ingested_at`` is null or not newer; older batch rows are ignored;
    unmatched batch rows are inserted. Target rows without a key match nothing
    and go round the join, so they do not meet in one task.
    """
    cols = cols or target.columns
    src = latest_per_key(batch, key, order).select(F.struct(*cols).alias("s"), F.lit(True).alias("in_s"))
    keyed = F.col(key).isNotNull()
    tgt = target.where(keyed).select(F.struct(*cols).alias("t"), F.lit(True).alias("in_t"))
    both = tgt.join(src, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")
    fresh = F.col("t._ingested_at").isNull() | (F.col("s._ingested_at") >= F.col("t._ingested_at"))
    take = F.col("in_s").isNotNull() & (F.col("in_t").isNull() | fresh)

    def pick(c: str) -> Column:
        if c in keep or c == key:
            return F.when(F.col("in_t").isNull(), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))
        return F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))

    merged = both.select(*[pick(c).alias(c) for c in cols])
    return merged.unionByName(target.where(~keyed).select(*cols))


def refresh(batch: DataFrame, cols: list[str], key: str = KEY, order: tuple[str, ...] = LATEST) -> DataFrame:
    """Contents of a full refresh: the newest row per key, chosen columns."""
    return latest_per_key(batch, key, order).select(*cols)


def upsert_months(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    key: str = KEY,
    order: tuple[str, ...] = LATEST,
    sender: tuple[str, int] | None = None,
) -> commits.Manifest:
    """Upsert into a committed table partitioned by ``part_month`` (see
    :mod:`curbline.sources.commits`), rewriting only the months the batch touches.

    A row keeps the month it was inserted under, so no update moves it; a row
    inserted without ``open_dt`` stays in the partition of no month. The months
    to rewrite are those of the batch rows and of the target rows they match; the
    latter are found by reading just the key, where the files' own statistics leave
    keys of the batch possible. The merged months are written once, as new files,
    and become the table's with one manifest: a job that dies before leaves the
    table as it was, and repeating the batch gives the same table. When another
    writer commits first, the attempt is made again on what it left.

    ``sender`` names the source of the batch and its number there; a number that is
    not above the last one committed for that sender is a replay, and changes nothing.

    What a step shuffled is dropped before the next one, and the stored batch when it is
    done. More than ``CHUNK_ROWS`` rows are merged by ranges of the key, one after the other.
    """
    newest = cut(latest_per_key(batch, key, order).withColumn("part_month", F.date_format("open_dt", "yyyyMM")))
    settle(spark)
    span = newest.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()

    def attempt() -> commits.Manifest:
        base = commits.manifest(spark, path)
        if sender and base.senders.get(sender[0], -1) >= sender[1]:
            return base
        cols = base.schema.names
        table = commits.rows_of(spark, path, base)
        possible = table.where(F.col(key).between(span["low"], span["high"])).select(key, "part_month")
        matched = possible.join(newest.select(key), key, "left_semi").select("part_month")
        found = newest.select("part_month").union(matched).distinct().collect()  # at most one value per calendar month
        months = [commits.NULL_PARTITION if r[0] is None else r[0] for r in found]
        if not months:
            return commits.commit(spark, path, base, {}, sender) if sender else base
        part = commits.rows_of(spark, path, base, months)
        written: dict[str, list[str]] = {m: [] for m in months}
        for inside in key_ranges(part.select(key).union(newest.select(key)), key):
            merged = upsert(part.where(inside), newest.where(inside).select(cols), key, cols, order, ("_id", "part_month"))
            for month, folder in commits.write_files(merged.repartitionByRange("part_month", key), path, "part_month").items():
                written[month].append(folder)
            settle(spark)
        return commits.commit(spark, path, base, written, sender)

    try:
        return commits.retried(attempt)
    finally:
        discard(newest)
        settle(spark)


def key_ranges(keys: DataFrame, key: str) -> list[Column]:
    """Conditions that deal all rows, by their key, out to ranges of about ``CHUNK_ROWS`` rows; one for few rows, and for keys
    that are no whole numbers. Rows without a key are in the first."""
    n = -(-keys.count() // CHUNK_ROWS)
    if n < 2 or not isinstance(keys.schema[key].dataType, T.IntegralType):
        return [F.lit(True)]
    ends = sorted({min(int(x), (1 << 63) - 1) for x in keys.approxQuantile(key, [i / n for i in range(1, n)], 0.1 / n)})
    k = F.col(key)
    between = [(k > a) & (k <= b) for a, b in zip(ends, ends[1:])]
    return [(k <= ends[0]) | k.isNull(), *between, k > ends[-1]] if ends else [F.lit(True)]


def create_months(cases: DataFrame, path: str) -> commits.Manifest:
    """A committed table of the cases by month of ``open_dt``, for :func:`upsert_months`."""
    return commits.create(cases.withColumn("part_month", F.date_format("open_dt", "yyyyMM")), path, "part_month")


def chat_table(cases: DataFrame) -> DataFrame:
    """The 16 columns of the chat table; the id is text, null ids are dropped."""
    return cases.where(F.col(KEY).isNotNull()).select(
        *[F.col(c).cast("string").alias(c) if c == KEY else F.col(c) for c in CHAT_COLUMNS]
    )


def has_rows(df: DataFrame) -> bool:
    """Reads at most one row."""
    return not df.isEmpty()


def missing_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts without an action row; a null key never matches."""
    keys = ["snapshot_date", "slice_type", "slice_group"]
    return alerts.join(actions.select(*keys).distinct(), keys, "left_anti")


def seed_actions(alerts: DataFrame, actions: DataFrame, now, day) -> DataFrame:
    """Empty action rows for today's alerts that have none yet."""
    todo = alerts.where(
        (F.col("snapshot_date") == F.lit(day).cast("date")) & (F.col("status") == "needs_attention")
    )

    def pct(c: str) -> Column:
        return F.round(F.col(c) * 100, 1).cast("string")

    # Fixed value: the summary text.
    summary = F.concat(
        F.lit("ontime_rate="), pct("ontime_rate"), F.lit("%; median="), pct("median_ontime_rate"),
        F.lit("%; gap="), pct("gap_below_median"), F.lit("pts below median"),
    )
    return missing_actions(todo, actions).select(
        clock.instant(now).alias("action_timestamp"),
        "snapshot_date", "slice_type", "slice_group",
        summary.alias("issue_summary"),
        F.lit("").alias("action_taken"),
        F.lit("").alias("expected_tradeoff"),
        F.lit("").alias("owner"),
    )


def append_snapshot(df: DataFrame, path: str, part: str = "snapshot_date") -> None:
    """Write dated rows; a rerun of the same day replaces that day only."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(part)
        .parquet(path)
    )


def metrics_schema() -> T.StructType:
    return T.StructType.fromDDL(
        ", ".join(
            f"{n.rstrip('!')} {kind}" + (" NOT NULL" if n.endswith("!") else "")
            for n, kind in MODEL_METRICS
        )
    )


def append_metrics(row: DataFrame, path: str) -> None:
    """Append monitoring rows in the fixed column order; required values are checked."""
    schema = metrics_schema()
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType)
        if not f.nullable:
            c = F.coalesce(c, F.raise_error(F.lit(f"{f.name} is required")).cast(f.dataType))
        row = row.withColumn(f.name, c)
    row.select(*schema.fieldNames()).write.mode("append").parquet(path)
