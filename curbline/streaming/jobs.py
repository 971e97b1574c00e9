"""Structured Streaming jobs: request metrics, upsert, dedup.

Every job takes a streaming frame and writes to the shared folder; nothing is
kept in driver memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curbline.operators import maintain
from curbline.sources import commits

#: Values that a pane's quantile sketch keeps, about: ranks are off by about 1.3 / SKETCH.
SKETCH = 400


def read_files(spark: SparkSession, folder: str, file_glob: str, ts: str) -> DataFrame:
    """Stream of the Parquet files of a folder; plain time stamps become instants."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", file_glob).parquet(folder)
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def request_metrics(
    log: DataFrame, by: str, width: str = "1 day", slide: str | None = None, late: str = "1 hour",
    with_p95: bool = False,
) -> DataFrame:
    """Count, mean latency and error rate per window and ``by``.

    Needs ts, latency_ms and failed. ``slide`` makes the windows overlap; the
    95th percentile is a sketch.
    """
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    n = F.count("*")
    aggs = [
        n.alias("n"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        (F.count_if("failed") / n).alias("error_rate"),
    ]
    if with_p95:
        aggs.append(F.percentile_approx("latency_ms", 0.95).alias("p95_latency_ms"))
    return (
        log.withWatermark("ts", late)
        .groupBy(window.alias("w"), by)
        .agg(*aggs)
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, *_names(with_p95))
    )


def _names(with_p95: bool) -> list[str]:
    return ["n", "avg_latency_ms", "error_rate"] + (["p95_latency_ms"] if with_p95 else [])


def pane_metrics(log: DataFrame, by: str, pane: str = "1 hour", late: str = "1 hour", kept: int = SKETCH) -> DataFrame:
    """Per pane and ``by`` what windows of any slide are merged from: counts, sums, and a quantile sketch.

    Needs ts, latency_ms and failed. A row's state is a few numbers and ``kept`` values
    or so, however many requests a pane has.
    """
    return (
        log.withWatermark("ts", late)
        .groupBy(F.window("ts", pane).alias("w"), by)
        .agg(
            F.count("*").alias("n"), F.count("latency_ms").alias("n_latency"), F.sum("latency_ms").alias("latency_ms"),
            F.count_if("failed").alias("n_failed"), F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(kept)).alias("sketch"),
        )
        .select(F.col("w.start").alias("pane_start"), by, "n", "n_latency", "latency_ms", "n_failed", "sketch")
    )


def windows_of(panes: DataFrame, by: str, width: str, slide: str | None = None) -> DataFrame:
    """The metrics of :func:`request_metrics` for windows whose ends are ends of panes; the
    95th percentile's rank is off by about 1 / ``kept`` of the panes' sketches."""
    window = F.window("pane_start", width, slide) if slide else F.window("pane_start", width)
    merged = panes.groupBy(window.alias("w"), by).agg(
        F.sum("n").alias("n"), F.sum("n_latency").alias("_m"), F.sum("latency_ms").alias("_sum"), F.sum("n_failed").alias("_bad"),
        F.kll_merge_agg_double("sketch").alias("_sketch"),
    )
    p95 = F.when(F.col("_m") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(0.95)))
    return merged.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n",
        F.when(F.col("_m") > 0, F.col("_sum") / F.col("_m")).alias("avg_latency_ms"), (F.col("_bad") / F.col("n")).alias("error_rate"),
        p95.alias("p95_latency_ms"),
    )


#: Read what has arrived, then stop; {"processingTime": "1 minute"} keeps a job running.
ONCE = {"availableNow": True}


def write_updates(df: DataFrame, out: str, state: str, trigger: dict = ONCE) -> StreamingQuery:
    """Write the rows each batch changed under ``batch_id=<n>``; a replayed
    batch overwrites its own folder."""

    def save(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        df.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", state)
        .trigger(**trigger)
        .start()
    )


def _compacted(spark: SparkSession, out: str) -> int | None:
    """The last batch of the newest finished compaction."""
    done = [n for n in commits.names(spark, f"{out}/_compacted") if "_SUCCESS" in commits.names(spark, f"{out}/_compacted/{n}")]
    return max((int(n.split("=")[1]) for n in done), default=None)


def latest_updates(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Current value per key from the written updates: the newest compaction and the batches since."""
    upto = _compacted(spark, out)
    batches = sorted(int(n.split("=")[1]) for n in commits.names(spark, out) if n.startswith("batch_id="))
    found = [] if upto is None else [spark.read.parquet(f"{out}/_compacted/upto={upto}").withColumn("batch_id", F.lit(upto).cast("bigint"))]
    new = [f"{out}/batch_id={n}" for n in batches if upto is None or n > upto]
    if new:
        rows = spark.read.option("basePath", out).parquet(*new)
        found.append(rows.withColumn("batch_id", F.col("batch_id").cast("bigint")))
    if not found:
        raise FileNotFoundError(f"no updates at {out}")
    rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
        .select(*keys, "v.*")
    )


def compact(spark: SparkSession, out: str, keys: list[str]) -> int:
    """Keep one row per key of all batches written so far, and remove those batches; returns the last one.

    The batches go when the compacted rows are complete, so a job that dies loses
    nothing and is run again. For times between batches; readers list folders anew.
    """
    batches = [int(n.split("=")[1]) for n in commits.names(spark, out) if n.startswith("batch_id=")]
    before = _compacted(spark, out)
    last = max([*batches, *([] if before is None else [before])])
    if before is None or last > before:
        latest_updates(spark, out, keys).write.mode("overwrite").parquet(f"{out}/_compacted/upto={last}")
    commits.remove(spark, [f"{out}/batch_id={n}" for n in batches])
    commits.remove(spark, [f"{out}/_compacted/{n}" for n in commits.names(spark, f"{out}/_compacted") if n != f"upto={last}"])
    return last


def upsert_by_month(
    batches: DataFrame, path: str, state: str, key: str = maintain.KEY,
    order: tuple[str, ...] = maintain.LATEST, trigger: dict = ONCE,
) -> StreamingQuery:
    """Upsert every arriving batch into a committed table partitioned by
    ``part_month``, rewriting only the months it touches.

    The batch and its number, under the query's checkpoint folder, are one commit, so
    a replayed batch is neither lost nor done twice: see
    :func:`curbline.operators.maintain.upsert_months`.
    """

    def merge(rows: DataFrame, batch_id: int) -> None:
        maintain.upsert_months(rows.sparkSession, path, rows, key, order, (state, batch_id))

    return (
        batches.writeStream.foreachBatch(merge)
        .option("checkpointLocation", state)
        .trigger(**trigger)
        .start()
    )


def dedup(cases: DataFrame, key: str = maintain.KEY, ts: str = "open_dt", keep: str = "28 days") -> DataFrame:
    """First arrival of each key; repeats inside the window are dropped."""
    return cases.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key])
