"""Queries for sources, sinks and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from curbline.functions.text import sorted_json
from curbline.operators import fairness, filters, maintain, metrics, model, vocab
from curbline.plans.registry import query
from curbline.plans.views import AS_OF, BATCH_ORDER, DAY, FIRST_INGEST, SECOND_INGEST
from curbline.schemas import CASE_COLUMNS
from curbline.session import fresh_path
from curbline.sources import commits, files, geojson, tables

CORE = ["_id", "case_enquiry_id", "open_dt", "closed_dt", "on_time", "case_status", "neighborhood", "_ingested_at"]
CORE_SQL = ", ".join(CORE)
LATEST_SQL = "QUALIFY row_number() OVER (PARTITION BY case_enquiry_id ORDER BY _ingested_at DESC, _id DESC, closed_dt DESC) = 1"


@query(
    "s01_jsonl_scan",
    f"SELECT {CORE_SQL}, sla_target_dt, location_zipcode, latitude, longitude FROM cases",
)
def _(v):
    path, out = fresh_path(v.spark, "cases_jsonl"), fresh_path(v.spark, "staging")
    lines = v.cases.select(F.to_json(F.struct("*")).alias("value"))
    bad = v.table("region").select(F.concat(F.lit("{not json "), "r_name").alias("value"))
    lines.unionByName(bad).write.text(path)
    return files.load_staging(v.spark, path, out).select(*CORE, "sla_target_dt", "location_zipcode", "latitude", "longitude")


@query(
    "s02_jsonl_sink",
    f"""SELECT _id, case_enquiry_id, TIMESTAMP '{SECOND_INGEST}' AS _ingested_at,
    (SELECT count(*) FROM cases) AS n_written FROM cases""",
)
def _(v):
    path = fresh_path(v.spark, "out_jsonl")
    n = files.write_jsonl(v.cases, path, SECOND_INGEST)
    back = files.read_cases_jsonl(v.spark, path)
    return back.select("_id", "case_enquiry_id", "_ingested_at", F.lit(n).cast("bigint").alias("n_written"))


@query(
    "s03_recent_window",
    f"SELECT {CORE_SQL} FROM cases WHERE open_dt >= TIMESTAMP '{AS_OF}' - INTERVAL 28 DAY",
)
def _(v):
    return filters.recent_window(v.cases, AS_OF).select(*CORE)


@query(
    "s04_keyset_page",
    f"SELECT {CORE_SQL} FROM cases WHERE case_status = 'Open' AND _id > 5000 ORDER BY _id LIMIT 100",
)
def _(v):
    return filters.keyset_page(v.cases, "case_status = 'Open'", 5000, 100).select(*CORE)


@query("s04_id_ranges", "SELECT _id, case_enquiry_id FROM cases")
def _(v):
    return filters.id_ranges(v.cases.select("_id", "case_enquiry_id"), 8)


@query(
    "s05_ingest_audit",
    """SELECT count(*) AS n_rows, CAST(ceil(count(*) / 5000.0) AS BIGINT) AS n_pages, min(_id) AS min_id,
    max(_id) AS max_id, max(_ingested_at) AS ingested_at FROM staging""",
)
def _(v):
    return metrics.ingest_audit(v.staging)


@query(
    "s06_case_table",
    "SELECT _id, case_enquiry_id, case_status, CAST(_ingested_at AS DATE) AS ingest_date FROM staging",
)
def _(v):
    where = fresh_path(v.spark, "case_table")
    name = "curbline_" + where.split("curbline-")[1][:12]
    tables.ensure_case_table(v.spark, name, where)
    tables.ensure_case_table(v.spark, name, where)
    tables.append_cases(v.staging, name)
    v.spark.sql(f"DROP TABLE {name}")  # external: the files stay
    back = v.spark.read.parquet(where)
    return back.select("_id", "case_enquiry_id", "case_status", F.col("ingest_date").cast("date"))


@query("s07_csv_sink", "SELECT case_enquiry_id, priority_score, segment, rank_overall FROM ranked")
def _(v):
    path = fresh_path(v.spark, "scores_csv")
    files.write_csv(v.ranked.select("case_enquiry_id", "priority_score", "segment", "rank_overall"), path)
    schema = "case_enquiry_id bigint, priority_score double, segment string, rank_overall bigint"
    return v.spark.read.schema(schema).csv(path, header=True)


@query("s07_parquet_sink", f"SELECT {CORE_SQL} FROM cases")
def _(v):
    path = fresh_path(v.spark, "cases_parquet")
    files.write_parquet(v.cases, path)
    return v.spark.read.parquet(path).select(*CORE)


@query("s08_replace_table", "SELECT case_enquiry_id, rank_overall, segment FROM ranked")
def _(v):
    path = fresh_path(v.spark, "ranking")
    files.overwrite_table(v.scores.select("case_enquiry_id"), path)
    files.overwrite_table(v.ranked.select("case_enquiry_id", "rank_overall", "segment"), path)
    return v.spark.read.parquet(path)


@query("s09_latest_n", f"SELECT {CORE_SQL} FROM cases ORDER BY open_dt DESC, case_enquiry_id LIMIT 5000")
def _(v):
    return filters.latest_n(v.cases).select(*CORE)


@query(
    "s10_profile",
    f"""SELECT count(*) AS n_rows, CAST({len(CASE_COLUMNS)} AS INTEGER) AS n_columns, min(open_dt) AS first_open,
    max(open_dt) AS last_open, count(DISTINCT neighborhood) AS n_neighborhoods, count(DISTINCT type) AS n_types,
    count(*) FILTER (case_status = 'Open') AS n_open, count(*) FILTER (case_status = 'Closed') AS n_closed FROM cases""",
)
def _(v):
    return metrics.profile(v.cases)


def polygon_features(v):
    """A GeoJSON feature per nation: a square of a 5 x 5 raster over the points."""
    k = F.col("n_nationkey")
    lat = F.lit(42.2999) + (k % 5) * F.lit(17 * 0.0002)
    lon = F.lit(-71.1001) + F.floor(k / 5) * F.lit(16 * 0.0002)
    lat2, lon2 = lat + F.lit(17 * 0.0002), lon + F.lit(16 * 0.0002)
    ring = F.array(*[F.array(x, y) for x, y in ((lon, lat), (lon2, lat), (lon2, lat2), (lon, lat2), (lon, lat))])
    name_key = F.when(k % 4 == 0, "Name").when(k % 4 == 1, "NEIGHBORHOOD").otherwise("name")
    name = F.when(k == 24, F.lit("")).otherwise(F.concat(F.lit(" cell "), k.cast("string")))
    geometry = F.when(k != 23, F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    return v.table("nation").select(
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.create_map(name_key, name).alias("properties"),
                geometry.alias("geometry"),
            )
        ).alias("value")
    )


def read_polygons(v):
    path = fresh_path(v.spark, "cells_geojson")
    polygon_features(v).write.text(path)
    return geojson.read_geojson(v.spark, path, whole_file=False)


@query(
    "s11_geojson",
    """SELECT CASE WHEN n_nationkey = 24 THEN '' ELSE ' cell ' || n_nationkey END AS name, 'Polygon' AS geometry_type
    FROM nation WHERE n_nationkey <> 23""",
)
def _(v):
    return read_polygons(v).select("name", F.get_json_object("geometry", "$.type").alias("geometry_type"))


@query(
    "s12_ref_polygons",
    """SELECT 'CELL ' || n_nationkey AS neighborhood_name, CAST(1 AS INTEGER) AS n_rings, true AS rings_closed,
    round(42.2999 + (n_nationkey % 5) * 17 * 0.0002, 6)::DOUBLE AS min_lat,
    round(-71.1001 + (n_nationkey // 5) * 16 * 0.0002, 6)::DOUBLE AS min_lon
    FROM nation WHERE n_nationkey < 23""",
)
def _(v):
    from curbline.operators import geo

    return geo.ref_neighborhoods(read_polygons(v)).select(
        "neighborhood_name", F.size("rings").alias("n_rings"), "rings_closed",
        F.round("min_lat", 6).alias("min_lat"), F.round("min_lon", 6).alias("min_lon"),
    )


@query(
    "s13_clustered_table",
    """SELECT CAST(date_trunc('week', CAST((open_dt AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE)) AS DATE) AS week_start,
    neighborhood, upper(trim(type)) AS type, count(*) AS n FROM cases GROUP BY ALL""",
)
def _(v):
    path = fresh_path(v.spark, "weekly")
    weekly = metrics.weekly_counts(v.cases, ["neighborhood", "type"])
    files.write_clustered(weekly, "week_start", ["neighborhood", "type"], path)
    return v.spark.read.parquet(path).withColumn("week_start", F.col("week_start").cast("date"))


SLICE_SQL = f"""
slices AS (
  SELECT DATE '{DAY}' AS snapshot_date, slice_type, slice_group, count(*) AS total_cases,
    count(*) FILTER (upper(trim(on_time)) = 'ONTIME') / count(*)::DOUBLE AS ontime_rate,
    count(*) FILTER (lower(trim(case_status)) = 'closed') / count(*)::DOUBLE AS closed_rate
  FROM (
    SELECT 'neighborhood' AS slice_type, neighborhood AS slice_group, * FROM cases
    UNION ALL SELECT 'department', department, * FROM cases
    UNION ALL SELECT 'source', source, * FROM cases)
  WHERE slice_group IS NOT NULL AND _ingested_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1, 2, 3),
medians AS (SELECT slice_type, quantile_disc(ontime_rate, 0.5) AS median_ontime_rate FROM slices GROUP BY 1),
alerts AS (
  SELECT s.*, median_ontime_rate, median_ontime_rate - ontime_rate AS gap_below_median, 'needs_attention' AS status
  FROM slices s JOIN medians USING (slice_type) WHERE ontime_rate < median_ontime_rate - 0.10::DOUBLE),
actions AS (SELECT snapshot_date, slice_type, slice_group FROM alerts WHERE slice_group IN (SELECT min(slice_group) FROM alerts))
"""


@query(
    "s14_json_report",
    """SELECT slice_type, slice_group, total_cases, round(ontime_rate, 6) AS ontime_rate, round(closed_rate, 6) AS closed_rate FROM slices""",
    SLICE_SQL,
)
def _(v):
    path = fresh_path(v.spark, "report")
    files.write_report(fairness.slice_metrics(v.cases, AS_OF), path)
    schema = "slice_type string, slice_group string, total_cases bigint, ontime_rate double, closed_rate double"
    back = v.spark.read.schema(schema).json(path)
    return back.withColumns({c: F.round(c, 6) for c in ("ontime_rate", "closed_rate")})


@query(
    "s15_labelled_window",
    f"""SELECT case_enquiry_id, priority_score, label FROM scores
    WHERE open_dt BETWEEN TIMESTAMP '2001-07-11' AND TIMESTAMP '{AS_OF}' AND priority_score IS NOT NULL AND label IS NOT NULL""",
)
def _(v):
    rows = filters.labelled_window(v.scores, "2001-07-11", AS_OF, "open_dt", "priority_score", "label")
    return rows.select("case_enquiry_id", "priority_score", "label")


@query(
    "s16_bounded_sample",
    "SELECT case_enquiry_id, priority_score FROM scores ORDER BY md5(concat_ws(':', case_enquiry_id, '42')), case_enquiry_id LIMIT 2000",
)
def _(v):
    return filters.bounded_sample(v.scores, "case_enquiry_id", 2000).select("case_enquiry_id", "priority_score")


@query(
    "s17_eval_csv",
    """SELECT DISTINCT lower(c_mktsegment) AS query, 'department' AS "column", c_mktsegment AS expected FROM customer""",
)
def _(v):
    path = fresh_path(v.spark, "eval_csv")
    pairs = v.table("customer").select(
        F.lower("c_mktsegment").alias("query"), F.lit("department").alias("column"), F.col("c_mktsegment").alias("expected")
    )
    files.write_csv(pairs.distinct(), path)
    return files.read_eval(v.spark, path)


@query(
    "s17_eval_json_column",
    """SELECT 'event ' || event_id AS query, json_extract_string(props, '$.k') AS expected_k FROM events WHERE event_type NOT IN ('error', 'view')""",
)
def _(v):
    path = fresh_path(v.spark, "eval_pipe")
    broken = F.expr("CASE event_type WHEN 'error' THEN left(props, length(props) - 1) WHEN 'view' THEN concat(props, ' tail') ELSE props END")
    text = F.concat(F.lit("event "), F.col("event_id"), F.lit("|"), broken).alias("value")
    v.table("events").select(text).write.text(path)
    raw = v.spark.read.text(path)
    head = fresh_path(v.spark, "eval_pipe_headed")
    # each part file of a CSV folder starts with the header line
    raw.select(F.split("value", r"\|").alias("p")).select(
        F.col("p")[0].alias("query"), F.col("p")[1].alias("expected_json")
    ).write.option("quote", "").csv(head, sep="|", header=True)
    return files.read_eval(v.spark, head, "|").select("query", F.col("expected")["k"].alias("expected_k"))


VOCAB_SQL = """
official AS (
  SELECT DISTINCT 'type' AS "column", type AS value FROM cases
  UNION SELECT DISTINCT 'department', department FROM cases
  UNION SELECT DISTINCT 'neighborhood', neighborhood FROM cases
  UNION SELECT DISTINCT 'case_status', case_status FROM cases
  UNION SELECT DISTINCT 'on_time', on_time FROM cases
  UNION SELECT DISTINCT 'reason', reason FROM cases
  UNION SELECT DISTINCT 'subject', subject FROM cases
  UNION SELECT DISTINCT 'source', source FROM cases),
synonyms AS (
  SELECT DISTINCT 'type' AS "column", type AS phrase, upper(trim(type)) AS value FROM cases
  UNION SELECT DISTINCT 'department', lower(department), department FROM cases),
vocab AS (
  SELECT "column", phrase, value FROM (
    SELECT "column", value AS phrase, value, 0 AS p FROM official
    UNION ALL SELECT "column", phrase, value, 1 FROM synonyms)
  WHERE phrase IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY "column", phrase ORDER BY p DESC, value DESC) = 1)
"""


def vocabulary(v):
    columns = ["neighborhood", "department", "source", "case_status", "on_time", "reason", "type", "subject"]
    official = vocab.official_values(v.cases, columns)
    kinds = F.array(
        F.struct(F.lit("type").alias("column"), F.col("type").alias("phrase"), F.upper(F.trim("type")).alias("value")),
        F.struct(F.lit("department").alias("column"), F.lower("department").alias("phrase"), F.col("department").alias("value")),
    )
    return vocab.vocabulary(official, v.cases.select(F.inline(kinds)).distinct())


@query("s18_vocabulary", """SELECT "column", phrase, value FROM vocab""", VOCAB_SQL)
def _(v):
    return vocabulary(v)


@query(
    "s19_faq_table",
    """SELECT conv_id || '-' || turn AS id, question || ' ' || 'user c' || conv_id AS search_text FROM turns""",
)
def _(v):
    path = fresh_path(v.spark, "faq_json")
    v.turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "question", "answer",
        F.array(F.lit("user"), F.concat(F.lit("c"), "conv_id")).alias("keywords"),
    ).write.json(path)
    return files.faq_table(v.spark, path, multiline=False).select("id", "search_text")


@query(
    "s20_freshness",
    """SELECT 'cases' AS table_name, count(*) AS n_rows, max(CAST(open_dt AS DATE)) AS latest_date FROM cases
    UNION ALL SELECT 'daily_metrics', count(*), max(date) FROM daily
    UNION ALL SELECT 'scores', count(*), max(CAST(open_dt AS DATE)) FROM scores""",
)
def _(v):
    return metrics.freshness(
        {"cases": (v.cases, "open_dt"), "daily_metrics": (v.daily, "date"), "scores": (v.scores, "open_dt")}
    )


# --- maintenance ------------------------------------------------------------


@query("t01_latest_per_key", f"SELECT {CORE_SQL} FROM staging WHERE case_enquiry_id IS NOT NULL {LATEST_SQL}")
def _(v):
    return maintain.latest_per_key(v.staging, order=BATCH_ORDER).select(*CORE)


@query("w01_latest_row", f"SELECT {CORE_SQL} FROM (SELECT * FROM cases UNION ALL BY NAME SELECT * FROM staging) {LATEST_SQL}")
def _(v):
    return maintain.latest_per_key(v.cases.unionByName(v.staging), order=BATCH_ORDER).select(*CORE)


def upsert_sql(target: str, batch: str, cols: list[str] = CORE) -> str:
    take = "(t.case_enquiry_id IS NULL OR (s.case_enquiry_id IS NOT NULL AND (t._ingested_at IS NULL OR s._ingested_at >= t._ingested_at)))"
    picks = [
        f"CASE WHEN t.case_enquiry_id IS NULL THEN s.{c} ELSE t.{c} END AS {c}"
        if c in ("_id", "case_enquiry_id")
        else f"CASE WHEN {take} THEN s.{c} ELSE t.{c} END AS {c}"
        for c in cols
    ]
    return (
        f"SELECT {', '.join(picks)} FROM {target} t FULL JOIN "
        f"(SELECT * FROM {batch} WHERE case_enquiry_id IS NOT NULL {LATEST_SQL}) s ON t.case_enquiry_id = s.case_enquiry_id"
    )


@query("t02_upsert", upsert_sql("target", "staging"))
def _(v):
    return maintain.upsert(v.target, v.staging, order=BATCH_ORDER).select(*CORE)


@query("j03_upsert_join", upsert_sql("target", "(SELECT * FROM staging WHERE on_time = 'OVERDUE')"))
def _(v):
    late = v.staging.where("on_time = 'OVERDUE'")
    return maintain.upsert(v.target, late, cols=CORE, order=BATCH_ORDER)


def undated(df, every: int):
    """Some rows lose their ``open_dt``, as some sources leave it out."""
    return df.withColumn("open_dt", F.when(F.col("_id") % every != 0, F.col("open_dt")))


def undated_sql(src: str, every: int) -> str:
    return f"(SELECT * REPLACE (CASE WHEN _id % {every} <> 0 THEN open_dt END AS open_dt) FROM {src})"


@query("t02_upsert_by_month", upsert_sql(undated_sql("target", 7), undated_sql("staging", 5)))
def _(v):
    path = fresh_path(v.spark, "cases_by_month")
    maintain.create_months(undated(v.target, 7), path)
    maintain.upsert_months(v.spark, path, undated(v.staging, 5), order=BATCH_ORDER)
    return commits.read(v.spark, path).select(*CORE)


@query("t03_refresh", f"SELECT _id, case_enquiry_id, case_status FROM staging WHERE case_enquiry_id IS NOT NULL {LATEST_SQL}")
def _(v):
    path = fresh_path(v.spark, "refreshed")
    files.overwrite_table(maintain.refresh(v.staging, ["_id", "case_enquiry_id", "case_status"], order=BATCH_ORDER), path)
    return v.spark.read.parquet(path)


@query(
    "t04_align",
    "SELECT _id, case_enquiry_id, CAST(NULL AS VARCHAR) AS queue, reason, CAST(NULL AS DOUBLE) AS latitude FROM cases",
)
def _(v):
    narrow = v.cases.select("reason", "case_enquiry_id", "_id")
    return maintain.align(narrow).select("_id", "case_enquiry_id", "queue", "reason", "latitude")


@query(
    "t05_chat_table",
    """SELECT longitude, neighborhood, case_status, closure_reason, subject, type, reason, sla_target_dt, on_time,
    department, case_title, closed_dt, latitude, open_dt, CAST(case_enquiry_id AS VARCHAR) AS case_enquiry_id,
    CAST(NULL AS VARCHAR) AS geom_4326 FROM cases WHERE case_enquiry_id IS NOT NULL""",
)
def _(v):
    return maintain.chat_table(v.cases)


@query(
    "t06_has_rows",
    "SELECT name, n > 0 AS has_rows FROM (SELECT 'cases' AS name, count(*) AS n FROM cases UNION ALL SELECT 'later', count(*) FROM cases WHERE open_dt > TIMESTAMP '2030-01-01')",
)
def _(v):
    found = {
        "cases": maintain.has_rows(v.cases),
        "later": maintain.has_rows(v.cases.where("open_dt > TIMESTAMP '2030-01-01'")),
    }
    return v.spark.createDataFrame(list(found.items()), "name string, has_rows boolean")


@query(
    "t07_fairness_tables",
    """SELECT 'slice_metrics' AS table_name, count(*) AS n_rows FROM slices
    UNION ALL SELECT 'bias_alerts', count(*) FROM alerts UNION ALL SELECT 'bias_actions', count(*) FROM alerts""",
    SLICE_SQL,
)
def _(v):
    where = fresh_path(v.spark, "fairness")
    names = tables.ensure_fairness_tables(v.spark, "curbline_" + where.split("curbline-")[1][:12] + "_", where)
    m = fairness.slice_metrics(v.cases, AS_OF)
    alerts = fairness.bias_alerts(m)
    actions = maintain.seed_actions(alerts, v.spark.table(names["bias_actions"]), AS_OF, DAY)
    rows = {"slice_metrics": m, "bias_alerts": alerts, "bias_actions": actions.withColumn("action_date", F.to_date("action_timestamp"))}
    counts = []
    for table, df in rows.items():
        cols = v.spark.table(names[table]).columns
        df.select(*cols).write.insertInto(names[table])
        back = v.spark.read.parquet(f"{where}/{table}")
        counts.append(back.agg(F.count("*").alias("n_rows")).select(F.lit(table).alias("table_name"), "n_rows"))
        v.spark.sql(f"DROP TABLE {names[table]}")
    return vocab.union_all(counts)


@query(
    "t08_append_snapshot",
    f"""SELECT slice_type, slice_group, total_cases, snapshot_date FROM slices
    UNION ALL SELECT slice_type, slice_group, total_cases, snapshot_date - 7 FROM slices""",
    SLICE_SQL,
)
def _(v):
    path = fresh_path(v.spark, "snapshots")
    now = fairness.slice_metrics(v.cases, AS_OF)
    for df in (now.withColumn("snapshot_date", F.date_sub("snapshot_date", 7)), now, now):  # a rerun adds nothing
        maintain.append_snapshot(df, path)
    return v.spark.read.parquet(path).select(
        "slice_type", "slice_group", "total_cases", F.col("snapshot_date").cast("date")
    )


def half_filled_actions(v, alerts):
    """Actions exist for the alerts of the first slice group only."""
    first = alerts.agg(F.min("slice_group")).scalar()
    return alerts.where(F.col("slice_group") == first).select("snapshot_date", "slice_type", "slice_group")


@query(
    "t09_seed_actions",
    f"""SELECT TIMESTAMP '{AS_OF}' AS action_timestamp, snapshot_date, slice_type, slice_group,
    'ontime_rate=' || round(ontime_rate * 100, 1) || '%; median=' || round(median_ontime_rate * 100, 1)
      || '%; gap=' || round(gap_below_median * 100, 1) || 'pts below median' AS issue_summary,
    '' AS action_taken, '' AS expected_tradeoff, '' AS owner
    FROM alerts a WHERE NOT EXISTS (SELECT 1 FROM actions b WHERE a.snapshot_date = b.snapshot_date
      AND a.slice_type = b.slice_type AND a.slice_group = b.slice_group)""",
    SLICE_SQL,
)
def _(v):
    alerts = fairness.bias_alerts(fairness.slice_metrics(v.cases, AS_OF))
    return maintain.seed_actions(alerts, half_filled_actions(v, alerts), AS_OF, DAY)


@query(
    "j02_missing_actions",
    """SELECT slice_type, slice_group FROM alerts a WHERE NOT EXISTS (SELECT 1 FROM actions b
    WHERE a.snapshot_date = b.snapshot_date AND a.slice_type = b.slice_type AND a.slice_group = b.slice_group)""",
    SLICE_SQL,
)
def _(v):
    alerts = fairness.bias_alerts(fairness.slice_metrics(v.cases, AS_OF))
    return maintain.missing_actions(alerts, half_filled_actions(v, alerts)).select("slice_type", "slice_group")


@query(
    "j04_canonicalise",
    """SELECT case_enquiry_id, c.type, coalesce(value, c.type) AS type_canonical FROM cases c
    LEFT JOIN vocab w ON w."column" = 'type' AND w.phrase = c.type""",
    VOCAB_SQL,
)
def _(v):
    rows = vocab.canonicalise(v.cases.select("case_enquiry_id", "type"), vocabulary(v), "type", "type_canonical")
    return rows.select("case_enquiry_id", "type", "type_canonical")
