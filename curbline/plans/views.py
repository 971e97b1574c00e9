"""Domain views over the test tables, in Spark and, for the oracles, in SQL.

The test tables hold orders, not service requests. Each order stands for one
case; its customer's nation is the neighbourhood, and so on. ``Views`` builds
the frames; ``SQL_VIEWS`` says the same for the check database.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.operators import filters, maintain, metrics, ranking, vectors

AS_OF = "2001-08-10 00:00:00"
DAY = "2001-08-10"
CENTRE = (42.308, -71.092)
FIRST_INGEST, SECOND_INGEST, STALE_INGEST = (
    "2001-08-02 00:00:00", "2001-08-09 00:00:00", "2001-07-26 00:00:00",
)
BATCH_ORDER = ("_ingested_at", "_id", "closed_dt")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _raw(self) -> DataFrame:
        shipped = self.table("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
        return (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .withColumn(
                "open_dt",
                F.timestamp_add("SECOND", F.col("o_orderkey") * 7919 % 86400, F.col("o_orderdate").cast("timestamp")),
            )
            .withColumn(
                "_days",
                F.expr(
                    "CASE o_orderpriority WHEN '1-URGENT' THEN 180 WHEN '2-HIGH' THEN 365 "
                    "WHEN '3-MEDIUM' THEN 730 WHEN '5-LOW' THEN 1095 END"
                ),
            )
            .withColumn("_days", F.expr("CASE WHEN n_nationkey % 8 = 0 THEN _days div 4 ELSE _days END"))
            .withColumn("sla_target_dt", F.timestamp_add("DAY", F.col("_days"), F.col("open_dt")))
            .withColumn(
                "closed_dt",
                F.expr("CASE WHEN o_orderstatus = 'F' AND CAST(last_ship AS TIMESTAMP) >= open_dt "
                       "THEN CAST(last_ship AS TIMESTAMP) END"),
            )
        )

    def _case_columns(self, raw: DataFrame, extra: dict | None = None, **over) -> DataFrame:
        cols = {
            "_id": F.col("o_orderkey"),
            "case_enquiry_id": F.col("o_orderkey") + 101000000000,
            "open_dt": F.col("open_dt"),
            "sla_target_dt": F.col("sla_target_dt"),
            "closed_dt": F.col("closed_dt"),
            "on_time": F.expr(
                f"CASE WHEN sla_target_dt IS NULL OR coalesce(closed_dt, TIMESTAMP '{AS_OF}') <= sla_target_dt "
                "THEN 'ONTIME' ELSE 'OVERDUE' END"
            ),
            "case_status": F.expr("CASE WHEN o_orderstatus = 'F' THEN 'Closed' ELSE 'Open' END"),
            "closure_reason": F.expr("CASE WHEN o_orderstatus = 'F' THEN 'Case closed' END"),
            "case_title": F.concat("o_orderpriority", F.lit(" request")),
            "subject": F.concat("c_mktsegment", F.lit(" Department")),
            "reason": F.col("o_orderpriority"),
            "type": F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" ")),
            "department": F.col("c_mktsegment"),
            "location": F.expr("CASE WHEN c_acctbal >= -600 THEN c_name END"),
            "neighborhood": F.expr(
                "CASE WHEN c_acctbal < -900 THEN NULL WHEN c_acctbal < -800 THEN ' ' ELSE n_name END"
            ),
            "location_street_name": F.col("c_name"),
            "location_zipcode": (F.col("n_nationkey") + 2100).cast("bigint"),
            "latitude": F.expr("CASE WHEN c_acctbal >= -800 OR c_acctbal < -900 THEN 42.30D + (o_orderkey % 83) * 0.0002D END"),
            "longitude": F.expr("CASE WHEN c_acctbal >= -800 OR c_acctbal < -900 THEN -71.10D + (o_orderkey % 79) * 0.0002D END"),
            "source": F.col("r_name"),
            "_ingested_at": F.lit(FIRST_INGEST).cast("timestamp"),
        } | over
        if extra:
            return raw.select(*[c.alias(n) for n, c in (cols | extra).items()])
        return maintain.align(raw.select(*[c.alias(n) for n, c in cols.items()]))

    @cached_property
    def cases(self) -> DataFrame:
        return self._case_columns(self._raw)

    @cached_property
    def staging(self) -> DataFrame:
        """Re-ingested cases in progress: one row per order line, so a case
        occurs several times, some of them in a stale run."""
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("_line_order"), "l_linenumber", "l_shipdate", "l_returnflag"
        )
        raw = (
            self._raw.where("o_orderstatus = 'P'")
            .join(lines, F.col("o_orderkey") == F.col("_line_order"))
            .withColumn("closed_dt", F.col("l_shipdate").cast("timestamp"))
        )
        return self._case_columns(
            raw,
            _id=F.col("o_orderkey") * 10 + F.col("l_linenumber"),
            case_status=F.lit("Closed"),
            closure_reason=F.lit(None).cast("string"),
            _ingested_at=F.expr(
                f"CASE WHEN l_returnflag = 'R' THEN TIMESTAMP '{STALE_INGEST}' ELSE TIMESTAMP '{SECOND_INGEST}' END"
            ),
        )

    @cached_property
    def target(self) -> DataFrame:
        """The case table before the second run: nothing opened since May."""
        no_stamp = F.when(F.col("neighborhood").isNotNull(), F.col("_ingested_at"))
        return self.cases.where("open_dt < TIMESTAMP '2001-05-01'").withColumn("_ingested_at", no_stamp)

    @cached_property
    def scores(self) -> DataFrame:
        scored = self._case_columns(self._raw, {"priority_score": F.floor(F.col("o_totalprice") / 500) / 1000})
        return scored.select(
            "case_enquiry_id", "neighborhood", "reason", "department", "latitude", "longitude",
            "open_dt", (F.col("on_time") == "ONTIME").cast("int").alias("label"), "priority_score",
        )

    @cached_property
    def ranked(self) -> DataFrame:
        return ranking.rank_and_segment(self.scores)

    @cached_property
    def daily(self) -> DataFrame:
        return metrics.daily_metrics(self.cases)

    @cached_property
    def recent(self) -> DataFrame:
        return metrics.recent_metrics(self.daily, AS_OF, 365)

    @cached_property
    def volume(self) -> DataFrame:
        return metrics.daily_volume(metrics.recent_metrics(self.daily, AS_OF, 730))

    @cached_property
    def overdue(self) -> DataFrame:
        return filters.with_age(filters.overdue_open(self.cases, AS_OF), AS_OF)

    @cached_property
    def requests(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            F.expr("CASE WHEN event_type = 'view' AND user_id % 5 = 0 THEN '/monitor/log' "
                   "ELSE concat('/p', user_id % 8) END").alias("path"),
            F.lit("POST").alias("method"),
            F.expr("CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'signup' AND value > 200 "
                   "THEN 404 ELSE 200 END").alias("status_code"),
            F.col("value").alias("latency_ms"),
            F.expr("CASE WHEN event_type = 'error' THEN props END").alias("error"),
        )

    @cached_property
    def steps(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_type").alias("step"),
            F.col("value").alias("latency_ms"),
            (F.col("value") < 100).alias("success"),
        )

    @cached_property
    def query_log(self) -> DataFrame:
        """One query text per event type, with varying white space."""
        gap = F.expr("repeat(' ', CAST(user_id % 3 + 1 AS INT))")
        return self.table("events").select(
            F.col("ts").cast("timestamp").alias("ts"),
            F.concat(F.lit("SELECT"), gap, F.lit("* FROM cases WHERE type = '"), F.col("event_type"), F.lit("' ")).alias("sql"),
            F.expr("CASE WHEN value < 20 THEN 'hit' ELSE 'miss' END").alias("outcome"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        e = self.table("embeddings").withColumn("c", F.concat(F.lit("c"), "label"))
        return vectors.vector_table(e, "c", "vec_id", "embedding")

    @cached_property
    def lookups(self) -> DataFrame:
        """Every vector asks in another label's column; c10 and c11 do not exist."""
        e = self.table("embeddings").withColumn("c", F.concat(F.lit("c"), (F.col("label") + 3) % 12))
        return vectors.vector_table(e, "c", "vec_id", "embedding").withColumnRenamed("value", "query_id")

    @cached_property
    def turns(self) -> DataFrame:
        """User turns with the assistant turn that follows."""
        c = self.table("conversations")
        reply = c.where("role = 'assistant'").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
        )
        ask = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
        return ask.join(reply, ["conv_id", "turn"])


SQL_VIEWS = f"""
raw0 AS MATERIALIZED (
  SELECT o.*, c.*, n.*, r.*, s.last_ship,
    o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS open_dt,
    CASE o_orderpriority WHEN '1-URGENT' THEN 180 WHEN '2-HIGH' THEN 365
      WHEN '3-MEDIUM' THEN 730 WHEN '5-LOW' THEN 1095 END AS base_days
  FROM orders o JOIN customer c ON o_custkey = c_custkey
  JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) s ON o_orderkey = s.l_orderkey),
raw1 AS (
  SELECT *, open_dt + to_days(CAST(CASE WHEN n_nationkey % 8 = 0 THEN base_days // 4 ELSE base_days END AS INTEGER)) AS sla_target_dt,
    CASE WHEN o_orderstatus = 'F' AND last_ship >= open_dt THEN last_ship END AS first_closed
  FROM raw0),
raw2 AS (
  SELECT *, o_orderkey + 101000000000 AS case_enquiry_id,
    o_orderpriority || ' request' AS case_title, c_mktsegment || ' Department' AS subject,
    o_orderpriority AS reason, ' ' || lower(o_orderpriority) || ' ' AS type, c_mktsegment AS department,
    CASE WHEN c_acctbal >= -600 THEN c_name END AS location,
    CASE WHEN c_acctbal < -900 THEN NULL WHEN c_acctbal < -800 THEN ' ' ELSE n_name END AS neighborhood,
    c_name AS location_street_name, CAST(n_nationkey + 2100 AS BIGINT) AS location_zipcode,
    CASE WHEN c_acctbal >= -800 OR c_acctbal < -900 THEN 42.30::DOUBLE + (o_orderkey % 83) * 0.0002::DOUBLE END AS latitude,
    CASE WHEN c_acctbal >= -800 OR c_acctbal < -900 THEN -71.10::DOUBLE + (o_orderkey % 79) * 0.0002::DOUBLE END AS longitude,
    r_name AS source
  FROM raw1),
cases AS (
  SELECT o_orderkey AS _id, first_closed AS closed_dt,
    CASE WHEN sla_target_dt IS NULL OR coalesce(first_closed, TIMESTAMP '{AS_OF}') <= sla_target_dt THEN 'ONTIME' ELSE 'OVERDUE' END AS on_time,
    CASE WHEN o_orderstatus = 'F' THEN 'Closed' ELSE 'Open' END AS case_status,
    CASE WHEN o_orderstatus = 'F' THEN 'Case closed' END AS closure_reason,
    TIMESTAMP '{FIRST_INGEST}' AS _ingested_at, * EXCLUDE (last_ship, first_closed)
  FROM raw2),
staging AS (
  SELECT o_orderkey * 10 + l_linenumber AS _id, l_shipdate AS closed_dt,
    CASE WHEN sla_target_dt IS NULL OR l_shipdate <= sla_target_dt THEN 'ONTIME' ELSE 'OVERDUE' END AS on_time,
    'Closed' AS case_status, NULL::VARCHAR AS closure_reason,
    CASE WHEN l_returnflag = 'R' THEN TIMESTAMP '{STALE_INGEST}' ELSE TIMESTAMP '{SECOND_INGEST}' END AS _ingested_at,
    raw2.* EXCLUDE (last_ship, first_closed)
  FROM raw2 JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'),
target AS (
  SELECT * REPLACE (CASE WHEN neighborhood IS NOT NULL THEN _ingested_at END AS _ingested_at)
  FROM cases WHERE open_dt < TIMESTAMP '2001-05-01'),
scores AS (
  SELECT case_enquiry_id, neighborhood, reason, department, latitude, longitude, open_dt,
    CAST(on_time = 'ONTIME' AS INTEGER) AS label, floor(o_totalprice / 500) / 1000 AS priority_score FROM cases),
ranked AS (
  SELECT *, CASE WHEN rank_overall <= greatest(1, floor(0.05 * n_all)) THEN 'CRITICAL' ELSE 'SECONDARY' END AS segment
  FROM (SELECT *, row_number() OVER (ORDER BY priority_score DESC, case_enquiry_id) AS rank_overall,
    count(*) OVER () AS n_all FROM scores)),
daily AS (
  SELECT CAST(open_dt AS DATE) AS date, neighborhood, department, reason, source,
    count(*) AS total_cases, count(*) FILTER (case_status <> 'Closed') AS open_cases,
    count(*) FILTER (case_status = 'Closed') AS closed_cases,
    count(*) FILTER (sla_target_dt IS NOT NULL) AS sla_eligible_cases,
    count(*) FILTER (sla_target_dt IS NOT NULL AND on_time = 'ONTIME') AS sla_met_cases,
    avg(CASE WHEN case_status = 'Closed' AND closed_dt IS NOT NULL
      THEN (epoch_us(closed_dt) - epoch_us(open_dt)) / 86400000000.0 * 24 END) AS avg_resolution_hrs,
    count(*) FILTER (sla_target_dt IS NOT NULL AND on_time = 'ONTIME') * 100.0
      / nullif(count(*) FILTER (sla_target_dt IS NOT NULL), 0) AS sla_compliance_pct
  FROM cases GROUP BY ALL),
recent AS (SELECT * FROM daily WHERE date >= DATE '{DAY}' - 365),
volume AS (SELECT date, CAST(sum(total_cases) AS BIGINT) AS daily_volume FROM daily WHERE date >= DATE '{DAY}' - 730 GROUP BY 1),
overdue AS (
  SELECT *, round_even(days_open * 24, 1)::DOUBLE AS overdue_hours FROM (
    SELECT *, round_even((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(open_dt)) / 86400000000.0, 1)::DOUBLE AS days_open
    FROM cases WHERE open_dt >= DATE '{DAY}' - 365 AND case_status = 'Open' AND sla_target_dt < TIMESTAMP '{AS_OF}')),
requests AS (
  SELECT event_id, ts, CASE WHEN event_type = 'view' AND user_id % 5 = 0 THEN '/monitor/log' ELSE '/p' || (user_id % 8) END AS path,
    'POST' AS method, CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'signup' AND value > 200 THEN 404 ELSE 200 END AS status_code,
    value AS latency_ms, CASE WHEN event_type = 'error' THEN props END AS error FROM events),
steps AS (SELECT event_id, ts, event_type AS step, value AS latency_ms, value < 100 AS success FROM events),
query_log AS (
  SELECT ts, 'SELECT' || repeat(' ', user_id % 3 + 1) || '* FROM cases WHERE type = ''' || event_type || ''' ' AS sql,
    CASE WHEN value < 20 THEN 'hit' ELSE 'miss' END AS outcome FROM events),
unit AS (
  SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)),
vectors AS (SELECT 'c' || label AS "column", vec_id AS value, v AS vector FROM unit),
lookups AS (SELECT 'c' || ((label + 3) % 12) AS "column", vec_id AS query_id, v AS vector FROM unit),
matches AS (
  SELECT q.query_id, q."column", v.value, list_dot_product(q.vector, v.vector) AS raw,
    row_number() OVER (PARTITION BY q.query_id ORDER BY list_dot_product(q.vector, v.vector) DESC, v.value) AS place
  FROM lookups q JOIN vectors v ON q."column" = v."column"),
turns AS (
  SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a
  JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')
"""
