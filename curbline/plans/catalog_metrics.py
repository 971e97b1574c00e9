"""Queries for serving aggregates, dashboards, fairness and request logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from curbline.operators import deltas, fairness, filters, maintain, metrics, ranking, requests
from curbline.plans.catalog_tables import CORE, SLICE_SQL, half_filled_actions, upsert_sql
from curbline.plans.registry import query
from curbline.plans.views import AS_OF, BATCH_ORDER, DAY
from curbline.session import fresh_path

LOCAL_WEEK = "CAST(date_trunc('week', CAST((open_dt AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE)) AS DATE)"


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("a01_dashboard_daily", """SELECT CAST(open_dt AS DATE) AS open_date, neighborhood, department, type, reason, case_status, count(*) AS case_count,
    count(*) FILTER (on_time = 'ONTIME') AS on_time_count,
    count(*) FILTER (lower(on_time) = 'true') AS on_time_count_parity FROM cases WHERE case_enquiry_id IS NOT NULL GROUP BY ALL""")
def _(v):
    return metrics.dashboard_daily(v.cases)


@query("a02_weekly_by_type", f"SELECT {LOCAL_WEEK} AS week_start, neighborhood, upper(trim(type)) AS type, count(*) AS n FROM cases GROUP BY ALL")
def _(v):
    return metrics.weekly_counts(v.cases, ["neighborhood", "type"])


@query("a03_weekly_by_department", f"SELECT {LOCAL_WEEK} AS week_start, upper(trim(department)) AS department, count(*) AS n FROM cases GROUP BY ALL")
def _(v):
    return metrics.weekly_counts(v.cases, ["department"])


SLICE_COLS = "snapshot_date, slice_type, slice_group, total_cases, round(ontime_rate, 6) AS ontime_rate, round(closed_rate, 6) AS closed_rate"
RATES = ("ontime_rate", "closed_rate")


@query("a04_slice_metrics", f"SELECT {SLICE_COLS} FROM slices", SLICE_SQL)
def _(v):
    return rounded(fairness.slice_metrics(v.cases, AS_OF), *RATES)


@query("u01_union_slices", f"SELECT {SLICE_COLS} FROM slices", SLICE_SQL)
def _(v):
    parts = [fairness.slice_metrics(v.cases, AS_OF, dims=(d,)) for d in fairness.SLICES]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), *RATES)


@query("a05_slice_medians", "SELECT slice_type, round(median_ontime_rate, 6) AS median_ontime_rate FROM medians", SLICE_SQL)
def _(v):
    return rounded(fairness.slice_medians(fairness.slice_metrics(v.cases, AS_OF)), "median_ontime_rate")


@query("j01_join_medians", """SELECT slice_type, slice_group, round(median_ontime_rate - ontime_rate, 6) AS gap_below_median
    FROM slices JOIN medians USING (slice_type)""", SLICE_SQL)
def _(v):
    m = fairness.slice_metrics(v.cases, AS_OF)
    rows = fairness.join_medians(m, fairness.slice_medians(m))
    return rounded(rows.select("slice_type", "slice_group", "gap_below_median"), "gap_below_median")


@query("a06_bias_alerts", f"""SELECT {SLICE_COLS}, round(median_ontime_rate, 6) AS median_ontime_rate,
    round(gap_below_median, 6) AS gap_below_median, status FROM alerts""", SLICE_SQL)
def _(v):
    alerts = fairness.bias_alerts(fairness.slice_metrics(v.cases, AS_OF))
    return rounded(alerts, *RATES, "median_ontime_rate", "gap_below_median")


@query("a07_alert_count", "SELECT count(*) AS n_alerts, count(*) > 0 AS has_alerts FROM alerts", SLICE_SQL)
def _(v):
    return fairness.alert_count(fairness.bias_alerts(fairness.slice_metrics(v.cases, AS_OF)), DAY)


DAILY_COLS = """date, neighborhood, department, reason, source, total_cases, open_cases, closed_cases, sla_eligible_cases,
    sla_met_cases, round(avg_resolution_hrs, 6) AS avg_resolution_hrs, round(sla_compliance_pct, 6) AS sla_compliance_pct"""


@query("a08_daily_metrics", f"SELECT {DAILY_COLS} FROM daily")
def _(v):
    return rounded(v.daily, "avg_resolution_hrs", "sla_compliance_pct")


@query("a09_filled_metrics", f"""SELECT * REPLACE (coalesce(avg_resolution_hrs, 0) AS avg_resolution_hrs, coalesce(sla_compliance_pct, 0) AS sla_compliance_pct)
    FROM (SELECT {DAILY_COLS} FROM daily WHERE date >= DATE '{DAY}' - 180)""")
def _(v):
    return rounded(metrics.recent_metrics(v.daily, AS_OF, 180, fill=True), "avg_resolution_hrs", "sla_compliance_pct")


@query("a09_recent_metrics", f"SELECT {DAILY_COLS} FROM daily WHERE date >= DATE '{DAY}' - 180")
def _(v):
    return rounded(metrics.recent_metrics(v.daily, AS_OF, 180), "avg_resolution_hrs", "sla_compliance_pct")


for _dim in ("neighborhood", "department"):

    @query(f"a10_critical_by_{_dim}", f"""SELECT {_dim}, count(*) AS n_critical FROM ranked WHERE segment = 'CRITICAL' AND {_dim} IS NOT NULL
        GROUP BY 1 ORDER BY n_critical DESC, 1 LIMIT 5""")
    def _(v, dim=_dim):
        return metrics.critical_top(v.ranked, dim)


PERF_SQL = """perf AS (SELECT CASE WHEN trim(coalesce(neighborhood, '')) = '' THEN 'Unknown / missing neighborhood' ELSE trim(neighborhood) END AS neighborhood,
    count(case_enquiry_id) AS total_open, count(*) FILTER (segment = 'CRITICAL') AS num_crit, avg(priority_score) AS avg_score FROM ranked GROUP BY 1)"""


@query("a11_neighborhood_perf", """SELECT neighborhood, total_open, num_crit, round(avg_score, 6) AS avg_score,
    round(num_crit / total_open::DOUBLE * 100, 6) AS critical_share, neighborhood = 'Unknown / missing neighborhood' AS is_unknown FROM perf""", PERF_SQL)
def _(v):
    return rounded(metrics.neighborhood_perf(v.ranked), "avg_score", "critical_share")


@query("a12_perf_totals", """SELECT count(*) AS n_groups, CAST(sum(total_open) AS BIGINT) AS total_open, CAST(sum(num_crit) AS BIGINT) AS num_crit FROM perf""", PERF_SQL)
def _(v):
    return metrics.perf_totals(metrics.neighborhood_perf(v.ranked))


@query("a13_sla_rate", "SELECT round(sum(sla_met_cases) / sum(sla_eligible_cases)::DOUBLE * 100, 6) AS overall_sla_rate FROM recent")
def _(v):
    return rounded(metrics.sla_rate(v.recent), "overall_sla_rate")


@query("a14_sla_by_dept", """SELECT department, n_eligible, round_even(n_met / n_eligible::DOUBLE * 100, 1)::DOUBLE AS sla_rate FROM (
    SELECT trim(coalesce(department, 'Unknown')) AS department, CAST(sum(sla_eligible_cases) AS BIGINT) AS n_eligible, CAST(sum(sla_met_cases) AS BIGINT) AS n_met
    FROM recent GROUP BY 1) WHERE n_eligible > 0 ORDER BY n_eligible DESC, department LIMIT 10""")
def _(v):
    return metrics.sla_by_dept(v.recent)


@query("a15_avg_resolution", """SELECT round(h / c, 6) AS avg_resolution_hours, round(h / c / 24, 6) AS avg_resolution_days FROM (
    SELECT sum(avg_resolution_hrs * closed_cases) AS h, sum(closed_cases)::DOUBLE AS c FROM daily)""")
def _(v):
    return rounded(metrics.avg_resolution(v.daily), "avg_resolution_hours", "avg_resolution_days")


@query("a16_resolution_by_reason", """SELECT reason, round_even(h, 1)::DOUBLE AS resolution_hours FROM (
    SELECT trim(coalesce(reason, 'Unknown')) AS reason, coalesce(sum(avg_resolution_hrs * closed_cases), 0) / sum(closed_cases)::DOUBLE AS h
    FROM daily GROUP BY 1 HAVING sum(closed_cases) > 0) ORDER BY h DESC, reason LIMIT 15""")
def _(v):
    return metrics.resolution_by_reason(v.daily)


@query("a17_overdue_by_neigh", """SELECT trim(coalesce(neighborhood, 'Unknown')) AS neighborhood, count(case_enquiry_id) AS n_overdue FROM overdue GROUP BY 1""")
def _(v):
    return metrics.overdue_by_neigh(v.overdue)


@query("a17_overdue_total", "SELECT count(*) AS n_overdue FROM overdue")
def _(v):
    return v.overdue.agg(F.count("*").alias("n_overdue"))


for _dim in ("neighborhood", "department", "reason", "source"):

    @query(f"a18_volume_by_{_dim}", f"""SELECT trim(coalesce({_dim}, 'Unknown')) AS {_dim}, CAST(sum(total_cases) AS BIGINT) AS n_cases FROM recent
        GROUP BY 1 HAVING sum(total_cases) > 0 ORDER BY n_cases DESC, 1 LIMIT 10""")
    def _(v, dim=_dim):
        return metrics.volume_by(v.recent, dim)


@query("a18_volume_all", """SELECT dim, label, n_cases, place FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY dim ORDER BY n_cases DESC, label) AS INTEGER) AS place FROM (
      SELECT dim, trim(coalesce(label, 'Unknown')) AS label, CAST(sum(total_cases) AS BIGINT) AS n_cases FROM (
        SELECT 'neighborhood' AS dim, neighborhood AS label, total_cases FROM recent
        UNION ALL SELECT 'department', department, total_cases FROM recent
        UNION ALL SELECT 'reason', reason, total_cases FROM recent
        UNION ALL SELECT 'source', source, total_cases FROM recent) GROUP BY 1, 2)) WHERE place <= 10""")
def _(v):
    return metrics.volume_all(v.recent, ["neighborhood", "department", "reason", "source"])


@query("a19_resolution_by_source", """SELECT source, round_even(h, 1)::DOUBLE AS resolution_hours FROM (
    SELECT trim(coalesce(source, 'Unknown')) AS source, sum(avg_resolution_hrs * closed_cases) / sum(closed_cases)::DOUBLE AS h
    FROM daily GROUP BY 1 HAVING sum(closed_cases) > 0) ORDER BY h DESC, source LIMIT 10""")
def _(v):
    return metrics.resolution_by_source(v.daily)


@query("a19_resolution_by_source_parity", """SELECT source, round_even(h, 1)::DOUBLE AS resolution_hours FROM (
    SELECT trim(coalesce(source, 'Unknown')) AS source, sum(avg_resolution_hrs) AS h
    FROM daily GROUP BY 1 HAVING sum(closed_cases) > 0) ORDER BY h DESC, source LIMIT 10""")
def _(v):
    return metrics.resolution_by_source(v.daily, weighted=False)


@query("a20_daily_volume", "SELECT date, CAST(sum(total_cases) AS BIGINT) AS daily_volume FROM daily GROUP BY 1")
def _(v):
    return metrics.daily_volume(v.daily)


WEEK_SQL = f"""
weeks AS (SELECT CAST(date + CAST((8 - isodow(date)) % 7 AS INTEGER) AS DATE) AS week_label, CAST(sum(total_cases) AS BIGINT) AS volume
  FROM recent GROUP BY 1 HAVING sum(total_cases) > 0),
last AS (SELECT max(date) AS day FROM recent)"""


@query("a21_weekly_history_parity", """SELECT week_label, volume FROM weeks, last WHERE week_label < (SELECT max(week_label) FROM weeks) OR day >= week_label + 6
    ORDER BY week_label DESC LIMIT 52""", WEEK_SQL)
def _(v):
    return metrics.weekly_history(metrics.daily_volume(v.recent))


@query("a21_weekly_history", """SELECT week_label, volume FROM weeks, last WHERE week_label < (SELECT max(week_label) FROM weeks) OR day >= week_label
    ORDER BY week_label DESC LIMIT 52""", WEEK_SQL)
def _(v):
    return metrics.weekly_history(metrics.daily_volume(v.recent), parity=False)


MONTH_SQL = """
sums AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, CAST(sum(daily_volume) AS BIGINT) AS v FROM {0} GROUP BY 1),
months AS (SELECT CAST(m AS DATE) AS month_start, coalesce(v, 0) AS volume FROM
  (SELECT unnest(generate_series((SELECT min(month_start) FROM sums), (SELECT max(month_start) FROM sums), INTERVAL 1 MONTH)) AS m)
  LEFT JOIN sums ON month_start = CAST(m AS DATE)),
ahead AS (SELECT CAST(m + to_months(CAST(step AS INTEGER)) AS DATE) AS month_start, step FROM
  (SELECT max(month_start) AS m FROM months), generate_series(1, 6) t(step))"""
LONG_MONTHS, SHORT_MONTHS = MONTH_SQL.format("volume"), MONTH_SQL.format(f"(SELECT * FROM volume WHERE date >= DATE '{DAY}' - 180)")
TREND_SQL = """SELECT a.month_start, CAST(greatest(0, l.volume + (l.volume - coalesce(p.volume, l.volume)) * step) AS BIGINT) AS forecast{0}
    FROM ahead a, (SELECT * FROM months ORDER BY month_start DESC LIMIT 1) l LEFT JOIN months p ON p.month_start = CAST(l.month_start - INTERVAL 1 MONTH AS DATE)"""
SEASON_SQL = """SELECT a.month_start, coalesce(p.volume, (SELECT max_by(volume, month_start) FROM months)) AS forecast{0}
    FROM ahead a LEFT JOIN months p ON p.month_start = CAST(a.month_start - INTERVAL 12 MONTH AS DATE)"""


def short_volume(v):
    return v.volume.where(F.col("date") >= F.date_sub(F.lit(DAY).cast("date"), 180))


@query("a22_monthly_volume", "SELECT month_start, volume FROM months", LONG_MONTHS)
def _(v):
    return metrics.monthly_volume(v.volume)


@query("a23_month_seasonality", """SELECT CAST(m AS INTEGER) AS month_num, CAST(coalesce(sum(daily_volume), 0) AS BIGINT) AS month_total,
    coalesce(sum(daily_volume), 0) > 0 AS has_data FROM generate_series(1, 12) t(m) LEFT JOIN volume ON month(date) = m GROUP BY 1""")
def _(v):
    return metrics.month_seasonality(v.volume)


_PIVOT = ", ".join(f"CAST(coalesce(sum(total_cases) FILTER (month(date) = {m}), 0) AS BIGINT) AS m{m}" for m in range(1, 13))


@query("a24_topic_seasonality", f"""SELECT trim(coalesce(reason, 'Unknown')) AS reason, {_PIVOT} FROM daily WHERE date >= DATE '{DAY}' - 730
    GROUP BY 1 ORDER BY sum(total_cases) DESC, 1 LIMIT 5""")
def _(v):
    return metrics.topic_seasonality(metrics.recent_metrics(v.daily, AS_OF, 730))


@query("j06_top_topic_rows", f"""SELECT date, reason, CAST(sum(total_cases) AS BIGINT) AS n FROM daily WHERE reason IN (
    SELECT reason FROM recent GROUP BY 1 ORDER BY sum(total_cases) DESC, 1 LIMIT 3) GROUP BY 1, 2""")
def _(v):
    top = metrics.top_topics(v.recent, 3).select("reason")
    return v.daily.join(top, "reason", "left_semi").groupBy("date", "reason").agg(F.sum("total_cases").alias("n"))


@query("a25_top_topics", f"""SELECT trim(coalesce(reason, 'Unknown')) AS reason, CAST(sum(total_cases) AS BIGINT) AS n_cases FROM daily
    WHERE date >= DATE '{DAY}' - 730 GROUP BY 1 ORDER BY n_cases DESC, 1 LIMIT 5""")
def _(v):
    return metrics.top_topics(metrics.recent_metrics(v.daily, AS_OF, 730))


@query("a26_slice_kpis", """SELECT count(*) AS total_open, count(*) FILTER (segment = 'CRITICAL') AS num_segment_critical, least(10, count(*)) AS num_crit,
    printf('%.1f', least(10, count(*)) / count(*)::DOUBLE * 100) AS crit_share FROM ranked WHERE neighborhood = 'NATION_3'""")
def _(v):
    return metrics.slice_kpis(filters.slice_filter(v.ranked, neighborhood="NATION_3"))


@query("a27_queue_stats", """SELECT count(*) AS n_rows, count(*) FILTER (segment = 'CRITICAL') AS n_critical, round(avg(priority_score), 6) AS avg_score FROM (
    SELECT * FROM ranked WHERE department = 'FURNITURE' ORDER BY rank_overall LIMIT 100)""")
def _(v):
    return rounded(ranking.queue_stats(ranking.work_queue(v.ranked, "FURNITURE")), "avg_score")


# --- forecast ---------------------------------------------------------------


@query("w11_trend_forecast", TREND_SQL.format(""), SHORT_MONTHS)
def _(v):
    return metrics.trend_forecast(metrics.monthly_volume(short_volume(v)))


@query("w12_seasonal_forecast", SEASON_SQL.format(""), LONG_MONTHS)
def _(v):
    return metrics.seasonal_forecast(metrics.monthly_volume(v.volume))


@query("w13_forecast_long", SEASON_SQL.format(", 'seasonal' AS method"), LONG_MONTHS)
def _(v):
    return metrics.forecast(metrics.monthly_volume(v.volume))


@query("w13_forecast_short", TREND_SQL.format(", 'trend' AS method"), SHORT_MONTHS)
def _(v):
    return metrics.forecast(metrics.monthly_volume(short_volume(v)))


@query("j07_year_ago", """SELECT a.month_start, a.volume, coalesce(b.volume, 0) AS year_ago FROM months a LEFT JOIN months b
    ON b.month_start = CAST(a.month_start - INTERVAL 12 MONTH AS DATE)""", LONG_MONTHS)
def _(v):
    months = metrics.monthly_volume(v.volume)
    past = months.select(F.add_months("month_start", 12).alias("month_start"), F.col("volume").alias("p"))
    return months.join(past, "month_start", "left").select("month_start", "volume", F.coalesce("p", F.lit(0)).alias("year_ago"))


# --- top lists --------------------------------------------------------------


@query("k01_top_cases", """SELECT case_enquiry_id, priority_score FROM ranked WHERE reason = '1-URGENT' ORDER BY priority_score DESC, case_enquiry_id LIMIT 10""")
def _(v):
    return ranking.top_cases(filters.slice_filter(v.ranked, reason="1-URGENT")).select("case_enquiry_id", "priority_score")


@query("k02_work_queue", """SELECT case_enquiry_id, priority_score, segment FROM ranked WHERE department = 'BUILDING' ORDER BY rank_overall LIMIT 100""")
def _(v):
    return ranking.work_queue(v.ranked, "BUILDING").select("case_enquiry_id", "priority_score", "segment")


@query("k02_all_queues", """SELECT department, case_enquiry_id, queue_rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY department ORDER BY rank_overall) AS INTEGER) AS queue_rank FROM ranked WHERE department IS NOT NULL) WHERE queue_rank <= 100""")
def _(v):
    return ranking.work_queues(v.scores).select("department", "case_enquiry_id", "queue_rank")


@query("k03_overdue_top", """SELECT case_enquiry_id, trim(coalesce(neighborhood, 'Unknown')) AS neighborhood, reason, department, source, days_open, overdue_hours
    FROM overdue ORDER BY days_open DESC, case_enquiry_id LIMIT 100""")
def _(v):
    return metrics.overdue_top(v.overdue)


@query("u02_distinct", "SELECT DISTINCT neighborhood, department FROM cases")
def _(v):
    return v.cases.select("neighborhood", "department").distinct()


# --- request logs -----------------------------------------------------------

P95 = "list_sort(list(latency_ms))[greatest(CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT), 1)]"


@query("a34_request_summary", f"""SELECT count(*) AS total_requests, round_even(avg(latency_ms), 1)::DOUBLE AS avg_latency_ms, round_even({P95}, 1)::DOUBLE AS p95_latency_ms,
    round_even(count(*) FILTER (status_code >= 400) / count(*)::DOUBLE, 3)::DOUBLE AS error_rate,
    max_by(ts, event_id) FILTER (status_code >= 400) AS last_error_ts, max_by(path, event_id) FILTER (status_code >= 400) AS last_error_path,
    max_by(status_code, event_id) FILTER (status_code >= 400) AS last_error_status,
    coalesce(max_by(coalesce(error, ''), event_id) FILTER (status_code >= 400), '') AS last_error_message
    FROM (SELECT * EXCLUDE (event_id), row_number() OVER (ORDER BY ts, event_id) AS event_id FROM requests WHERE path NOT LIKE '/monitor%')""")
def _(v):
    return requests.request_summary(requests.user_requests(v.requests))


@query("a35_by_path", """SELECT path, count(*) AS n_requests, round(avg(latency_ms), 6) AS avg_latency_ms,
    round(count(*) FILTER (status_code >= 400) / count(*)::DOUBLE, 6) AS error_rate FROM requests WHERE path NOT LIKE '/monitor%' GROUP BY 1""")
def _(v):
    return rounded(requests.by_path(requests.user_requests(v.requests)), "avg_latency_ms", "error_rate")


@query("a36_by_step", f"""SELECT step, count(*) AS n_steps, round(avg(latency_ms), 6) AS avg_latency_ms, {P95} AS p95_latency_ms,
    round(count(*) FILTER (NOT success) / count(*)::DOUBLE, 6) AS error_rate FROM steps GROUP BY 1""")
def _(v):
    return rounded(requests.by_step(v.steps), "avg_latency_ms", "error_rate")


@query("w09_p95", f"SELECT {P95} AS p95_latency_ms FROM requests")
def _(v):
    return requests.p95(v.requests)


@query("w09_p95_by_path", f"SELECT path, {P95} AS p95_latency_ms FROM requests GROUP BY 1")
def _(v):
    return requests.p95(v.requests, ["path"])


@query("w10_last_requests", "SELECT event_id, ts, path FROM requests ORDER BY ts DESC, event_id DESC LIMIT 1000")
def _(v):
    return requests.last_n(v.requests, 1000).select("event_id", "ts", "path")


KEY_SQL = r"md5(trim(regexp_replace(sql, '\s+', ' ', 'g')))"


@query("a37_hit_rates", f"""SELECT cache_key, hits, misses, round_even(hits / (hits + misses)::DOUBLE * 100, 2)::DOUBLE AS hit_rate_percent FROM (
    SELECT {KEY_SQL} AS cache_key, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'miss') AS misses FROM query_log GROUP BY 1)""")
def _(v):
    return requests.hit_rates(v.query_log)


@query("r04_ttl_repeats", """SELECT cache_key, CAST(sum(n) - count(s) AS BIGINT) AS hits, CAST(count(s) AS BIGINT) AS misses, CAST(count(s) - 1 AS BIGINT) AS expirations
    FROM secs LEFT JOIN spans ON k = cache_key AND s = sec GROUP BY 1""", f"""
secs AS MATERIALIZED (SELECT {KEY_SQL} AS cache_key, epoch_us(ts) AS sec, count(*) AS n FROM query_log GROUP BY 1, 2),
spans AS (SELECT cache_key AS k, min(sec) AS s FROM secs GROUP BY 1
  UNION ALL -- step
  SELECT k, min(sec) FROM spans JOIN secs ON cache_key = k AND sec > s + 3600000000 GROUP BY k)""")
def _(v):
    return requests.ttl_repeats(v.query_log)


# --- serving tables kept up to date by signed changes ------------------------

# The case table after two batches: the late cases first, then all rows of the second run.
KEPT_COLS = [*CORE, "sla_target_dt", "department", "type", "reason", "source"]
LATE = "on_time = 'OVERDUE'"
KEPT_SQL = upsert_sql(f"({upsert_sql('target', f'(SELECT * FROM staging WHERE {LATE})', KEPT_COLS)})", "staging", KEPT_COLS)


def kept(v, rollup):
    cases, path = fresh_path(v.spark, "cases_by_month"), fresh_path(v.spark, "serving")
    maintain.create_months(v.target.select(*KEPT_COLS), cases)
    deltas.create(v.spark, cases, path, rollup)
    for batch in (v.staging.where(LATE), v.staging):
        maintain.upsert_months(v.spark, cases, batch, order=BATCH_ORDER)
        deltas.refresh(v.spark, cases, path, rollup)
    return deltas.read(v.spark, path, rollup)


@query("a01_dashboard_maintained", """SELECT CAST(open_dt AS DATE) AS open_date, neighborhood, department, type, reason, case_status, count(*) AS case_count,
    count(*) FILTER (on_time = 'ONTIME') AS on_time_count,
    count(*) FILTER (lower(on_time) = 'true') AS on_time_count_parity FROM kept WHERE case_enquiry_id IS NOT NULL GROUP BY ALL""", f"kept AS ({KEPT_SQL})")
def _(v):
    return kept(v, deltas.dashboard())


@query("a08_daily_maintained", """SELECT CAST(open_dt AS DATE) AS date, neighborhood, department, reason, source,
    count(*) AS total_cases, count(*) FILTER (case_status <> 'Closed') AS open_cases, count(*) FILTER (case_status = 'Closed') AS closed_cases,
    count(*) FILTER (sla_target_dt IS NOT NULL) AS sla_eligible_cases,
    count(*) FILTER (sla_target_dt IS NOT NULL AND on_time = 'ONTIME') AS sla_met_cases,
    round(avg(CASE WHEN case_status = 'Closed' AND closed_dt IS NOT NULL THEN (epoch_us(closed_dt) - epoch_us(open_dt)) / 3600000000.0 END), 6) AS avg_resolution_hrs,
    round(count(*) FILTER (sla_target_dt IS NOT NULL AND on_time = 'ONTIME') * 100.0 / nullif(count(*) FILTER (sla_target_dt IS NOT NULL), 0), 6) AS sla_compliance_pct
    FROM kept GROUP BY ALL""", f"kept AS ({KEPT_SQL})")
def _(v):
    return rounded(kept(v, deltas.daily()), "avg_resolution_hrs", "sla_compliance_pct")


@query("a04_slices_maintained", f"""SELECT DATE '{DAY}' AS snapshot_date, slice_type, slice_group, count(*) AS total_cases,
    round(count(*) FILTER (upper(trim(on_time)) = 'ONTIME') / count(*)::DOUBLE, 6) AS ontime_rate,
    round(count(*) FILTER (lower(trim(case_status)) = 'closed') / count(*)::DOUBLE, 6) AS closed_rate
    FROM (SELECT unnest(['neighborhood', 'department', 'source']) AS slice_type, unnest([neighborhood, department, source]) AS slice_group, * FROM kept)
    WHERE slice_group IS NOT NULL AND _ingested_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1, 2, 3""", f"kept AS ({KEPT_SQL})")
def _(v):
    return rounded(deltas.slice_rates(kept(v, deltas.slices()), AS_OF), *RATES)
