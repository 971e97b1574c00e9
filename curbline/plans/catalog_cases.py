"""Queries for projections, filters, text, scalar functions and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from curbline.functions import clock, labels, numeric, text
from curbline.operators import filters, geo, prompts, questions, requests, segments
from curbline.operators.vocab import search, store_index, token_index
from curbline.plans.registry import query
from curbline.plans.views import AS_OF, CENTRE, DAY
from curbline.session import fresh_path

LAT, LON = CENTRE
LOCAL = "(({0} AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"


def dist_sql(lat1, lon1, lat2, lon2) -> str:
    a = (
        f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    )
    return f"(2 * 6371000.0::DOUBLE * atan2(sqrt({a}), sqrt(1 - {a})))"


NEAR_SQL = f"{dist_sql(LAT, LON, 'latitude', 'longitude')} <= 402"


@query("p01_overdue_open", f"""SELECT case_enquiry_id, open_dt, sla_target_dt FROM cases
    WHERE open_dt >= DATE '{DAY}' - 365 AND case_status = 'Open' AND sla_target_dt IS NOT NULL AND sla_target_dt < TIMESTAMP '{AS_OF}'""")
def _(v):
    return filters.overdue_open(v.cases, AS_OF).select("case_enquiry_id", "open_dt", "sla_target_dt")


@query("p02_age", "SELECT case_enquiry_id, days_open, overdue_hours FROM overdue")
def _(v):
    return v.overdue.select("case_enquiry_id", "days_open", "overdue_hours")


@query("p03_sla_lateness", f"""SELECT case_enquiry_id,
    round_even((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(sla_target_dt)) / 86400000000.0, 1)::DOUBLE AS days_overdue FROM overdue""")
def _(v):
    return filters.with_sla_lateness(v.overdue, AS_OF).select("case_enquiry_id", "days_overdue")


@query("p04_slice_filter", """SELECT case_enquiry_id, neighborhood, department FROM ranked
    WHERE neighborhood = 'NATION_3' AND department = 'MACHINERY'""")
def _(v):
    rows = filters.slice_filter(v.ranked, neighborhood="NATION_3", reason=filters.ALL, department="MACHINERY")
    return rows.select("case_enquiry_id", "neighborhood", "department")


@query("p05_id_search", "SELECT case_enquiry_id FROM cases WHERE regexp_matches(CAST(case_enquiry_id AS VARCHAR), '(17|42)$')")
def _(v):
    return filters.id_search(v.cases, "(17|42)$").select("case_enquiry_id")


@query("p06_near", f"SELECT case_enquiry_id, latitude, longitude FROM cases WHERE {NEAR_SQL}")
def _(v):
    return geo.near(v.cases, LAT, LON, 402).select("case_enquiry_id", "latitude", "longitude")


@query("p06_near_strict", f"SELECT case_enquiry_id, latitude, longitude FROM cases WHERE {NEAR_SQL}")
def _(v):
    return geo.within(v.cases, LAT, LON, 402).select("case_enquiry_id", "latitude", "longitude")


@query("p06_near_fallback", "SELECT case_enquiry_id, latitude, longitude FROM cases")
def _(v):
    return geo.near(v.cases, 10.0, 10.0, 402).select("case_enquiry_id", "latitude", "longitude")


@query("p07_labels", """SELECT case_enquiry_id, upper(trim(type)) AS type_upper, trim(coalesce(neighborhood, 'Unknown')) AS hood_unknown,
    CASE WHEN trim(coalesce(neighborhood, '')) = '' THEN 'Unknown / missing neighborhood' ELSE trim(neighborhood) END AS hood_missing,
    coalesce(neighborhood, 'None') AS hood_none FROM cases""")
def _(v):
    return v.cases.select(
        "case_enquiry_id",
        labels.norm_upper("type").alias("type_upper"),
        labels.norm_unknown("neighborhood").alias("hood_unknown"),
        labels.norm_missing("neighborhood").alias("hood_missing"),
        labels.norm_none("neighborhood").alias("hood_none"),
    )


@query("p08_safe_casts", """SELECT event_id,
    CASE lower(trim(b)) WHEN 'true' THEN true WHEN 'false' THEN false END AS as_bool, TRY_CAST(t AS TIMESTAMP) AS as_ts
    FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'TRUE' WHEN 'click' THEN 'false' WHEN 'error' THEN 'yes' ELSE event_type END AS b,
      CASE WHEN event_type = 'error' THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS t FROM events)""")
def _(v):
    b = F.expr("CASE event_type WHEN 'view' THEN 'TRUE' WHEN 'click' THEN 'false' WHEN 'error' THEN 'yes' ELSE event_type END")
    t = F.when(F.col("event_type") == "error", "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return v.table("events").select(
        "event_id", numeric.safe_bool(b).alias("as_bool"), numeric.safe_ts(t).alias("as_ts")
    )


@query("p09_local_date", f"""SELECT case_enquiry_id, CAST({LOCAL.format('open_dt')} AS DATE) AS local_date FROM cases""")
def _(v):
    return v.cases.select("case_enquiry_id", clock.local_date("open_dt").alias("local_date"))


@query("p10_case_durations", f"""SELECT CAST(_id AS VARCHAR) AS case_enquiry_id, upper(trim(department)) AS department, upper(trim(reason)) AS reason,
    upper(trim(type)) AS type, CAST({LOCAL.format('open_dt')} AS DATE) AS open_date_local, open_dt, closed_dt,
    date_sub('day', open_dt, closed_dt) AS days_to_close FROM cases""")
def _(v):
    return filters.case_durations(v.cases)


@query("p11_priority_band", """SELECT case_enquiry_id, CASE WHEN priority_score >= 0.9 THEN 'high' WHEN priority_score >= 0.7 THEN 'medium' ELSE 'low' END AS band FROM scores""")
def _(v):
    return v.scores.select("case_enquiry_id", labels.priority_band("priority_score").alias("band"))


@query("p12_options", "SELECT DISTINCT neighborhood FROM scores WHERE neighborhood IS NOT NULL ORDER BY 1")
def _(v):
    return filters.options(v.scores, "neighborhood")


COMBO_SQL = """combos AS (SELECT DISTINCT neighborhood, reason, department FROM scores
    WHERE neighborhood IS NOT NULL AND reason IS NOT NULL AND department IS NOT NULL)"""


@query("p13_combos", "SELECT neighborhood, reason, department FROM combos", COMBO_SQL)
def _(v):
    return filters.combos(v.scores)


@query("p14_cascade", """SELECT list_name, reason_selected, array_to_string(list_sort(options), ',') AS options FROM (
    SELECT 'reason' AS list_name, '2-HIGH' AS reason_selected, list(DISTINCT reason) AS options FROM combos WHERE neighborhood = 'NATION_7'
    UNION ALL SELECT 'department', '2-HIGH', list(DISTINCT department) FROM combos WHERE neighborhood = 'NATION_7' AND reason = '2-HIGH')""", COMBO_SQL)
def _(v):
    lists = filters.cascade(filters.combos(v.scores), "NATION_7", "2-HIGH")
    return lists.withColumn("options", F.array_join("options", ","))


@query("p15_fill_numeric", """SELECT event_id, coalesce(TRY_CAST(x AS DOUBLE), 0) AS x FROM (
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a' WHEN event_type = 'view' THEN NULL ELSE CAST(user_id AS VARCHAR) || '.5' END AS x FROM events)""")
def _(v):
    x = F.expr("CASE WHEN event_type = 'error' THEN 'n/a' WHEN event_type = 'view' THEN NULL ELSE concat(user_id, '.5') END")
    return numeric.fill_numeric(v.table("events").select("event_id", x.alias("x")), ["x"])


@query("p16_map_points", """SELECT case_enquiry_id, latitude, longitude, priority_score, segment FROM ranked
    WHERE latitude IS NOT NULL AND longitude IS NOT NULL ORDER BY rank_overall LIMIT 2000""")
def _(v):
    cols = ["case_enquiry_id", "latitude", "longitude", "priority_score", "segment"]
    return geo.map_points(v.ranked, cols, [F.asc("rank_overall")])


@query("p16_overdue_map_points", """SELECT case_enquiry_id, latitude, longitude, days_open FROM overdue
    WHERE latitude IS NOT NULL AND longitude IS NOT NULL ORDER BY case_enquiry_id LIMIT 1000""")
def _(v):
    cols = ["case_enquiry_id", "latitude", "longitude", "days_open"]
    return geo.map_points(v.overdue, cols, [F.asc("case_enquiry_id")], 1000)


@query("p17_clamp", "SELECT case_enquiry_id, least(greatest(priority_score * 2 - 0.5::DOUBLE, 0), 1) AS s FROM scores")
def _(v):
    return v.scores.select("case_enquiry_id", numeric.clamp01(F.col("priority_score") * 2 - 0.5).alias("s"))


@query("p18_common_features", "SELECT department, neighborhood, priority_score, reason FROM scores")
def _(v):
    drop = {"case_enquiry_id", "label", "open_dt"}
    ref, cur = filters.common_features(v.cases.withColumn("priority_score", F.lit(0.0)).drop("latitude", "longitude"), v.scores, drop)
    return cur


@query("p19_clean_nan", """SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'error') THEN NULL ELSE value END AS x,
    CASE WHEN event_type = 'view' THEN '[null,1.0]' ELSE '[2.0,1.0]' END AS xs FROM events""")
def _(v):
    x = F.expr("CASE event_type WHEN 'view' THEN double('NaN') WHEN 'click' THEN double('Infinity') WHEN 'error' THEN double('-Infinity') ELSE value END")
    first = F.expr("CASE event_type WHEN 'view' THEN double('NaN') ELSE 2.0D END")
    rows = v.table("events").select("event_id", x.alias("x"), F.array(first, F.lit(1.0)).alias("xs"))
    return numeric.clean_nan(rows).withColumn("xs", F.to_json("xs"))


@query("p20_entities", """SELECT event_id, CASE WHEN event_type IN ('view', 'error') OR (event_type IN ('click', 'signup') AND event_id % 3 = 0) THEN '{}' ELSE '{"k":"' || json_extract_string(props, '$.k') || '"}' END AS entities FROM events""")
def _(v):
    # objects, lists of objects, other JSON, broken JSON, text after the end, and a null value to drop
    shape = F.expr(
        """CASE event_type WHEN 'click' THEN concat('[', props, ', {"k": 0}]') WHEN 'view' THEN '"text"'
        WHEN 'error' THEN left(props, 4) WHEN 'signup' THEN replace(props, '}', ', "z": null}') ELSE props END"""
    )
    tail = F.expr("CASE WHEN event_type IN ('click', 'signup') AND event_id % 3 = 0 THEN ' junk' ELSE ' ' END")
    return v.table("events").select("event_id", text.sorted_json(text.entity_map(F.concat(shape, tail))).alias("entities"))


@query("p21_strip_fences", r"""SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare FROM conversations""")
def _(v):
    fenced = F.concat(F.lit("```sql\n"), "text", F.lit("\n``` "))
    return v.table("conversations").select("conv_id", "turn", text.strip_fences(fenced).alias("bare"))


@query("p22_prompts", """SELECT conv_id, turn, '### Task' || chr(10) || 'Generate a BigQuery SQL query to answer [QUESTION]' || text || '[/QUESTION]'
    || chr(10) || chr(10) || '### Schema' || chr(10) || 'cases' || chr(10) || chr(10) || '### Hints' || chr(10)
    || CASE role WHEN 'user' THEN 'role=''user'', turn=' || turn WHEN 'assistant' THEN 'role=''assistant''' ELSE 'None' END
    || chr(10) || chr(10) || '### Answer' || chr(10) AS prompt FROM conversations""")
def _(v):
    hints = F.expr(
        "CASE role WHEN 'user' THEN array(\"role='user'\", concat('turn=', turn)) "
        "WHEN 'assistant' THEN array(\"role='assistant'\") ELSE array() END"
    )
    rows = v.table("conversations").withColumn("hints", hints)
    return prompts.build_prompts(rows, "cases", "text").select("conv_id", "turn", "prompt")


@query("p23_fingerprint", r"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS cache_key, left(text, 100) AS preview FROM documents""")
def _(v):
    return v.table("documents").select(
        "doc_id", text.fingerprint("text").alias("cache_key"), text.preview_text("text").alias("preview")
    )


@query("p24_user_requests", "SELECT event_id, path FROM requests WHERE path NOT LIKE '/monitor%'")
def _(v):
    return requests.user_requests(v.requests).select("event_id", "path")


@query("p25_preview", """SELECT '{"reason":"' || reason || '","n":' || n || '}' AS row_json, 'reason: ' || reason || ', n: ' || n AS row_text
    FROM (SELECT reason, count(*) AS n FROM cases GROUP BY 1) ORDER BY reason LIMIT 5""")
def _(v):
    counts = v.cases.groupBy("reason").agg(F.count("*").alias("n"))
    return filters.preview(counts, [F.asc("reason")])


@query("p26_prompt_corpus", """SELECT conv_id || ':' || turn AS row_key, question || answer || '</s>' AS text,
    CASE WHEN ('0x' || substr(md5(conv_id || ':' || turn), 1, 4))::INTEGER % 100 < 10 THEN 'test' ELSE 'train' END AS part FROM turns""")
def _(v):
    pairs = v.turns.withColumnsRenamed({"question": "input", "answer": "completion"})
    return prompts.prompt_corpus(pairs, F.concat_ws(":", "conv_id", "turn"), "</s>")


TOKENS_SQL = r"""tokens AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS token FROM documents)"""


@query("v07_token_index", "SELECT token, doc_id FROM tokens WHERE token <> ''", TOKENS_SQL)
def _(v):
    return token_index(v.table("documents"), "doc_id", ["text"])


@query("v07_keyword_search", """SELECT doc_id FROM tokens WHERE token IN ('the', 'and') GROUP BY 1 HAVING count(*) = 2""", TOKENS_SQL)
def _(v):
    index = store_index(token_index(v.table("documents"), "doc_id", ["text"]), fresh_path(v.spark, "token_index"))
    return search(index, "doc_id", ["The", "and"])


@query("v07_case_search", """SELECT case_enquiry_id FROM cases WHERE list_contains(string_split(lower(concat_ws(' ', subject, case_title, location)), ' '), 'machinery')
    AND list_contains(string_split(lower(concat_ws(' ', subject, case_title, location)), ' '), '1-urgent')""")
def _(v):
    index = token_index(v.cases, "case_enquiry_id", ["subject", "case_title", "location"])
    return search(index, "case_enquiry_id", ["MACHINERY", "1-urgent"])


@query("v07_segment_search", """SELECT doc_id FROM (SELECT doc_id, regexp_split_to_array(lower(CASE WHEN n_chars < 400 THEN concat_ws(' ', source, lang, text) ELSE text END), '\\s+') AS w FROM documents)
    WHERE list_contains(w, 'the') AND list_contains(w, 'en')""")
def _(v):
    docs, path = v.table("documents").select("doc_id", "text", "source", "lang", F.col("n_chars") < 400), fresh_path(v.spark, "segments")
    docs = docs.toDF("doc_id", "text", "source", "lang", "short")
    segments.create(docs.where("short"), "doc_id", ["text"], path)
    segments.add(docs.where("NOT short OR short IS NULL"), "doc_id", ["text"], path)
    segments.add(docs.where("short"), "doc_id", ["source", "lang", "text"], path)  # the short ones again, with more words
    segments.merge(v.spark, path, fan=3)
    return segments.search(v.spark, path, ["The", "en"], "doc_id")


@query("u03_common_columns", "SELECT department, latitude, longitude, neighborhood, open_dt, reason FROM cases")
def _(v):
    left, _right = filters.common_features(v.cases, v.scores, {"case_enquiry_id"})
    return left


# --- scalar families --------------------------------------------------------


@query("scalar_string", """SELECT case_enquiry_id, upper(trim(type)) AS u, CASE WHEN case_status = 'Open' THEN 'Open' ELSE 'Closed' END AS i,
    'rate=' || round(location_zipcode / 7.0::DOUBLE, 1) AS c, split_part(location_street_name, '#', 2) AS s, case_title LIKE '1-%' AS w,
    replace(case_title, '-', '_') AS r, printf('%.1f', location_zipcode / 9.0::DOUBLE) AS f, 'cases/' || location_street_name AS obj FROM cases""")
def _(v):
    uri = F.concat(F.lit("s3://bucket/cases/"), "location_street_name")
    return v.cases.select(
        "case_enquiry_id",
        labels.norm_upper("type").alias("u"),
        F.initcap(F.upper("case_status")).alias("i"),
        F.concat(F.lit("rate="), F.round(F.col("location_zipcode") / 7, 1).cast("string")).alias("c"),
        F.element_at(F.split("location_street_name", "#", 2), 2).alias("s"),
        F.col("case_title").startswith("1-").alias("w"),
        F.regexp_replace("case_title", "-", "_").alias("r"),
        F.format_string("%.1f", F.col("location_zipcode") / 9).alias("f"),
        F.regexp_extract(uri, r"^\w+://[^/]+/(.*)$", 1).alias("obj"),
    )


@query("scalar_null_conditional", """SELECT case_enquiry_id, coalesce(neighborhood, 'Unknown') AS a,
    CASE WHEN closed_dt IS NULL THEN 'open' WHEN closed_dt < sla_target_dt THEN 'met' ELSE 'late' END AS b,
    nullif(neighborhood, ' ') AS c FROM cases WHERE latitude IS NOT NULL AND longitude IS NOT NULL""")
def _(v):
    rows = v.cases.na.drop(subset=["latitude", "longitude"])
    return rows.select(
        "case_enquiry_id",
        F.coalesce("neighborhood", F.lit("Unknown")).alias("a"),
        F.when(F.col("closed_dt").isNull(), "open").when(F.col("closed_dt") < F.col("sla_target_dt"), "met").otherwise("late").alias("b"),
        F.nullif(F.col("neighborhood"), F.lit(" ")).alias("c"),
    )


@query("scalar_cast", """SELECT event_id, CAST(user_id AS VARCHAR) AS a, TRY_CAST(event_type AS DOUBLE) AS b,
    CAST(trunc(value) AS INTEGER) AS c, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS d FROM events""")
def _(v):
    return v.table("events").select(
        "event_id",
        F.col("user_id").cast("string").alias("a"),
        F.col("event_type").try_cast("double").alias("b"),
        F.col("value").cast("int").alias("c"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("d"),
    )


@query("scalar_date", f"""SELECT case_enquiry_id, CAST(open_dt AS DATE) AS d, CAST(date_trunc('week', open_dt) AS DATE) AS w, CAST(month(open_dt) AS INTEGER) AS m,
    CAST(date_trunc('month', open_dt) AS DATE) AS ms, CAST(date_trunc('month', open_dt) + INTERVAL 12 MONTH AS DATE) AS ny, strftime(open_dt, '%Y-%m') AS p,
    strftime(open_dt, '%Y-%m-%dT%H:%M:%S') AS iso, date_sub('day', open_dt, TIMESTAMP '{AS_OF}') AS age, open_dt - INTERVAL 28 DAY AS b,
    CAST(dayofweek(open_dt) + 1 AS INTEGER) AS dow FROM cases""")
def _(v):
    d = F.to_date("open_dt")
    return v.cases.select(
        "case_enquiry_id", d.alias("d"), F.to_date(F.date_trunc("week", d)).alias("w"), F.month(d).alias("m"),
        clock.month_start(d).alias("ms"), F.add_months(clock.month_start(d), 12).alias("ny"),
        F.date_format("open_dt", "yyyy-MM").alias("p"), F.date_format("open_dt", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        clock.whole_days("open_dt", clock.instant(AS_OF)).alias("age"), F.timestamp_add("DAY", F.lit(-28), "open_dt").alias("b"),
        F.dayofweek(d).alias("dow"),
    )


@query("scalar_math", """SELECT event_id, round(value, 1) AS r, round_even(value, 1)::DOUBLE AS e, round(sqrt(value), 6) AS s,
    round(sin(radians(value)), 6) AS n, round(atan2(value, 10), 6) AS t, abs(value - 50) AS a, least(greatest(value, 1), 100) AS c,
    value / nullif(user_id, 0) AS q, round(pow(value, 2), 6) AS p FROM events""")
def _(v):
    x = F.col("value")
    return v.table("events").select(
        "event_id", F.round(x, 1).alias("r"), numeric.half_even(x, 1).alias("e"), F.round(F.sqrt(x), 6).alias("s"),
        F.round(F.sin(F.radians(x)), 6).alias("n"), F.round(F.atan2(x, F.lit(10.0)), 6).alias("t"), F.abs(x - 50).alias("a"),
        F.least(F.greatest(x, F.lit(1.0)), F.lit(100.0)).alias("c"), numeric.ratio(x, "user_id").alias("q"), F.round(F.pow(x, 2), 6).alias("p"),
    )


@query("scalar_array", """SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS dot,
    CAST(list_reverse_sort(embedding)[2] AS FLOAT) AS second_best, len(embedding)::INTEGER AS n FROM embeddings""")
def _(v):
    e = F.transform("embedding", lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(e, e, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return v.table("embeddings").select(
        "vec_id", F.round(dot, 6).alias("dot"),
        F.element_at(F.sort_array("embedding", False), 2).alias("second_best"), F.size("embedding").alias("n"),
    )


@query("scalar_json_map", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    '{"a":"' || event_type || '","b":"' || json_extract_string(props, '$.k') || '"}' AS j, 0 AS d FROM events""")
def _(v):
    m = F.from_json("props", "map<string,bigint>")
    named = F.create_map(F.lit("b"), F.col("k").cast("string"), F.lit("a"), F.col("event_type"), F.lit("c"), F.lit(None).cast("string"))
    return (
        v.table("events")
        .select("event_id", "event_type", F.element_at(m, "k").alias("k"), F.coalesce(F.try_element_at(m, F.lit("zz")), F.lit(0)).cast("int").alias("d"))
        .select("event_id", "k", text.sorted_json(F.map_filter(named, lambda _, x: x.isNotNull())).alias("j"), "d")
    )


@query("scalar_hash", r"""SELECT conv_id, turn, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM conversations""")
def _(v):
    return v.table("conversations").select("conv_id", "turn", text.fingerprint("text").alias("h"))


@query("scalar_type_test", """SELECT 'location_zipcode=' || location_zipcode AS zip_hint, 'department=''' || department || '''' AS dept_hint, count(*) AS n FROM cases GROUP BY ALL""")
def _(v):
    def hint(name):  # quoting is decided by the column type, not per value
        value = F.col(name).cast("string")
        quoted = dict(v.cases.dtypes)[name] == "string"
        return F.concat(F.lit(f"{name}='"), value, F.lit("'")) if quoted else F.concat(F.lit(f"{name}="), value)

    return v.cases.groupBy(hint("location_zipcode").alias("zip_hint"), hint("department").alias("dept_hint")).agg(
        F.count("*").alias("n")
    )


# --- questions --------------------------------------------------------------

LIST_SQL = ", ".join(questions.LIST_COLUMNS)


@query("q01_open_on_street", f"""SELECT {LIST_SQL}, location_street_name FROM cases
    WHERE case_status = 'Open' AND reason = '1-URGENT' AND location_street_name ILIKE '%customer#0000007%'""")
def _(v):
    return questions.open_on_street(v.cases, "1-URGENT", "customer#0000007")


@query("q02_most_overdue", """SELECT department, round(avg(CAST(on_time = 'OVERDUE' AS INTEGER)), 6) AS overdue_share FROM cases
    GROUP BY 1 ORDER BY avg(CAST(on_time = 'OVERDUE' AS INTEGER)) DESC, department LIMIT 1""")
def _(v):
    return questions.most_overdue(v.cases).withColumn("overdue_share", F.round("overdue_share", 6))


@query("q03_open_longer_than", f"""SELECT {LIST_SQL}, CAST(date_diff('day', CAST(open_dt AS DATE), DATE '{DAY}') AS INTEGER) AS days_open FROM cases
    WHERE case_status = 'Open' AND date_diff('day', CAST(open_dt AS DATE), DATE '{DAY}') > 100""")
def _(v):
    return questions.open_longer_than(v.cases, AS_OF)


@query("q04_other_source_no_place", f"""SELECT {LIST_SQL}, source FROM cases WHERE source IS DISTINCT FROM 'ASIA' AND location IS NULL""")
def _(v):
    return questions.not_from_source_without_place(v.cases, "ASIA")


@query("q05_busiest_hour", """SELECT CAST(hour(open_dt) AS INTEGER) AS hour_of_day, count(*) AS n FROM cases WHERE reason = '5-LOW'
    GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1""")
def _(v):
    return questions.busiest_hour(v.cases, "5-LOW")


@query("q06_place_and_month", """SELECT neighborhood, CAST(month(open_dt) AS INTEGER) AS month, count(*) AS n FROM cases
    WHERE reason = '1-URGENT' AND year(open_dt) = 2000 GROUP BY 1, 2""")
def _(v):
    return questions.by_place_and_month(v.cases, "1-URGENT", 2000)


@query("q07_count_of_type", f"""SELECT count(*) AS n_all, count(*) FILTER (open_dt >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY) AS n_recent FROM cases
    WHERE type = ' 2-high ' AND neighborhood = 'NATION_5'""")
def _(v):
    return questions.count_of_type(v.cases, " 2-high ", "NATION_5", AS_OF, 60)


@query("q08_open_in", f"SELECT {LIST_SQL} FROM cases WHERE neighborhood = 'NATION_11' AND case_status = 'Open'")
def _(v):
    return questions.open_in(v.cases, "NATION_11")


@query("q09_mean_resolution", """SELECT round(avg(date_sub('hour', open_dt, closed_dt)), 6) AS avg_hours, count(closed_dt) AS n_closed FROM cases""")
def _(v):
    return questions.mean_resolution(v.cases).withColumn("avg_hours", F.round("avg_hours", 6))


@query("q10_ranking", "SELECT neighborhood, count(*) AS n FROM cases WHERE neighborhood IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def _(v):
    return questions.ranking(v.cases, "neighborhood")
