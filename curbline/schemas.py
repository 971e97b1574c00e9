"""Fixed column lists and types."""

from __future__ import annotations

from pyspark.sql import types as T

# The case table, in its column order.
CASE_DDL = """
_id BIGINT, case_enquiry_id BIGINT, open_dt TIMESTAMP, sla_target_dt TIMESTAMP,
closed_dt TIMESTAMP, on_time STRING, case_status STRING, closure_reason STRING,
case_title STRING, subject STRING, reason STRING, type STRING, queue STRING,
department STRING, submitted_photo STRING, closed_photo STRING, location STRING,
fire_district STRING, pwd_district STRING, city_council_district STRING,
police_district STRING, neighborhood STRING, neighborhood_services_district STRING,
ward STRING, precinct STRING, location_street_name STRING, location_zipcode BIGINT,
latitude DOUBLE, longitude DOUBLE, geom_4326 STRING, source STRING,
_ingested_at TIMESTAMP, _full_text STRING
"""
_TYPES = {
    "BIGINT": T.LongType(), "STRING": T.StringType(), "DOUBLE": T.DoubleType(),
    "TIMESTAMP": T.TimestampType(),
}
CASE_SCHEMA = T.StructType(
    [T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in CASE_DDL.split(","))]
)
CASE_COLUMNS = CASE_SCHEMA.fieldNames()

# The columns the chat table serves.
CHAT_COLUMNS = [
    "longitude", "neighborhood", "case_status", "closure_reason", "subject", "type",
    "reason", "sla_target_dt", "on_time", "department", "case_title", "closed_dt",
    "latitude", "open_dt", "case_enquiry_id", "geom_4326",
]

# The monitoring table; names ending in ! are required.
MODEL_METRICS = [
    ("run_timestamp!", "timestamp"), ("window_start!", "timestamp"),
    ("window_end!", "timestamp"), ("n_rows!", "bigint"), ("auc", "double"),
    ("rmse", "double"), ("decay_flag!", "boolean"), ("drift_flag!", "boolean"),
    ("class_balance", "double"), ("drift_share", "double"), ("n_features", "bigint"),
    ("n_drifted", "bigint"), ("dataset_drift", "boolean"), ("notes", "string"),
]
