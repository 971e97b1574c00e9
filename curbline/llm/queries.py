"""The queries of this folder and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curbline.llm import (
    fingerprints, language, license_rules, mixing, packing, quality, run_detection, secret_ledger, signature_join, spelling,
    topk, toxicity, warc_store,
)

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(name: str, table: str, fn: Callable[..., DataFrame], *more: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(spark, *[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in (table, *more)])

    SPARK[name] = run


_register("op1_secret_ledger", "documents", secret_ledger.op1)
_register("op2_exact_dedup", "documents", fingerprints.op2)
_register("op3_license_rules", "documents", license_rules.op3)
_register("op4_warc_store", "pages", warc_store.op4)
_register("op5_language_id", "documents", language.op5)
_register("op6_mixing", "documents", mixing.op6)
_register("op7_packing", "documents", packing.op7)
_register("op8_topk_search", "embeddings", topk.op8)
_register("op9_quality", "documents", quality.op9, "labels")
_register("op10_signature_join", "documents", signature_join.op10)
_register("op11_periodic_runs", "documents", run_detection.op11)
_register("op12_toxicity", "documents", toxicity.op12, "labels")
_register("op13_spelling_groups", "documents", spelling.op13)

SQL["op2_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

SQL["op3_license_rules"] = license_rules.sql()

SQL["op4_warc_store"] = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages
), g AS (
    SELECT page_id, octet_length(body) AS payload_bytes, h, max(page_id) OVER (PARTITION BY body) AS top FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(h, 1 + (i // 8) * 10, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM g
"""

SQL["op8_topk_search"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
