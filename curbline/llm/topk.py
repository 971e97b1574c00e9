"""Exact top-k search by exhaustive term-at-a-time accumulation.

Queries and candidates are dealt into blocks; a task holds one block of each.
Candidates are kept as postings: for each component the rows that have it and
their values. Queries are sparse rows: component by component, their weights
times the postings are added into a dense array of scores, one row per query.
A partition selection keeps the k best of a block, all ties at the border
resolved by id; the blocks' winners are merged per query.

Defined results: components become floor(256 * x), x as double; vectors that are
null or hold null, NaN or infinity, and rows without id, take no part; vectors of
unequal length meet in the components both have; an empty vector scores 0; a
candidate of the query's id is its own row; of several rows with one query id
the smallest vector asks; scores beyond a long are held at its limits before they are ranked.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Components in a block of candidates and in a block of queries, at most.
CANDIDATE_BLOCK, QUERY_BLOCK = 1 << 22, 1 << 20
#: Blocks of candidates for each core of the session, at least, so that small tables use all of them.
BLOCKS_A_CORE = 2
#: Cells of the dense score array.
SCORES = 1 << 20
_LONG = np.iinfo(np.int64)


def _sparse(table: pa.Table, ids: str, values: str):
    """Ids in order, and the (row, component, floor(256 x)) of all components that are not 0."""
    order = np.argsort(table.column(ids).to_numpy(), kind="stable")
    column = table.column(values).combine_chunks().take(pa.array(order))
    lengths = np.diff(column.offsets.to_numpy())
    q = np.floor(256.0 * np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64))
    rows = np.repeat(np.arange(len(order)), lengths)
    terms = np.arange(len(q)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    has = q != 0
    return table.column(ids).to_numpy()[order], rows[has], terms[has], q[has]


def _by_term(rows, terms, values, n: int) -> list:
    order = np.argsort(terms, kind="stable")
    cuts = np.searchsorted(terms[order], np.arange(n + 1))
    return [(rows[order[a:b]], values[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]


def _exact(q, v, terms: int):
    """Both value lists in a type whose sums of products are exact."""
    most = [np.abs(x).max(initial=0) for x in (q, v)]
    if most[0] * most[1] * max(terms, 1) < 2.0**62:
        return q.astype(np.int64), v.astype(np.int64)
    return [np.array([int(y) for y in x] or [], dtype=object) for x in (q, v)]


def _block(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    q_ids, q_rows, q_terms, q_values = _sparse(queries, "_qid", "_qv")
    c_ids, c_rows, c_terms, c_values = _sparse(candidates, "_cid", "_cv")
    n_terms = 1 + int(max(q_terms.max(initial=-1), c_terms.max(initial=-1)))
    q_values, c_values = _exact(q_values, c_values, n_terms)
    out = []
    wide = min(max(len(c_ids), 1), 4096)
    tall = max(1, SCORES // wide)
    for c0 in range(0, len(c_ids), wide):
        part = (c_rows >= c0) & (c_rows < c0 + wide)
        postings = _by_term(c_rows[part] - c0, c_terms[part], c_values[part], n_terms)
        ids = c_ids[c0 : c0 + wide]
        for q0 in range(0, len(q_ids), tall):
            some = (q_rows >= q0) & (q_rows < q0 + tall)
            asked = q_ids[q0 : q0 + tall]
            weights = _by_term(q_rows[some] - q0, q_terms[some], q_values[some], n_terms)
            scores = np.zeros((len(asked), len(ids)), q_values.dtype)
            for (rows, w), (at, v) in zip(weights, postings):
                if not len(rows) or not len(at):
                    continue
                if len(rows) == len(asked) and len(at) == len(ids):
                    scores += np.multiply.outer(w, v)
                else:
                    scores[np.ix_(rows, at)] += np.multiply.outer(w, v)
            if scores.dtype == object:
                scores = np.clip(scores, _LONG.min, _LONG.max)
            for i, qid in enumerate(asked):
                others = np.flatnonzero(ids != qid)
                own = scores[i, others]
                if len(own) > k:
                    border = np.partition(own, len(own) - k)[len(own) - k]
                    over = np.flatnonzero(own > border)
                    # ids are in order, so the first ties are those of the smallest ids
                    best = np.concatenate([over, np.flatnonzero(own == border)[: k - len(over)]])
                else:
                    best = np.arange(len(own))
                out += [(int(qid), int(ids[others[b]]), own[b]) for b in best]
    # Exact order within the block, then k a query leave it.
    out.sort(key=lambda r: (r[0], -r[2], r[1]))
    kept, last, n = [], None, 0
    for r in out:
        last, n = (r[0], n + 1) if r[0] == last else (r[0], 1)
        if n <= k:
            kept.append(r)
    return pa.table({
        "query_id": pa.array([r[0] for r in kept], pa.int64()),
        "vec_id": pa.array([r[1] for r in kept], pa.int64()),
        "score": pa.array([int(r[2]) for r in kept], pa.int64()),
    })


def search(vectors: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best other rows of each row that ``is_query``."""
    spark = vectors.sparkSession
    real = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id).isNotNull() & F.col(vector).isNotNull() & real).select(
        F.col(id).cast("bigint").alias("_id"), F.col(vector).alias("_v"), is_query.alias("_asks")
    )
    seen = rows.agg(
        F.count("*").alias("n"), F.count_if("_asks").alias("asks"), F.max(F.size("_v")).alias("longest")
    ).first()
    longest = max(seen["longest"] or 1, 1)
    per = max(1, CANDIDATE_BLOCK // longest)
    least = -(-seen["n"] // 512)
    c_blocks = max(1, -(-seen["n"] // per), min(BLOCKS_A_CORE * spark.sparkContext.defaultParallelism, least))
    q_blocks = max(1, -(-seen["asks"] // max(1, QUERY_BLOCK // longest)))

    def blocks(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def own(n: int) -> Column:
        return F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")

    asking = rows.where("_asks").groupBy("_id").agg(F.min("_v").alias("_v"))
    left = asking.select(F.col("_id").alias("_qid"), F.col("_v").alias("_qv"), own(q_blocks).alias("_qb"), blocks(c_blocks).alias("_cb"))
    right = rows.select(F.col("_id").alias("_cid"), F.col("_v").alias("_cv"), own(c_blocks).alias("_cb"), blocks(q_blocks).alias("_qb"))
    found = (
        left.groupBy("_qb", "_cb")
        .cogroup(right.groupBy("_qb", "_cb"))
        .applyInArrow(partial(_block, k=k), "query_id bigint, vec_id bigint, score bigint")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op8(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.col("vec_id") % 50 == 0)
