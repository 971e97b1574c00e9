"""Vector lookup per column, and the grounding of entities built on it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curbline.session import cut

BLOCK_ROWS = 4096  # vectors per block and queries per slice: bounds one task's work
SMALL_BYTES = 32 << 20  # a vocabulary that travels to the queries holds no more

# Answer bands and texts of the question lookup.
ANSWER_AT = 0.7
CAVEAT_AT = 0.5
HINT_AT = 0.1
GROUND_AT = 0.4


def vector_table(df: DataFrame, column: str, value: str, vec: str) -> DataFrame:
    """(column, value, vector) with unit-length vectors; zero vectors stay zero."""
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    unit = F.when(F.col("n") > 0, F.transform("v", lambda x: x / F.col("n"))).otherwise(F.col("v"))
    return (
        df.select(F.col(column).alias("column"), F.col(value).alias("value"), v.alias("v"))
        .withColumn("n", norm)
        .select("column", "value", unit.alias("vector"))
    )


def topk(queries: DataFrame, vectors: DataFrame, k: int = 1, threshold: float = 0.0) -> DataFrame:
    """The ``k`` best values per query within its column; threshold afterwards.

    queries: query_id, column, vector; vectors: column, value, vector.

    Exact in both forms. A vocabulary of at most one block and SMALL_BYTES is broadcast. A
    larger one is spread over blocks of bounded size and its queries over
    slices; each (column, block, slice) is one matrix product that returns its
    own best ``k`` rows per query, and a window merges the blocks. A hot column
    gets more blocks and slices, not a bigger task. Queries whose column has no
    vectors give no rows. Ties go to the smaller value.
    """
    n_vectors = vectors.groupBy("column").agg(
        F.count("*").alias("n_vectors"), F.sum(F.size("vector")).alias("n_numbers")
    )
    n_queries = queries.groupBy("column").agg(F.count("*").alias("n_queries"))
    plan = cut(n_vectors.join(n_queries, "column"))  # a row per column
    total, numbers = plan.agg(F.sum("n_vectors"), F.sum("n_numbers")).first()
    if (total or 0) <= BLOCK_ROWS and (numbers or 0) * 8 <= SMALL_BYTES:
        return _topk_small(queries, vectors.join(plan.select("column"), "column", "left_semi"), k, threshold)

    sizes = plan.select(
        F.col("column").alias("_column"),
        F.ceil(F.col("n_vectors") / BLOCK_ROWS).cast("int").alias("n_blocks"),
        F.ceil(F.col("n_queries") / BLOCK_ROWS).cast("int").alias("n_slices"),
    )
    if plan.count() <= BLOCK_ROWS:
        sizes = F.broadcast(sizes)
    keys = ["column", "block", "slice"]
    own = F.col("column") == F.col("_column")
    vec = F.col("vector").cast("array<double>").alias("vector")
    q = (
        queries.join(sizes, own)
        .withColumn("slice", F.pmod(F.xxhash64("query_id"), "n_slices").cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select(*keys, "query_id", vec)
    )
    v = (
        vectors.join(sizes, own)
        .withColumn("block", F.pmod(F.xxhash64("value"), "n_blocks").cast("int"))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1)))
        .select(*keys, "value", vec)
    )

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "value": [], "raw": []})
        values, matrix = _matrix(right)
        return _best_of(left["query_id"].to_numpy(), np.vstack(left["vector"].to_numpy()), values, matrix, k)

    found = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(best, _found_schema(queries, vectors))
    order = W.partitionBy("query_id").orderBy(F.desc("raw"), F.asc("value"))
    ranked = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return _finish(ranked, threshold)


def _topk_small(queries: DataFrame, vectors: DataFrame, k: int, threshold: float) -> DataFrame:
    """All vectors fit one block (the caller has counted them): they travel to
    the queries, which are not shuffled at all."""
    by_column = {}
    for name, part in vectors.select("column", "value", F.col("vector").cast("array<double>").alias("vector")).toPandas().groupby("column"):
        by_column[name] = _matrix(part)
    shared = queries.sparkSession.sparkContext.broadcast(by_column)

    def best(batches):
        for pdf in batches:
            for name, part in pdf.groupby("column"):
                if name not in shared.value:
                    continue
                values, matrix = shared.value[name]
                for at in range(0, len(part), 1024):
                    some = part.iloc[at : at + 1024]
                    out = _best_of(some["query_id"].to_numpy(), np.vstack(some["vector"].to_numpy()), values, matrix, k)
                    n = min(k, len(values))
                    yield out.assign(place=np.tile(np.arange(1, n + 1, dtype="int32"), len(some)))

    ask = queries.select("query_id", "column", F.col("vector").cast("array<double>").alias("vector"))
    return _finish(ask.mapInPandas(best, _found_schema(queries, vectors) + ", place int"), threshold)


def _matrix(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    part = part.sort_values("value", kind="stable")
    return part["value"].to_numpy(), np.vstack(part["vector"].to_numpy())


def _best_of(ids, asked, values, matrix, k: int) -> pd.DataFrame:
    """Best ``k`` per query of one block. Selects the k-th score first, keeps all
    rows at or above it, and puts only those in order, by score, then value."""
    scores = asked @ matrix.T
    n = min(k, len(values))
    border = np.partition(scores, len(values) - n, axis=1)[:, len(values) - n]
    row, col = np.nonzero(scores >= border[:, None])
    order = np.lexsort((col, -scores[row, col], row))  # values are in order, so are their places
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(ids)))
    top = np.arange(len(row)) - first[row] < n
    row, col = row[top], col[top]
    return pd.DataFrame({"query_id": np.asarray(ids)[row], "value": values[col], "raw": scores[row, col]})


def _found_schema(queries: DataFrame, vectors: DataFrame) -> str:
    ids, values = queries.schema["query_id"].dataType, vectors.schema["value"].dataType
    return f"query_id {ids.simpleString()}, value {values.simpleString()}, raw double"


def _finish(ranked: DataFrame, threshold: float) -> DataFrame:
    return ranked.where(F.col("raw") >= threshold).select(
        "query_id", "place", "value", F.round("raw", 4).alias("score")
    )


def faq_answer(
    queries: DataFrame, faqs: DataFrame, vectors: DataFrame, caveat: str, default: str
) -> DataFrame:
    """Best question per query: its answer, the answer with a caveat, or a default.

    The bands apply to the rounded score; a query without match gets the default.
    """
    hit = topk(queries, vectors, 1, CAVEAT_AT).join(
        faqs.select(F.col("id").alias("value"), "answer"), "value"
    )
    text = (
        F.when(F.col("score") >= ANSWER_AT, F.col("answer"))
        .when(F.col("score") >= CAVEAT_AT, F.concat("answer", F.lit("\n\n" + caveat)))
        .otherwise(F.lit(default))
    )
    return queries.select("query_id").join(hit, "query_id", "left").select(
        "query_id", F.col("value").alias("faq_id"), "score", text.alias("answer_text")
    )


def hints(entities: DataFrame, vectors: DataFrame, threshold: float = HINT_AT) -> DataFrame:
    """``column='value'`` per request (numbers unquoted); unmatched entities give none.

    entities: request_id, entity_id, column, vector.
    """
    found = topk(entities.select(F.col("entity_id").alias("query_id"), "column", "vector"), vectors, 1, threshold)
    numeric = dict(vectors.dtypes)["value"] not in ("string",)
    value = F.col("value").cast("string")
    shown = value if numeric else F.concat(F.lit("'"), value, F.lit("'"))
    return (
        entities.select("request_id", F.col("entity_id").alias("query_id"), "column")
        .join(found, "query_id")
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_list(F.concat("column", F.lit("="), shown))).alias("hints"))
    )


def ground(entities: DataFrame, vectors: DataFrame, known: list[str], threshold: float = GROUND_AT) -> DataFrame:
    """Replace the raw value of known columns by the best match.

    entities: entity_id, column, raw, vector. Without a match, and for columns
    that are not known, the raw value stays.
    """
    ask = entities.where(F.col("column").isin(known)).select(
        F.col("entity_id").alias("query_id"), "column", "vector"
    )
    found = topk(ask, vectors, 1, threshold).select(
        F.col("query_id").alias("entity_id"), F.col("value").cast("string").alias("match"), "score"
    )
    return entities.join(found, "entity_id", "left").select(
        "entity_id",
        "column",
        "raw",
        F.coalesce("match", F.col("raw").cast("string")).alias("grounded"),
        F.col("match").isNotNull().alias("matched"),
    )


def retrieval_accuracy(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of cases whose keys all agree.

    predicted: case_id, key, value; expected: case_id, key, value. A missing
    prediction is a mismatch; unexpected keys do not matter.
    """
    same = expected.alias("e").join(
        predicted.alias("p"),
        (F.col("e.case_id") == F.col("p.case_id")) & (F.col("e.key") == F.col("p.key")),
        "left",
    ).select(
        F.col("e.case_id"),
        F.coalesce(F.col("e.value") == F.col("p.value"), F.lit(False)).alias("ok"),
    )
    return (
        same.groupBy("case_id")
        .agg(F.bool_and("ok").alias("passed"))
        .agg(
            F.count("*").alias("n_cases"),
            F.count_if("passed").alias("n_passed"),
            (F.avg(F.col("passed").cast("int")) * 100).alias("accuracy_pct"),
        )
    )
