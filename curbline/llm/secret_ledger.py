"""Secret scans over an incremental blob ledger.

Every version of a file is named by the SHA-256 of its text. The ledger keeps,
for each blob, the rule versions already run on it and the spans they found; a
scan reads the texts of those blobs only that have a rule version still to run,
each blob once however many paths hold it, and joins the findings back to all
paths.

Defined results: a null text is the empty text; an empty text has no spans; a
path that comes several times comes back as often; a null path is a path like
any other; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.llm.common import HOT_SHARE, attach, bounded_batches, total_of, whole
from curbline.session import cut, fresh_path

# Kind, pattern, group to measure, least length of that group.
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: Raise a rule's version when its pattern changes; only that rule then runs again.
VERSIONS = {"assign": 1, "access": 1, "hex": 1}

_SPANS = "array<struct<kind:string,begin:int,end:int>>"
_LEDGER = f"blob string, rules array<string>, spans {_SPANS}"


def create(spark: SparkSession, path: str) -> str:
    """An empty ledger at ``path``."""
    spark.createDataFrame([], _LEDGER).write.parquet(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_LEDGER).parquet(path)


def _finders():
    """kind -> function(text) -> spans; the quick forms find the same spans as the patterns."""
    assign = re.compile("(?i)" + RULES[0][1], re.ASCII)
    words = ("password", "passwd", "secret", "token", "apikey", "api_key")
    # A failing match runs to the end of its run of characters, so the length can stand in the pattern.
    access = re.compile(r"AKIA[A-Z0-9]{12,}")
    run = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

    def in_assign(text: str):
        low = text.lower()
        if any(w in low for w in words):
            # Here a failing match may swallow the start of a good one, so it is matched, then dropped.
            for m in assign.finditer(text):
                if m.end(2) - m.start(2) >= RULES[0][3]:
                    yield m.span()

    return {
        "assign": in_assign,
        "access": lambda text: (m.span() for m in access.finditer(text)) if "AKIA" in text else (),
        "hex": lambda text: (m.span() for m in run.finditer(text)),
    }


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finders = _finders()
    schema = pa.schema(
        {
            "blob": pa.string(),
            "rules": pa.list_(pa.string()),
            "spans": pa.list_(pa.struct({"kind": pa.string(), "begin": pa.int32(), "end": pa.int32()})),
        }
    )
    for batch in batches:
        todo = batch.column("rules").to_pylist()
        spans = []
        for i, rules in enumerate(todo):
            text = batch.column("text")[i].as_py()
            kinds = [r.rpartition("@")[0] for r in rules]
            spans.append([{"kind": k, "begin": a, "end": b} for k in kinds for a, b in finders[k](text)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("blob"), pa.array(todo, schema.field("rules").type), pa.array(spans, schema.field("spans").type)],
            schema=schema,
        )


def scan(versions: DataFrame, ledger: str, path: str = "path", text: str = "text", rules: dict[str, int] | None = None) -> DataFrame:
    """Scan what the ledger lacks, add it, and return ``path, blob, spans`` for every row.

    ``rules`` maps kinds to versions. Spans are in code points, end exclusive, by start, then kind.
    """
    spark = versions.sparkSession
    bounded_batches(versions)
    wanted = [f"{k}@{v}" for k, v in (rules or VERSIONS).items()]
    every = F.array(*[F.lit(w) for w in wanted])
    source = versions.select(F.col(path).alias("_path"), whole(text).alias("_text"))
    named = source.withColumn("_blob", F.sha2("_text", 256))
    paths = cut(named.select("_path", "_blob"))
    sizes = cut(paths.groupBy("_blob").agg(F.min("_path").alias("_rep"), F.count("*").alias("_n")))

    seen = read(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("_seen"))
    unseen = (
        sizes.join(seen, sizes["_blob"] == seen["blob"], "left")
        .withColumn("rules", F.array_except(every, F.coalesce("_seen", F.array().cast("array<string>"))))
        .where(F.size("rules") > 0)
        .select(F.col("_blob").alias("_b"), "_rep", "rules")
    )
    texts = named.join(unseen, (F.col("_blob") == F.col("_b")) & F.col("_path").eqNullSafe(F.col("_rep"))).select(
        F.col("_blob").alias("blob"), F.col("_text").alias("text"), "rules"
    )
    # The same path and text may come twice; equal blobs have equal spans.
    found = texts.mapInArrow(_scan, _LEDGER).dropDuplicates(["blob"])
    found.select("blob", "rules", "spans").write.mode("append").parquet(ledger)

    order = F.array(*[F.lit(k) for k, *_ in RULES])
    spans = (
        read(spark, ledger)
        .where((F.size("spans") > 0) & F.arrays_overlap("rules", every))
        .select("blob", F.filter(
            F.transform("spans", lambda s: F.struct(
                s["begin"].alias("begin"), F.array_position(order, s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind"),
            )),
            # a row may hold rules that have a newer version
            lambda s: F.exists("rules", lambda r: F.array_contains(every, r) & r.startswith(F.concat(s["kind"], F.lit("@")))),
        ).alias("spans"))
        .groupBy("blob")
        .agg(F.array_distinct(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"))
    )
    # Blobs with spans, and the hot ones, whose paths must not meet in one task either.
    total = total_of(sizes, "_n")
    named = sizes.join(spans, sizes["_blob"] == spans["blob"], "left").where(
        F.col("spans").isNotNull() | (F.col("_n") > max(total // HOT_SHARE, 1))
    )
    joined = attach(paths, named.select("_blob", "_n", "spans"), "_blob", "_n", total, ["_path", "_blob"])
    empty = F.array().cast("array<struct<begin:int,at:bigint,end:int,kind:string>>")
    return joined.select(
        F.col("_path").alias(path),
        F.col("_blob").alias("blob"),
        F.transform(F.coalesce("spans", empty), lambda s: F.struct(s["kind"].alias("kind"), s["begin"].alias("begin"), s["end"].alias("end"))).alias("spans"),
    )


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Digest columns of a first scan of all documents, with a ledger of its own."""
    found = scan(docs.select("doc_id", "text"), create(spark, fresh_path(spark, "ledger")), path="doc_id")
    listed = F.array_join(
        F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k, *_ in RULES],
        F.sha2(listed, 256).alias("base_sha256"),
        listed.alias("spans"),
    )
