"""A content-addressed archive of WARC records.

``write`` keeps three things below one folder: the payload bytes, once for each
SHA-256 (compressed, with the digest to verify them by); the exact header block
of every record; and, joined from those two, the WARC files themselves. ``read``
parses the files back, checks each payload against the digest its header
states, and resolves revisit records through a join with the record they name.

Defined results: a null payload is the empty one; a record without id keeps a
null id; of equal payloads the record with the largest id is the response (of
rows equal in both, one of them), the others revisit it; records below
``least_bytes`` are all responses; a null or many-line URL is written without
line ends; an empty table gives empty archives; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.llm.common import attach, bounded_batches, total_of, whole
from curbline.session import cut, fresh_path

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
_LINE = "\r\n"
#: The date written into every record; an argument of ``write``.
DATE = "2020-01-01T00:00:00Z"
#: Records a file holds at most, which bounds what one task reads.
FILE_RECORDS = 20_000
#: Shuffles of many small partitions are merged into files of about so many bytes before compression, but not below one file a core.
FILE_BYTES = 4 << 20
#: What a record's header counts as in that.
HEADER_BYTES = 1 << 10


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests, length and compressed bytes of each payload."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data = [batch.column("_payload")[i].as_buffer() for i in range(batch.num_rows)]
        raw = [d.to_pybytes() for d in data]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_id"),
                batch.column("_url"),
                pa.array([hashlib.sha256(d).hexdigest() for d in raw], pa.string()),
                pa.array([base32_sha1(d) for d in raw], pa.string()),
                pa.array([len(d) for d in raw], pa.int64()),
                pa.array([pack.compress(d) for d in raw], pa.binary()),
            ],
            names=["_id", "_url", "_sha", "_sha1", "_bytes", "_packed"],
        )


def _urn(*columns: Column) -> Column:
    """A name-based UUID of the columns."""
    h = F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("-")) for c in columns]))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(
        F.lit("urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12)
    )


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_LINE))


def _http(size: Column) -> Column:
    return F.concat(
        F.lit(f"HTTP/1.1 200 OK{_LINE}Content-Type: text/html; charset=utf-8{_LINE}Content-Length: "),
        size.cast("string"),
        F.lit(_LINE * 2),
    )


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the stored payload by its text, verified against its name."""
    for batch in batches:
        out = []
        for sha, data in zip(batch.column("_sha").to_pylist(), batch.column("_packed").to_pylist()):
            payload = zstandard.ZstdDecompressor().decompress(data)
            if hashlib.sha256(payload).hexdigest() != sha:
                raise ValueError(f"stored payload {sha} does not match its digest")
            out.append(payload.decode())
        keep = ["id", "header", "http"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.string())], names=[*keep, "_payload"])


def write(
    pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, date: str = DATE
) -> None:
    """Write payload store, headers and WARC files below ``path``."""
    spark = pages.sparkSession
    bounded_batches(pages)
    kind = pages.schema[id].dataType.simpleString()
    rows = pages.select(
        F.col(id).alias("_id"),
        F.regexp_replace(whole(url), r"[\r\n]", "").alias("_url"),
        whole(payload).alias("_payload"),
    ).mapInArrow(_digests, f"_id {kind}, _url string, _sha string, _sha1 string, _bytes bigint, _packed binary")
    meta = cut(rows.drop("_packed").withColumn("_row", F.monotonically_increasing_id()))
    total, volume = meta.agg(F.count("*"), F.sum(F.col("_bytes") + HEADER_BYTES)).first()
    files = max(spark.sparkContext.defaultParallelism, -(-(volume or 0) // FILE_BYTES))
    groups = cut(
        meta.groupBy("_sha").agg(
            F.max(F.struct("_id", "_row", "_url")).alias("_first"), F.max("_sha1").alias("_sha1"), F.max("_bytes").alias("_bytes"), F.count("*").alias("_n")
        ).coalesce(files)
    )

    # One row of each group brings the payload into the store; the key holds one row but for repeated rows.
    keyed = lambda sha, key: F.concat_ws(":", sha, F.coalesce(key.cast("string"), F.lit("")))
    holders = groups.select(keyed(F.col("_sha"), F.col("_first._id")).alias("_k"))
    rows.select(keyed(F.col("_sha"), F.col("_id")).alias("_k"), "_sha", "_bytes", "_packed").join(holders, "_k", "left_semi").dropDuplicates(
        ["_k"]
    ).drop("_k").coalesce(files).write.option("compression", "none").parquet(f"{path}/payloads")

    first = groups.select("_sha", "_first", "_n")
    urn = _urn(F.col("_id"), F.col("_row"), F.col("_url"))
    named = attach(meta, first, "_sha", "_n", total, ["_row"]).select(
        "_id", "_url", "_sha", "_sha1", "_bytes", "_n",
        ((F.col("_first._row") == F.col("_row")) | (F.col("_bytes") < least_bytes)).alias("_is_response"),
        urn.alias("_urn"),
        _urn(F.col("_first._id"), F.col("_first._row"), F.col("_first._url")).alias("_refers"),
        F.col("_first._url").alias("_refers_url"),
    )
    http = _http(F.col("_bytes"))
    size = F.octet_length(http) + F.when(F.col("_is_response"), F.col("_bytes")).otherwise(0)
    nothing = F.lit("")
    header = F.concat(
        F.lit(VERSION + _LINE),
        _line("WARC-Type", F.when(F.col("_is_response"), "response").otherwise("revisit")),
        _line("WARC-Record-ID", F.concat(F.lit("<"), "_urn", F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("_url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "_sha1")),
        F.when(
            F.col("_is_response"), nothing
        ).otherwise(
            F.concat(
                _line("WARC-Profile", F.lit(PROFILE)),
                _line("WARC-Refers-To", F.concat(F.lit("<"), "_refers", F.lit(">"))),
                _line("WARC-Refers-To-Target-URI", F.col("_refers_url")),
            )
        ),
        F.coalesce(_line("WARC-Page-ID", F.col("_id").cast("string")), nothing),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", size.cast("string")),
    )
    named.select(
        F.col("_id").alias("id"), "_urn", "_sha", "_is_response",
        F.when(F.col("_bytes") < least_bytes, F.col("_n")).otherwise(1).alias("_n"),
        header.alias("header"), http.alias("http"),
    ).coalesce(files).write.parquet(f"{path}/headers")
    records(spark, path).select("record").coalesce(files).write.option("lineSep", RECORD_END).option("compression", "gzip").option(
        "maxRecordsPerFile", FILE_RECORDS
    ).text(f"{path}/warc")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record as written, rebuilt from headers and payloads: ``id, record``."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads").select("_sha", "_packed")
    responses, revisits = headers.where("_is_response"), headers.where("NOT _is_response")
    # Only payloads below the least size have several responses; those are short enough to send to all.
    counts = responses.groupBy("_sha").agg(F.count("*").alias("_n"))
    if counts.where("_n > 1").isEmpty():
        full = responses.join(payloads, "_sha")
    else:
        stored = payloads.join(counts, "_sha")
        full = attach(responses.drop("_n"), stored, "_sha", "_n", total_of(counts, "_n"), ["_urn"])
    kind = headers.schema["id"].dataType.simpleString()
    unpacked = full.select("id", "header", "http", "_sha", "_packed").mapInArrow(
        _unpack, f"id {kind}, header string, http string, _payload string"
    )
    block = F.concat("header", F.lit(_LINE), "http", "_payload")
    return unpacked.select("id", block.alias("record")).unionByName(
        revisits.select("id", F.concat("header", F.lit(_LINE), "http").alias("record"))
    )


def unzipped(data: pa.Buffer) -> bytes:
    """A gzip file of one member or of many, as archives have one a record."""
    view, at, out = memoryview(data), 0, []
    while at < len(view):
        member = zlib.decompressobj(47)
        while not member.eof and at < len(view):
            part = view[at : at + (1 << 16)]
            out.append(member.decompress(part))
            at += len(part) - len(member.unused_data)
        if not member.eof:
            raise ValueError("gzip member is cut short")
    return b"".join(out)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The responses and revisits of whole WARC files, their payloads checked where a SHA-1 is given; other records are passed over."""
    names = ["urn", "type", "id", "digest", "refers", "bytes"]
    for batch in batches:
        for i in range(batch.num_rows):
            data = batch.column("content")[i].as_buffer()
            data = unzipped(data) if batch.column("path")[i].as_py().endswith(".gz") else data.to_pybytes()
            at, rows = 0, []
            while at < len(data):
                end = data.index(b"\r\n\r\n", at)
                lines = data[at:end].decode().split(_LINE)
                if lines[0] != VERSION:
                    raise ValueError(f"no WARC record at byte {at}")
                field = dict(line.split(": ", 1) for line in lines[1:])
                start, size = end + 4, int(field["Content-Length"])
                block = data[start : start + size]
                at = start + size + 4
                if data[at - 4 : at] != b"\r\n\r\n":
                    raise ValueError(f"record before byte {at} is cut short")
                if field["WARC-Type"] not in ("response", "revisit"):
                    continue
                body = block[block.index(b"\r\n\r\n") + 4 :]
                given = field.get("WARC-Payload-Digest", "")
                digest = given.removeprefix("sha1:") if given.startswith("sha1:") else base32_sha1(body)
                if field["WARC-Type"] == "response" and base32_sha1(body) != digest:
                    raise ValueError(f"payload of {field['WARC-Record-ID']} does not match its digest")
                rows.append((
                    field["WARC-Record-ID"], field["WARC-Type"], field.get("WARC-Page-ID"), digest, field.get("WARC-Refers-To"), len(body),
                ))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.string()] * 5 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files (``.warc`` or ``.txt``, plain or gzip): id, full payload's length and digest, type, and the id referred to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,warc}*").load(f"{path}/warc").select("path", "content")
    parsed = cut(files.mapInArrow(_parse, "urn string, type string, id string, digest string, refers string, bytes bigint"))
    revisits = parsed.where("type = 'revisit'").drop("bytes")
    asked = revisits.groupBy("refers").agg(F.count("*").alias("_n"))
    targets = cut(
        parsed.where("type = 'response'")
        .select(F.col("urn").alias("_urn"), F.col("id").alias("_to"), F.col("bytes").alias("_bytes"), F.col("digest").alias("_digest"))
        .join(asked, F.col("_urn") == F.col("refers"))
        .drop("_urn")
    )
    resolved = attach(revisits, targets, "refers", "_n", total_of(targets, "_n"), ["urn"])
    return parsed.where("type = 'response'").select(
        "id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.lit(None).cast("string").alias("refers_to"),
    ).unionByName(
        resolved.select(
            "id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"),
            F.col("type").alias("record_type"), F.col("_to").alias("refers_to"),
        )
    )


def op4(spark: SparkSession, pages: DataFrame) -> DataFrame:
    path = fresh_path(spark, "archive")
    write(pages, path)
    return read(spark, path).select(
        F.col("id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )
