"""Round trip of pages through payload store, headers and WARC files."""

import base64
import gzip
import hashlib

import pytest

from curbline.llm import warc_store as A
from curbline.session import fresh_path

PAGES = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "http://c/\r\nX: y", ""),
    (5, "http://d/", "é\r\n\r\nWARC/1.1\r\n" * 50), (6, "http://e/", "x" * 200_000), (7, "http://f/", "<p>one</p>"), (7, "http://f/", "<p>one</p>"),
    (None, "http://g/", "alone"), (8, "http://h/", "same"), (9, "http://h/", "same"),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, payload_bytes string")


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    got = sorted(map(tuple, A.op4(spark, frame(spark)).collect()), key=repr)
    tops = {}
    for i, _, h in PAGES:
        tops[h or ""] = max(tops.get(h or "", -1), -1 if i is None else i)
    want, done = [], set()
    for i, _, h in PAGES:
        h = h or ""
        first = (i == tops[h] or i is None) and h not in done
        if first:
            done.add(h)
        want.append((i, len(h.encode()), sha1(h), "response" if first else "revisit", None if first else tops[h]))
    assert got == sorted(want, key=repr)


def test_store_holds_each_payload_once_and_files_are_warc(spark):
    path = fresh_path(spark, "archive")
    A.write(frame(spark), path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for *_, h in PAGES})
    files = spark.read.format("binaryFile").load(f"{path}/warc").select("content").collect()
    data = b"".join(gzip.decompress(f["content"]) for f in files)
    assert data.count(b"x" * 200_000) == 1
    rebuilt = sorted(r["record"].encode() + b"\r\n\r\n" for r in A.records(spark, path).collect())
    assert sum(map(len, rebuilt)) == len(data) and all(r in data for r in rebuilt)
    assert all(r.startswith(b"WARC/1.1\r\nWARC-Type: ") for r in rebuilt)


def test_short_payloads_are_all_responses(spark):
    path = fresh_path(spark, "archive")
    A.write(frame(spark), path, least_bytes=5)
    got = {(r["id"], r["record_type"]) for r in A.read(spark, path).collect()}
    assert {("8", "response"), ("9", "response"), ("3", "response"), ("4", "response"), ("1", "revisit")} <= got


def test_changed_payload_is_noticed(spark):
    import zstandard
    from pyspark.sql import functions as F

    path = fresh_path(spark, "archive")
    A.write(frame(spark), path)
    other = fresh_path(spark, "broken")
    spark.read.parquet(f"{path}/payloads").withColumn(
        "_packed", F.lit(zstandard.compress(b"other"))
    ).write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{other}/headers")
    with pytest.raises(Exception, match="does not match its digest"):
        A.records(spark, other).collect()


def test_archives_with_a_member_for_each_record(spark, tmp_path):
    def record(kind, n, body, **more):
        http = b"HTTP/1.1 200 OK\r\n\r\n" + body
        fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{n}>", "WARC-Page-ID": str(n)} | more | {"Content-Length": str(len(http))}
        return "\r\n".join(["WARC/1.1", *[f"{k}: {v}" for k, v in fields.items()]]).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"

    bodies = [b"a" * 70_000, "é".encode() * 9, b""]
    records = [record("warcinfo", 0, b"software: x")]
    records += [record("response", k, b, **{"WARC-Payload-Digest": f"sha1:{A.base32_sha1(b)}"}) for k, b in enumerate(bodies, 1)]
    records += [record("response", 9, b"no digest"), record("revisit", 7, b"", **{"WARC-Payload-Digest": f"sha1:{A.base32_sha1(bodies[0])}", "WARC-Refers-To": "<urn:1>"})]
    folder = tmp_path / "warc"
    folder.mkdir()
    (folder / "one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    got = sorted(map(tuple, A.read(spark, str(tmp_path)).select("id", "payload_bytes", "record_type", "refers_to").collect()))
    assert got == [("1", 70_000, "response", None), ("2", 18, "response", None), ("3", 0, "response", None), ("7", 70_000, "revisit", "1"), ("9", 9, "response", None)]
    (folder / "two.warc.gz").write_bytes(gzip.compress(records[1])[:-9])
    with pytest.raises(Exception, match="cut short"):
        A.read(spark, str(tmp_path)).collect()


def test_empty_table(spark):
    assert A.op4(spark, frame(spark).where("false")).collect() == []


def test_files_follow_the_bytes_and_not_the_shuffle_partitions(spark, monkeypatch):
    rows = [(k, f"http://h/{k}", f"<p>{k % 300}</p>") for k in range(600)]
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    cores = spark.sparkContext.defaultParallelism
    assert cores < 20

    def files():
        path = fresh_path(spark, "archive")
        A.write(frame(spark, rows), path)
        got = A.read(spark, path).collect()
        assert sorted((int(r["id"]), r["refers_to"]) for r in got) == [(k, str(k + 300) if k < 300 else None) for k in range(600)]
        return [spark.read.format("binaryFile").load(f"{path}/{part}").select("path").count() for part in ("payloads", "headers", "warc")]

    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        few = files()
        assert all(n <= cores for n in few), few
        volume = sum(len(h) + A.HEADER_BYTES for *_, h in rows)
        monkeypatch.setattr(A, "FILE_BYTES", -(-volume // 30))
        many = files()
        assert cores < many[0] <= 30 and all(n <= 30 for n in many), many
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
