import hashlib

import pytest

from cohortframe.llm import archive
from cohortframe.llm.common import scratch

PAGES = "page_id long, url string, html string, digest string, payload string, header string, bytes int, record_type string, first_id long"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", 1, "x", 1) for r in rows], PAGES).repartition(3)


BIG = "<p>" + "x" * 200
ROWS = [(5, "http://a/\r\nInjected: 1", BIG), (3, "http://b/%0D?q=1", BIG), (9, None, BIG), (1, "http://ü/", ""), (2, "http://c", None), (4, "u", "short"), (6, "u", "short"),
        (7, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n" + "é" * 60), (8, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n" + "é" * 60),
        (3, "http://again", BIG), (None, "u", "z" * 150), (10, "u", "z" * 150), (11, "u", "y" * 1_000_000), (-4, "u", "y" * 1_000_000)]


def brute(rows):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    out = []
    for p, u, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and p != first.get(h or "")
        out.append((p, u, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    folder = scratch(spark, "warc-test")
    archive.write_archive(pages_of(spark, ROWS), folder)
    got = archive.read_archive(spark, folder).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(ROWS)
    kept = spark.read.parquet(f"{folder}/payloads")
    assert kept.count() == kept.select("digest").distinct().count() == len({h or "" for _, _, h in ROWS})


def test_records_are_whole_and_headers_exact(spark):
    folder = scratch(spark, "warc-test")
    archive.write_archive(pages_of(spark, ROWS), folder)
    for r in archive.rebuilt(spark, folder).collect():
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and b"Injected" not in fields and bytes(r.record).endswith(b"\r\n\r\n")
        assert int(fields[b"Content-Length"]) == len(block) - 4
        if fields[b"WARC-Type"] == b"response":
            assert fields[b"WARC-Payload-Digest"].decode() == "sha256:" + hashlib.sha256(block[:-4]).hexdigest()


def test_a_damaged_payload_is_noticed(spark):
    folder = scratch(spark, "warc-test")
    archive.write_archive(pages_of(spark, ROWS[:3]), folder)
    bad = scratch(spark, "warc-bad")
    spark.read.parquet(f"{folder}/payloads").selectExpr("digest", "first_id", "concat(payload, X'00') AS payload").write.parquet(f"{bad}/payloads")
    spark.read.parquet(f"{folder}/records").write.parquet(f"{bad}/records")
    with pytest.raises(Exception, match="does not have its digest"):
        archive.read_archive(spark, bad).collect()


def test_empty_table(spark):
    folder = scratch(spark, "warc-test")
    archive.write_archive(pages_of(spark, ROWS[:1]).where("page_id = 0"), folder)
    assert archive.read_archive(spark, folder).collect() == []
