import base64
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from chronoreel.llm import warc
from chronoreel.llm._io import Scratch

ROWS = [(1, "http://a/b", "same"), (9, None, "same"), (5, "http://c\r\n x", "same"), (7, "u", None), (8, "u", ""), (None, "n", "same"), (None, None, None), (4, "é", "日本 \r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (9, None, "same"), (3, "z", "x" * 300_000)]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    return df.withColumn("refers_to", F.lit("clash")).withColumn("path", F.lit("clash")).repartition(3)


@pytest.mark.parametrize("least", [0, 2])
def test_round_trip(pages, least):
    got = sorted(map(tuple, warc.round_trip(pages, min_bytes=least, with_payload=True).collect()), key=repr)
    want = []
    for i, url, html in ROWS:
        body = (html or "").encode()
        same = [x[0] for x in ROWS if (x[2] or "") == (html or "") and x[0] is not None]
        first = max(same) if len(body) >= least and sum((x[2] or "") == (html or "") for x in ROWS) > 1 else None
        revisit = first is not None and i != first
        clean = None if url is None else warc._escape(url)
        want.append((i, clean, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None, "" if revisit else html or ""))
    assert got == sorted(want, key=repr)


def test_members_and_index(spark, pages, tmp_path):
    scratch = Scratch(spark, "test-warc")
    marked = warc.mark_revisits(pages.select("page_id", "url", "html"), scratch, "page_id", "html")
    raw = scratch.save(warc.write_archives(marked, f"file://{tmp_path}/raw", archive_bytes=100_000))
    normal = scratch.save(warc.normalise(raw, f"file://{tmp_path}/normal")).collect()
    assert sum(r.records for r in normal) == len(ROWS)
    for r in normal:
        data = open(r.path.removeprefix("file://"), "rb").read()
        lines = [json.loads(x) for x in open(r["index"].removeprefix("file://"))]
        assert sum(x["length"] for x in lines) == len(data)
        before = gzip.decompress(open(r.path.removeprefix("file://").replace("/normal/", "/raw/"), "rb").read())
        assert b"".join(gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]) for x in lines) == before
    assert not list(tmp_path.rglob("*.attempt-*"))


def test_truncated_archive(spark, tmp_path):
    whole = gzip.compress(warc.record_bytes(1, "u", b"body", None))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(warc.record_bytes(1, "u", b"body", None)[:-9]))
    (tmp_path / "b.warc.gz").write_bytes(whole + whole)
    with pytest.raises(ValueError, match="after the last whole record"):
        list(warc.records(f"file://{tmp_path}/a.warc.gz"))
    assert len(list(warc.records(f"file://{tmp_path}/b.warc.gz"))) == 2


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in warc.op4_warc(spark, pages).collect()}
    for r in pages.collect():
        body = (r.html or "").encode()
        assert (got[r.page_id].payload_bytes, got[r.page_id].payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())


def test_string_keys(spark):
    """Keys with spaces, percent signs, brackets, nothing at all and null come back as they were."""
    rows = [("a b", None, "1"), ("a%20b", None, "2"), ("", None, "3"), (None, None, "4"), ("<é>%", "u", "5"), ("z", "u", "1")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {(r.page_id, r.payload, r.refers_to) for r in warc.round_trip(pages, with_payload=True).collect()}
    assert got == {(k, "" if k == "a b" else h, "z" if k == "a b" else None) for k, _, h in rows}
