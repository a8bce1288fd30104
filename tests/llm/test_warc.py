import base64
import gzip
import hashlib

import pytest
from helpers import TABLES
from pyspark.sql import functions as F

from tributary.llm import warc
from tributary.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, record_id string"
PAGES = [
    (1, "http://a/x y", "<p>é</p>", "c"), (2, "http://b", "<p>é</p>", "c"), (7, None, "<p>é</p>", "c"), (3, "http://c\r\nX: y", "", "c"), (4, "u", None, "c"),
    (5, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\r\n", "c"), (None, "u", "only", "c"), (6, "u", "z" * 200_000, "c"), (8, "u", "WARC/1.1", "c"),
]


def expected(pages):
    groups = {}
    for i, _, html, *_ in pages:
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for payload, ids in groups.items():
        known = [i for i in ids if i is not None]
        top = max(known) if known else None
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out += [(i, len(payload), digest, "response" if i == top else "revisit", None if i == top else top) for i in ids]
    return sorted(out, key=str)


def rows(df):
    return sorted([(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=str)


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, SCHEMA)
    got = warc.round_trip(df)
    assert rows(got) == expected(PAGES)
    payloads = {r.id: bytes(r.payload) for r in got.collect()}
    assert payloads == {i: (h or "").encode() for i, _, h, _ in PAGES}


def test_least_bytes(spark):
    got = warc.round_trip(spark.createDataFrame(PAGES[:3], SCHEMA), least_bytes=100)
    assert {r.record_type for r in got.collect()} == {"response"}


def test_ties_are_responses(spark):
    twice = [(9, "u", "same", "c"), (9, "u", "same", "c"), (2, "u", "same", "c")]
    got = warc.round_trip(spark.createDataFrame(twice, SCHEMA)).collect()
    assert sorted((r.id, r.record_type, r.refers_to) for r in got) == [(2, "revisit", 9), (9, "response", None), (9, "response", None)]


def test_binary_payload_and_many_files(spark, tmp_path):
    raw = bytes(range(256)) + b"\r\n\r\n"
    df = spark.createDataFrame([(i, "u", raw + bytes([i])) for i in range(7)], "page_id long, url string, html binary")
    path = str(tmp_path / "out")
    warc.write_warc(df, path, records_per_file=5)
    back = warc.read_warc(spark, path).where("record_type = 'response'").collect()
    assert sorted(bytes(r.payload) for r in back) == [raw + bytes([i]) for i in range(7)]
    assert all(r.payload_digest == r.computed_digest for r in back)


def test_assembly(spark, tmp_path):
    df = spark.createDataFrame(PAGES, SCHEMA)
    path = str(tmp_path / "out")
    warc.write_warc(df, path)
    got = warc.assemble(warc.read_warc(spark, path)).collect()
    assert len(got) == len(PAGES)
    assert all(len(r.requests) == len(r.metadata) == 1 and r.response is not None for r in got)


def test_strange_records(spark, tmp_path):
    """Records of other writers: one gzip member each, a metadata record two hops away, an orphan."""

    def record(kind, i, block=b"", to=None, kind_of="application/http; msgtype=x"):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nwarc-record-id: <{i}>\r\n" + (f"WARC-Concurrent-To: <{to}>\r\n" if to else "") + f"Content-Type: {kind_of}\r\nContent-Length: {len(block)}\r\n\r\n"
        return gzip.compress(head.encode() + block + b"\r\n\r\n")

    data = record("warcinfo", 0) + record("response", 1, b"HTTP/1.1 200 OK\r\n\r\nbody") + record("request", 2, b"GET", to=1) + record("metadata", 3, b"a: b", to=2, kind_of="application/warc-fields") + record("metadata", 4, b"", to=99)
    (tmp_path / "x.warc.gz").write_bytes(data)
    got = {r.capture_id: r for r in warc.assemble(warc.read_warc(spark, str(tmp_path))).collect()}
    assert set(got) == {"<1>", "<99>"}
    assert bytes(got["<1>"].response.payload) == b"body" and got["<1>"].requests[0].record_id == "<2>" and got["<1>"].metadata[0].record_id == "<3>"
    assert got["<99>"].response is None


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("value", [b"", b"abc", b"\x00" * 100])
def test_base32(spark, value):
    got = spark.createDataFrame([(value,)], "b binary").select(warc.sha1_base32(F.col("b"))).first()[0]
    assert got == base64.b32encode(hashlib.sha1(value).digest()).decode()


def test_query_on_the_table(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{TABLES}/pages.parquet").collect()]
    assert rows(QUERIES["op2_warc"](spark, TABLES).withColumnRenamed("page_id", "id")) == expected(pages)
