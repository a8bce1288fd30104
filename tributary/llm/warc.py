"""WARC archives: writing, reading, and assembly of transactions.

A capture is a request, a response (or a revisit, where another response has the same
payload) and a metadata record; request and metadata name the response in
WARC-Concurrent-To. Writing is one SQL expression per record over Spark's text sink, whose
line separator is the two CRLFs that end a WARC record, so payload bytes reach the file
unchanged through every Hadoop file system. Reading takes each archive as one binary row
and parses by Content-Length. Assembly joins the record kinds through the concurrent-to
identifiers and emits one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.storage import shared_dir, written

CRLF = "\r\n"
DIGITS = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
RECORD = "archive string, position long, record_id string, record_type string, concurrent_to string, target_uri string, date string, payload_digest string, block binary, payload binary, payload_bytes long, computed_digest string"
RECORD_ARROW = pa.schema(
    [("archive", pa.string()), ("position", pa.int64()), *[(c, pa.string()) for c in ("record_id", "record_type", "concurrent_to", "target_uri", "date", "payload_digest")], ("block", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("computed_digest", pa.string())]
)


def sha1_base32(binary: Column) -> Column:
    """Upper-case base32 SHA-1: ten hex digits are eight base32 digits."""
    return _base32(F.sha1(binary))


def _base32(h: Column) -> Column:
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(h, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]), *DIGITS)


def _uuid(*parts) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column | str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """The record as a string of raw bytes, without the CRLFs after its block."""
    lines = [F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit(CRLF)]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit("")))
    size = F.octet_length(block).cast("string")
    return F.concat(*lines, F.lit("Content-Length: "), size, F.lit(CRLF + CRLF), block)


def _one_line(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "%20")


def decide_revisits(keys: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(_digest, _id, _bytes) rows to one row per digest and id, with `_type` and `_response`, the id of the response with the same payload.

    Of payloads equal in digest, of `least_bytes` at least, the largest id is response. Rows that
    repeat that id and payload are responses too. A digest that many pages share is joined in rows
    of three small columns, never with payloads.
    """
    once = keys.groupBy("_digest", "_id").agg(F.first("_bytes").alias("_bytes"))
    largest = keys.groupBy("_digest").agg(F.max("_id").alias("_largest"))
    revisit = ~F.col("_id").eqNullSafe(F.col("_largest")) & (F.col("_bytes") >= least_bytes)
    return once.join(largest, "_digest").select("_digest", "_id", F.when(revisit, "revisit").otherwise("response").alias("_type"), F.when(revisit, F.col("_largest")).alias("_response"))


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, file_bytes: int = 32 << 20, records_per_file: int | None = None
) -> None:
    """Writes gzipped archives: three records per row of `pages`, next to each other.

    The payload is string or binary; null is empty. Null ids are written as absent and count as
    smaller than any other id. An archive holds about `file_bytes` of payloads, as pages come in the
    order of a hash and it ends after as many as hold that much on average; `records_per_file` sets
    the number instead.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{url_col}`").alias("_url"), payload.alias("_payload"))
    rows = rows.withColumn("_digest", F.unhex(F.sha1("_payload")))
    keys = written(rows.select("_digest", "_id", F.octet_length("_payload").alias("_bytes")), "keys")
    if records_per_file is None:
        mean = keys.agg(F.avg("_bytes")).first()[0] or 0
        records_per_file = 3 * max(1, int(file_bytes / (mean + 1024)))
    # payloads move by digest and id, which no two pages share
    known = [F.col("_digest"), F.col("_id").isNull().alias("_none"), F.coalesce("_id", F.lit(0)).alias("_known")]
    decided = decide_revisits(keys, least_bytes).select(*known, "_type", "_response")
    rows = rows.select(*known, "_id", "_url", "_payload").join(decided.hint("merge"), ["_digest", "_none", "_known"])
    rows = rows.withColumn("_digest", _base32(F.lower(F.hex("_digest"))))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    ids = {kind: _uuid(F.lit(kind), F.col("_id"), F.col("_row"), F.col("_digest")) for kind in ("capture", "request", "metadata")}
    url = _one_line(F.col("_url"))
    same = [("WARC-Target-URI", F.when(url != "", url)), ("WARC-Date", F.lit(date))]
    revisit = F.col("_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.octet_length("_payload").cast("string"), F.lit(CRLF + CRLF))
    # a cast from binary keeps the bytes as they are, also where they aren't UTF-8
    body = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("_payload").cast("string")))
    response = _record(F.col("_type"), [
        ("WARC-Record-ID", ids["capture"]), *same, ("Content-Type", F.lit("application/http; msgtype=response")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
    ], body)
    asked = F.concat(F.lit("GET "), F.when(url != "", url).otherwise(F.lit("/")), F.lit(" HTTP/1.1" + CRLF + CRLF))
    request = _record("request", [("WARC-Record-ID", ids["request"]), ("WARC-Concurrent-To", ids["capture"]), *same, ("Content-Type", F.lit("application/http; msgtype=request"))], asked)
    facts = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("_id").cast("string"), F.lit(CRLF)), F.lit("")), F.coalesce(F.concat(F.lit("same-payload-as: "), F.col("_response").cast("string"), F.lit(CRLF)), F.lit("")))
    metadata = _record("metadata", [("WARC-Record-ID", ids["metadata"]), ("WARC-Concurrent-To", ids["capture"]), *same, ("Content-Type", F.lit("application/warc-fields"))], facts)
    lines = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    lines.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records_per_file).text(path)


def _parse(data: bytes):
    """(position, headers, block) of each record; header names in lower case."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in data[at:head].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode(errors="replace")
        size = int(headers["content-length"])
        yield at, headers, data[head + 4 : head + 4 + size]
        at = head + 4 + size + 4


def _records(with_payload: bool, most: int = 8 << 20):
    def read(batches):
        import zlib

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if content[:2] == b"\x1f\x8b":
                    members = []
                    while content:  # an archive may be one gzip member or one for each record
                        unzip = zlib.decompressobj(31)
                        members.append(unzip.decompress(content) + unzip.flush())
                        content = unzip.unused_data
                    content = b"".join(members)
                rows, held = [], 0
                for at, h, block in _parse(content):
                    kind, payload = h.get("warc-type"), None
                    if "http" in h.get("content-type", ""):
                        payload = block.partition(b"\r\n\r\n")[2]
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if payload is not None and kind == "response" else None
                    rows.append((path, at, h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-date"), (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, block if kind == "metadata" else None, payload if with_payload else None, None if payload is None else len(payload), digest))
                    held += len(block)
                    if held > most:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    return read


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(RECORD_ARROW)], schema=RECORD_ARROW)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under `path` (plain or gzip), whatever wrote them."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_records(with_payload), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, requests, metadata.

    Request and metadata records join the response or revisit that their concurrent-to names,
    directly or through one more record that itself names it. A capture without one of them has
    an empty array there; records that name nothing known are captures without response, one each.
    Records without an identifier are left out of the joins.
    """
    body = F.struct("record_id", "record_type", "target_uri", "date", "payload_digest", "payload_bytes", "computed_digest", "payload")
    main = records.where(F.col("record_type").isin("response", "revisit", "resource")).select(F.col("record_id").alias("capture_id"), body.alias("response"))
    side = records.where(F.col("record_type").isin("request", "metadata")).select("record_id", "record_type", "concurrent_to", "target_uri", "date", "block")
    hop = side.where("record_id is not null and concurrent_to is not null").select(F.col("record_id").alias("via"), F.col("concurrent_to").alias("beyond"))
    side = side.join(hop, side.concurrent_to == hop.via, "left").withColumn("capture_id", F.coalesce("beyond", "concurrent_to", "record_id"))
    entry = F.struct("record_id", "target_uri", "date", "block")
    grouped = side.groupBy("capture_id").agg(F.collect_list(F.when(F.col("record_type") == "request", entry)).alias("requests"), F.collect_list(F.when(F.col("record_type") == "metadata", entry)).alias("metadata"))
    empty = F.array().cast(grouped.schema["requests"].dataType)
    full = main.join(grouped, "capture_id", "full_outer")
    return full.select("capture_id", "response", F.coalesce("requests", empty).alias("requests"), F.coalesce("metadata", empty).alias("metadata"))


def fact(metadata: Column, name: str) -> Column:
    """A field of the first warc-fields metadata block that has it."""
    text = F.array_join(F.transform(metadata, lambda m: m.getField("block").cast("string")), CRLF)
    found = F.regexp_extract(text, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", with_payload: bool = True, **options) -> DataFrame:
    """Writes the pages as archives in the shared folder, reads them back and resolves revisits.

    One row per page: id, url, payload_bytes, payload_digest, record_type, refers_to and, with_payload,
    payload. Size, digest and payload of a revisit are those of the response it refers to. Null
    payload is empty; an empty table gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, id_col, url_col, payload_col, **options)
    # parsed once for all joins; payloads are read where they are returned
    captures = assemble(written(read_warc(spark, path, False), "records"))
    flat = captures.select(
        fact(F.col("metadata"), "page-id").cast("long").alias("id"), F.col("response.target_uri").alias("url"), F.col("response.record_type").alias("record_type"),
        F.col("response.payload_digest").alias("named_digest"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.computed_digest").alias("payload_digest"),
        F.col("response.record_id").alias("record_id"), fact(F.col("metadata"), "same-payload-as").cast("long").alias("refers_to"),
    )
    responses = flat.where("record_type = 'response'")
    revisits = flat.where("record_type = 'revisit'").select("id", "url", "record_type", "named_digest", "refers_to")
    if with_payload:
        payloads = read_warc(spark, path).where("record_type = 'response'").select("record_id", "payload")
        responses = responses.join(payloads, "record_id")
    full = responses.select("named_digest", F.col("id").alias("refers_to"), "payload_bytes", "payload_digest", *(["payload"] if with_payload else [])).dropDuplicates(["named_digest", "refers_to"])
    resolved = revisits.join(full, ["named_digest", "refers_to"], "left")
    columns = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    return responses.select(columns).unionByName(resolved.select(columns))
