"""WARC archives: pages to request, response (or revisit) and metadata records, and back to one nested row per capture.

Writing uses Spark's text writer, whose line separator is the blank line that ends a record; a task writes its own archives,
compressed with gzip. Reading takes whole archives (bounded by `records_per_file`), walks them by Content-Length, and never
trusts separators inside a payload. Records are then assembled by joins: request and metadata name the response they belong to
in WARC-Concurrent-To, and a revisit names the response whose payload it repeats in WARC-Refers-To.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.llm.common import cut, one_per_id

REVISIT_BYTES = 1000
RECORDS_PER_FILE = 12_000
DATE = "2026-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
FIELDS = ("record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "date", "content_type", "page_id", "payload_digest")
SCHEMA = ", ".join(f"{f} string" for f in FIELDS) + ", payload_bytes long, block binary"
BATCH_BYTES = 8 << 20


def record_id(kind: str, key: Column) -> Column:
    """A fixed urn:uuid for a record of a page."""
    h = F.md5(F.concat(F.lit(kind + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column, rid: Column, block: Column, content_type: str, *fields: tuple[str, Column]) -> Column:
    """A record without the blank line that ends it. Fields whose value is NULL are left out."""
    named = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {DATE}")]
    named += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    named += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *named), F.lit(CRLF + CRLF), block)


def decide(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Pages with payload, payload_bytes, payload_digest and, for those that repeat a payload, the page_id in _refers.

    Only payloads that several pages share are joined back; a payload shared by many pages is a hot key on the large side
    alone, which an adaptive join splits.
    """
    body = F.coalesce("html", F.lit(""))
    sized = pages.select("page_id", "url", body.alias("payload"), F.sha1(body.cast("binary")).alias("payload_digest"),
                         F.octet_length(body).cast("long").alias("payload_bytes"))
    shared = (sized.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
              .agg(F.count(F.lit(1)).alias("_n"), F.max("page_id").alias("_last")).where("_n > 1").drop("_n"))
    joined = sized.join(shared, ["payload_digest", "payload_bytes"], "left")
    repeats = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return joined.withColumn("_refers", F.when(repeats, F.col("_last"))).drop("_last")


def write_archives(pages: DataFrame, path: str, least: int = REVISIT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write page_id, url, html as archives under `path`.

    A NULL html is an empty payload, a NULL url leaves the target out; control characters of an url are percent-encoded. Rows
    that repeat a page_id are one capture, with the greatest html. Further columns are not looked at.
    """
    made = decide(one_per_id(pages.select("page_id", "url", "html"), "page_id", "html"), least)
    rid = record_id("response", F.col("page_id"))
    is_revisit = F.col("_refers").isNotNull()
    target = ("WARC-Target-URI", F.regexp_replace(F.replace("url", F.lit("%"), F.lit("%25")), r"[\x00-\x20\x7f]", "%20"))
    http = F.concat(F.lit(CRLF.join(("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "))),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    response = _record(
        F.when(is_revisit, "revisit").otherwise("response"), rid, F.when(is_revisit, http).otherwise(F.concat(http, "payload")),
        "application/http;msgtype=response", target, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        ("WARC-Profile", F.when(is_revisit, F.lit(REVISIT))),
        ("WARC-Refers-To", F.when(is_revisit, record_id("response", F.col("_refers")))))
    beside = ("WARC-Concurrent-To", rid)
    request = _record(F.lit("request"), record_id("request", F.col("page_id")), F.lit("GET / HTTP/1.1" + CRLF + CRLF),
                      "application/http;msgtype=request", target, beside)
    fields = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record(F.lit("metadata"), record_id("metadata", F.col("page_id")), fields, "application/warc-fields", target, beside)
    (made.select(F.explode(F.array(request, response, metadata)).alias("value")).write
     .option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def _walk(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower case) and block of every record of an archive."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError("no record where one should begin")
            continue
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("an archive ends inside a record")
        yield head, block


def _parse(head: dict[str, str], block: bytes, blocks: bool) -> tuple:
    kind, page, digest, size = head.get("warc-type"), None, None, None
    if kind in ("response", "revisit"):
        payload = block.partition(b"\r\n\r\n")[2]
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "response":
            size, found = len(payload), hashlib.sha1(payload).hexdigest()
            if digest not in (None, found):
                raise ValueError("a payload does not have its digest")
            digest = found
    elif kind == "metadata":
        for line in block.split(b"\r\n"):
            if line.startswith(b"page_id: "):
                page = line[9:].decode() or None
    return (head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"),
            head.get("warc-date"), head.get("content-type"), page, digest, size, block if blocks else None)


def read_records(spark: SparkSession, path: str, blocks: bool = False) -> DataFrame:
    """One row per record of the archives under `path`; their blocks only if asked for. Broken archives fail the job."""
    arrow = pa.schema([*[(f, pa.string()) for f in FIELDS], ("payload_bytes", pa.int64()), ("block", pa.binary())])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for data in batch.column("content"):
                for head, block in _walk(data.as_py()):
                    rows.append(_parse(head, block, blocks))
                    held += 500 + len(block) * blocks
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(records, SCHEMA)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, record_type, payload_bytes, payload_digest, refers_to, response, request, metadata.

    Joins over concurrent-to; a capture without request or metadata has NULL there, of several the smallest record id
    counts. Repeated record ids are one record. refers_to is the page_id of the response that a revisit repeats, and its payload
    size comes from there; where that response is not among the records, size and refers_to are NULL.
    """
    rest = [c for c in records.columns if c != "record_id"]
    once = lambda kinds, key, name: records.where(F.col("record_type").isin(*kinds)).groupBy(key).agg(
        F.min(F.struct("record_id", *rest)).alias(name)).withColumnRenamed(key, f"_{name}")
    response = once(("response", "revisit"), "record_id", "response")
    request, metadata = once(("request",), "concurrent_to", "request"), once(("metadata",), "concurrent_to", "metadata")
    whole = (response.join(request, F.col("_response") == F.col("_request"), "left")
             .join(metadata, F.col("_response") == F.col("_metadata"), "left")
             .select("_response", "response", "request", "metadata", F.col("metadata.page_id").cast("long").alias("page_id"),
                     F.col("response.record_type").alias("record_type")))
    origin = whole.where("record_type = 'response'").select(
        F.col("_response").alias("_origin"), F.col("page_id").alias("_page"), F.col("response.payload_bytes").alias("_bytes"))
    revisit = F.col("record_type") == "revisit"
    linked = whole.join(origin, F.when(revisit, F.col("response.refers_to")) == F.col("_origin"), "left")
    return linked.select(
        "page_id", F.when(revisit, F.col("_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), "record_type", F.when(revisit, F.col("_page")).alias("refers_to"),
        "response", "request", "metadata")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captures of the archives under `path`, without their blocks. Records are read once and kept for the joins."""
    return captures(cut(read_records(spark, path).drop("block")))
