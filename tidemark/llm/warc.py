"""WARC archives of captures, and their transactions assembled again.

Archives are plain WARC 1.0 files, compressed with gzip and written by Spark's text writer: a record is one value, whose last
byte is the writer's line end. They are read by Spark's text reader cut at version lines, so a task streams through its
files record by record; a payload that holds a version line itself is put together again by its Content-Length.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import materialised
from tidemark.sources.storage import scratch_path

VERSION = "WARC/1.0\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Payloads below this many bytes are stored again instead of being referred to.
LEAST = 1000
_RECORD = pa.schema([
    ("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()),
    ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("http_header", pa.string()),
    ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("declared_digest", pa.string()),
    ("page_id", pa.int64())])
_RECORD_DDL = (
    "type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, content_type string, "
    "http_header string, payload binary, payload_bytes long, payload_digest string, declared_digest string, page_id long")


def record_id(kind: str, *of: Column) -> Column:
    """A stable urn:uuid for what the columns say."""
    digest = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("")) for c in of]))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(fields: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record without its last byte; fields whose value is null are left out."""
    lines = [
        F.coalesce(F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n")), F.lit(""))
        for name, value in fields]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.lit(VERSION), *lines, length, block, F.lit("\r\n\r"))


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages(page_id, url, html) with their payload, digest, record type and the page that a revisit refers to.

    Of equal payloads of at least ``least`` bytes, the one with the largest page_id is the response.
    """
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    firsts = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(
        F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(firsts, "digest", "left").withColumn("type", F.when(revisit, "revisit").otherwise("response"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST, date: str = DATE) -> None:
    """A request, a response or revisit, and a metadata record for every row of pages(page_id, url, html), under path.

    A null html is an empty payload; a null url has no target; control characters in a url are percent-encoded.
    """
    uri = F.col("url")
    for code in (9, 10, 13, 32):
        uri = F.replace(uri, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    main = F.when(F.col("type") == "revisit", record_id("revisit", F.col("page_id"), F.col("digest"), F.col("url"))).otherwise(
        record_id("response", F.col("page_id"), F.col("digest")))
    rows = plan(pages, least).withColumn("uri", uri).withColumn("id", main)
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("uri"))]
    header = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    http = ("Content-Type", "application/http;msgtype=response")
    response = _record([
        ("WARC-Type", "response"), ("WARC-Record-ID", F.col("id")), *common, http, ("WARC-Payload-Digest", digest)],
        F.concat(header, F.col("payload")))
    revisit = _record([
        ("WARC-Type", "revisit"), ("WARC-Record-ID", F.col("id")), *common, http, ("WARC-Payload-Digest", digest),
        ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("response", F.col("first"), F.col("digest")))], header)
    request = _record([
        ("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", F.col("id"))), *common,
        ("Content-Type", "application/http;msgtype=request"), ("WARC-Concurrent-To", F.col("id"))],
        F.concat(F.lit("GET "), F.coalesce("uri", F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _record([
        ("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", F.col("id"))), *common,
        ("Content-Type", "application/warc-fields"), ("WARC-Concurrent-To", F.col("id"))],
        F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))))
    main_record = F.when(F.col("type") == "revisit", revisit).otherwise(response)
    rows.select(F.explode(F.array(request, main_record, metadata)).alias("value")).write.option("compression", "gzip").text(path)


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines.split(b"\r\n") if line)
    return {name.strip().lower().decode(): value.strip().decode("utf-8", "replace") for name, _, value in pairs}


def parse(header: bytes, block: bytes) -> tuple:
    fields = _fields(header)
    content = fields.get("content-type", "")
    http, payload = None, block
    if content.startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = head.decode("utf-8", "replace")
    page = _fields(block).get("page-id") if content == "application/warc-fields" else None
    return (
        fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-concurrent-to"), fields.get("warc-refers-to"),
        fields.get("warc-target-uri"), fields.get("warc-date"), content, http, payload, len(payload),
        hashlib.sha1(payload).hexdigest(), fields.get("warc-payload-digest"), int(page) if page else None)


class Cutter:
    """Records from the pieces between version lines, in file order."""

    def __init__(self):
        self.file, self.held, self.need = None, b"", 0

    def feed(self, file: str, piece: bytes) -> tuple[bytes, bytes] | None:
        """(header, block) once a record is complete."""
        if file != self.file:
            if self.held:
                raise ValueError(f"a record is cut off at the end of {self.file}")
            self.file = file
        if self.held:
            self.held += VERSION.encode() + piece
        elif not piece:
            return None
        else:
            header, _, _ = piece.partition(b"\r\n\r\n")
            self.held, self.need = piece, len(header) + 4 + int(_fields(header)["content-length"])
        if len(self.held) < self.need:
            return None
        header, _, rest = self.held.partition(b"\r\n\r\n")
        block = rest[:self.need - len(header) - 4]
        self.held = b""
        return header, block


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record under path, with the payload as bytes, its length and its SHA-1 as read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for batch in batches:
            rows, held = [], 0
            for file, piece in zip(batch.column(0), batch.column(1)):
                record = cutter.feed(file.as_py(), piece.as_py())
                if record:
                    rows.append(parse(*record))
                    held += len(record[1])
                if rows and held > 16 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)
        if cutter.held:
            raise ValueError(f"a record is cut off at the end of {cutter.file}")

    return spark.read.option("lineSep", VERSION).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary")).mapInArrow(run, _RECORD_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD)


def captures(records: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row (request, response, metadata) per response or revisit record.

    Requests and metadata are found through their concurrent-to identifier and are null if there is none; equal ones count
    once, so that repeated captures neither get lost nor multiply.
    """
    def part(kind: str, columns: list[str]) -> DataFrame:
        chosen = records.filter(F.col("type") == kind).dropDuplicates(["concurrent_to"])
        return chosen.select(F.col("concurrent_to").alias(f"{kind}_of"), F.struct(*columns).alias(kind))

    main = ["type", "record_id", "refers_to", "target_uri", "date", "http_header", "payload_bytes", "payload_digest", "declared_digest"]
    response = records.filter(F.col("type").isin("response", "revisit")).select(
        F.struct(*main, *["payload"] * payload).alias("response"))
    request = part("request", ["record_id", "target_uri", "date", "http_header"])
    metadata = part("metadata", ["record_id", "date", "page_id"])
    own = F.col("response.record_id")
    return response.join(request, own == F.col("request_of"), "left").join(metadata, own == F.col("metadata_of"), "left").select(
        "request", "response", "metadata")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from archives of pages(page_id, url, html).

    A revisit's payload is that of the response it refers to. Repeated rows come back as often as they went in; rows that
    repeat the largest page_id of a payload are all responses. Other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path)
    # the archives are parsed once; what the join needs of a record is a few hundred bytes
    records = materialised(read_records(spark, path).drop("payload"), "records")
    found = materialised(captures(records, payload=False), "captures")
    r = F.col("response")
    rows = found.select(
        F.col("metadata.page_id").alias("page_id"), r["type"].alias("record_type"),
        F.coalesce(r["refers_to"], r["record_id"]).alias("source"))
    originals = found.filter(r["type"] == "response").select(
        r["record_id"].alias("source"), r["payload_bytes"].alias("payload_bytes"), r["payload_digest"].alias("payload_digest"),
        F.col("metadata.page_id").alias("source_page")).dropDuplicates(["source"])
    return rows.join(originals, "source", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", F.col("source_page")).alias("refers_to"))
