"""Web archives: WARC files with revisit records, and a merged capture index.

Archives are written by Spark's text writer, gzip-compressed, a bounded number
of records a file, to the shared folder; any store Spark reaches will do.  The
index comes from reading them back: sorted capture runs are exchanged by key
range and each range is merged with a loser tree.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, scratch_path, ship, staged
from .merging import merge

#: Payloads shorter than this are always stored.
MIN_REVISIT_BYTES = 100
RECORDS_PER_FILE = 1000
RUN_RECORDS = 65_536
#: Captures that one merging task gets on average, and the keys looked at to find the ranges, at most.
RANGE_RECORDS = 100_000
SAMPLE_KEYS = 8_192
#: Pages carry no time of capture; theirs is this second plus the page's number.
FIRST_CAPTURE = 1_704_067_200
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, payload_bytes, payload_digest and refers_to.

    Among equal payloads of at least MIN_REVISIT_BYTES the smallest page_id is
    stored and the others refer to it; rows that repeat that id are stored
    again.  Only digests that occur more than once reach the join.
    """
    out = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    out = out.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    first = out.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select(F.col("payload_digest").alias("d"), "first")
    out = out.join(first, F.col("payload_digest") == F.col("d"), "left").drop("d")
    return out.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def _record(r: dict[str, Column]) -> Column:
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), r["payload_bytes"].cast("string"), F.lit("\r\n\r\n"))
    block = F.when(r["refers_to"].isNull(), F.concat(http, r["payload"])).otherwise(http)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    uri = F.regexp_replace(F.regexp_replace(F.coalesce(r["url"], F.lit("")), "\r", "%0D"), "\n", "%0A")
    when = F.date_format(F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.coalesce(r["page_id"], F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), name(r["refers_to"]), F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(r["refers_to"].isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), name(r["page_id"]), F.lit("\r\nWARC-Date: "), when, F.lit("\r\nWARC-Target-URI: "), uri, F.lit("\r\n"),
        F.when(r["refers_to"].isNull(), "").otherwise(revisit),
        F.lit("WARC-Payload-Digest: sha256:"), r["payload_digest"], F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes one record for each row of ``pages`` to gzip-compressed WARC files under ``path``."""
    rows = plan_records(pages)
    record = _record({c: F.col(c) for c in rows.columns})
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def url_key(url: str) -> str:
    """The sort key of a url: host names from the right, then path and query in lower case."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", url or "", re.S)
    if not m:
        return (url or "").lower()
    host = m[1].lower().rpartition("@")[2]
    host = re.sub(r":(80|443)$", "", host)
    return ",".join(reversed(re.sub(r"^www\d*\.", "", host).split("."))) + ")" + (m[2].lower() or "/")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start = end + 4
        stop = start + int(head["content-length"])
        yield head, data[start:stop]
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"a record does not end at byte {stop}")
        at = stop + 4


CAPTURES = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_SCHEMA = pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _captures(data: bytes) -> list[tuple]:
    def number(name: str) -> int | None:
        x = name.removeprefix("<urn:page:").removesuffix(">")
        return None if x in ("", "none") else int(x)

    out = []
    for head, block in parse(data):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
        told = head["warc-payload-digest"].removeprefix("sha256:")
        if head["warc-type"] == "response":
            found = hashlib.sha256(payload).hexdigest()
            if found != told or len(payload) != size:
                raise ValueError(f"{head['warc-record-id']}: the payload is not the one that was written")
        out.append((url_key(head.get("warc-target-uri", "")), head["warc-date"], number(head["warc-record-id"]), size, told, head["warc-type"], number(head.get("warc-refers-to", ""))))
    return out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives under ``path``; payloads are checked against their digests."""
    ship(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                got = _captures(gzip.decompress(content.as_py()))
                yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in got], _SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(rows, CAPTURES)


def _order(r: dict) -> tuple:
    return r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0


def merge_index(captures: DataFrame, range_records: int = RANGE_RECORDS, run_records: int = RUN_RECORDS, sample_keys: int = SAMPLE_KEYS) -> DataFrame:
    """``captures`` with ``part`` and ``place``: sorted by them they are in order of url key, time and page.

    Tasks sort runs of at most ``run_records`` rows and cut them at the range
    bounds; a range's runs meet in one task and go through a loser tree.
    Bounds are whole (key, time, page) triples from a bounded sample, so that
    one url's many captures are spread over ranges too.
    """
    ship(captures.sparkSession)
    ranges = max(1, -(-captures.count() // range_records))
    some = captures.select("url_key", "captured", "page_id").orderBy(F.xxhash64("url_key", "captured", "page_id")).limit(sample_keys) if ranges > 1 else captures.limit(0)
    keys = sorted(_order(r.asDict()) for r in some.collect())
    bounds = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    row = pa.struct(list(_SCHEMA))
    schema = pa.schema([("part", pa.int32()), ("rows", pa.list_(row))])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(rows: list[dict]) -> pa.RecordBatch:
            parts: dict[int, list[dict]] = {}
            for r in sorted(rows, key=_order):
                parts.setdefault(bisect_right(bounds, _order(r)), []).append(r)
            return pa.RecordBatch.from_pylist([{"part": p, "rows": x} for p, x in parts.items()], schema)

        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= run_records:
                yield cut(held[:run_records])
                held = held[run_records:]
        if held:
            yield cut(held)

    final = pa.schema([("part", pa.int32()), ("place", pa.int64()), *_SCHEMA])

    def merged(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        own = sorted((r for r in table.column("rows").to_pylist() if r), key=lambda r: _order(r[0]))
        order = merge([[_order(x) for x in r] for r in own])
        return pa.Table.from_pylist([{"part": part, "place": i} | own[a][b] for i, (a, b) in enumerate(order)], final)

    struct = ",".join(f"{f.split()[0]}:{f.split()[1]}" for f in CAPTURES.split(", "))
    return captures.mapInArrow(runs, f"part int, rows array<struct<{struct}>>").groupBy("part").applyInArrow(merged, f"part int, place long, {CAPTURES}")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a page: page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives.

    A null html is an empty payload, always a response of its own.
    """
    path = scratch_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    index = merge_index(staged(read_archives(spark, path), "captures"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY 1)
SELECT q.page_id, q.payload_bytes, q.payload_digest,
  CASE WHEN f.first IS NOT NULL AND f.first IS DISTINCT FROM q.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first IS DISTINCT FROM q.page_id THEN f.first END AS refers_to
FROM q LEFT JOIN f ON q.payload_digest = f.payload_digest AND q.payload_bytes >= 100
"""
