"""WARC: writing captures as records, reading archives, and assembling transactions by concurrent-to identifiers."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import erase, shared_dir, written

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data) -> F.Column:
    """Upper-case base32 of the SHA-1 of binary data: five hex digits make four signs."""
    h = F.sha1(data)
    signs = []
    for g in range(8):
        n = F.conv(F.substring(h, 5 * g + 1, 5), 16, 10).cast("int")
        signs += [F.substring(F.lit(_B32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*signs)


def _record(kind: str, headers: list, block) -> F.Column:
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n")]
    for name, value in headers:
        head += [F.lit(f"{name}: "), value, F.lit("\r\n")]
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0, file_bytes: int = 128 << 20) -> None:
    """Gzipped WARC files under path: a request, a response or revisit, and a metadata record for each row.

    Of rows with equal payloads (by SHA-1) of min_bytes at least, that with the largest id is written in full, the others
    revisit it; among equal ids a later row comes first, and null ids come last. Every row has a number, which record
    identifiers hold before the id, so rows that repeat an id or have none stay apart. A null payload is an empty
    one, a null URL an empty string. Files hold about file_bytes before compression, by the mean record. Spark's text writer
    puts the closing line ends, so any file system of Spark's will do.
    """
    q = lambda c: F.col(f"`{c}`")
    p = pages.select(F.coalesce(q(id_col).cast("long").cast("string"), F.lit("")).alias("name"), q(id_col).cast("long").alias("id"), F.coalesce(F.regexp_replace(q(url_col), r"[\r\n]", " "), F.lit("")).alias("url"), F.coalesce(q(payload_col), F.lit("")).alias("body"))
    # Numbers must not change between uses, so rows are written with theirs.
    p = written(p.withColumn("digest", base32_sha1(F.encode("body", "UTF-8"))).withColumn("n_bytes", F.octet_length("body")).withColumn("row", F.monotonically_increasing_id()))
    # Written too, so that its size is known: bodies are shuffled only where it can't be broadcast.
    first = written(p.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.max(F.struct("id", "row", "name")).alias("of"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d2"), "of"))
    p = p.join(first, (p["digest"] == first["d2"]) & (p["n_bytes"] >= min_bytes), "left").withColumn("again", F.coalesce(F.col("of.row") != F.col("row"), F.lit(False)))
    mean = p.agg(F.avg("n_bytes")).first()[0] or 0
    urn = lambda kind, r="": F.concat(F.lit(f"<urn:capture:{kind}:"), F.col(f"{r}row").cast("string"), F.lit(":"), F.col(f"{r}name"), F.lit(">"))
    size = F.octet_length("body").cast("string")
    base = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    own = [("WARC-Record-ID", urn("response")), *base, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("Content-Type", F.lit("application/http; msgtype=response"))]
    response = _record("response", own, F.concat(http, F.col("body")))
    revisit = _record("revisit", [*own, ("WARC-Refers-To", urn("response", "of.")), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))], http)
    request = _record("request", [("WARC-Record-ID", urn("request")), *base, ("WARC-Concurrent-To", urn("response")), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _record("metadata", [("WARC-Record-ID", urn("metadata")), *base, ("WARC-Concurrent-To", urn("request")), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("pageId: "), F.col("name"), F.lit("\r\n")))
    lines = p.select(F.explode(F.array(request, F.when(F.col("again"), revisit).otherwise(response), metadata)).alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, min(60_000, int(3 * file_bytes / (mean + 2000))))).text(path)


def parse(data: bytes):
    """(headers, block) of each record of a plain or gzipped archive, by Content-Length."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers = {}
        while (line := f.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        n = int(headers["content-length"])
        block = f.read(n)
        if len(block) != n:
            raise ValueError("a record is cut short")
        yield headers, block


RECORD = "record_id string, kind string, concurrent_to string, url string, date string, digest string, payload_bytes long, refers_to string, fields string, payload binary"


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record. Digest and size of a response are taken from its bytes, which must agree with the header; a revisit has those its headers give of the full payload."""

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for data in b.column(0):
                for h, block in parse(data.as_py()):
                    kind, body, n, fields = h.get("warc-type"), None, None, None
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind in ("response", "revisit"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        if kind == "response":
                            n, found = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                            if digest not in (None, found):
                                raise ValueError(f"{h.get('warc-record-id')}: the payload's digest is not {digest}")
                            digest = found
                        else:
                            n = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
                    else:
                        fields = block.decode("utf-8", "replace")
                    rows.append((h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-date"), digest, n, h.get("warc-refers-to"), fields, body if payload else None))
                    if len(rows) >= 2000:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def _batch(rows):
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names=names)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, url, date, record_type, digest, payload_bytes, refers_to, payload, request, metadata.

    Requests and metadata reach their response through concurrent-to, directly or by way of one other
    record (metadata to request to response). Records that reach none are left out; of several the
    smallest by identifier is kept, and repeated captures are one row. Null columns stay null.
    """
    anchor = records.where("kind in ('response', 'revisit')").dropDuplicates(["record_id"])
    side = records.where("kind not in ('response', 'revisit') and concurrent_to is not null").select("record_id", "kind", "concurrent_to", "fields")
    hop = side.select(F.col("record_id").alias("via"), F.col("concurrent_to").alias("then"))
    reached = side.join(hop, side["concurrent_to"] == hop["via"], "left").withColumn("capture", F.coalesce("then", "concurrent_to"))
    told = lambda k: F.min(F.when(F.col("kind") == k, F.struct("record_id", "fields"))).alias(k)
    sides = reached.groupBy("capture").agg(told("request"), told("metadata"))
    out = anchor.join(sides, anchor["record_id"] == sides["capture"], "left")
    return out.select("record_id", "url", "date", F.col("kind").alias("record_type"), "digest", "payload_bytes", "refers_to", "payload", "request", "metadata")


def round_trip(pages: DataFrame, payload: bool = False) -> DataFrame:
    """Captures of pages, written to archives in the shared folder and read back: a row for every row of pages, whatever its id.

    The archives are parsed once, into a table of records; then they go. Null, empty and very long payloads come back as they are
    (null as empty); an empty table gives an empty one; columns other than the id, URL and payload aren't read.
    """
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    records = written(read_records(pages.sparkSession, path, payload))
    erase(pages.sparkSession, path)
    return assemble(records)
