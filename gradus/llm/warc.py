"""WARC archives with an index of byte ranges, and reads of selected records.

Archives hold one gzip member a record, as ``.warc.gz`` files do, so a record can be read
by itself.  A record of a payload that others share is written once, as ``response``;
the others are ``revisit`` records that name it.  Payloads are the same if length and
SHA-256 are; the one of the largest id stands, and payloads below ``least`` bytes are
always written.

Writing: each task streams its rows into archives of up to ``ROLL`` bytes and returns the
index (archive, offset, length, url, digest, id), which is written first of all that is
read.  File names are drawn by each attempt and only the index of the attempt that Spark
commits names them, so a lost or repeated task leaves at most a file that nothing reads.

Reading: the index rows of the records wanted are dealt out by archive and stretches of
``STRETCH`` bytes, sorted by offset, and neighbours with less than ``GAP`` bytes between
them are read at once, up to ``SPAN`` bytes.  Digests are taken anew from the payloads
that are read.  A revisit gets length and digest from the record that it names.

Defined cases: a null payload is empty; a null id is the smallest of its group, has no id
line and reads back as null; rows of equal id and payload are each a record, responses if
theirs is the largest id; a null url has no target line, and bytes outside printable ASCII
are percent-encoded in it; very long payloads are one record and one read; other columns
are not looked at; an empty table gives no archives and an empty index.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, fresh_path, read, stored

ROLL, STRETCH, SPAN, GAP = 1 << 30, 64 << 20, 8 << 20, 64 << 10
INDEX = "archive string, offset long, length long, url string, digest string, id long, record_type string"
RECORDS = "id long, record_type string, record_id string, refers_to string, payload_bytes long, payload_digest string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS_HELD = 64


def _url(url: str) -> str:
    """The url in printable ASCII."""
    return "".join(chr(b) if 0x20 < b < 0x7F else f"%{b:02X}" for b in url.encode())


def record_id(digest: str, page: int | None) -> str:
    """The name of the response for a shared payload: its SHA-256 and id."""
    return uuid.UUID(bytes=hashlib.sha256(f"{digest}|{page}".encode()).digest()[:16], version=5).urn


def member(page: int | None, url: str | None, payload: bytes, name: str, refers: str | None, date: str) -> bytes:
    """One record, compressed."""
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""]
    block = b"\r\n".join(http) + (b"" if refers else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}",
             *([f"WARC-Target-URI: {_url(url)}"] if url is not None else []), *([f"WARC-Page-ID: {page}"] if page is not None else []),
             f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
             *([f"WARC-Refers-To: <{refers}>", f"WARC-Profile: {PROFILE}"] if refers else []),
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; raises ValueError if it is none."""
    unpack = zlib.decompressobj(31)
    text = unpack.decompress(raw) + unpack.flush()
    if not unpack.eof or unpack.unused_data:
        raise ValueError("the byte range is not one record")
    head, _, rest = text.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if not first.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    fs, base = file_system(folder)
    out, name, at, rows = None, None, 0, []
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()),
                        ("digest", pa.string()), ("id", pa.int64()), ("record_type", pa.string())])
    try:
        for b in itertools.chain.from_iterable((x.slice(i, ROWS_HELD) for i in range(0, x.num_rows, ROWS_HELD)) for x in batches):
            for row in b.to_pylist():
                if out is None or at >= ROLL:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                payload, shared = (row["payload"] or "").encode(), row["stands"]
                revisit = bool(shared) and row["id"] != row["best"]
                own = record_id(row["sha256"], row["best"]) if shared and not revisit else uuid.uuid5(uuid.NAMESPACE_OID, f"{name}:{at}").urn
                packed = member(row["id"], row["url"], payload, own, record_id(row["sha256"], row["best"]) if revisit else None, date)
                out.write(packed)
                rows.append((name, at, len(packed), row["url"], hashlib.sha1(payload).hexdigest(), row["id"], "revisit" if revisit else "response"))
                at += len(packed)
            if len(rows) > 2_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                rows = []
    finally:
        if out is not None:
            out.close()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000,
          folder: str | None = None, date: str = "1970-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """Writes the archives; returns their folder and the index.

    Payloads are compressed where they are read; only if the table of shared payloads is
    too large to be sent to all tasks do rows move, to be joined with it by digest.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"),
                        F.when(F.octet_length(body) >= least, F.sha2(body, 256)).alias("sha256"))
    shared = stored(rows.where("sha256 is not null").groupBy("sha256").agg(F.max("id").alias("best"), F.count("*").alias("held"))
                    .where("held > 1").select("sha256", "best", F.lit(True).alias("stands")), "warc-shared")
    index = stored(rows.join(shared, "sha256", "left").select("id", "url", "payload", "sha256", "best", "stands")
                   .mapInArrow(functools.partial(_write, folder=folder, date=date), INDEX), "warc-index")
    return folder, index


def spans(ranges: list[tuple[int, int]], gap: int = GAP, most: int = SPAN) -> Iterator[tuple[int, int]]:
    """(first, last + 1) runs of sorted (offset, length) ranges that one read fetches."""
    first = 0
    for i in range(1, len(ranges) + 1):
        if i == len(ranges) or ranges[i][0] - sum(ranges[i - 1]) > gap or sum(ranges[i]) - ranges[first][0] > most:
            yield first, i
            first = i


def _fetch(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, base = file_system(folder)
    schema = pa.schema([("id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
    name = source = None
    for b in batches:
        rows, wanted = [], list(zip(*[b.column(c).to_pylist() for c in ("archive", "offset", "length")]))
        for archive, own in itertools.groupby(wanted, key=lambda w: w[0]):
            if archive != name:
                if source is not None:
                    source.close()
                name, source = archive, fs.open_input_file(f"{base}/{archive}")
            ranges = [w[1:] for w in own]
            for first, end in spans(ranges):
                start = ranges[first][0]
                raw = memoryview(source.read_at(sum(ranges[end - 1]) - start, start))
                for offset, length in ranges[first:end]:
                    fields, payload = parse(raw[offset - start:offset - start + length])
                    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    digest, kind = hashlib.sha1(payload).digest(), fields["WARC-Type"]
                    if kind == "response" and told != base64.b32encode(digest).decode():
                        raise ValueError(f"{archive} at {offset}: the payload is not what its digest says")
                    page, refers = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To")
                    rows.append((None if page is None else int(page), kind, fields["WARC-Record-ID"][1:-1], refers and refers[1:-1],
                                 len(payload), digest.hex() if kind == "response" else base64.b32decode(told).hex()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
    if source is not None:
        source.close()


def fetch(folder: str, index: DataFrame) -> DataFrame:
    """The records of the given index rows, as the archives hold them."""
    stretch = F.floor(F.col("offset") / STRETCH)
    return (index.select("archive", "offset", "length").repartition("archive", stretch).sortWithinPartitions("archive", "offset")
            .mapInArrow(functools.partial(_fetch, folder=folder), RECORDS))


def resolve(records: DataFrame) -> DataFrame:
    """Revisits get length and digest from the response that they name."""
    records = stored(records, "warc-records")
    named = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(
        F.max("id").alias("target"), F.max("payload_bytes").alias("full"), F.max("payload_digest").alias("full_digest"))
    plain = records.where("refers_to is null").select("id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = records.where("refers_to is not null").join(named, "refers_to", "left")
    same = F.when(F.col("payload_digest") == F.col("full_digest"), F.col("full_digest")).otherwise(
        F.raise_error(F.concat(F.lit("no response for "), "refers_to")))
    return plain.union(again.select("id", "full", same, "record_type", "target"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = write(read(spark, sf_dir, "pages"))
    return resolve(fetch(folder, index)).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, coalesce(html, '') AS body FROM pages),
s AS (SELECT body, max(page_id) AS best, count(*) AS held FROM p WHERE n >= 1000 GROUP BY body)
SELECT page_id, n AS payload_bytes, sha1(p.body) AS payload_digest,
       CASE WHEN held > 1 AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN held > 1 AND page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM p LEFT JOIN s ON p.body = s.body AND n >= 1000
"""
