"""Operator 9: WARC archives of pages, written in segments and reassembled.

Writing.  Each page becomes a ``response`` record whose HTTP body is in chunked
transfer framing.  A record block over ``SEGMENT_BYTES`` is cut into segments: the
first keeps its type with WARC-Segment-Number 1, the rest are ``continuation``
records with WARC-Segment-Origin-ID, and the last has WARC-Segment-Total-Length.
Of records with equal payloads of at least ``MIN_DEDUP`` bytes that with the largest
page_id is the response; the others are ``revisit`` records without a body that name
it.  Files are written by Spark's writer in any store that Spark reaches, each record in a gzip
member of its own, at most ``FILE_RECORDS`` records in a file.

Reading.  Gzip members, one or many in a file, and records of WARC 1.0 and 1.1 are parsed, a file
at a time; records in one piece are complete.
Segments are grouped by origin, ordered by number, checked for gaps, for the total
length and for the block digest, and joined; then the chunked framing is decoded and
the payload digest is verified, as far as a record states digests (base 16 or 32).  A record that
fails raises an error.

Defined results: a null or empty html is an empty payload, a response; rows that
repeat a page_id are records of their own, and those with the largest page_id of
equal payloads are all responses.  A null page_id is a response and is never
referred to.  A very long page is segments of bounded size, joined in one task.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.scratch import new_dir, stage, tuned

MIN_DEDUP = 1000
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4096
FILE_RECORDS = 8192
_END = b"\r\n\r\n"
_VERSION = b"WARC/1.1\r\n"
#: Between the members that Spark's writer puts on lines: a member that holds nothing.
_EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
_READ = 1 << 16


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0" + _END


def dechunked(data: bytes) -> bytes:
    """Payload of a chunked body; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        line = data.index(b"\r\n", at)
        size = int(data[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is not closed")
        out.append(data[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its closing blank lines."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return _VERSION + lines.encode() + b"\r\n" + block


def records(page: int | None, uid: str, url: str, payload: bytes, digest: str, kind: str, refers_to, segment: int = SEGMENT_BYTES):
    """The WARC records of one page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + _END
    block = http if kind == "revisit" else http + chunked(payload)
    base = [
        ("WARC-Target-URI", re.sub(r"\s", "%20", url)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Page", "" if page is None else page),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", len(payload)),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
    ]
    if kind == "revisit":
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        base += [("WARC-Profile", profile), ("WARC-Refers-To", refers_to)]
    cuts = range(0, len(block), segment)
    for k, a in enumerate(cuts):
        head = [("WARC-Type", kind if k == 0 else "continuation"), ("WARC-Record-ID", f"<urn:x:{uid}>" if k == 0 else f"<urn:x:{uid}-{k + 1}>")]
        if len(cuts) > 1:
            head.append(("WARC-Segment-Number", k + 1))
        if k:
            head.append(("WARC-Segment-Origin-ID", f"<urn:x:{uid}>"))
            if k == len(cuts) - 1:
                head.append(("WARC-Segment-Total-Length", len(block)))
        yield _record(head + (base if k == 0 else []), block[a : a + segment])


def member(data: bytes) -> bytes:
    """A gzip member."""
    make = zlib.compressobj(6, zlib.DEFLATED, 31)
    return make.compress(data) + make.flush()


def inflate(data: bytes) -> bytes:
    """All gzip members of a file, in bounded steps, so that many small ones are read in linear time."""
    view, at, out = memoryview(data), 0, []
    while at < len(view):
        one = zlib.decompressobj(31)
        while not one.eof:
            some = view[at : at + _READ]
            if not len(some):
                raise ValueError("a gzip member is cut off")
            out.append(one.decompress(some))
            at += len(some) - len(one.unused_data)
    return b"".join(out)


def parse(data: bytes):
    """(headers in lower case, block) of each record of a file."""
    at = 0
    while at < len(data):
        if data[at : at + len(_VERSION)] not in (_VERSION, b"WARC/1.0\r\n"):
            raise ValueError(f"no record at byte {at}")
        end = data.index(_END, at)
        lines = data[at + len(_VERSION) : end].decode().split("\r\n")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start, size = end + 4, int(headers["content-length"])
        if data[start + size : start + size + 4] != _END:
            raise ValueError("a record is not closed")
        yield headers, data[start : start + size]
        at = start + size + 4


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Decide responses and revisits and write the archives."""
    tuned(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        html.alias("html"),
        F.sha1(html).alias("digest"),
        F.octet_length(html).alias("size"),
    )
    # only payloads that occur more than once: one row for each, made before the shuffle
    copies = (
        rows.where(F.col("size") >= MIN_DEDUP)
        .groupBy("digest")
        .agg(F.max("page").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first is not null")
        .select("digest", "first")
    )

    def run(batches):
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in range(6)]
            for page, url, html, digest, first, uid in zip(*columns, strict=True):
                kind = "revisit" if first is not None and page is not None and page != first else "response"
                out += [member(r + _END) for r in records(page, uid, url, html.encode("utf-8"), digest, kind, first)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    (
        rows.join(copies, "digest", "left")
        .select("page", "url", "html", "digest", "first", F.uuid().alias("uid"))
        .mapInArrow(run, "record binary")
        .select(F.col("record").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", _EMPTY_MEMBER.decode("latin-1"))
        .option("maxRecordsPerFile", FILE_RECORDS)
        .text(path)
    )


_FIELDS = "page long, digest string, length long, kind string, refers_to long, block_digest string"
_NAMES = ["page", "digest", "length", "kind", "refers_to", "block_digest"]


def _hex(digest: str) -> str:
    return base64.b32decode(digest).hex() if len(digest) == 32 else digest.lower()


def _fields(h: dict[str, str]) -> list:
    number = lambda k: int(h[k]) if h.get(k) else None
    digest = lambda k: _hex(h[k].removeprefix("sha1:")) if k in h else None
    kind = h["warc-type"]
    return [
        number("warc-page"), digest("warc-payload-digest"), number("warc-payload-length"),
        None if kind == "continuation" else kind, number("warc-refers-to"), digest("warc-block-digest"),
    ]


def payload(block: bytes, block_digest: str | None, digest: str | None, kind: str) -> bytes | None:
    """Payload of a whole block, all digests verified; None for a revisit."""
    if block_digest is not None and hashlib.sha1(block).hexdigest() != block_digest:
        raise ValueError("the block's digest differs")
    if kind == "revisit":
        return None
    head, _, body = block.partition(_END) if block[:5] == b"HTTP/" else (b"", b"", block)
    found = dechunked(body) if re.search(rb"transfer-encoding:\s*chunked", head.lower()) else body
    # some writers state the digest of the body as it was transferred
    if digest is not None and digest not in (hashlib.sha1(found).hexdigest(), hashlib.sha1(body).hexdigest()):
        raise ValueError("the payload's digest differs")
    return found


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each page of the archives: page, kind, digest, length, refers_to, uri (and payload)."""

    def scan(batches):
        """Whole records decoded; segments as they are."""
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = inflate(data)
                columns: list[list] = [[] for _ in range(12)]
                for h, block in parse(data):
                    segment = h.get("warc-segment-number")
                    row = [*_fields(h), h.get("warc-segment-origin-id", h["warc-record-id"]), int(segment or 0)]
                    row.append(int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None)
                    row += [block if segment else None, None, None]
                    if not segment:
                        found = payload(block, row[5], row[1], row[3])
                        row[10] = found if with_payload else None
                        row[11] = len(found) if found is not None else row[2]
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
                names = [*_NAMES, "origin", "segment", "total", "part", "payload", "size"]
                table = pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                yield from table.to_batches(max_chunksize=256)

    def join(batches):
        """Blocks that were joined in order; the plan checked numbers and lengths."""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                found = payload(r["block"], r["block_digest"], r["digest"], r["kind"])
                out.append({**r, "payload": found if with_payload else None, "size": r["length"] if found is None else len(found)})
                out[-1].pop("block")
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(n, pa.int64() if n in ("page", "length", "refers_to", "size") else pa.binary() if n == "payload" else pa.string()) for n in [*_NAMES, "payload", "size"]]))

    schema = f"{_FIELDS}, origin string, segment int, total long, part binary, payload binary, size long"
    tuned(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    # a file at a time in a worker; once for whole records and segments
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        parsed = stage(files.mapInArrow(scan, schema), "records")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    whole = parsed.where("segment = 0").select(*_NAMES, "payload", "size")
    firsts = [F.max(c).alias(c) for c in [*_NAMES, "total"]]
    ordered = F.array_sort(F.collect_list(F.struct("segment", "part")))
    groups = parsed.where("segment > 0").groupBy("origin").agg(*firsts, ordered.alias("parts"))
    block = F.aggregate(F.col("parts.part"), F.lit(b""), lambda a, b: F.concat(a, b))
    sound = (F.col("parts")[F.size("parts") - 1]["segment"] == F.size("parts")) & (F.octet_length("block") == F.col("total"))
    checked = F.when(sound, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments don't add up: "), F.col("origin"))).cast("binary"))
    joined = groups.withColumn("block", block).select(*_NAMES, checked.alias("block"))
    again = joined.mapInArrow(join, f"{_FIELDS}, payload binary, size long")
    return whole.unionByName(again).select("page", "kind", "digest", "size", "refers_to", *["payload"] * with_payload)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", with_payload: bool = False) -> DataFrame:
    """Write archives to the shared folder and read them back: id, payload_bytes, payload_digest, record_type, refers_to."""
    path = new_dir(pages.sparkSession, "warc")
    write(pages, path, id_col, url_col, html_col)
    found = read(pages.sparkSession, path, with_payload)
    return found.select(
        F.col("page").alias(id_col),
        F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        "refers_to",
        *["payload"] * with_payload,
    )
