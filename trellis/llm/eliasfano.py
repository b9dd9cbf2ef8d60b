"""Operator 10: token ids in binary files with Elias-Fano coded document boundaries.

File format (little-endian).  A file holds blocks one after another, each followed
by a line feed.  A block:

    magic "EFTK1\\0" | id width u16 | documents u64 | ids u64 | documents without id u64
    | EF(ends of the documents in the id array) | EF(document ids less the first) | first id i64 | ids

EF(x): count u64, low bits u8, length of the high part u64, number of samples u64,
high part, low part, samples.  The high part has bit (x[i] >> low) + i set for each
i; ``samples`` are the places of every 256th set bit in 32 bits, so that select needs
a short scan: two bits and a little for each document instead of 64.

A block closes at ``BLOCK_IDS`` ids or at its document's end, so a worker's memory is
bounded by that and the longest text.  Files are written by Spark's writer, under its
commit protocol, into any store Spark reaches, in ascending order of (doc_id, hash of
the text) over file names.

A reader gets each document's place by ``select`` in its block's boundaries.

Defined results: a null or empty text has only the end id; documents whose doc_id is
null come first; equal doc_ids are ordered by the hash of their text; a text that holds an
added token of the tokenizer gets that token's id there, as from the library; a very long
text makes its block longer.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.llm.scratch import new_dir, stage, tuned
from trellis.llm.vocab import ByteLevelEncoder, encoder, release

MAGIC = b"EFTK1\0"
BLOCK_IDS = 4_000_000
#: Bytes of texts of a range of documents, number of ranges at most, and rows that the ranges are drawn from.
RANGE_BYTES, MAX_RANGES, RANGE_SAMPLE = 32 << 20, 100_000, 100_000
#: Blocks of a file at most: a file is one value to its reader.
FILE_BLOCKS = 8
SAMPLE = 256
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, high: np.ndarray, low: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.high, self.low, self.samples = n, low_bits, high, low, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        x = np.asarray(values, np.uint64)
        n = len(x)
        bits = max(0, int(x[-1] // np.uint64(n)).bit_length() - 1) if n else 0
        places = (x >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        flags[places] = 1
        lows = (x[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        return cls(
            n,
            bits,
            np.packbits(flags, bitorder="little"),
            np.packbits(lows.astype(np.uint8).ravel(), bitorder="little"),
            places[::SAMPLE].astype(np.uint32),
        )

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        window = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3].tobytes(), "little")
        return (window >> (first & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Place of the set bit number i of the high part: from the sample before it, bytes are counted."""
        place = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, place >> 3
        word = int(self.high[byte]) & (0xFF << (place & 7)) & 0xFF
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return (byte << 3) + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        return (self.select(i) - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        """Every value, by one scan."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        x = (places - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits)
        if self.low_bits and self.n:
            lows = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
            x |= (lows.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return x.astype(np.int64)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQ", self.n, self.low_bits, len(self.high), len(self.samples))
        return head + self.high.tobytes() + self.low.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, bits, highs, samples = struct.unpack_from("<QBQQ", data, at)
        at += struct.calcsize("<QBQQ")
        lows = (n * bits + 7) >> 3
        cut = [at, at + highs, at + highs + lows, at + highs + lows + 4 * samples]
        high, low = (np.frombuffer(data[a:b], np.uint8) for a, b in (cut[:2], cut[1:3]))
        return cls(n, bits, high, low, np.frombuffer(data[cut[2] : cut[3]], "<u4")), cut[3]


def block(doc_ids: list, parts: list[bytes], width: int) -> bytes:
    """One block; ``doc_ids`` ascend, nulls first; ``parts`` are the documents' ids."""
    ends = np.cumsum([len(p) // width for p in parts]) if parts else np.zeros(0, np.int64)
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    head = MAGIC + struct.pack("<HQQQ", width, len(parts), int(ends[-1]) if parts else 0, len(doc_ids) - len(known))
    ids = EliasFano.of(np.array([d - first for d in known], np.uint64))
    return head + EliasFano.of(ends).to_bytes() + ids.to_bytes() + struct.pack("<q", first) + b"".join(parts)


class Block:
    """A block read back: offsets by select, ids by slices."""

    def __init__(self, data: memoryview, at: int):
        if bytes(data[at : at + 6]) != MAGIC:
            raise ValueError("not a block of token ids")
        self.width, self.docs, self.count, nulls = struct.unpack_from("<HQQQ", data, at + 6)
        self.ends, at = EliasFano.read(data, at + 6 + struct.calcsize("<HQQQ"))
        ids, at = EliasFano.read(data, at)
        (first,) = struct.unpack_from("<q", data, at)
        self._nulls, self._ids, self._first = nulls, ids, first
        self.end = at + 8 + self.count * self.width
        self.ids = np.frombuffer(data[at + 8 : self.end], f"<u{self.width}")

    def doc_id(self, i: int) -> int | None:
        return None if i < self._nulls else self._ids[i - self._nulls] + self._first

    def bounds(self, i: int) -> tuple[int, int]:
        """Start and end of document i in the id array, each by one select."""
        return (self.ends[i - 1] if i else 0), self.ends[i]


def blocks(data: bytes):
    view, at = memoryview(data), 0
    while at < len(view):
        one = Block(view, at)
        at = one.end + 1
        yield one


def _bounds(rows: DataFrame) -> list[tuple]:
    """Lower ends of the ranges of (id known, id, tie), nulls first, but that of the first, from a sample of ``RANGE_SAMPLE`` rows or so.

    They only steer how even the ranges are.  The texts are read once for their hashes, and not encoded.
    """
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length(rows.columns[2]) + 8)).first()
    parts = min(MAX_RANGES, max(rows.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // RANGE_BYTES)))
    share = min(1.0, RANGE_SAMPLE / max(n, 1))
    some = rows.select("id", "tie").sample(share, 7)
    keys = sorted((r.id is not None, r.id or 0, r.tie) for r in some.collect())
    return [keys[len(keys) * k // parts] for k in range(1, parts)] if keys else []


def _range(bounds: list[tuple], key: tuple, k: int) -> int:
    """The range of a row; rows of a key that fills several ranges are equal and are dealt to these by turns."""
    low, high = bisect_left(bounds, key), bisect_right(bounds, key)
    return high if high - low < 2 else low + 1 + k % (high - low)


def write(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode each whole text, append ``end_id`` and write the files."""
    tuned(docs.sparkSession)
    end = np.array([end_id], "<u2").tobytes()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie"), text_col)
    bounds = _bounds(rows)

    def encode(batches):
        coder = encoder(ByteLevelEncoder, tokenizer_path)
        for batch in batches:
            ids = [coder.encode(t.as_py() or "") + end for t in batch.column(2)]
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            parts = [_range(bounds, (i is not None, i or 0, t), k) for k, (i, t) in enumerate(keys)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["part", "id", "tie", "ids"])

    def run(batches):
        release()
        doc_ids, parts, size = [], [], 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                doc_ids.append(doc_id)
                parts.append(ids.as_py())
                size += len(parts[-1])
                if size >= 2 * BLOCK_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([block(doc_ids, parts, 2)], pa.binary())], ["block"])
                    doc_ids, parts, size = [], [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([block(doc_ids, parts, 2)], pa.binary())], ["block"])

    # texts are encoded where they are read; their ids, a fraction of them, are shuffled
    encoded = rows.mapInArrow(encode, "part int, id long, tie long, ids binary")
    (
        encoded.repartitionById(len(bounds) + 1, "part")
        .sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("tie"))
        .mapInArrow(run, "block binary")
        .select(F.col("block").cast("string").alias("value"))
        .write.option("lineSep", "\n")
        .option("maxRecordsPerFile", FILE_BLOCKS)
        .text(path)
    )


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start over all files, n_tokens, ids_crc32 of its ids in 32 bits."""
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part, number = (int(x) for x in file.split("-"))
                base = 0
                for one in blocks(content.as_py()):
                    bounds = [one.bounds(i) for i in range(one.docs)]
                    crcs = [zlib.crc32(one.ids[a:b].astype("<u4").tobytes()) for a, b in bounds]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part] * one.docs, pa.int64()),
                            pa.array([number] * one.docs, pa.int64()),
                            pa.array([one.doc_id(i) for i in range(one.docs)], pa.int64()),
                            pa.array([a + base for a, _ in bounds], pa.int64()),
                            pa.array([b - a for a, b in bounds], pa.int64()),
                            pa.array(crcs, pa.int64()),
                        ],
                        ["part", "number", id_col, "start", "n_tokens", "ids_crc32"],
                    )
                    base += one.count

    schema = f"part long, number long, `{id_col}` long, start long, n_tokens long, ids_crc32 long"
    # files of a partition are numbered in their order at the end of their names
    number = F.concat_ws("-", F.regexp_extract("path", r"part-(\d+)", 1), F.regexp_extract("path", r"-c(\d+)[^/]*$", 1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        found = stage(spark.read.format("binaryFile").load(path).select(number, "content").mapInArrow(run, schema), "tokens")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    # one row for each file
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    totals = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("part", "number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return found.join(bases, ["part", "number"]).select(id_col, (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write files to the shared folder and read them back."""
    path = new_dir(docs.sparkSession, "ids")
    write(docs, tokenizer_path, end_id, path, id_col, text_col)
    return read(docs.sparkSession, path, id_col)
