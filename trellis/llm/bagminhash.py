"""Operator 7: near-duplicate documents by BagMinHash over multisets of word shingles.

A document is the multiset of its shingles of five words (lower case, split at white
space; a shorter text is one shingle).  Weights are cut at 1, 2, 4, 8 ...: each interval
(2^(k-1), 2^k] of a shingle's weight axis carries a Poisson process whose rate is the
interval's length and whose points are marked with a unit step of the interval and with
one of the signature's components, all from a hash of the shingle.  A document sees the
points whose step is within the shingle's count; a component's value is its first point.
Two documents agree in a component with probability equal to their weighted Jaccard
similarity, without bias, for all integer counts.  Only points before a horizon are made,
set so that every component surely has one; where one has none the horizon doubles.

Signatures are cut into bands.  Equal texts (by 128 bits of SHA-256) are one node from the
start.  In each bucket of a band all nodes are compared with the one that meets most others in
all its buckets (the pivot) by the exact multiset similarity, a number of pairs linear in the
bucket.  What a pivot did not catch is found exactly as well: within a pivot's group, a node y
farther than 1 - t from the pivot is compared with all nodes x of other components, block by
block, save pairs that cannot reach t by a bound that is always true: similarity distance is a
metric, so |d(x, pivot) - d(y, pivot)| <= 1 - t for a link, and what y shares with x is at most
what y shares with all nodes of x's block together.  No pair is judged by its signature alone,
and groups of all sizes take the same way.  Classes are connected components of links.

Elements are keyed 64-bit hashes of five words, each word by its own hash, mixed step by step,
so no structure of a text makes unlike shingles equal (by chance: one pair in 2^64).

Defined results: null and empty texts, or texts of white space only, are no copies of
anything, also not of each other; a class's id is its smallest doc_id; rows that repeat a
doc_id are judged by their own texts; a null doc_id never is a class's id while the class has
another; a very long text is one multiset in a worker's memory, eight bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.chunks import _Memo
from trellis.llm.components import connected, spread_join
from trellis.llm.scratch import free_name, stage, tuned

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 5
SIZE = BANDS * ROWS
#: Rows of a block, and the bytes of its bags, about.
BLOCK_ROWS, BLOCK_BYTES = 256, 8 << 20
#: Key of the word hashes.
SEED = 0x5DEECE66D
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_word_hash = _Memo(lambda word: xxhash.xxh3_64_intdigest(word.encode("utf-8"), SEED), 400_000)


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their counts."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    each = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))
    span = min(WORDS, len(words))
    hashes = np.full(len(words) - span + 1, np.uint64(span))
    for k in range(span):
        hashes = _mix(hashes * _BASE + each[k : len(words) - span + 1 + k])
    return np.unique(hashes, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    whole = int(a[1].sum() + b[1].sum()) - shared
    return shared / whole if whole else 0.0


def _points(seeds: np.ndarray, rate: float, horizon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points of the processes before the horizon: (time, hash, index of the process)."""
    first = -np.log(((_mix(seeds + _BASE) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate
    at = np.flatnonzero(first <= horizon)
    expected = rate * horizon
    many = int(expected + 4 * expected**0.5) + 4
    while True:
        steps = np.arange(1, many + 1, dtype=np.uint64) * _BASE
        hashes = _mix(seeds[at, None] + steps[None, :])
        times = np.cumsum(-np.log(((hashes >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53), axis=1) / rate
        if not len(at) or times[:, -1].min() > horizon:
            inside = times <= horizon
            return times[inside], _mix(hashes[inside] + np.uint64(1)), np.broadcast_to(at[:, None], times.shape)[inside]
        many *= 2


def signature(bag: tuple[np.ndarray, np.ndarray], size: int = SIZE) -> np.ndarray:
    """The hash of each component's first point."""
    elements, counts = bag
    weight, horizon = float(counts.sum()), 0.0
    out = np.zeros(size, np.uint64)
    while True:
        horizon = horizon * 2 or size * (np.log(size) + 5) / weight
        times, marks, k = [], [], 0
        while True:
            low = 0 if k == 0 else 1 << (k - 1)
            seen = counts > low
            if not seen.any():
                break
            length = 1 if k == 0 else low
            t, h, of = _points(_mix(elements[seen] + np.uint64((k + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)), length, horizon)
            step = low + 1 + ((h >> np.uint64(32)) % np.uint64(length)).astype(np.int64)
            within = step <= counts[seen][of]
            times.append(t[within])
            marks.append(h[within])
            k += 1
        t, h = np.concatenate(times), np.concatenate(marks)
        place = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
        if np.bincount(place, minlength=size).min() > 0:
            last = np.argsort(-t, kind="stable")
            out[place[last]] = _mix(h[last])
            return out


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = values.reshape(bands, -1)
    keys = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    for column in rows.T:
        keys = _mix(keys ^ column) + _BASE
    return keys.view(np.int64)


def _digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def _sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Staged (id, node, bands) of each row: a node is the digest of a text."""

    def run(batches):
        for batch in batches:
            keys = []
            for text in batch.column(2):
                bag = shingles(text.as_py())
                keys.append(band_keys(signature(bag)).tolist() if len(bag[0]) else [])
            columns = [batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), _digest(F.col(text_col)).alias("node"), text_col)
    return stage(rows.mapInArrow(run, f"id {kind}, node binary, bands array<long>"), "signatures")


def _judged(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Staged (a, b, j) of pairs of a pivot and a node, j the exact similarity.

    A pivot's text goes once to each block of its nodes; a worker holds one pivot at a time.
    """
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"), F.count(F.lit(1)).alias("c"))
    blocks = stage(blocks, "blocks")
    dealt = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("s")
    members = spread_join(pairs, blocks, "a", pairs.count()).select("a", dealt, "b")
    members = members.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "s", "b", "text")
    pivots = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("s"))
    pivots = pivots.join(texts.select(F.col("node").alias("a"), "text"), "a").select("a", "s", F.lit(None).cast("binary").alias("b"), "text")

    def run(batches):
        pivot, bag = None, None
        for batch in batches:
            out = [[], [], []]
            for a, s, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if b is None:
                    pivot, bag = (a, s), shingles(text.as_py())
                    continue
                if pivot != (a, s):
                    raise ValueError("a node came before its pivot")
                for column, value in zip(out, (a, b, similarity(bag, shingles(text.as_py()))), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.binary(), pa.float64()), strict=True)], ["a", "b", "j"])

    rows = pivots.unionByName(members).repartition("a", "s").sortWithinPartitions("a", "s", F.col("b").asc_nulls_first())
    return stage(rows.mapInArrow(run, "a binary, b binary, j double"), "judged")


def _bags(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Staged (node, bag): the elements of the multiset, repeats numbered, as ascending 64-bit values."""

    def run(batches):
        for batch in batches:
            bags = []
            for text in batch.column(1):
                hashes, counts = shingles(text.as_py())
                copy = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                bags.append(np.sort(_mix(np.repeat(hashes, counts) + copy.astype(np.uint64) * _BASE)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary())], ["node", "bag"])

    rows = texts.select("node", "text").join(nodes.distinct(), "node", "left_semi")
    return stage(rows.mapInArrow(run, "node binary, bag binary"), "bags")


def links_between(ys: list[np.ndarray], xs: list[np.ndarray], may: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (y, x) of ascending bags with similarity of at least ``threshold`` among those that ``may`` allows."""
    sizes = [np.array([len(b) for b in bags]) for bags in (ys, xs)]
    flat = [np.concatenate(bags) for bags in (ys, xs)]
    # elements that the other block holds at all: no bag shares more than these
    held = []
    for own, other, n in ((flat[0], flat[1], sizes[0]), (flat[1], flat[0], sizes[1])):
        pool = np.unique(other)
        at = np.minimum(np.searchsorted(pool, own), len(pool) - 1)
        held.append(np.add.reduceat((pool[at] == own).astype(np.int64), np.cumsum(n) - n))
    shared = np.minimum(held[0][:, None], held[1][None, :])
    may = may & (shared >= threshold * (sizes[0][:, None] + sizes[1][None, :] - shared))
    begins, out = np.cumsum(sizes[1]) - sizes[1], []
    for k in np.flatnonzero(may.any(1)):
        own, hits = ys[k], np.flatnonzero(may[k])
        elements = flat[1] if 2 * len(hits) > len(xs) else np.concatenate([xs[h] for h in hits])
        n = sizes[1] if elements is flat[1] else sizes[1][hits]
        place = np.minimum(np.searchsorted(own, elements), len(own) - 1)
        both = np.add.reduceat((own[place] == elements).astype(np.int64), begins if elements is flat[1] else np.cumsum(n) - n)
        both = both[hits] if elements is flat[1] else both
        near = hits[both >= threshold * (sizes[1][hits] + len(own) - both)]
        out.append((np.full(len(near), k), near))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _remaining(judged: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Staged links (a, b) between different components within a pivot's group that its pivot did not catch.

    ``judged``: (a pivot, node, j, label).  Only links leave a task.
    """
    far = F.col("j") < threshold
    sizes = judged.groupBy("a").agg(
        F.count_if(far).alias("l"), F.count(F.lit(1)).alias("c"), F.min("label").alias("x"), F.max("label").alias("y")
    )
    sizes = stage(sizes.where("l > 0 and x <> y").select("a", "l", "c"), "sizes")
    rows = spread_join(judged, sizes.select("a", "c"), "a", judged.count())
    rows = stage(rows.join(_bags(texts, rows.select("node")), "node"), "bagged")
    sizes = sizes.join(rows.groupBy("a").agg(F.sum(F.octet_length("bag")).alias("w")), "a")
    blocks = lambda of: F.ceil(F.greatest(F.col(of) / BLOCK_ROWS, F.col("w") / BLOCK_BYTES)).cast("int")
    sizes = stage(sizes.select("a", "c", blocks("l").alias("ps"), blocks("c").alias("qs")), "blocks")
    rows = spread_join(rows, sizes, "a", rows.count())
    dealt = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["node", "j", "label", "bag"]
    ones = rows.where(far).select("a", dealt(1, "ps").alias("p"), upto("qs").alias("q"), *columns)
    again = [F.col(c).alias(c) for c in columns]  # columns of its own: both sides come from one table
    others = rows.select(F.col("a").alias("a"), upto("ps").alias("p"), dealt(2, "qs").alias("q"), *again)
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def compare(y: pa.Table, x: pa.Table) -> pa.Table:
        if not len(y) or not len(x):
            return schema.empty_table()
        i, j = y["j"].to_numpy(), x["j"].to_numpy()
        marks, known = [], {}
        for t in (y, x):
            marks.append(np.array([known.setdefault(v, len(known)) for v in t["label"].to_pylist()]))
        may = (np.abs(i[:, None] - j[None, :]) <= 1 - threshold + 1e-9) & (marks[0][:, None] != marks[1][None, :])
        bags = [[np.frombuffer(b, np.uint64) for b in t["bag"].to_pylist()] for t in (y, x)]
        k, h = links_between(*bags, may, threshold)
        return pa.Table.from_arrays([y["node"].combine_chunks().take(pa.array(k)), x["node"].combine_chunks().take(pa.array(h))], schema=schema)

    by = ["a", "p", "q"]
    found = ones.groupBy(*by).cogroup(others.groupBy(*by)).applyInArrow(compare, "a binary, b binary")
    return stage(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "remaining")


def _classified(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(id, node, empty, class_id, first node of the class's id, n_class) of each row."""
    tuned(docs.sparkSession)
    signed = _sign(docs, id_col, text_col)
    # nodes: equal texts, with the id that stands for them
    nodes = stage(signed.groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")), "nodes")
    keys = signed.where(F.size("bands") > 0).dropDuplicates(["node"]).select("node", F.explode("bands").alias("key"))
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = stage(keys.join(counts, "key"), "shared")
    # the node that meets most others is the pivot: of near copies that is the text they were made from
    score = shared.groupBy("node").agg(F.sum("c").alias("score"))
    shared = shared.join(score, "node").select("key", "node", "score")
    pivots = shared.groupBy("key").agg(F.max(F.struct("score", "node")).alias("top"), F.count(F.lit(1)).alias("c"))
    pivots = stage(pivots.select("key", F.col("top.node").alias("pivot"), "c"), "pivots")
    members = spread_join(shared.select("key", "node"), pivots, "key", signed.count())
    pairs = stage(members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node")
    wanted = wanted.select(F.col("node").alias("wanted"), F.col("rep").alias("by"))
    text = docs.select(_digest(F.col(text_col)).alias("node"), F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
    # of equal texts one row is shuffled, that with the smallest id
    one = (F.col("node") == F.col("wanted")) & F.col("rep").eqNullSafe(F.col("by"))
    texts = stage(text.join(wanted, one, "left_semi").dropDuplicates(["node"]), "texts")
    near = _judged(pairs, texts)
    links = near.where(F.col("j") >= threshold).select("a", "b")
    # what the pivots did not catch
    label = connected(links).select(F.col("node").alias("b"), F.col("root").alias("label"))
    judged = near.join(label, "b", "left").select("a", F.col("b").alias("node"), "j", F.coalesce("label", "b").alias("label"))
    more = _remaining(stage(judged, "labelled"), texts, threshold)
    roots = stage(connected(links.unionByName(more)), "roots")
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node"))
    ids = roots.join(nodes, "node").groupBy("root").agg(first.alias("first"), F.sum("c").alias("n_class"), F.count(F.lit(1)).alias("c"))
    ids = ids.select("root", F.col("first.rep").alias("class_id"), F.col("first.node").alias("first"), "n_class", "c")
    member = spread_join(roots, stage(ids, "classes"), "root", roots.count()).select("node", "class_id", "first", "n_class")
    own = nodes.join(member.withColumnsRenamed({"class_id": "i", "first": "f", "n_class": "n"}), "node", "left")
    alone = F.col("f").isNull()
    own = own.select(
        "node", F.when(alone, F.col("rep")).otherwise(F.col("i")).alias("class_id"), F.coalesce("f", "node").alias("first"), F.coalesce("n", "c").alias("n_class"), "c"
    )
    rows = signed.select("id", "node", (F.size("bands") == 0).alias("empty"))
    return spread_join(rows, stage(own, "own"), "node", signed.count())


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, class_id, n_class, kept): a row for each row of ``docs``; kept where it is its class's id."""
    out = _classified(docs, threshold, id_col, text_col).select(
        F.col("id").alias(id_col),
        F.when(F.col("empty"), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("empty"), 1).otherwise(F.col("n_class")).alias("n_class"),
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, all columns as they are: a row with the class's id and, of several texts
    with that id, the first by its digest.  Rows without text all stay.
    """
    rows = _classified(docs, threshold, id_col, text_col)
    first = (F.col("node") == F.col("first")) & F.col("id").eqNullSafe(F.col("class_id"))
    keys = rows.where(F.col("empty") | first).groupBy(F.col("id").alias("kept_id"), F.col("node").alias("kept_node"), "empty")
    kept = stage(keys.agg(F.count(F.lit(1)).alias("rows")), "kept")
    i, n = (free_name(docs.columns, c) for c in ("same_id", "same_node"))
    keyed = docs.withColumn(n, _digest(F.col(text_col))).withColumn(i, F.col(id_col))
    same = keyed[i].eqNullSafe(kept["kept_id"]) & (keyed[n] == kept["kept_node"])
    keep = lambda condition: keyed.join(kept.where(condition).select("kept_id", "kept_node"), same, "left_semi")
    out = keep("empty or rows = 1")
    if not kept.where("not empty and rows > 1").isEmpty():
        out = out.unionByName(keep("not empty and rows > 1").dropDuplicates([i, n]))
    return out.drop(i, n)
