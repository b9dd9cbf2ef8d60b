"""Operator 8: near-duplicate vectors by product quantisation over coarse inverted lists.

Vectors are scaled to length 1; equal vectors become one with a multiplicity first.  A cell
holds the vectors nearest to its centroid.  Two linked vectors are no farther apart than
d = sqrt(2 - 2t); if they lie in different cells, their distances from the plane between the
two centroids add up to at most d, so one of them is within d / 2 of it.  Each vector probes
its own cell and, of the ``PROBES`` cells nearest to it, those whose plane is that near.  A pair
is lost only where neither end's cell is among the other's nearest ``PROBES``; with up to
``PROBES`` cells none is.  (Simulated with 64 unclustered dimensions and 2000 cells: 0.6 % of
pairs at a cosine of 0.90 exactly, 0.1 % at 0.93, none of 5000 at 0.97.)

A cell is cut into blocks of bounded size; a block is shuffled and indexed once, and the vectors
that probe it stream past it in batches.  In a block there are inverted lists around local
centroids; a vector's residual from its list's centroid is coded by ``SUBSPACES`` codewords, and
the length of what the code misses is kept as e.  Three steps lose no pair of cosine >= t:

* probes of lists, by the same bound as above;
* asymmetric distances.  x.y = x.centroid + x.code + x.missed, and the last is at most
  e(y): pairs whose table-lookup sum plus e(y) stays under t are dropped;
* rerank by the exact cosine in double precision.

A pair that both ends would find is counted by the end with the smaller row number.  A task
returns link counts and a spanning forest of its links, never the pairs: a group of near copies,
however large, adds rows in proportion to its size.

Centroids and codewords are fitted on ``SAMPLE`` vectors (cells: the first by hash; lists: evenly
spaced ones of the block); they only steer the search.

Defined results: null, zero or non-finite vectors have no links and are their own component;
repeated rows are vectors of their own, linked with each other, also if they share an id; vectors
of different lengths don't link; a null id never is a component's id while it has another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.components import connected, spread_join
from trellis.llm.scratch import stage, tuned
from trellis.llm.vectors import matrix, usable

SAMPLE = 20_000
SUBSPACES, CODEWORDS = 8, 64
#: Cells that a vector probes at most.
PROBES = 8
MAX_CELLS = 4096
#: Vector lengths that have cells; rarer lengths have one cell each.
MAX_WIDTHS = 16
#: Rows of a block, of the queries that go past it in one task, and of a batch of these.
BLOCK, QUERY_BLOCK, QUERY_BATCH = 16_384, 65_536, 2048
#: Vectors of a block that its lists and codewords are fitted on, and rows of a list.
BLOCK_SAMPLE, LIST_ROWS = 4096, 64
#: Pairs of a list whose distances are held at once.
PAIRS = 1 << 21
#: Over the rounding of single-precision table sums.
SLACK = 1e-5


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(b @ centres.T - 0.5 * (centres**2).sum(1), axis=1) for b in np.array_split(x, -(-len(x) // 1024))])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        counts = np.bincount(nearest, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """At most k centres of length 1."""
    found = kmeans(x, min(k, len(x)))
    norms = np.linalg.norm(found, axis=1)
    found = found[norms > 0] / norms[norms > 0, None]
    return found if len(found) else x[:1].copy()


def gaps(centres: np.ndarray) -> np.ndarray:
    """Distances between the centres."""
    return np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 1e-18))


class Codebook:
    """Coarse centroids (length 1) and residual codewords."""

    def __init__(self, x: np.ndarray, lists: int):
        self.centroids = centroids(x, lists)
        residual = x - self.centroids[self.assign(x)]
        self.cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
        self.words = [kmeans(residual[:, a:b], min(CODEWORDS, len(x))) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        self.apart = gaps(self.centroids)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centroids.T, axis=1)

    def encode(self, x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the length of what they miss."""
        rest = x - self.centroids[of]
        codes = np.empty((len(x), len(self.words)), np.uint8)
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            words = self.words[m]
            codes[:, m] = np.argmax(rest[:, a:b] @ words.T - 0.5 * (words**2).sum(1), axis=1)
            rest[:, a:b] -= words[codes[:, m]]
        return codes, np.linalg.norm(rest, axis=1)

    def probes(self, x: np.ndarray, reach: float) -> np.ndarray:
        """Whether each vector probes each of the lists: its plane with the vector's nearest list is within reach."""
        near = x @ self.centroids.T
        of = np.argmax(near, axis=1)
        plane = (near[np.arange(len(x)), of][:, None] - near) / self.apart[of]
        plane[np.arange(len(x)), of] = 0
        return plane <= reach + SLACK

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        """x.codeword for each subspace."""
        return [x[:, a:b] @ w.T for w, a, b in zip(self.words, self.cuts, self.cuts[1:], strict=False)]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of pairs over 0..size-1, as (node, smallest node of its component)."""
    label = np.arange(size)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            node = np.flatnonzero(label != np.arange(size))
            return node, label[node]


class Block:
    """Indexed rows of a cell."""

    def __init__(self, rid: np.ndarray, x: np.ndarray, weight: np.ndarray, asks: np.ndarray, threshold: float):
        self.rid, self.x, self.weight, self.asks, self.threshold = rid, x, weight, asks, threshold
        self.reach = np.sqrt(max(0.0, 2 - 2 * threshold)) / 2
        unit = _unit(x)
        sample = unit[:: max(1, -(-len(x) // BLOCK_SAMPLE))]
        self.book = Codebook(sample, max(1, len(x) // LIST_ROWS))
        of = self.book.assign(unit)
        self.codes, missed = self.book.encode(unit, of)
        self.missed, self.unit = missed.astype(np.float32), unit.astype(np.float32)
        self.lists = [np.flatnonzero(of == c) for c in range(len(self.book.centroids))]

    def links(self, cell: int, rid: np.ndarray, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions (query, row) of linked pairs that this cell counts; ``home`` are the queries' cells."""
        unit = _unit(x)
        probed, coarse, single = self.book.probes(unit, self.reach), (unit @ self.book.centroids.T).astype(np.float32), unit.astype(np.float32)
        tables = [t.astype(np.float32) for t in self.book.tables(unit)]
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for c, there in enumerate(self.lists):
            asking = np.flatnonzero(probed[:, c]) if len(there) else there
            some = max(1, PAIRS // max(1, len(there)))
            for a in range(0, len(asking), some):
                here = asking[a : a + some]
                near = coarse[here, c][:, None] + self.missed[there][None, :]
                for m, table in enumerate(tables):
                    near += np.take(table[here], self.codes[there, m], axis=1)
                may = near >= self.threshold - SLACK
                if not may.any():
                    continue
                may &= single[here] @ self.unit[there].T >= self.threshold - SLACK  # single precision first
                q, d = np.nonzero(may)
                q, d = here[q], there[d]
                # the other end finds the pair as well if it probes the query's cell: the smaller row number counts it
                both = (self.asks[d] == home[q][:, None]).any(1)
                keep = (rid[q] != self.rid[d]) & (~both | (rid[q] < self.rid[d]))
                q, d = q[keep], d[keep]
                for s in range(0, len(q), 65536):
                    u, v = x[q[s : s + 65536]], self.x[d[s : s + 65536]]
                    cosine = (u * v).sum(1) / (np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1))
                    sure = cosine >= self.threshold
                    pairs.append((q[s : s + 65536][sure], d[s : s + 65536][sure]))
        return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def links(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, n_links, component_id, kept: a row for each row of ``vectors``."""
    tuned(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    x = F.when(usable(vectors, vector_col), F.col(vector_col).cast("array<float>" if single else "array<double>"))
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), x.alias("x"))
    key = F.struct(F.xxhash64("x").alias("a"), F.xxhash64(F.lit(1), "x").alias("b"))  # 128 bits of the vector
    every = stage(rows.withColumn("key", F.when(F.col("x").isNotNull(), key)), "vectors")
    # equal vectors: the first row stands for all
    same = every.where("x is not null").groupBy("key").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("c"))
    same = stage(same, "same")
    found = stage(_found(stage(every.select("rid", "x").join(same.select("rid", "c"), "rid"), "distinct"), threshold), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n"))
    roots = connected(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rid")
    own = same.join(counts, "rid", "left").join(roots, "rid", "left")
    own = stage(own.select("key", "c", F.coalesce("root", "rid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n_links")), "own")
    keyed = spread_join(every.where("key is not null").select("rid", "id", "key"), own, "key", every.count())
    least = keyed.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("c"))
    out = spread_join(keyed, stage(least, "least"), "root", every.count())
    alone = every.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.select("id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(alone)
    return out.select(
        F.col("id").cast(kind).alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _cells(rows: DataFrame) -> dict[int, np.ndarray]:
    """Centroids of the cells of the most frequent vector lengths."""
    widths = rows.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").limit(MAX_WIDTHS).collect()
    out = {}
    for w in widths:
        cells = min(MAX_CELLS, -(-4 * w.n // (3 * BLOCK)))
        if cells > 1:
            sample = rows.where(F.size("x") == w.width).orderBy(F.xxhash64("rid")).limit(SAMPLE).select("x").toArrow()
            out[w.width] = centroids(_unit(matrix(sample["x"], w.width)), cells)
    return out


def _found(rows: DataFrame, threshold: float) -> DataFrame:
    """Of distinct vectors (rid, x, c): link counts (a, null, n) and a forest of links (a, b, 0)."""
    cells = rows.sparkSession.sparkContext.broadcast(_cells(rows))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) / 2)
    vector = rows.schema["x"].dataType.simpleString()

    def place(batches):
        """Each row with its own cell and the cells that it probes."""
        apart = {w: gaps(c) for w, c in cells.value.items()}
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            home, asks = np.zeros(len(lengths), np.int32), [[0]] * len(lengths)
            for w in set(lengths.tolist()) & apart.keys():
                at = np.flatnonzero(lengths == w)
                near = _unit(matrix(batch.column(1).take(pa.array(at)), w)) @ cells.value[w].T
                of = np.argmax(near, axis=1)
                plane = (near[np.arange(len(at)), of][:, None] - near) / apart[w][of]
                plane[np.arange(len(at)), of] = 0
                top = np.argsort(-near, axis=1, kind="stable")[:, :PROBES]
                home[at] = of
                for row, cell, some in zip(at, top, np.take_along_axis(plane, top, axis=1) <= reach + SLACK, strict=True):
                    asks[row] = cell[some].tolist()
            arrays = [*batch.columns, pa.array(lengths.astype(np.int32)), pa.array(home), pa.array(asks, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["rid", "x", "c", "width", "home", "asks"])

    placed = rows.select("rid", "x", "c").mapInArrow(place, f"rid long, x {vector}, c long, width int, home int, asks array<int>")
    placed = stage(placed.withColumnRenamed("c", "weight"), "placed")
    cell = lambda of: F.struct("width", F.col(of).alias("cell")).alias("g")
    asked = placed.select("width", F.explode("asks").alias("ask"), "rid")
    sizes = placed.groupBy(cell("home")).agg(F.count(F.lit(1)).alias("n")).join(asked.groupBy(cell("ask")).agg(F.count(F.lit(1)).alias("c")), "g")
    upto = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    sizes = stage(sizes.select("g", "c", upto("n", BLOCK).alias("i_of"), upto("c", QUERY_BLOCK).alias("j_of")), "sizes")
    tasks = int(sizes.agg(F.sum(F.col("i_of") * F.col("j_of"))).first()[0] or 1)
    dealt = lambda salt, n: F.pmod(F.xxhash64("rid", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    count = placed.count()
    columns = ["rid", "x", "weight", "home", "asks"]
    data = spread_join(placed.select(cell("home"), *columns), sizes, "g", count)
    data = data.select("g", dealt(1, "i_of").alias("i"), every("j_of").alias("j"), F.lit(0).alias("kind"), *columns)
    probing = spread_join(placed.withColumn("ask", F.explode("asks")).select(cell("ask"), *columns), sizes, "g", count)
    probing = probing.select("g", every("i_of").alias("i"), dealt(2, "j_of").alias("j"), F.lit(1).alias("kind"), *columns)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def compare(batches):
        now, held, block = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True))
            begins = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(begins, begins[1:], strict=False):
                if a == b:
                    continue
                (width, number, i, j, kind), part = keys[a], batch.slice(a, b - a)
                rid, x, weight, home = part.column(5).to_numpy(), matrix(part.column(6), width), part.column(7).to_numpy(), part.column(8).to_numpy()
                if now != keys[a][:4]:
                    now, held, block = keys[a][:4], [], None
                if kind == 0:
                    asks = np.full((len(rid), PROBES), -1)
                    for row, some in zip(asks, part.column(9).to_pylist(), strict=True):
                        row[: len(some)] = some
                    held.append((rid, x, weight, asks))
                    continue
                if not held:
                    continue
                block = block or Block(*(np.concatenate(h) for h in zip(*held, strict=True)), threshold)
                q, d = block.links(number, rid, x, home)
                rids, back = np.unique(np.concatenate([rid[q], block.rid[d]]), return_inverse=True)
                u, v = back[: len(q)], back[len(q) :]
                node, root = _forest(u, v, len(rids))
                n = np.bincount(u, block.weight[d], len(rids)) + np.bincount(v, weight[q], len(rids))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([rids, rids[node]]), pa.int64()),
                        pa.concat_arrays([pa.nulls(len(rids), pa.int64()), pa.array(rids[root], pa.int64())]),
                        pa.array(np.concatenate([n.astype(np.int64), np.zeros(len(node), np.int64)])),
                    ],
                    schema=schema,
                )

    flat = [F.col("g.width").alias("width"), F.col("g.cell").alias("cell"), "i", "j", "kind", *columns]
    rows = data.unionByName(probing).select(*flat)
    rows = rows.repartition(min(tasks, 1 << 16), "width", "cell", "i", "j").sortWithinPartitions("width", "cell", "i", "j", "kind", "rid")
    return rows.mapInArrow(compare, "a long, b long, n long")
