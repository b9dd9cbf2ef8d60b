"""Operator 5: nearest neighbours by collision counting over single projections.

Rows are dealt by hash to blocks of bounded size; a block keeps ``PROJECTIONS`` sorted
arrays, one for each random direction.  A query opens a window around its own projection in
every array.  At radius R the windows reach WIDTH * R to both sides; a vector within distance
R of the query (both scaled to length 1) falls into a window with probability
p = P(|N(0,1)| <= WIDTH), so one that collides in at least p * m - MARGIN standard deviations
of the m arrays is verified by its exact cosine.  Virtual rehashing expands the windows by the
steps of GROWTH, in units of the distance at which a few rows of the block have their own k-th
neighbours.  A query ends when its k-th best verified vector lies within R; the last
radius covers the whole sphere.  Windows are intervals of ranks, so a batch of queries counts
its collisions by comparing each array's ranks with the batch's intervals.

A block is shuffled and indexed once, in a task that then streams the queries past it, a batch
at a time: memory is a block and a batch, however many queries there are.  Each query visits
each block and brings back k rows, which are merged.  Only vectors of equal length are compared.

Defined results: null, zero or non-finite vectors take no part; equal scores are ordered by
the smaller id; a row is its own query's neighbour never, but other rows may share its id or its
vector; rows that repeat an id are queries of their own; a null id is a neighbour after all others
of its score, and no query; with fewer than k candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.scratch import stage, tuned
from trellis.llm.vectors import matrix, usable

PROJECTIONS = 224
WIDTH = 0.8
MARGIN = 1.1
#: Radii: steps around the distance of the k-th neighbours of some of the rows of the block, then the whole sphere.
GROWTH = (0.95, 1.02, 1.08, 1.2, 1.5)
ROW_BLOCK, QUERY_BATCH = 32_768, 16
#: Rows of a block whose own neighbours set the scale of the radii.
SCALE_ROWS = 32
SEED = 7
#: Stands for a null id in a block.
_NO_ID = (1 << 63) - 1


class Arrays:
    """Sorted projections of a block of vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, k: int):
        self.vectors, self.ids, self.k = vectors, ids, k
        self.norms = np.sqrt((vectors * vectors).sum(1))
        unit = vectors / self.norms[:, None]
        self.directions = np.random.default_rng(SEED).standard_normal((vectors.shape[1], PROJECTIONS))
        places = unit @ self.directions
        order = np.argsort(places, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(places, order.T, axis=0).T.copy()
        self.rank = np.empty(order.shape, np.uint16 if len(ids) < 1 << 16 else np.uint32)
        np.put_along_axis(self.rank, order, np.arange(len(ids), dtype=self.rank.dtype)[None, :], axis=1)
        p = math.erf(WIDTH / math.sqrt(2))
        self.threshold = max(1, math.floor(PROJECTIONS * p - MARGIN * math.sqrt(PROJECTIONS * p * (1 - p))))
        some = unit[:: max(1, len(ids) // SCALE_ROWS)][:SCALE_ROWS]
        near = np.sort(some @ unit.T, axis=1)[:, -min(k + 1, len(ids))]
        scale = float(np.median(np.sqrt(np.maximum(2 - 2 * near, 0))))
        self.radii = [r for g in GROWTH if 0 < (r := scale * g) < 2] + [2.0]
        self.verified = 0

    def _counts(self, centres: np.ndarray, reach: float) -> np.ndarray:
        """Arrays in which each row of the block lies in each query's window."""
        low = np.array([np.searchsorted(row, c - reach, "left") for row, c in zip(self.sorted, centres.T, strict=True)])
        high = np.array([np.searchsorted(row, c + reach, "right") for row, c in zip(self.sorted, centres.T, strict=True)])
        low, wide = low.astype(self.rank.dtype), (high - low).astype(self.rank.dtype)
        counts = np.zeros((len(centres), len(self.ids)), np.uint8)
        offset, inside = np.empty(counts.shape, self.rank.dtype), np.empty(counts.shape, bool)
        for ranks, a, n in zip(self.rank, low, wide, strict=True):
            np.subtract(ranks[None, :], a[:, None], out=offset)  # wraps below the window
            np.less(offset, n[:, None], out=inside)
            np.add(counts, inside.view(np.uint8), out=counts)
        return counts

    def nearest(self, queries: np.ndarray, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query rows of the block and exact cosines of the k nearest found; row ``own`` (or -1) is left out."""
        norms = np.sqrt((queries * queries).sum(1))
        centres = (queries / norms[:, None]) @ self.directions
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
        seen = np.zeros((len(queries), len(self.ids)), bool)
        seen[np.flatnonzero(own >= 0), own[own >= 0]] = True
        active = np.arange(len(queries))
        for radius in self.radii:
            if not len(active):
                break
            whole = radius >= 2
            hits = ~seen[active] if whole else (self._counts(centres[active], WIDTH * radius) >= self.threshold) & ~seen[active]
            seen[active] |= hits
            self.verified += int(hits.sum())
            left = []
            for q, found in zip(active, hits, strict=True):
                rows = np.flatnonzero(found)
                if len(rows) > self.k:
                    rough = self.vectors[rows] @ (queries[q] / norms[q]) / self.norms[rows]
                    rows = rows[rough >= np.partition(rough, -self.k)[-self.k] - 1e-9]
                scores = (self.vectors[rows] * queries[q]).sum(1) / (self.norms[rows] * norms[q])
                rows, scores = np.concatenate([best[q][0], rows]), np.concatenate([best[q][1], scores])
                first = np.lexsort((self.ids[rows], -scores))[: self.k]
                best[q] = rows[first], scores[first]
                if len(first) < self.k or 2 - 2 * scores[first[-1]] > radius * radius:
                    left.append(q)
            active = np.array(left, np.int64)
        return best


def search(
    vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, id_col, score) of the k nearest rows found for each row where ``is_query`` holds."""
    spark = tuned(vectors.sparkSession)
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.where(usable(vectors, vector_col)).select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), vector.alias("x"),
        F.size(vector_col).alias("width"), F.coalesce(is_query & F.col(id_col).isNotNull(), F.lit(False)).alias("query"),
    )
    rows = stage(rows, "vectors")  # row numbers are fixed from here on
    blocks = max(1, -(-rows.count() // ROW_BLOCK))
    block = F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")
    data = rows.select("width", block.alias("block"), F.lit(0).alias("kind"), "rid", "id", "x")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = rows.where("query").select("width", every.alias("block"), F.lit(1).alias("kind"), "rid", "id", "x")
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), (id_col, pa.int64()), ("score", pa.float64())])

    def run(batches):
        now, held, arrays, rids = None, [], None, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            begins = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(begins, begins[1:], strict=False):
                if a == b:
                    continue
                width, number, kind = keys[a]
                part = batch.slice(a, b - a)
                rid, ids, x = part.column(3).to_numpy(), part.column(4).fill_null(_NO_ID).to_numpy(), matrix(part.column(5), width)
                if now != (width, number):
                    now, held, arrays = (width, number), [], None
                if kind == 0:
                    held.append((rid, ids, x))
                    continue
                if not held:
                    continue  # no row was dealt to the block
                if arrays is None:
                    rids, own_ids, own = (np.concatenate(c) for c in zip(*held, strict=True))
                    arrays = Arrays(own, own_ids, k)
                out: list[list] = [[], [], [], []]
                for s in range(0, len(rid), QUERY_BATCH):
                    some = rid[s : s + QUERY_BATCH]
                    at = np.minimum(np.searchsorted(rids, some), len(rids) - 1)  # rows of a block ascend
                    found = arrays.nearest(x[s : s + QUERY_BATCH], np.where(rids[at] == some, at, -1))
                    for q, (place, scores) in enumerate(found, s):
                        for column, values in zip(out, ([rid[q]] * len(place), [ids[q]] * len(place), arrays.ids[place], scores), strict=True):
                            column.extend(values)
                made = [pa.array(c, t) for c, t in zip(out, schema.types, strict=True)]
                made[2] = pc.if_else(pc.equal(made[2], _NO_ID), pa.scalar(None, pa.int64()), made[2])
                yield pa.RecordBatch.from_arrays(made, schema=schema)

    order = ["width", "block", "kind", "rid"]
    dealt = data.unionByName(asked).repartition(blocks, "width", "block").sortWithinPartitions(*order)
    found = dealt.mapInArrow(run, f"query long, query_id long, `{id_col}` long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col(id_col).asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", id_col, "score")
