"""Operator 3: mixture-controlled packing of documents into fixed sequences.

Each source is a queue of tokens with a target weight.  A window of ``window`` tokens
credits every queue that still holds tokens in proportion to its weight; the queue is
served the whole tokens of its credit and the rest stays as its deficit for the next
window (deficit round-robin).  When a queue is empty its part of the credit goes to the
others, so every window is filled, at the target proportions of the sources that remain.

In closed form: let x be the credit for each unit of weight since the start.  A queue has
been served min(floor(x * weight), length) tokens, and all queues together S(x), which is
linear between the levels at which queues run dry.  Window r ends at the level where S is
(r + 1) * window.  So a window's content, and each token's place in the output, follow
from the queues' lengths and the token's place in its queue, whatever the windows before
held.  Levels are knots of S, one for each 64th of a doubling of the level at which queues
run dry: their number is bounded, and where several queues share a knot windows are about
one per cent shorter at most.  A queue is in the order of the parts of the tokenised table,
so a part needs only the lengths of the parts before it, and no text or id is shuffled.
Sequences are full, since windows follow one another without gaps.  Only the last sequence
of all needs padding.

Weights are given by source, or are the sources' sizes to the power ``temperature``: 1
keeps the corpus's own shares, less favours small sources while they last.

Each source has its own queue, whatever their number.  Up to ``MAX_QUEUES`` the lengths of
all queues go to the tasks, which place their tokens by the closed form alone.  Of more,
a task knows only its own queues' lengths: it cuts its documents at the windows, the
stretches of (window, queue) are ordered and summed up as a table, and the cut documents
are joined to their stretch's place, with the same result.

Defined results: a null or empty text has only the end id; null sources are one more
queue; an empty table gives no pieces; repeated rows are documents of their own; a text
that holds an added token of the tokenizer gets that token's id there, as from the library;
a very long text is cut like any other.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.scratch import stage, tuned
from trellis.llm.vocab import WordEncoder, encoder

SEQUENCE = 4096
#: Sequences in a window.
WINDOW_SEQUENCES = 64
#: Queues up to which their lengths go to every task.
MAX_QUEUES = 4096
#: Rows of (part, queue) lengths that are broadcast at most; beyond it they are joined by a shuffle.
MAX_BROADCAST_ROWS = 200_000


#: Units of a level of 1.
UNIT = 1 << 64
#: Steps of the logarithm by which queues share a knot.
KNOTS = 64


class Levels:
    """Level of credit by tokens served: linear between knots (level in 1 / UNIT, tokens), both ascending from (0, 0)."""

    def __init__(self, groups: list[tuple[float, int, int]]):
        """``groups``: (level at which all are dry, tokens, weight) of queues, ascending."""
        self.x, self.tokens, dry, weight = [0], [0], 0, sum(g[2] for g in groups)
        for level, length, w in groups:
            top = int(level * (1 + 1e-12) * UNIT) + 1
            dry, weight = dry + length, weight - w
            served = dry + top * weight // UNIT
            if top > self.x[-1] and served > self.tokens[-1]:
                self.x.append(top)
                self.tokens.append(served)

    @staticmethod
    def of(lengths: list[int], weights: list[int]) -> Levels:
        return Levels(sorted((n / w, n, w) for n, w in zip(lengths, weights, strict=True)))

    def level(self, tokens: int) -> int:
        """The level when that many tokens are served."""
        if tokens >= self.tokens[-1]:
            return self.x[-1]
        k = bisect_right(self.tokens, tokens) - 1
        return self.x[k] + (tokens - self.tokens[k]) * (self.x[k + 1] - self.x[k]) // (self.tokens[k + 1] - self.tokens[k])

    def reached(self, level: int) -> int:
        """Least number of tokens at which the level is reached."""
        k = bisect_left(self.x, level) - 1
        return self.tokens[k] - (-(level - self.x[k]) * (self.tokens[k + 1] - self.tokens[k]) // (self.x[k + 1] - self.x[k]))


class Schedule:
    """Closed form of the round-robin over queues of given lengths and integer weights."""

    def __init__(self, lengths: list[int], weights: list[int], window: int, levels: Levels | None = None):
        self.lengths, self.weights, self.window = lengths, weights, window
        self.levels = levels or Levels.of(lengths, weights)  # of all queues, where only some are given
        self._bases: dict[int, list[int]] = {}

    def served(self, queue: int, windows: int) -> int:
        """Tokens that the queue has given to the first windows."""
        return min(self.levels.level(windows * self.window) * self.weights[queue] // UNIT, self.lengths[queue])

    def window_of(self, queue: int, token: int) -> int:
        """The window that serves the token: the least r with served(r + 1) > token."""
        return -(-self.levels.reached(-(-(token + 1) * UNIT // self.weights[queue])) // self.window) - 1

    def cuts(self, queue: int, start: int, stop: int):
        """(start, stop, window) of the stretches of queue tokens start..stop that one window serves."""
        while start < stop:
            r = self.window_of(queue, start)
            end = min(stop, self.served(queue, r + 1))
            yield start, end, r
            start = end

    def runs(self, queue: int, start: int, stop: int):
        """(start, stop, place in the output) of the stretches of queue tokens start..stop that one window serves."""
        for a, b, r in self.cuts(queue, start, stop):
            yield a, b, self.base(queue, r) + a - self.served(queue, r)

    def base(self, queue: int, r: int) -> int:
        """Where the queue's stretch of window r begins: all earlier windows, then earlier queues in this one."""
        if r not in self._bases:
            if len(self._bases) >= 64:
                self._bases.clear()
            before = [self.served(q, r) for q in range(len(self.lengths))]
            sums, at = [], sum(before)
            for q, n in enumerate(before):
                sums.append(at)
                at += self.served(q, r + 1) - n
            self._bases[r] = sums
        return self._bases[r][queue]


def weighed(totals: DataFrame, targets: dict[str, int] | None, temperature: float) -> DataFrame:
    """(queue, n, weight) of (queue, n): weights are positive whole numbers."""
    if targets is None:
        return totals.withColumn("weight", F.greatest(F.lit(1), F.round(F.pow("n", F.lit(float(temperature)))).cast("long")))
    given = totals.sparkSession.createDataFrame([(k, max(1, int(w))) for k, w in targets.items()], "name string, weight long")
    return totals.join(given, F.substring("queue", 2, 1 << 30) == F.col("name"), "left").drop("name").fillna(1, ["weight"])


def levels_of(shares: DataFrame) -> Levels:
    """Knots of (queue, n, weight): a row for each group of queues that run dry at about the same level."""
    level = F.col("n") / F.col("weight")
    groups = shares.groupBy(F.floor(F.log2(level) * KNOTS).alias("g")).agg(
        F.max(level).alias("level"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("weight").cast("decimal(38,0)")).alias("weight")
    )
    return Levels([(r.level, int(r.n), int(r.weight)) for r in groups.orderBy("g").collect()])


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Staged table of documents: part, queue, start in (part, queue), doc_id, ids (16-bit), n."""
    tuned(docs.sparkSession)
    queue = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u2").tobytes()

    def run(batches):
        coder = encoder(WordEncoder, tokenizer_path)
        part, ahead = TaskContext.get().partitionId(), {}
        for batch in batches:
            ids, starts, counts = [], [], []
            for text, key in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids.append(coder.encode(text.as_py() or "") + end)
                counts.append(len(ids[-1]) // 2)
                starts.append(ahead.get(key, 0))
                ahead[key] = starts[-1] + counts[-1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(ids), pa.int32()),
                    batch.column(2),
                    pa.array(starts, pa.int64()),
                    batch.column(0),
                    pa.array(ids, pa.binary()),
                    pa.array(counts, pa.int64()),
                ],
                ["part", "queue", "ahead", id_col, "ids", "n"],
            )

    rows = docs.select(id_col, text_col, queue.alias("queue"))
    return stage(rows.mapInArrow(run, f"part int, queue string, ahead long, `{id_col}` {kind}, ids binary, n long"), "ids")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    targets: dict[str, int] | None = None,
    temperature: float = 1.0,
    sequence: int = SEQUENCE,
    window_sequences: int = WINDOW_SEQUENCES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, window (and ids if asked).

    ``targets``: integer weights by source; sources that it lacks weigh 1.  Without it a source weighs its size to
    the power ``temperature``.
    """
    tokens = tokenise(docs, tokenizer_path, end_id, id_col, text_col, source_col)
    lengths = tokens.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(lengths.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    # a row for each queue
    shares = stage(weighed(bases.groupBy("queue").agg(F.sum("n").alias("n")), targets, temperature), "shares")
    levels = levels_of(shares)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window"] + ["ids"] * with_ids
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, `window` long"
    schema += ", ids array<int>" * with_ids
    window = sequence * window_sequences

    def pieces(out: list[list], doc_id, n: int, a: int, ids: np.ndarray, place: int) -> None:
        """Append the pieces of ids, which start at the document's token a and at a place of the output."""
        while len(ids):
            own = ids[: sequence - place % sequence]
            ids = ids[len(own) :]
            row = [doc_id, a, len(own), zlib.crc32(own.tobytes()), n, place // sequence, place % sequence, place // window]
            for column, value in zip(out, row + [own.tolist()] * with_ids, strict=True):
                column.append(value)
            a, place = a + len(own), place + len(own)

    def table(batch: pa.RecordBatch, out: list[list]) -> pa.RecordBatch:
        kinds = [batch.schema.field(0).type] + [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    small = bases.count() <= MAX_BROADCAST_ROWS
    places = bases.select("part", "queue", "base")
    rows = tokens.join(F.broadcast(places) if small else places, ["part", "queue"])
    rows = rows.select(id_col, "queue", (F.col("ahead") + F.col("base")).alias("at"), "n", "ids")
    if shares.count() > MAX_QUEUES:
        placed = _placed(rows, shares, levels, window, id_col)

        def cut(batches):
            for batch in batches:
                out = [[] for _ in names]
                for doc_id, n, a, place, raw in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4), strict=True):
                    pieces(out, doc_id, n, a, np.frombuffer(raw.as_py(), "<u2").astype("<u4"), place)
                yield table(batch, out)

        return placed.mapInArrow(cut, schema)

    ordered = shares.orderBy("queue").collect()
    queues = {r.queue: k for k, r in enumerate(ordered)}
    plan = Schedule([r.n for r in ordered], [r.weight for r in ordered], window, levels)

    def run(batches):
        for batch in batches:
            out = [[] for _ in names]
            for doc_id, queue, at, n, raw in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4), strict=True):
                wide = np.frombuffer(raw.as_py(), "<u2").astype("<u4")
                for a, b, place in plan.runs(queues[queue], at, at + n):
                    pieces(out, doc_id, n, a - at, wide[a - at : b - at], place)
            yield table(batch, out)

    return rows.mapInArrow(run, schema)


def _placed(rows: DataFrame, shares: DataFrame, levels: Levels, window: int, id_col: str) -> DataFrame:
    """(id_col, n, start in the document, place in the output, ids) of the stretches of documents that one window serves.

    A (window, queue) has at most ``window`` tokens, so no key of these joins is large.
    """
    spark, shares = rows.sparkSession, shares.withColumnRenamed("n", "length")
    kind = rows.schema[id_col].dataType.simpleString()
    names = [id_col, "n", "start", "r", "queue", "within", "stretch", "ids"]

    def cut(batches):
        for batch in batches:
            columns = batch.to_pydict()
            out = [[] for _ in names]
            for doc_id, queue, at, n, ids, length, weight in zip(*columns.values(), strict=True):
                own = Schedule([length], [weight], window, levels)
                for a, b, r in own.cuts(0, at, at + n):
                    before = own.served(0, r)
                    row = (doc_id, n, a - at, r, queue, a - before, own.served(0, r + 1) - before, ids[2 * (a - at) : 2 * (b - at)])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 3, pa.string(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    parts = rows.join(shares, "queue").select(id_col, "queue", "at", "n", "ids", "length", "weight")
    parts = stage(parts.mapInArrow(cut, f"`{id_col}` {kind}, n long, start long, r long, queue string, within long, stretch long, ids binary"), "cuts")
    # running sums over all stretches: within ranges of (window, queue), and before the ranges
    stretches = parts.where("within = 0").select("r", "queue", "stretch").repartitionByRange("r", "queue")
    stretches = stage(stretches.withColumn("range", F.spark_partition_id()), "stretches")
    ahead = Window.partitionBy("range").orderBy("r", "queue").rowsBetween(Window.unboundedPreceding, -1)
    ranges, before = [], 0
    for row in stretches.groupBy("range").agg(F.sum("stretch").alias("n")).orderBy("range").collect():
        ranges.append((row.range, before))
        before += row.n
    bases = spark.createDataFrame(ranges, "range int, first long")
    stretches = stretches.withColumn("base", F.coalesce(F.sum("stretch").over(ahead), F.lit(0))).join(F.broadcast(bases), "range")
    stretches = stretches.select("r", "queue", (F.col("first") + F.col("base")).alias("base"))
    placed = parts.join(stretches, ["r", "queue"])
    return placed.select(id_col, "n", "start", (F.col("base") + F.col("within")).alias("place"), "ids")
