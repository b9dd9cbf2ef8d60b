"""Operator 4: toxicity by a classifier chain of linear models.

Categories are predicted one after another; each model sees a document's features and
the probabilities of the categories before it.  In training those probabilities are
out-of-fold: a fold's documents get them from a model that was fitted on the other
folds, with features chosen on those folds alone, so later models learn from predictions as
uncertain as those they will meet.

Features are sums over the distinct space-delimited tokens of the whole text: the
bare lower-case word, its first five letters, and a closing run of symbols.
Only features whose rate differs between a category's two classes by ``LEAST_Z``
standard errors are kept, the clearest ``MAX_FEATURES``, so the many neutral words of a long text add nothing.

The models are fitted from a sample of at most ``TRAIN_ROWS`` labelled documents, the first by
a hash of their id (a documented bound).  Executors extract, count and choose the features, and
one task fits the models on the counts of the chosen ones; the driver gets the fitted chain only.
Scoring reads all documents, and the model it broadcasts is bounded by the number of chosen features.

Defined results: a null or empty text has no features and is not toxic; a category is learnt
from the documents whose label of it is known; without any labelled documents, or if a category
has one class only, the probability is that class's; repeated rows are scored alike; of rows
that share an id the greatest text and labels are learnt from; a very long text is one set of
tokens in a worker's memory.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.llm.chunks import _Memo
from trellis.llm.scratch import stage, tuned

TRAIN_ROWS = 8192
FOLDS = 5
LEAST_COUNT, LEAST_Z = 4, 4.0
#: Features of each category, the clearest first.
MAX_FEATURES = 600
PENALTY = 0.01
THRESHOLD = 0.5
#: Categories of the production chain, in order, from the two columns of ``labels``.
CHAIN = {
    "junk": lambda: F.col("quality") == 0,
    "toxic_prose": lambda: (F.col("toxic") == 1) & (F.col("quality") == 1),
    "toxic": lambda: F.col("toxic") == 1,
}


def token_features(token: str) -> tuple[str, ...]:
    word = token.strip("\t\n\r.,;:!?…\"'()[]|").lower()
    bare = word.rstrip("*&$#%")
    out = ["=" + bare] if bare else []
    if bare.isalpha():
        out += ["5" + bare[:5]] * (len(bare) > 5)
    if len(word) - len(bare) >= 2:
        out.append("~" + word[len(bare) :])
    return tuple(out)


def text_features(text: str | None) -> dict[str, int]:
    counts: dict[str, int] = defaultdict(int)
    for token in set((text or "").split()):
        for f in token_features(token):
            counts[f] += 1
    return counts


class _Sparse:
    """(row, column, value) entries, for products with vectors."""

    def __init__(self, n: int, width: int, row: np.ndarray, col: np.ndarray, val: np.ndarray):
        self.n, self.width, self.row, self.col, self.val = n, width, row, col, val

    def part(self, rows: np.ndarray, columns: np.ndarray) -> _Sparse:
        """The given rows (a mask) and columns (their numbers), renumbered."""
        r, c = np.cumsum(rows) - 1, np.full(self.width, -1)
        c[columns] = np.arange(len(columns))
        keep = rows[self.row] & (c[self.col] >= 0)
        return _Sparse(int(rows.sum()), len(columns), r[self.row[keep]], c[self.col[keep]], self.val[keep])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_linear(x: _Sparse, dense: np.ndarray, y: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Logistic regression with a ridge penalty: weights of the sparse columns, the dense ones and the intercept."""
    w = np.zeros(x.width + dense.shape[1] + 1)
    speed, step, seen = np.zeros_like(w), 0.0, np.zeros_like(w)
    rate = y.mean() if len(y) else 0.0
    if not 0 < rate < 1:
        w[-1] = 35 if rate else -35
        return w
    w[-1] = math.log(rate / (1 - rate))
    for _ in range(rounds):  # adaptive steps: columns differ in frequency by orders of magnitude
        error = _sigmoid(x.dot(w[: x.width]) + dense @ w[x.width : -1] + w[-1]) - y
        grad = np.concatenate([x.back(error), dense.T @ error, [error.sum()]]) / len(y)
        grad[:-1] += PENALTY / len(y) * w[:-1]
        step += 1
        speed = 0.9 * speed + 0.1 * grad
        seen = 0.999 * seen + 0.001 * grad * grad
        w -= 0.2 * (speed / (1 - 0.9**step)) / (np.sqrt(seen / (1 - 0.999**step)) + 1e-8)
    return w


@dataclass
class Chain:
    names: list[str]
    columns: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fit(cls, x: _Sparse, chosen: dict[int, np.ndarray], features: list[str], labels: np.ndarray, folds: np.ndarray, names: list[str]) -> Chain:
        """``chosen``: columns by the fold that they were chosen without; -1 for all rows.  Unknown labels are NaN."""
        own = chosen[-1]
        out = cls(names, {features[c]: k for k, c in enumerate(own.tolist())})
        earlier = np.zeros((x.n, 0))
        for k in range(len(names)):
            y, known = labels[:, k], ~np.isnan(labels[:, k])
            out.weights.append(fit_linear(x.part(known, own), earlier[known], y[known]))
            held_out = np.zeros(x.n)
            for fold in np.unique(folds):
                test, train = folds == fold, (folds != fold) & known
                w = fit_linear(x.part(train, chosen[fold]), earlier[train], y[train])
                part = x.part(test, chosen[fold])
                held_out[test] = _sigmoid(part.dot(w[: part.width]) + earlier[test] @ w[part.width : -1] + w[-1])
            earlier = np.column_stack([earlier, held_out])
        return out

    def scorer(self):
        """A function from text to the categories' probabilities."""
        width, columns = len(self.columns), self.columns
        table = np.array([w[:width] for w in self.weights]).T if width else np.zeros((0, len(self.names)))
        table = [tuple(r) for r in table.tolist()]
        none = (0.0,) * len(self.names)

        def token(t: str):
            hits = [table[columns[f]] for f in token_features(t) if f in columns]
            return tuple(map(sum, zip(*hits, strict=True))) if hits else none

        memo = _Memo(token, 400_000)
        chained = [w[width:].tolist() for w in self.weights]

        def score(text: str | None) -> list[float]:
            hits = [h for h in map(memo.__getitem__, set((text or "").split())) if h is not none]
            sums = [math.fsum(h[k] for h in hits) for k in range(len(none))]
            out: list[float] = []
            for s, w in zip(sums, chained, strict=True):
                z = s + w[-1] + sum(a * b for a, b in zip(w, out, strict=False))
                out.append(1 / (1 + math.exp(-max(-35.0, min(35.0, z)))))
            return out

        return score


def _chosen(features: DataFrame, folds: np.ndarray, labels: np.ndarray) -> DataFrame:
    """(feature, without): the clearest features of each category on all rows (without -1) and without each fold.

    ``features``: (fold, y0, y1, ..., feature) of the sample's rows.  At most ``MAX_FEATURES`` rows for each category and fold.
    """
    many = range(labels.shape[1])
    sums = [F.count_if((F.col("fold") == f) & F.col(f"y{k}").isNotNull()).alias(f"t{k}_{f}") for k in many for f in range(FOLDS)]
    sums += [F.count_if((F.col("fold") == f) & (F.col(f"y{k}") == 1)).alias(f"p{k}_{f}") for k in many for f in range(FOLDS)]
    counts = features.groupBy("feature").agg(*sums, F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)
    found = []
    for k in many:
        for without in (-1, *range(FOLDS)):
            rows = (folds != without) & ~np.isnan(labels[:, k])
            n, positive = int(rows.sum()), int((labels[rows, k] == 1).sum())
            total, hits = (sum((F.col(f"{c}{k}_{f}") for f in range(FOLDS) if f != without), F.lit(0)) for c in "tp")
            p, q, both = (hits + 0.5) / (positive + 1), (total - hits + 0.5) / (n - positive + 1), (total + 1) / (n + 2)
            z = F.abs(p - q) / F.sqrt(both * (1 - both) * (1 / (positive + 1) + 1 / (n - positive + 1)))
            frequent = F.when(total >= LEAST_COUNT, z).otherwise(F.lit(0.0))
            found.append(F.struct(F.lit(k).alias("k"), F.lit(without).alias("without"), frequent.alias("z")))
    rows = counts.select("feature", F.explode(F.array(*found)).alias("f")).select("feature", "f.*").where(F.col("z") >= LEAST_Z)
    best = Window.partitionBy("k", "without").orderBy(F.desc("z"), "feature")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= MAX_FEATURES).select("feature", "without").distinct()


def train(
    docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS
) -> Chain:
    """Fit the chain on labelled documents; a sample of at most ``rows`` ids, the first by hash."""
    tuned(docs.sparkSession)
    many = len(categories)
    ys = [f"y{k}" for k in range(many)]
    marks = [F.max(c.cast("int")).alias(y) for y, c in zip(ys, categories.values(), strict=True)]
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*marks).dropna("all", subset=ys)
    picked = known.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(rows)
    fold = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold")
    number = F.row_number().over(Window.orderBy(F.xxhash64("id"), "id")) - 1  # of the bounded sample
    picked = stage(picked.select("id", number.alias("row"), fold, *ys), "picked")
    sample = picked.orderBy("row").select("fold", *ys).toArrow()
    folds, y = sample["fold"].to_numpy(), np.array([sample[c].to_numpy() for c in ys], np.float64).reshape(many, -1).T
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    texts = texts.groupBy("row").agg(F.max("text").alias("text"), F.first("fold").alias("fold"), *[F.first(c).alias(c) for c in ys])

    def extract(batches):
        for batch in batches:
            for i in range(len(batch)):
                counts = text_features(batch.column(1)[i].as_py())
                if counts:
                    same = [pa.array([batch.column(c)[i].as_py()] * len(counts), pa.int32()) for c in (0, *range(2, 3 + many))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int32())], ["row", "fold", *ys, "feature", "n"])

    found = texts.mapInArrow(extract, f"row int, fold int, {', '.join(f'{c} int' for c in ys)}, feature string, n int")
    found = stage(found, "features")
    chosen = stage(_chosen(found, folds, y), "chosen")
    numbers = chosen.select("feature").distinct().withColumn("col", F.row_number().over(Window.orderBy("feature")) - 1)  # bounded
    numbers = stage(numbers, "numbers")
    entry = lambda kind, a, b, c, text=None: [F.lit(kind).alias("kind"), *(F.col(x).cast("int").alias(n) if isinstance(x, str) else F.lit(x).cast("int").alias(n) for x, n in zip((a, b, c), "abc", strict=True)), F.lit(None).cast("string").alias("text") if text is None else F.col(text).alias("text")]
    marks = [picked.select(*entry(0, "row", k, c)) for k, c in enumerate(ys)]
    parts = [picked.select(*entry(1, "row", "fold", 0)), chosen.join(F.broadcast(numbers), "feature").select(*entry(2, "col", "without", 0, "feature"))]
    parts += [*marks, found.join(F.broadcast(numbers), "feature").select(*entry(3, "row", "col", "n"))]
    names = list(categories)

    def fit(batches):
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_fitted(batches, names))], pa.binary())], ["chain"])

    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return pickle.loads(every.coalesce(1).mapInArrow(fit, "chain binary").first()[0])


def _fitted(batches, names: list[str]) -> Chain:
    """The chain of a sample's parts (kind, a, b, c, text): labels, folds, chosen features and their counts."""
    held: list[list] = [[], [], [], []]
    for batch in batches:
        kinds = batch.column(0).to_numpy()
        values = np.array([batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)], np.float64)
        for kind, part in enumerate(held):
            at = np.flatnonzero(kinds == kind)
            if len(at):
                part.append((values[:, at], batch.column(4).take(pa.array(at)).to_pylist() if kind == 2 else []))
    whole = [np.concatenate([v for v, _ in part], axis=1) if part else np.zeros((3, 0)) for part in held]
    labels, folds, chosen, counts = whole
    y, fold = np.full((folds.shape[1], len(names)), np.nan), np.zeros(folds.shape[1], np.int64)
    y[labels[0].astype(int), labels[1].astype(int)] = labels[2]
    fold[folds[0].astype(int)] = folds[1]
    texts = [t for _, some in held[2] for t in some]
    features = dict(zip(chosen[0].astype(int).tolist(), texts, strict=True))
    columns = {f: np.unique(chosen[0][chosen[1] == f]).astype(np.int64) for f in (-1, *range(FOLDS))}
    order = np.lexsort((counts[1], counts[0]))
    x = _Sparse(len(fold), len(features), counts[0][order].astype(np.int64), counts[1][order].astype(np.int64), counts[2][order])
    return Chain.fit(x, columns, [features[k] for k in range(len(features))], y, fold, names)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, p_<category> for each category, rejected); rejected by the last category."""
    spark = tuned(docs.sparkSession)
    model = spark.sparkContext.broadcast(chain)
    names = [f"p_{n}" for n in chain.names]

    def run(batches):
        rate = model.value.scorer()
        for batch in batches:
            p = [rate(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[k] for r in p], pa.float64()) for k in range(len(names))]
            flags = pa.array([bool(t.as_py()) and r[-1] >= threshold for t, r in zip(batch.column(1), p, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, flags], [id_col, *names, "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"`{n}` double" for n in names) + ", rejected boolean")


def keep_clean(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the last category doesn't reject, all columns as they are."""
    spark = tuned(docs.sparkSession)
    model = spark.sparkContext.broadcast(chain)
    at = docs.columns.index(text_col)

    def run(batches):
        rate = model.value.scorer()
        for batch in batches:
            keep = [not t.as_py() or rate(t.as_py())[-1] < threshold for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
