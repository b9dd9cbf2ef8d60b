"""Incremental keyed views with a changelog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.plans.scope import quoted


def changelog(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(change_type, key, columns): INSERT, UPDATE and DELETE between two states; equal rows give nothing."""
    values = [c for c in after.columns if c != key]
    old = before.select(quoted(key).alias("__k"), F.struct(*[quoted(c) for c in values]).alias("__old"))
    new = after.select(quoted(key).alias(key), F.struct(*[quoted(c) for c in values]).alias("__new"))
    both = new.join(old, quoted(key) == F.col("__k"), "full_outer")
    kind = F.when(F.col("__old").isNull(), "INSERT").when(F.col("__new").isNull(), "DELETE").when(F.col("__old") != F.col("__new"), "UPDATE")
    row = F.coalesce("__new", "__old")
    out = both.select(kind.alias("change_type"), F.coalesce(quoted(key), F.col("__k")).alias(key), *[row[c].alias(c) for c in values])
    return out.where("change_type is not null")


def apply_changes(state: DataFrame, changes: DataFrame, key: str, order: str, kind_col: str = "record_type") -> DataFrame:
    """The state after upserts and deletes: the newest change of each key wins."""
    values = [c for c in state.columns if c != key]
    newest = changes.groupBy(key).agg(F.max_by(F.struct(quoted(kind_col).alias("__kind"), *[quoted(c) for c in values]), order).alias("__row"))
    kept = state.join(newest.select(key), key, "left_anti")
    upserts = newest.where(F.col("__row.__kind") != "DELETE").select(key, *[F.col("__row")[c].alias(c) for c in values])
    return kept.select(key, *values).unionByName(upserts)


class IncrementalView:
    """A view kept as versioned Parquet tables under ``path``; each micro-batch writes the next version.

    ``on_change`` gets the changelog of each batch.  A batch that is delivered again
    rewrites the version it wrote before, so results don't depend on retries.
    """

    def __init__(
        self, path: str, key: str, order: str, on_change: Callable[[DataFrame, int], None] | None = None, aggregates: dict[str, tuple[str, str]] | None = None,
    ):
        """``aggregates``: {column: (source column, sum | count | min | max)} makes a view of running values by key
        instead of the newest rows; such a view only grows by upserts."""
        self.path, self.key, self.order, self.on_change = path, key, order, on_change
        self.aggregates, self.version = aggregates, -1

    def _after(self, before: DataFrame | None, batch: DataFrame) -> DataFrame:
        if self.aggregates is None:
            columns = [c for c in batch.columns if c != "record_type"]
            return apply_changes(batch.select(*columns).limit(0) if before is None else before, batch, self.key, self.order)
        made = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
        rows = batch.where("record_type <> 'DELETE'") if "record_type" in batch.columns else batch
        new = rows.groupBy(self.key).agg(*[made[fn](quoted(c)).alias(n) for n, (c, fn) in self.aggregates.items()])
        again = {n: F.sum if fn == "count" else made[fn] for n, (_, fn) in self.aggregates.items()}
        both = new if before is None else before.select(*new.columns).unionByName(new)
        return both.groupBy(self.key).agg(*[fn(quoted(n)).alias(n) for n, fn in again.items()])

    def snapshot(self, spark) -> DataFrame | None:
        return spark.read.parquet(f"{self.path}/v{self.version}") if self.version >= 0 else None

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """A foreachBatch function."""
        spark = batch.sparkSession
        if batch_id <= self.version:
            self.version = batch_id - 1
        before = self.snapshot(spark)
        after = self._after(before, batch)
        before = after.limit(0) if before is None else before
        after.write.mode("overwrite").parquet(f"{self.path}/v{batch_id}")
        if self.on_change is not None:
            self.on_change(changelog(before, spark.read.parquet(f"{self.path}/v{batch_id}"), self.key), batch_id)
        self.version = batch_id

    def query(self, spark, predicate) -> DataFrame:
        return self.snapshot(spark).where(predicate)

    def as_entity(self, session, label: str) -> None:
        """Register the present state as a label of a graph session."""
        session.add_entity(label, self.snapshot(session.spark), id_col=self.key)
