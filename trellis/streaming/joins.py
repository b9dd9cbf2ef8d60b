"""Enrichment of a stream from a table of latest values by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.plans.scope import quoted


def stream_table_join(stream: DataFrame, table: DataFrame, key: str, table_key: str | None = None, how: str = "left") -> DataFrame:
    """Columns of the table override those of the stream where a row matches; ``__table_match__`` tells whether one did."""
    if how not in ("inner", "left"):
        raise ValueError("a stream joins a table by inner or left")
    other = table.select(*[quoted(c).alias(f"__t_{c}") for c in table.columns], F.lit(True).alias("__hit"))
    joined = stream.join(other, quoted(key) == quoted(f"__t_{table_key or key}"), how)
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    values = [c for c in table.columns if c != (table_key or key)]
    columns = [F.when(hit, quoted(f"__t_{c}")).otherwise(quoted(c)).alias(c) if c in values else quoted(c) for c in stream.columns]
    added = [quoted(f"__t_{c}").alias(c) for c in values if c not in stream.columns]
    return joined.select(*columns, *added, hit.alias("__table_match__"))


def latest(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key: a table of the present from its changes; one aggregate, no window."""
    others = [c for c in changes.columns if c != key]
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*[quoted(c) for c in others]), order).alias("row"))
    return newest.select(key, *[F.col("row")[c].alias(c) for c in others])
