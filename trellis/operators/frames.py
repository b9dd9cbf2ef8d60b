"""Lazy relational operators: the engine protocol over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.catalog import union
from trellis.errors import CypherSemanticError
from trellis.plans.scope import ID, quoted

_HINTS = {"broadcast": "broadcast", "hash": "shuffle_hash", "merge": "merge", "nested_loop": "shuffle_replicate_nl", "auto": None}
_AGGREGATES = {
    "sum": F.sum, "count": F.count, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp,
    "first": F.first, "last": F.last,
}


def scan_entity(df: DataFrame) -> DataFrame:
    return df.select(ID)


def filter_rows(df: DataFrame, mask: Column | str) -> DataFrame:
    return df.where(mask)


def join(left: DataFrame, right: DataFrame, on: list[str] | str = (), how: str = "inner", strategy: str = "auto") -> DataFrame:
    """``strategy`` is a hint; without one Spark decides from sizes, before and while it runs."""
    if how == "cross":
        return left.crossJoin(right)
    if how not in ("inner", "left", "semi", "anti"):
        raise CypherSemanticError(f"there is no join {how!r}")
    hint = _HINTS[strategy]
    return left.join(right.hint(hint) if hint else right, on, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))


def join_many(frames: list[DataFrame], on: str) -> DataFrame:
    """Several frames on one shared key: each is dealt once, as all joins have the same key."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, on)
    return out


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def concat(frames: list[DataFrame]) -> DataFrame:
    return union(frames)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def assign_column(df: DataFrame, name: str, value: Column | object) -> DataFrame:
    return df.withColumn(name, value if isinstance(value, Column) else F.lit(value))


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def aggregate(df: DataFrame, keys: list[str], outputs: dict[str, tuple[str, str]]) -> DataFrame:
    """{output: (column, function)}"""
    aggs = [_AGGREGATES[fn](quoted(c) if c != "*" else F.lit(1)).alias(n) for n, (c, fn) in outputs.items()]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def sort(df: DataFrame, by: list[str], ascending: list[bool] | bool = True) -> DataFrame:
    ways = [ascending] * len(by) if isinstance(ascending, bool) else ascending
    return df.orderBy(*[quoted(c).asc_nulls_last() if up else quoted(c).desc_nulls_last() for c, up in zip(by, ways, strict=True)])


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def skip(df: DataFrame, n: int) -> DataFrame:
    return df.offset(n)


def row_count(df: DataFrame) -> int:
    return df.count()


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def memory_estimate_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the result's size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
