"""Tables of any origin to the graph's form."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.errors import CypherSemanticError
from trellis.plans.scope import ID, SOURCE, TARGET, quoted


def from_any(spark: SparkSession, data: Any) -> DataFrame:
    """A DataFrame of a DataFrame, pandas frame, Arrow table or list of dicts; NaN of pandas becomes null."""
    if isinstance(data, DataFrame):
        return data
    if type(data).__module__.startswith("pandas"):
        df = spark.createDataFrame(data)
        floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        return df.withColumns({n: F.when(~F.isnan(quoted(n)), quoted(n)) for n in floats}) if floats else df
    return spark.createDataFrame(data)


def _first_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key, in the order of the input's partitions."""
    order = df.withColumn("__order", F.monotonically_increasing_id())
    rank = F.row_number().over(Window.partitionBy(*[quoted(k) for k in keys]).orderBy("__order"))
    return order.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__order")


def as_entity(df: DataFrame, id_col: str | None = None, unique: bool = False) -> DataFrame:
    """``id_col`` becomes the id, the first row of each id stays; without one, rows get ids."""
    if id_col is not None:
        if id_col not in df.columns:
            raise CypherSemanticError(f"there is no column {id_col!r}; known: {df.columns}")
        df = df.select(quoted(id_col).alias(ID), *[quoted(c) for c in df.columns if c != ID])
    elif ID not in df.columns:
        return df.select(F.monotonically_increasing_id().alias(ID), *[quoted(c) for c in df.columns])
    return df if unique or id_col is None else _first_of(df, [ID])


def as_relationship(df: DataFrame, source_col: str | None = None, target_col: str | None = None, id_col: str | None = None, multi_edges: bool = True) -> DataFrame:
    """The ends are renamed; parallel edges collapse unless ``multi_edges``."""
    names = {source_col or SOURCE: SOURCE, target_col or TARGET: TARGET} | ({id_col: ID} if id_col else {})
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise CypherSemanticError(f"there is no column {missing[0]!r}; known: {df.columns}")
    df = df.select(*[quoted(n).alias(new) for n, new in names.items()], *[quoted(c) for c in df.columns if c not in names])
    if ID not in df.columns:
        df = df.select(F.monotonically_increasing_id().alias(ID), "*")
    return df if multi_edges else _first_of(df, [SOURCE, TARGET])
