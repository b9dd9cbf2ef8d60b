"""Edges that follow from keys of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.plans.scope import ID, SOURCE, TARGET, quoted


def _edges(rows: DataFrame, source: Column, target: Column, targets: DataFrame | None, target_id: str) -> DataFrame:
    out = rows.select(source.alias(SOURCE), target.alias(TARGET)).where(F.col(SOURCE).isNotNull() & F.col(TARGET).isNotNull())
    if targets is not None:
        known = targets.select(quoted(target_id).cast("string").alias("__known"))
        out = out.join(known, F.col(TARGET).cast("string") == F.col("__known"), "left_semi")
    # from the ends, so that an edge has the same id whenever it is derived
    return out.select(F.xxhash64(SOURCE, TARGET).alias(ID), SOURCE, TARGET)


def by_column(rows: DataFrame, id_col: str, column: str, targets: DataFrame | None = None, target_id: str = ID) -> DataFrame:
    """Equality with, and membership in, the other table's key; null keys give none."""
    return _edges(rows, quoted(id_col), quoted(column), targets, target_id)


def by_prefix(rows: DataFrame, id_col: str, length: int, targets: DataFrame | None = None, target_id: str = ID, column: str | None = None) -> DataFrame:
    """The other key is the first characters of this one."""
    return _edges(rows, quoted(id_col), F.substring(quoted(column or id_col), 1, length), targets, target_id)


def by_crosswalk(crosswalk: DataFrame, source_parts: list[str], target_parts: list[str], targets: DataFrame | None = None, target_id: str = ID) -> DataFrame:
    """Both keys are concatenations of a crosswalk's columns."""
    key = lambda parts: F.concat(*[quoted(p).cast("string") for p in parts])
    return _edges(crosswalk, key(source_parts), key(target_parts), targets, target_id)


def normalised_code(column: Column, width: int) -> Column:
    """A code that was read as a number: without ``.0``, with leading zeros."""
    return F.lpad(F.regexp_replace(F.trim(column.cast("string")), r"\.0+$", ""), width, "0")


def by_composite(rows: DataFrame, id_col: str, parts: dict[str, int], targets: DataFrame | None = None, target_id: str = ID) -> DataFrame:
    """The other key joins normalised codes of given widths."""
    return _edges(rows, quoted(id_col), F.concat(*[normalised_code(quoted(c), w) for c, w in parts.items()]), targets, target_id)
