"""The graph: labels and relationship types as tables."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.errors import CypherSemanticError
from trellis.plans.scope import ID, SOURCE, TARGET

PLANS = 256


@dataclass(frozen=True)
class Relationship:
    df: DataFrame
    #: Labels that the ends are known to have; None where unknown.
    source_label: str | None = None
    target_label: str | None = None
    #: Whether every end is known to be in its label's table, so that a label needs no join to be checked.
    sound: bool = False
    #: The end, "source" or "target", of which a node has one edge of the type at most. Only the order of joins depends on it.
    unique: str | None = None


def properties(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (ID, SOURCE, TARGET)]


@dataclass(frozen=True)
class Graph:
    """Immutable: a change makes a new graph, so a failed query leaves nothing behind."""

    nodes: dict[str, DataFrame] = field(default_factory=dict)
    rels: dict[str, Relationship] = field(default_factory=dict)
    #: Plans of queries that only read, by query and parameters, the ``PLANS`` used last.
    plans: OrderedDict = field(default_factory=OrderedDict, compare=False, repr=False)

    def plan(self, key: tuple) -> DataFrame | None:
        if key in self.plans:
            self.plans.move_to_end(key)
        return self.plans.get(key)

    def keep_plan(self, key: tuple, df: DataFrame) -> None:
        self.plans[key] = df
        while len(self.plans) > PLANS:
            self.plans.popitem(last=False)

    def with_node(self, label: str, df: DataFrame) -> Graph:
        return replace(self, nodes=self.nodes | {label: df}, plans=OrderedDict())

    def with_rel(self, kind: str, rel: Relationship) -> Graph:
        return replace(self, rels=self.rels | {kind: rel}, plans=OrderedDict())

    def labels(self, wanted: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(x for x in (wanted or tuple(self.nodes)) if x in self.nodes)


def union(parts: list[DataFrame]) -> DataFrame:
    """By name; a column that has different types becomes a string unless both are numbers."""
    kinds: dict[str, set[T.DataType]] = {}
    for p in parts:
        for f in p.schema:
            if not isinstance(f.dataType, T.NullType):
                kinds.setdefault(f.name, set()).add(f.dataType)
    mixed = {n for n, k in kinds.items() if len(k) > 1 and not all(isinstance(t, T.NumericType) for t in k)}
    out = None
    for p in parts:
        for n in mixed & set(p.columns):
            p = p.withColumn(n, F.col(f"`{n}`").cast("string"))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    if out is None:
        raise CypherSemanticError("there is no table to read")
    return out
