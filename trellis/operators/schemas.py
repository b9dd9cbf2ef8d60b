"""Versioned schemas with compatibility rules, merging, and lineage between datasets."""

from __future__ import annotations

from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import types as T

from trellis.errors import CypherSemanticError

#: Widenings that lose nothing, in order.
_LADDER = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType())


def widened(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type that holds both; None where there is none."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if a in _LADDER and b in _LADDER:
        return _LADDER[max(_LADDER.index(a), _LADDER.index(b))]
    if {type(a), type(b)} == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    return None


def merge(a: T.StructType, b: T.StructType, conflict: str = "widen") -> T.StructType:
    """Fields of both; ``conflict``: widen, left, right or fail."""
    out = {f.name: f for f in a}
    for f in b:
        if f.name not in out or out[f.name].dataType == f.dataType:
            out.setdefault(f.name, f)
            continue
        wide = widened(out[f.name].dataType, f.dataType)
        if conflict == "fail" or conflict == "widen" and wide is None:
            raise CypherSemanticError(f"the field {f.name!r} has types that don't go together")
        kept = {"widen": wide, "left": out[f.name].dataType, "right": f.dataType}[conflict]
        out[f.name] = T.StructField(f.name, kept, out[f.name].nullable or f.nullable)
    return T.StructType(list(out.values()))


def readable(writer: T.StructType, reader: T.StructType) -> bool:
    """Whether data of ``writer`` can be read as ``reader``."""
    known = {f.name: f for f in writer}
    for f in reader:
        if f.name not in known:
            if not f.nullable:
                return False
        elif widened(known[f.name].dataType, f.dataType) != f.dataType:
            return False
    return True


@dataclass
class SchemaRegistry:
    """Versions of named schemas; a new one must keep the registry's compatibility."""

    compatibility: str = "backward"  # none, backward, forward or full
    versions: dict[str, list[T.StructType]] = field(default_factory=dict)

    def register(self, name: str, schema: T.StructType) -> int:
        known = self.versions.setdefault(name, [])
        if known and known[-1] == schema:
            return len(known)
        if known:
            back, ahead = readable(known[-1], schema), readable(schema, known[-1])
            if not {"none": True, "backward": back, "forward": ahead, "full": back and ahead}[self.compatibility]:
                raise CypherSemanticError(f"the new schema of {name!r} is not {self.compatibility} compatible")
        known.append(schema)
        return len(known)

    def get(self, name: str, version: int | None = None) -> T.StructType:
        return self.versions[name][-1 if version is None else version - 1]

    def rollback(self, name: str, version: int) -> int:
        self.versions[name].append(self.get(name, version))
        return len(self.versions[name])

    def diff(self, name: str, old: int, new: int) -> dict[str, list[str]]:
        a, b = ({f.name: f.dataType for f in self.get(name, v)} for v in (old, new))
        return {"added": sorted(b.keys() - a.keys()), "removed": sorted(a.keys() - b.keys()), "changed": sorted(n for n in a.keys() & b.keys() if a[n] != b[n])}


@dataclass
class Lineage:
    """What each dataset is made from."""

    parents: dict[str, set[str]] = field(default_factory=dict)

    def add(self, name: str, *sources: str) -> None:
        if name in sources or any(name in self.provenance(s) for s in sources):
            raise CypherSemanticError(f"{name!r} would be made from itself")
        self.parents.setdefault(name, set()).update(sources)

    def provenance(self, name: str) -> set[str]:
        out: set[str] = set()
        todo = list(self.parents.get(name, ()))
        while todo:
            if (p := todo.pop()) not in out:
                out.add(p)
                todo += self.parents.get(p, ())
        return out

    def impact(self, name: str) -> set[str]:
        return {n for n in self.parents if name in self.provenance(n)}

    def order(self) -> list[str]:
        return list(TopologicalSorter(self.parents).static_order())
