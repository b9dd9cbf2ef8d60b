"""What the variables of a query stand for in the columns of a frame."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.errors import CypherSemanticError

#: Reserved columns of the graph's tables.
ID, SOURCE, TARGET = "__ID__", "__SOURCE__", "__TARGET__"


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def prop_column(var: str, prop: str) -> str:
    return f"{var}__p__{prop}"


@dataclass(frozen=True)
class Symbol:
    """``column`` holds the id of a node or relationship, or the value."""

    kind: str  # node, rel, value or path
    column: str
    labels: tuple[str, ...] = ()
    props: dict[str, str] = field(default_factory=dict)
    label_column: str | None = None
    source: str | None = None
    target: str | None = None

    def identity(self) -> list[str]:
        """Columns that tell two bindings apart."""
        parts = [*self.props.values()] if self.kind == "path" else []
        return [c for c in (self.column, self.label_column, *parts) if c is not None]

    def columns(self) -> list[str]:
        extra = [c for c in (self.label_column, self.source, self.target) if c is not None]
        return [self.column, *self.props.values(), *extra]


@dataclass(frozen=True)
class Frame:
    """Rows of variable bindings: a lazy DataFrame and its symbols."""

    df: DataFrame
    symbols: dict[str, Symbol]

    def with_df(self, df: DataFrame) -> Frame:
        return replace(self, df=df)

    def symbol(self, name: str) -> Symbol:
        if name not in self.symbols:
            raise CypherSemanticError(f"the variable {name!r} is not defined; known: {sorted(n for n in self.symbols if n[0] != '_')}")
        return self.symbols[name]

    def type_of(self, column: str) -> T.DataType:
        return self.df.schema[column].dataType
