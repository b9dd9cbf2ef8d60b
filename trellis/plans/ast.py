"""Syntax tree of queries."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


class Node:
    """Base of all tree nodes."""


# expressions


@dataclass(frozen=True)
class Literal(Node):
    value: Any


@dataclass(frozen=True)
class Parameter(Node):
    name: str


@dataclass(frozen=True)
class Variable(Node):
    name: str


@dataclass(frozen=True)
class Property(Node):
    target: Node
    name: str


@dataclass(frozen=True)
class Index(Node):
    target: Node
    at: Node


@dataclass(frozen=True)
class Slice(Node):
    target: Node
    start: Node | None
    stop: Node | None


@dataclass(frozen=True)
class Unary(Node):
    op: str
    value: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class IsNull(Node):
    value: Node
    negated: bool


@dataclass(frozen=True)
class HasLabel(Node):
    value: Node
    labels: tuple[str, ...]


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Case(Node):
    subject: Node | None
    whens: tuple[tuple[tuple[Node, ...], Node], ...]
    default: Node | None


@dataclass(frozen=True)
class ListLiteral(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class MapLiteral(Node):
    entries: tuple[tuple[str, Node], ...]


@dataclass(frozen=True)
class MapProjection(Node):
    name: str
    entries: tuple[tuple[str, Node | None], ...]  # (".*", None), (property, None), (key, expression)


@dataclass(frozen=True)
class Comprehension(Node):
    name: str
    source: Node
    where: Node | None
    body: Node | None


@dataclass(frozen=True)
class Quantifier(Node):
    kind: str
    name: str
    source: Node
    where: Node


@dataclass(frozen=True)
class Reduce(Node):
    acc: str
    init: Node
    name: str
    source: Node
    body: Node


@dataclass(frozen=True)
class PatternComprehension(Node):
    path: PathPattern
    where: Node | None
    body: Node


@dataclass(frozen=True)
class Exists(Node):
    clauses: tuple[Node, ...]


# patterns


@dataclass(frozen=True)
class NodePattern(Node):
    name: str | None
    labels: tuple[str, ...] = ()
    any_label: bool = False  # A|B
    properties: Node | None = None
    where: Node | None = None


@dataclass(frozen=True)
class RelPattern(Node):
    name: str | None
    types: tuple[str, ...] = ()
    direction: str = "out"  # out, in, both
    properties: Node | None = None
    length: tuple[int, int | None] | None = None
    where: Node | None = None


@dataclass(frozen=True)
class PathPattern(Node):
    name: str | None
    nodes: tuple[NodePattern, ...]
    rels: tuple[RelPattern, ...]
    shortest: str | None = None  # one, all


# clauses


@dataclass(frozen=True)
class Match(Node):
    paths: tuple[PathPattern, ...]
    where: Node | None = None
    optional: bool = False


@dataclass(frozen=True)
class Unwind(Node):
    value: Node
    name: str


@dataclass(frozen=True)
class Item(Node):
    value: Node
    alias: str | None = None


@dataclass(frozen=True)
class Sort(Node):
    value: Node
    descending: bool = False
    nulls: str | None = None


@dataclass(frozen=True)
class Projection(Node):
    """RETURN, or WITH where ``final`` is false."""

    items: tuple[Item, ...]
    star: bool = False
    distinct: bool = False
    order: tuple[Sort, ...] = ()
    skip: Node | None = None
    limit: Node | None = None
    where: Node | None = None
    final: bool = True


@dataclass(frozen=True)
class CallProcedure(Node):
    name: str
    args: tuple[Node, ...]
    yields: tuple[tuple[str, str], ...] | None = None
    where: Node | None = None


@dataclass(frozen=True)
class Create(Node):
    paths: tuple[PathPattern, ...]


@dataclass(frozen=True)
class SetItem(Node):
    """kind: property, replace (=), merge (+=) or label."""

    kind: str
    target: str
    name: str | None = None
    value: Node | None = None


@dataclass(frozen=True)
class SetClause(Node):
    items: tuple[SetItem, ...]


@dataclass(frozen=True)
class Remove(Node):
    items: tuple[SetItem, ...]


@dataclass(frozen=True)
class Delete(Node):
    values: tuple[Node, ...]
    detach: bool = False


@dataclass(frozen=True)
class Merge(Node):
    path: PathPattern
    on_create: tuple[SetItem, ...] = ()
    on_match: tuple[SetItem, ...] = ()


@dataclass(frozen=True)
class Foreach(Node):
    name: str
    source: Node
    updates: tuple[Node, ...]


@dataclass(frozen=True)
class Query(Node):
    """Statements joined by UNION; ``all`` tells whether every union keeps repeats."""

    statements: tuple[tuple[Node, ...], ...]
    all: bool = True
    text: str = field(default="", compare=False)


UPDATES = (Create, SetClause, Remove, Delete, Merge, Foreach)


def walk(node: Any):
    """All tree nodes at and under ``node``."""
    if isinstance(node, Node):
        yield node
    if is_dataclass(node):
        for f in fields(node):
            yield from walk(getattr(node, f.name))
    elif isinstance(node, (tuple, list)):
        for x in node:
            yield from walk(x)


def rename(node: Any, names: dict[str, str]) -> Any:
    """The tree with variables renamed, wherever they are bound or used."""
    if is_dataclass(node) and isinstance(node, Node):
        changed = {f.name: rename(getattr(node, f.name), names) for f in fields(node)}
        for key in ("name", "acc", "target"):
            if isinstance(changed.get(key), str) and not isinstance(node, (Property, Parameter, Call, CallProcedure)) and (key != "name" or not isinstance(node, SetItem)):
                changed[key] = names.get(changed[key], changed[key])
        if isinstance(node, Item) and changed["alias"] is not None:
            changed["alias"] = names.get(changed["alias"], changed["alias"])
        return type(node)(**changed)
    if isinstance(node, tuple):
        return tuple(rename(x, names) for x in node)
    return node


_PRECEDENCE = {"OR": 1, "XOR": 2, "AND": 3}


def render(e: Node) -> str:
    """Text of an expression, as it names a column that has no alias."""
    if isinstance(e, Literal):
        if e.value is None:
            return "null"
        if isinstance(e.value, bool):
            return str(e.value).lower()
        return f"'{e.value}'" if isinstance(e.value, str) else str(e.value)
    if isinstance(e, Parameter):
        return f"${e.name}"
    if isinstance(e, Variable):
        return e.name
    if isinstance(e, Property):
        return f"{render(e.target)}.{e.name}"
    if isinstance(e, Index):
        return f"{render(e.target)}[{render(e.at)}]"
    if isinstance(e, Slice):
        return f"{render(e.target)}[{render(e.start) if e.start else ''}..{render(e.stop) if e.stop else ''}]"
    if isinstance(e, Unary):
        return f"{e.op} {render(e.value)}" if e.op == "NOT" else f"{e.op}{render(e.value)}"
    if isinstance(e, Binary):
        return f"{render(e.left)} {e.op} {render(e.right)}"
    if isinstance(e, IsNull):
        return f"{render(e.value)} IS {'NOT ' * e.negated}NULL"
    if isinstance(e, HasLabel):
        return render(e.value) + "".join(f":{x}" for x in e.labels)
    if isinstance(e, Call):
        return f"{e.name}({'*' if e.star else ('DISTINCT ' * e.distinct) + ', '.join(map(render, e.args))})"
    if isinstance(e, ListLiteral):
        return f"[{', '.join(map(render, e.items))}]"
    if isinstance(e, MapLiteral):
        return "{" + ", ".join(f"{k}: {render(v)}" for k, v in e.entries) + "}"
    return type(e).__name__.lower()
