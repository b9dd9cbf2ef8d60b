"""Checks of a query before it runs: all findings at once, with the nearest known names."""

from __future__ import annotations

from dataclasses import dataclass
from difflib import get_close_matches
from typing import Any

from trellis.catalog import Graph, properties
from trellis.errors import CypherError
from trellis.functions import aggregates, scalar
from trellis.plans import ast as A
from trellis.plans.expressions import has_aggregate
from trellis.plans.parser import parse

#: Functions of nodes, relationships and paths, which are not in the scalar registry.
_OF_GRAPH = {"length", "labels", "type", "keys", "properties", "startnode", "endnode", "nodes", "relationships", "id", "elementid"}


@dataclass(frozen=True)
class Finding:
    severity: str  # error or warning
    message: str


def _hint(name: str, known: Any) -> str:
    near = get_close_matches(name, list(known), 1)
    return f"; did you mean {near[0]!r}?" if near else ""


def _bound(clause: A.Node) -> set[str]:
    """Variables that a pattern, UNWIND or CALL brings."""
    out = {n.name for n in A.walk(clause) if isinstance(n, (A.NodePattern, A.RelPattern))}
    out |= {p.name for p in A.walk(clause) if isinstance(p, A.PathPattern) and p.name}
    if isinstance(clause, (A.Unwind, A.Foreach)):
        out.add(clause.name)
    if isinstance(clause, A.CallProcedure):
        out |= {n for _, n in clause.yields}
    return out


def _local(node: A.Node) -> set[str]:
    """Variables that comprehensions, quantifiers and reductions bind for themselves."""
    names = set()
    for n in A.walk(node):
        for f in ("name", "variable", "accumulator", "item"):
            value = getattr(n, f, None)
            if isinstance(value, str) and not isinstance(n, (A.Variable, A.Property, A.Call, A.Parameter, A.SetItem)):
                names.add(value)
    return names


def validate(text: str, graph: Graph | None = None, functions: Any = (), procedures: Any = ()) -> list[Finding]:
    """Findings of a query; with a graph, labels, types and properties are looked up as well."""
    try:
        tree = parse(text)
    except CypherError as e:
        return [Finding("error", str(e))]
    out: list[Finding] = []
    for statement in tree.statements:
        known: set[str] = set()
        labels: dict[str, tuple[str, ...]] = {}
        for clause in statement:
            if isinstance(clause, A.CallProcedure) and procedures and clause.name.lower() not in procedures:
                out.append(Finding("error", f"there is no procedure {clause.name!r}{_hint(clause.name.lower(), procedures)}"))
            known |= _bound(clause)
            inner = _local(clause)
            if isinstance(clause, A.Projection):  # ORDER BY and WHERE see the new names
                inner |= {i.alias for i in clause.items if i.alias}
            for n in A.walk(clause):
                if isinstance(n, A.Variable) and n.name not in known | inner:
                    out.append(Finding("error", f"the variable {n.name!r} is not defined{_hint(n.name, known)}"))
                elif isinstance(n, A.SetItem) and n.target not in known:
                    out.append(Finding("error", f"the variable {n.target!r} is not defined{_hint(n.target, known)}"))
                elif isinstance(n, A.Call) and n.name.lower() not in {*scalar.REGISTRY, *aggregates.NAMES, *_OF_GRAPH, *functions}:
                    out.append(Finding("error", f"there is no function {n.name!r}{_hint(n.name.lower(), {*scalar.REGISTRY, *aggregates.NAMES, *functions})}"))
                elif isinstance(n, A.Call) and n.name.lower() in aggregates.NAMES and n.name.lower() not in ("min", "max") and any(has_aggregate(a) for a in n.args):
                    out.append(Finding("error", f"the argument of {n.name} holds an aggregate"))
                elif isinstance(n, A.NodePattern):
                    labels[n.name] = labels.get(n.name, ()) + tuple(n.labels)
            if isinstance(clause, (A.Match, A.Unwind)) and any(has_aggregate(e) for e in (getattr(clause, "where", None), getattr(clause, "value", None)) if e is not None):
                out.append(Finding("error", "an aggregate can't be used outside WITH and RETURN"))
            if graph is not None and isinstance(clause, (A.Match, A.Projection, A.SetClause)):
                out += _of_graph(clause, graph, labels)
            if isinstance(clause, A.Match) and len(clause.paths) > 1:
                out += _products(clause)
            if isinstance(clause, A.Projection):
                names = {i.alias or (i.value.name if isinstance(i.value, A.Variable) else A.render(i.value)) for i in clause.items}
                known = names | (known if clause.star else set())
    return list(dict.fromkeys(out))


def _of_graph(clause: A.Node, graph: Graph, labels: dict[str, tuple[str, ...]]) -> list[Finding]:
    out = []
    for n in A.walk(clause):
        if isinstance(n, A.NodePattern):
            out += [Finding("warning", f"there is no label {x!r}{_hint(x, graph.nodes)}") for x in n.labels if x not in graph.nodes]
        elif isinstance(n, A.RelPattern):
            out += [Finding("warning", f"there is no relationship type {x!r}{_hint(x, graph.rels)}") for x in n.types if x not in graph.rels]
        elif isinstance(n, A.Property) and isinstance(n.target, A.Variable):
            tables = [graph.nodes[x] for x in labels.get(n.target.name, ()) if x in graph.nodes]
            known = {p for t in tables for p in properties(t)}
            if tables and n.name not in known:
                out.append(Finding("warning", f"{n.target.name} has no property {n.name!r}{_hint(n.name, known)}"))
    return out


def _products(clause: A.Match) -> list[Finding]:
    """Patterns that share no variable, neither by themselves nor by an equality, are multiplied."""
    groups = [{n.name for n in p.nodes} for p in clause.paths]
    if clause.where is not None:
        for n in A.walk(clause.where):
            if isinstance(n, A.Binary) and n.op == "=":
                groups.append({v.name for v in A.walk(n) if isinstance(v, A.Variable)})
    joined = groups[0]
    rest = groups[1:]
    while (near := next((g for g in rest if g & joined), None)) is not None:
        joined, rest = joined | near, [g for g in rest if g is not near]
    apart = [g for g in groups[: len(clause.paths)] if not g & joined]
    return [Finding("warning", "patterns that share no variable give all pairs of their rows")] if apart else []
