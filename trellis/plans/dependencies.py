"""Order of dependent queries: those that make a label or property come before those that read it."""

from __future__ import annotations

from graphlib import CycleError, TopologicalSorter

from trellis.errors import CypherSemanticError
from trellis.plans import ast as A
from trellis.plans.parser import parse


def effects(query: str) -> tuple[set[str], set[str]]:
    """(what the query makes, what it reads): labels, types and ``Label.property``."""
    made, read, labels = set(), set(), {}
    tree = parse(query)
    creating = {id(n) for c in A.walk(tree.statements) if isinstance(c, (A.Create, A.Merge)) for n in A.walk(c)}
    for n in A.walk(tree.statements):
        if isinstance(n, A.NodePattern):
            labels.setdefault(n.name, set()).update(n.labels)
            (made if id(n) in creating else read).update(n.labels)
        elif isinstance(n, A.RelPattern):
            labels.setdefault(n.name, set()).update(n.types)
            (made if id(n) in creating else read).update(n.types)
    for n in A.walk(tree.statements):
        if isinstance(n, A.SetItem) and n.kind == "property":
            made |= {f"{x}.{n.name}" for x in labels.get(n.target, ())}
        elif isinstance(n, A.Property) and isinstance(n.target, A.Variable):
            read |= {f"{x}.{n.name}" for x in labels.get(n.target.name, ())}
    return made, read - made


def ordered(queries: list[str]) -> list[str]:
    """A topological order that otherwise keeps the given one."""
    found = [effects(q) for q in queries]
    sorter = TopologicalSorter({k: {m for m, (made, _) in enumerate(found) if m != k and made & found[k][1]} for k in range(len(queries))})
    try:
        sorter.prepare()
    except CycleError as e:
        raise CypherSemanticError("the queries depend on each other in a circle") from e
    out: list[int] = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        out += ready
        sorter.done(*ready)
    return [queries[k] for k in out]
