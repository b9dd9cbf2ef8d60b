"""An order of hops for patterns that close a cycle.

Path by path, two hops into one node multiply their edges (every customer of a nation
with every supplier of it) before the rest of the cycle, which would leave few of them,
is read.  Where edges are known to be unique at an end, the hops of all paths are taken
together instead: first those that add no rows, then, before one that multiplies, such
as meet the bound nodes again over unique edges and so are joined by several keys.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from trellis.catalog import Graph
from trellis.plans import ast as A
from trellis.plans.scope import Frame


@dataclass(frozen=True)
class Hop:
    """Relationship ``k`` of the path, walked from ``near`` to ``far``."""

    path: A.PathPattern
    k: int
    near: str
    far: str
    backwards: bool
    #: Whether a near node has one far node at most, and the other way round.
    one: bool
    one_back: bool

    def turned(self) -> Hop:
        return replace(self, near=self.far, far=self.near, backwards=not self.backwards, one=self.one_back, one_back=self.one)


@dataclass(frozen=True)
class Cycle:
    #: What all patterns of a name ask for together.
    nodes: dict[str, A.NodePattern]
    #: The node to scan; None where the frame binds one.
    start: A.NodePattern | None
    #: Hops in order; several in a step are joined with each other first.
    steps: list[list[Hop]]


def plain(e: A.Node) -> bool:
    """Whether it has the same value wherever it is computed from the same row, and no sub-query."""
    return not any(isinstance(n, (A.Call, A.Exists, A.PatternComprehension, A.MapProjection)) for n in A.walk(e))


def plan(paths: tuple[A.PathPattern, ...], frame: Frame | None, graph: Graph, filtered: set[str]) -> Cycle | None:
    """None where no hop can be joined by several keys, or the paths hold more than single hops over sound edges of one type."""
    bound = frame.symbols if frame is not None else {}
    rels = [r for p in paths for r in p.rels]
    if len({r.name for r in rels} - set(bound)) < len(rels) or any(p.name is not None or p.shortest for p in paths):
        return None
    labels: dict[str, str] = {}
    nodes: dict[str, A.NodePattern] = {}
    hops: list[Hop] = []
    for p in paths:
        for k, r in enumerate(p.rels):
            edges = graph.rels.get(r.types[0]) if len(r.types) == 1 else None
            if edges is None or not edges.sound or r.length is not None or r.direction == "both" or r.where is not None:
                return None
            out = r.direction == "out"
            a, b = p.nodes[k].name, p.nodes[k + 1].name
            for name, label in ((a, edges.source_label if out else edges.target_label), (b, edges.target_label if out else edges.source_label)):
                if labels.setdefault(name, label) != label:
                    return None
            one, one_back = (edges.unique == ("source" if out else "target")), (edges.unique == ("target" if out else "source"))
            hops.append(Hop(p, k, a, b, False, one, one_back))
        for n in p.nodes:
            known = nodes.get(n.name, n)
            if n.where is not None or None not in (known.properties, n.properties) and known is not n:
                return None
            nodes[n.name] = replace(known, labels=tuple(dict.fromkeys(known.labels + n.labels)), properties=known.properties or n.properties)
    if any(isinstance(x, A.Variable) or not plain(x) for x in A.walk([n.properties for n in nodes.values()] + [r.properties for r in rels]) if isinstance(x, A.Node)):
        return None
    for name, n in nodes.items():
        if labels.get(name) not in graph.nodes or not set(n.labels) <= {labels[name]}:
            return None
        nodes[name] = replace(n, labels=(labels[name],))
        if name in bound and (bound[name].kind != "node" or bound[name].labels != (labels[name],) or bound[name].label_column is not None):
            return None
    start = None
    if not set(nodes) & set(bound):
        start = max(nodes.values(), key=lambda n: n.properties is not None or n.name in filtered)  # the first of equal ones
    steps = order(hops, [n for n in nodes if n in bound] or [start.name])
    return Cycle(nodes, start, steps) if steps is not None and any(len(s) > 1 for s in steps) else None


def order(hops: list[Hop], bound: list[str]) -> list[list[Hop]] | None:
    """Steps that bind every node; None where the hops don't hang together."""
    left, reached, steps = list(hops), list(bound), []
    shared: set[str] = set()  # reached over unique edges: many rows may meet there
    while left:
        ways = [w for h in left for w in (h, h.turned()) if w.near in reached]
        fresh = [w for w in ways if w.far not in reached]
        if not ways:
            return None
        if closing := [w for w in ways if w.far in reached]:
            step = closing[:1]
        elif single := [w for w in fresh if w.one]:
            step = single[:1]
            shared.add(step[0].far)
        else:
            met = [s for w in fresh if (s := meeting(w, left, reached))]
            # after those, on from the node that was reached last, so that no two hops multiply at one node
            step = met[0] if met else [max(fresh, key=lambda w: (w.near not in shared, reached.index(w.near)))]
        steps.append(step)
        gone = {(id(w.path), w.k) for w in step}
        left = [h for h in left if (id(h.path), h.k) not in gone]
        reached += dict.fromkeys(w.far for w in step if w.far not in reached)
    return steps


def meeting(first: Hop, left: list[Hop], reached: list[str]) -> list[Hop] | None:
    """The hop with unique edges that lead on from its far node, if one of them leads to a node reached before."""
    rest, own, out = [h for h in left if (h.path, h.k) != (first.path, first.k)], [first.far], [first]
    while way := next((w for h in rest for w in (h, h.turned()) if w.near in own and w.one), None):
        rest = [h for h in rest if (h.path, h.k) != (way.path, way.k)]
        out.append(way)
        if way.far not in reached and way.far not in own:
            own.append(way.far)
    return out if any(w.far in reached for w in out[1:]) else None
