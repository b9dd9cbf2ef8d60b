"""Clauses to one lazy DataFrame.

A pattern starts from a variable that is bound already, or else from one scan, and each
hop is an equi-join with the edge table and with the target's table.  Property columns
ride along in the scans; Catalyst prunes those that nothing reads and pushes the filters
down, and adaptive execution picks the joins.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.catalog import Graph, Relationship, properties, union
from trellis.errors import CypherSemanticError
from trellis.functions.typed import Typed
from trellis.operators import paths
from trellis.plans import ast as A
from trellis.plans import cycles
from trellis.plans.expressions import Expressions, has_aggregate
from trellis.plans.scope import ID, SOURCE, TARGET, Frame, Symbol, prop_column, quoted


def conjuncts(e: A.Node | None) -> list[A.Node]:
    if isinstance(e, A.Binary) and e.op == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [] if e is None else [e]


class Compiler:
    """Compiles one statement; ``graph`` is replaced where an update clause changes it."""

    def __init__(self, spark: SparkSession, graph: Graph, parameters: dict[str, Any], udfs: dict, procedures: dict):
        self.spark, self.graph, self.parameters, self.udfs, self.procedures = spark, graph, parameters, udfs, procedures
        self.fresh_columns = 0
        self.used: set[str] | None = None
        self.before: dict[str, Symbol] = {}
        self.filtered: set[str] = set()
        self.conditions: list[A.Node] = []

    def fresh(self, stem: str = "c") -> str:
        self.fresh_columns += 1
        return f"__{stem}{self.fresh_columns}"

    # entry

    def run(self, clauses: tuple[A.Node, ...], frame: Frame | None = None) -> Frame | None:
        from trellis.plans.updates import Updates

        self.used = self._needed(clauses)
        updates = Updates(self)
        for clause in clauses:
            if isinstance(clause, A.UPDATES):
                frame = updates.apply(clause, frame or self.seed())
            else:
                frame = getattr(self, f"_{type(clause).__name__.lower()}")(clause, frame)
        return frame

    def seed(self) -> Frame:
        return Frame(self.spark.range(1).select(), {})

    @staticmethod
    def _needed(clauses: Any) -> set[str]:
        """Variables of which more than the id may be read; targets without need and label skip their table."""
        out = set()
        for n in A.walk(clauses):
            if isinstance(n, A.Property) and isinstance(n.target, A.Variable):
                out.add(n.target.name)
            elif isinstance(n, A.Call):
                out |= {a.name for a in n.args if isinstance(a, A.Variable)}
            elif isinstance(n, (A.MapProjection, A.SetItem)):
                out.add(n.name if isinstance(n, A.MapProjection) else n.target)
            elif isinstance(n, A.HasLabel):
                out.add(n.value.name)
            elif isinstance(n, A.Delete):
                out |= {v.name for v in n.values if isinstance(v, A.Variable)}
            elif isinstance(n, A.Projection):
                out |= {i.value.name for i in n.items if isinstance(i.value, A.Variable) and not n.final}
            elif isinstance(n, A.NodePattern) and (n.properties or n.where):
                out.add(n.name)
        return out

    # expressions

    def expressions(self, frame: Frame, joined: dict | None = None, aggregating: bool = False) -> Expressions:
        return Expressions(frame, self.parameters, self.udfs, joined, aggregating)

    def prepare(self, frame: Frame, *exprs: A.Node | None) -> tuple[Frame, dict]:
        """Join the sub-queries of expressions to the frame: (frame, sub-query to column)."""
        joined: dict[A.Node, str] = {}
        for e in exprs:
            for n in self._subqueries(e):
                if n not in joined:
                    frame, joined[n] = self._join_subquery(frame, n)
        return frame, joined

    def _subqueries(self, e: Any):
        if isinstance(e, (A.Exists, A.PatternComprehension)):
            yield e
        elif isinstance(e, A.Node):
            for f in e.__dataclass_fields__:
                yield from self._subqueries(getattr(e, f))
        elif isinstance(e, tuple):
            for x in e:
                yield from self._subqueries(x)

    def _outer(self, frame: Frame, e: A.Node) -> tuple[Frame, list[str]]:
        """Distinct outer bindings that the sub-query reads, and their columns."""
        names = {n.name for n in A.walk(e) if isinstance(n, (A.Variable, A.NodePattern, A.RelPattern, A.MapProjection))}
        symbols = {n: s for n, s in frame.symbols.items() if n in names}
        columns = list(dict.fromkeys(c for s in symbols.values() for c in s.columns()))
        ids = list(dict.fromkeys(c for s in symbols.values() for c in (s.column, s.label_column) if c is not None))
        rest = [c for c in columns if c not in ids]
        if ids:
            grouped = frame.df.groupBy(*[quoted(c) for c in ids])
            df = grouped.agg(*[F.first(quoted(c)).alias(c) for c in rest]) if rest else frame.df.select(*[quoted(c) for c in ids]).distinct()
        else:
            df = self.spark.range(1).select()
        return Frame(df, symbols), ids

    def _join_subquery(self, frame: Frame, e: A.Node) -> tuple[Frame, str]:
        outer, ids = self._outer(frame, e)
        out = self.fresh("sub")
        if isinstance(e, A.Exists):
            inner = self._inner(outer, e.clauses)
            value = F.lit(True).alias(out)
            found = inner.select(*[quoted(c) for c in ids]).distinct().withColumn(out, value) if ids else inner.limit(1).select(value)
            default = F.lit(False)
        else:
            matched = self._match(A.Match((e.path,), e.where), outer)
            matched, joined = self.prepare(matched, e.body)
            body = self.expressions(matched, joined)(e.body).col
            rows = matched.df.select(*[quoted(c) for c in ids], body.alias(out))
            gathered = F.transform(F.collect_list(F.struct(quoted(out).alias("v"))), lambda s: s["v"]).alias(out)
            found = rows.groupBy(*[quoted(c) for c in ids]).agg(gathered)
            default = F.array().cast(found.schema[out].dataType)
        names = {c: self.fresh("k") for c in ids}
        found = found.select(*[quoted(c).alias(n) for c, n in names.items()], out)
        on = [quoted(c).eqNullSafe(quoted(n)) for c, n in names.items()]
        df = frame.df.join(found, on, "left") if on else frame.df.join(found, F.lit(True), "left")
        df = df.withColumn(out, F.coalesce(quoted(out), default)).drop(*names.values())
        return frame.with_df(df), out

    def _inner(self, outer: Frame, clauses: tuple[A.Node, ...]) -> DataFrame:
        """Rows of a sub-query with the outer columns kept; its RETURN doesn't matter."""
        frame = outer
        for c in clauses:
            if isinstance(c, A.Projection):
                if c.final:
                    continue
                kept = tuple(A.Item(A.Variable(n), n) for n in outer.symbols if n not in {i.alias or A.render(i.value) for i in c.items})
                c = replace(c, items=c.items + kept)
            frame = getattr(self, f"_{type(c).__name__.lower()}")(c, frame)
        return frame.df

    def where(self, frame: Frame, condition: A.Node | None) -> Frame:
        """Filter; EXISTS among the conjuncts becomes a semi or anti join."""
        plain = []
        for c in conjuncts(condition):
            negated = isinstance(c, A.Unary) and c.op == "NOT" and isinstance(c.value, A.Exists)
            exists = c.value if negated else c
            if isinstance(exists, A.Exists):
                outer, ids = self._outer(frame, exists)
                if ids:
                    names = {i: self.fresh("k") for i in ids}
                    inner = self._inner(outer, exists.clauses).select(*[quoted(i).alias(n) for i, n in names.items()])
                    on = [quoted(i) == quoted(n) for i, n in names.items()]
                    frame = frame.with_df(frame.df.join(inner, on, "left_anti" if negated else "left_semi"))
                    continue
            plain.append(c)
        if plain:
            columns = frame.df.columns
            prepared, joined = self.prepare(frame, *plain)
            compile_ = self.expressions(prepared, joined)
            df = prepared.df
            for c in plain:
                df = df.filter(compile_._truth(compile_(c)).col)
            frame = frame.with_df(df.select(*[quoted(c) for c in columns]) if joined else df)
        return frame

    # MATCH

    def _match(self, clause: A.Match, frame: Frame | None) -> Frame:
        if clause.optional:
            return self._optional(clause, frame or self.seed())
        self.filtered, self.conditions = self._filtered(clause.where), conjuncts(clause.where)
        frame = self.patterns(clause.paths, frame)
        return self.where(frame, clause.where)

    @staticmethod
    def _filtered(condition: A.Node | None) -> set[str]:
        """Variables that a conjunct compares with a constant, so that few of their rows remain."""
        out = set()
        for c in conjuncts(condition):
            if isinstance(c, A.Binary) and c.op in ("=", "<", ">", "<=", ">=", "IN", "STARTS WITH", "=~"):
                for a, b in ((c.left, c.right), (c.right, c.left)):
                    constant = not any(isinstance(n, A.Variable) for n in A.walk(b))
                    if isinstance(a, A.Property) and isinstance(a.target, A.Variable) and constant:
                        out.add(a.target.name)
        return out

    def patterns(self, todo: tuple[A.PathPattern, ...], frame: Frame | None) -> Frame:
        """Paths in an order in which each shares a variable with those before, where there is one; cycles hop by hop."""
        if (cycle := cycles.plan(todo, frame, self.graph, self.filtered)) is not None:
            return self._cycle(cycle, frame)
        left = list(todo)
        while left:
            bound = set(frame.symbols) if frame is not None else set()
            path = next((p for p in left if bound & {n.name for n in p.nodes}), left[0])
            left.remove(path)
            frame = self._path(path, frame)
        return frame

    def _path(self, path: A.PathPattern, frame: Frame | None) -> Frame:
        bound = frame.symbols if frame is not None else {}
        start = next((k for k, n in enumerate(path.nodes) if n.name in bound), None)
        if start is None:
            few = lambda n: n.properties is not None or n.name in self.filtered
            start = max(range(len(path.nodes)), key=lambda k: (few(path.nodes[k]), bool(path.nodes[k].labels), -k))
            start = 0 if path.shortest or any(r.length for r in path.rels) else start
            if frame is None and self._skips(path, start):
                frame = Frame(self.spark.range(1).select(), {})  # the first hop's edges are the start
            else:
                scanned = self.scan(path.nodes[start].name, path.nodes[start])
                # a filter that ties it to the frame makes the product a join
                frame = scanned if frame is None else Frame(frame.df.crossJoin(scanned.df), frame.symbols | scanned.symbols)
                frame = self._node_filters(frame, path.nodes[start])
        else:
            frame = self._check_bound(frame, path.nodes[start])
        hops: list[str] = []
        for k in range(start, len(path.rels)):
            frame = self._hop(frame, path, k, path.nodes[k], path.nodes[k + 1], False, hops)
        for k in range(start - 1, -1, -1):
            frame = self._hop(frame, path, k, path.nodes[k + 1], path.nodes[k], True, hops)
        if path.name is not None:
            column = self.fresh("path")
            length = F.lit(len(path.rels) - len(hops)).cast("long")
            for h in hops:
                length = length + quoted(h)
            parts: dict[str, str] = {}
            if not hops:  # ids of a path of fixed length
                ids = {"nodes": [n.name for n in path.nodes], "relationships": [r.name for r in path.rels]}
                parts = {k: self.fresh(k) for k in ids}
                one = lambda name: quoted(frame.symbols[name].column)
                frame = frame.with_df(frame.df.withColumns({parts[k]: F.array(*map(one, v)) if v else F.array().cast("array<bigint>") for k, v in ids.items()}))
            frame = Frame(frame.df.withColumn(column, length), frame.symbols | {path.name: Symbol("path", column, props=parts)})
        return frame

    def _cycle(self, cycle: cycles.Cycle, frame: Frame | None) -> Frame:
        outer = set(frame.symbols) if frame is not None else set()
        if cycle.start is not None:
            scanned = self.scan(cycle.start.name, cycle.start)
            frame = scanned if frame is None else Frame(frame.df.crossJoin(scanned.df), frame.symbols | scanned.symbols)
            frame = self._node_filters(frame, cycle.start)
        for name in (n for n in cycle.nodes if n in outer):
            frame = self._check_bound(frame, cycle.nodes[name])
        for first, *rest in cycle.steps:
            frame = self._wedge(cycle, frame, first, rest, outer) if rest else self._step(cycle, frame, first)
        return frame

    def _step(self, cycle: cycles.Cycle, frame: Frame, hop: cycles.Hop, hidden: dict[str, str] | None = None) -> Frame:
        """``hidden``: names of nodes for which only an id is wanted."""
        near, far = (A.NodePattern(hidden[n]) if n in (hidden or {}) else cycle.nodes[n] for n in (hop.near, hop.far))
        return self._hop(frame, hop.path, hop.k, near, far, hop.backwards, [])

    def _wedge(self, cycle: cycles.Cycle, frame: Frame, first: cycles.Hop, rest: list[cycles.Hop], outer: set[str]) -> Frame:
        """Edges to a new node with the edges that lead from there to bound nodes, joined with the frame by the ids of all of these at once."""
        keys = [(first.near, self.fresh("k"))]
        found = self._step(cycle, self.seed(), first, dict(keys))
        if first.near not in outer and (few := self._few(cycle.nodes[first.near])) is not None:
            ids = few.df.select(quoted(first.near).alias(self.fresh("k")))
            found = found.with_df(found.df.join(ids, quoted(keys[0][1]) == quoted(ids.columns[0]), "left_semi"))
        for hop in rest:
            hidden = {hop.far: self.fresh("k")} if hop.far in frame.symbols else {}
            found = self._step(cycle, found, hop, hidden)
            keys += hidden.items()
        on = [quoted(frame.symbol(n).column) == quoted(k) for n, k in keys]
        hidden = {k for _, k in keys}
        new = {n: s for n, s in found.symbols.items() if n not in hidden}
        return Frame(frame.df.join(found.df, on).drop(*hidden), frame.symbols | new)

    def _few(self, node: A.NodePattern) -> Frame | None:
        """The node's rows that its own filters leave; None where it has none."""
        own = [c for c in self.conditions if {n.name for n in A.walk(c) if isinstance(n, A.Variable)} == {node.name} and cycles.plain(c)]
        if not own and node.properties is None:
            return None
        frame = self._node_filters(self.scan(node.name, node), node)
        for c in own:
            frame = self.where(frame, c)
        return frame

    def _skips(self, path: A.PathPattern, start: int) -> bool:
        """Whether the start's table need not be read: nothing reads it, and the sound edges of the first hop tell its label."""
        node = path.nodes[start]
        if not path.rels or path.shortest or len(path.nodes) != len({n.name for n in path.nodes}):
            return False
        rel, backwards = (path.rels[start], False) if start < len(path.rels) else (path.rels[start - 1], True)
        if rel.length is not None or rel.direction == "both" or not self._unread(node):
            return False
        out = (rel.direction == "out") != backwards
        rels = [self.graph.rels.get(t) for t in rel.types]
        known = {None if r is None or not r.sound else r.source_label if out else r.target_label for r in rels}
        return bool(rels) and None not in known and (not node.labels or set(node.labels) == known)

    def _unread(self, node: A.NodePattern) -> bool:
        return self.used is not None and node.name not in self.used and node.properties is None and node.where is None and node.name not in self.filtered

    def scan(self, name: str, pattern: A.NodePattern | None = None, labels: tuple[str, ...] = ()) -> Frame:
        wanted = labels or (pattern.labels if pattern is not None else ())
        if pattern is not None and len(pattern.labels) > 1 and not pattern.any_label and len(set(pattern.labels)) > 1:
            wanted = ("\0none",)  # a node has one label
        known = self.graph.labels(wanted)
        if not known:
            if wanted and wanted[0] != "\0none" and not self.graph.nodes and not self.graph.rels:
                raise CypherSemanticError(f"there is no label {wanted[0]!r}")
            empty = self.spark.range(0).select(F.col("id").alias(name))
            return Frame(empty, {name: Symbol("node", name, wanted[:1])})
        single = len(known) == 1
        parts = [self.graph.nodes[x] if single else self.graph.nodes[x].withColumn("__label__", F.lit(x)) for x in known]
        df = parts[0] if single else union(parts)
        props = {p: prop_column(name, p) for p in properties(df) if p != "__label__"}
        label_column = None if single else f"{name}__label"
        columns = [quoted(ID).alias(name), *[quoted(p).alias(c) for p, c in props.items()]]
        if label_column:
            columns.append(F.col("__label__").alias(label_column))
        return Frame(df.select(*columns), {name: Symbol("node", name, known, props, label_column)})

    def _node_filters(self, frame: Frame, pattern: A.NodePattern) -> Frame:
        frame = self._match_properties(frame, pattern.name, pattern.properties)
        return self.where(frame, pattern.where)

    def _match_properties(self, frame: Frame, name: str, given: A.Node | None) -> Frame:
        if given is None:
            return frame
        if isinstance(given, A.Parameter):
            entries = tuple((k, A.Index(given, A.Literal(k))) for k in self.parameters.get(given.name, {}))
        else:
            entries = given.entries
        for key, value in entries:
            frame = self.where(frame, A.Binary("=", A.Property(A.Variable(name), key), value))
        return frame

    def _check_bound(self, frame: Frame, pattern: A.NodePattern) -> Frame:
        symbol = frame.symbol(pattern.name)
        if symbol.kind == "value":
            # an id that came through a projection: look its node up
            scanned = self.scan(pattern.name, pattern)
            other = scanned.symbols[pattern.name]
            renamed = scanned.df.withColumnRenamed(other.column, self.fresh("n"))
            key = next(c for c in renamed.columns if c.startswith("__n"))
            df = frame.df.join(renamed, quoted(symbol.column) == quoted(key)).drop(key)
            frame = Frame(df, frame.symbols | {pattern.name: replace(other, column=symbol.column)})
            return self._node_filters(frame, pattern)
        if pattern.labels and symbol.kind == "node":
            if symbol.label_column is not None:
                frame = frame.with_df(frame.df.filter(quoted(symbol.label_column).isin(*pattern.labels)))
            elif symbol.labels and not set(symbol.labels) & set(pattern.labels):
                frame = frame.with_df(frame.df.filter(F.lit(False)))
            elif not symbol.labels:
                known = self.scan(self.fresh("n"), pattern)
                column = next(iter(known.symbols.values())).column
                frame = frame.with_df(frame.df.join(known.df.select(column), quoted(symbol.column) == quoted(column), "left_semi"))
        return self._node_filters(frame, pattern)

    def edges(self, pattern: A.RelPattern) -> tuple[DataFrame, list[str], tuple[str, ...]]:
        """Edge rows of the pattern's types: id, s, t, type and properties."""
        types = tuple(t for t in (pattern.types or tuple(self.graph.rels)) if t in self.graph.rels)
        if not types:
            empty = self.spark.range(0).select(*[F.col("id").alias(c) for c in (ID, SOURCE, TARGET)])
            return empty.withColumns({c: F.lit(None).cast("string") for c in ("__type__", "__sl__", "__tl__")}), [], pattern.types
        rels = [self.graph.rels[t] for t in types]
        ends = lambda r: {"__sl__": F.lit(r.source_label).cast("string"), "__tl__": F.lit(r.target_label).cast("string")}
        parts = [r.df.withColumns({"__type__": F.lit(t)} | ends(r)) for t, r in zip(types, rels, strict=True)]
        df = parts[0] if len(parts) == 1 else union(parts)
        return df, [p for p in properties(df) if p not in ("__type__", "__sl__", "__tl__")], types

    def _hop(self, frame: Frame, path: A.PathPattern, k: int, near: A.NodePattern, far: A.NodePattern, backwards: bool, hops: list[str]) -> Frame:
        rel = path.rels[k]
        direction = rel.direction
        if backwards and direction != "both":
            direction = "in" if direction == "out" else "out"
        if rel.length is not None or path.shortest:
            return self._far_hop(frame, path, rel, near, far, direction, hops)
        df, props, types = self.edges(rel)
        if ID not in df.columns:
            df = df.withColumn(ID, F.monotonically_increasing_id())
        names = {c: self.fresh("e") for c in (ID, SOURCE, TARGET, "__type__", "__sl__", "__tl__")} | {p: prop_column(rel.name, p) for p in props}
        again = rel.name in frame.symbols
        if again:
            names |= {p: self.fresh("e") for p in props}
        flat = df.select(*[quoted(c).alias(n) for c, n in names.items()])
        source, target, ends = quoted(names[SOURCE]), quoted(names[TARGET]), {}
        if direction == "both":
            s, t, sl, tl = (self.fresh(c) for c in ("s", "t", "sl", "tl"))
            labels = quoted(names["__sl__"]), quoted(names["__tl__"])
            loop = (source == target) & F.coalesce(labels[0] == labels[1], F.lit(True))
            swapped = flat.where(~loop).withColumns({s: target, t: source, sl: labels[1], tl: labels[0]})
            flat = flat.withColumns({s: source, t: target, sl: labels[0], tl: labels[1]}).unionByName(swapped)
            ends = {"near": s, "far": t, "near_label": sl, "far_label": tl}
        else:
            ends = {"near": names[SOURCE], "far": names[TARGET], "near_label": names["__sl__"], "far_label": names["__tl__"]}
            if direction == "in":
                ends = {"near": ends["far"], "far": ends["near"], "near_label": ends["far_label"], "far_label": ends["near_label"]}
        if near.name not in frame.symbols:  # the edges are the start
            known = self._end_labels(types, "in" if direction == "out" else "out")
            flat = flat.withColumn(near.name, quoted(ends["near"]))
            frame, flat = Frame(flat, {near.name: Symbol("node", near.name, known[:1])}), None
        here = frame.symbol(near.name)
        on = quoted(here.column) == quoted(ends["near"])
        on = self._of_label(on, here, quoted(ends["near_label"]), types, direction, False)
        if again:
            on = on & (quoted(frame.symbols[rel.name].column) == quoted(names[ID]))
        bound = far.name in frame.symbols and frame.symbols[far.name].kind != "value" or far.name == near.name
        if bound:
            there = frame.symbol(far.name)
            on = on & (quoted(there.column) == quoted(ends["far"]))
            on = self._of_label(on, there, quoted(ends["far_label"]), types, direction, True)
        joined = frame.df if flat is None else frame.df.join(flat, on)
        symbol = Symbol("rel", names[ID], types, {p: names[p] for p in props}, names["__type__"] if len(types) != 1 else None, names[SOURCE], names[TARGET])
        frame = Frame(joined, frame.symbols | {rel.name: symbol} if not again else frame.symbols)
        frame = self._match_properties(frame, rel.name, rel.properties)
        frame = self.where(frame, rel.where)
        if bound:
            return self._check_bound(frame, far)
        known = self._end_labels(types, direction)
        sound = all(self.graph.rels[t].sound for t in types if t in self.graph.rels)
        return self._arrive(frame, far, ends["far"], known, ends["far_label"], sound)

    def _of_label(self, on: Column, symbol: Symbol, label: Column, types: tuple[str, ...], direction: str, far: bool) -> Column:
        """``on`` and that the node has the label that the edge's end is known to have; nothing where all have it anyway."""
        if symbol.kind != "node" or direction != "both" and self._end_labels(types, direction if far else {"out": "in", "in": "out"}[direction]) == symbol.labels and len(symbol.labels) == 1:
            return on
        if symbol.label_column is not None:
            return on & F.coalesce(label == quoted(symbol.label_column), F.lit(True))
        return on & F.coalesce(label.isin(*symbol.labels), F.lit(True)) if symbol.labels else on

    def _end_labels(self, types: tuple[str, ...], direction: str) -> tuple[str, ...]:
        rels = [self.graph.rels[t] for t in types if t in self.graph.rels]
        side = {"out": lambda r: {r.target_label}, "in": lambda r: {r.source_label}, "both": lambda r: {r.source_label, r.target_label}}[direction]
        found = set().union(*map(side, rels)) if rels else set()
        return () if None in found else tuple(sorted(found))

    def _arrive(self, frame: Frame, far: A.NodePattern, column: str, known: tuple[str, ...], label: str | None = None, sound: bool = False) -> Frame:
        """Bind the far node: a join with its table, which also checks its label; none where nothing is to be read or checked."""
        if far.name in frame.symbols:
            frame = frame.with_df(frame.df.filter(quoted(frame.symbol(far.name).column) == quoted(column)))
            return self._check_bound(frame, far)
        told = sound and len(known) == 1 and tuple(far.labels) == known
        if (not far.labels or told) and self._unread(far):
            df = frame.df.withColumn(far.name, quoted(column))
            return Frame(df, frame.symbols | {far.name: Symbol("node", far.name, known[:1] if len(known) == 1 else ())})
        labels = () if far.labels else tuple(x for x in known if x in self.graph.nodes)
        scanned = self.scan(far.name, far, labels)
        on = quoted(column) == quoted(far.name)
        symbol = scanned.symbols[far.name]
        if label is not None and (symbol.labels != known or len(known) > 1):
            if symbol.label_column is not None:
                on = on & F.coalesce(quoted(label) == quoted(symbol.label_column), F.lit(True))
            elif symbol.labels:
                on = on & F.coalesce(quoted(label).isin(*symbol.labels), F.lit(True))
        df = frame.df.join(scanned.df, on)
        return self._node_filters(Frame(df, frame.symbols | scanned.symbols), far)

    def _far_hop(self, frame: Frame, path: A.PathPattern, rel: A.RelPattern, near: A.NodePattern, far: A.NodePattern, direction: str, hops: list[str]) -> Frame:
        df, _, types = self.edges(rel)
        if rel.properties is not None or rel.where is not None:
            names = {c: f"{rel.name}__p__{c}" for c in df.columns}
            one = Frame(df.select(*[quoted(c).alias(n) for c, n in names.items()]), {rel.name: Symbol("rel", names.get(ID, names[SOURCE]), types, {c: names[c] for c in properties(df)})})
            one = self.where(self._match_properties(one, rel.name, rel.properties), rel.where)
            df = one.df.select(*[quoted(n).alias(c) for c, n in names.items()])
        here = frame.symbol(near.name)
        rels = [self.graph.rels[t] for t in types if t in self.graph.rels]
        labels = {x for r in rels for x in (r.source_label, r.target_label)}
        # ids of several labels are told apart by their label, where it is known of all ends
        apart = len(labels) > 1 and None not in labels and here.kind == "node" and (here.label_column is not None or len(here.labels) == 1)
        node = lambda label, i: F.struct(label.alias("label"), i.cast("string").alias("id")) if apart else i
        here_label = quoted(here.label_column) if here.label_column is not None else F.lit(here.labels[0] if here.labels else None)
        out = df.select(node(F.col("__sl__"), quoted(SOURCE)).alias("s"), node(F.col("__tl__"), quoted(TARGET)).alias("t"))
        edges = {"out": out, "in": out.select(F.col("t").alias("s"), F.col("s").alias("t"))}
        edges["both"] = edges["out"].unionByName(edges["in"])
        pairs = edges[direction].distinct()
        starts = frame.df.select(node(here_label, quoted(here.column)).alias("start")).distinct()
        least, most = rel.length or (1, 1)
        if most is not None and least > most:
            raise CypherSemanticError(f"no length is from {least} to {most}")
        walk = paths.shortest if path.shortest else paths.expand
        found = walk(starts, pairs, least, most)
        a, b, h = self.fresh("a"), self.fresh("b"), self.fresh("h")
        hops.append(h)
        again, end_label = far.name in frame.symbols, None
        if apart:
            end_label, kind = self.fresh("l"), frame.df.schema[here.column].dataType
            ends = [F.col("start.label").alias(a + "l"), F.col("start.id").cast(kind).alias(a), F.col("end.label").alias(end_label), F.col("end.id").alias(b)]
            found = found.select(*ends, F.col("hops").cast("long").alias(h))
            on = (quoted(here.column) == quoted(a)) & (here_label == quoted(a + "l"))
        else:
            found = found.select(F.col("start").alias(a), F.col("end").alias(b), F.col("hops").cast("long").alias(h))
            on = quoted(here.column) == quoted(a)
        if again:
            there = frame.symbol(far.name)
            on = on & (quoted(there.column).cast("string") == quoted(b) if apart else quoted(there.column) == quoted(b))
            if apart and there.kind == "node" and (there.label_column is not None or there.labels):
                on = on & (quoted(end_label) == quoted(there.label_column) if there.label_column is not None else quoted(end_label).isin(*there.labels))
        frame = Frame(frame.df.join(found, on).drop(a, a + "l"), frame.symbols | {rel.name: Symbol("value", h)})
        if again:
            return self._check_bound(frame, far)
        known = tuple(sorted(labels)) if apart else self._end_labels(types, direction) if least > 0 else ()
        return self._arrive(frame, far, b, known, end_label)

    def _optional(self, clause: A.Match, frame: Frame) -> Frame:
        """Left join: the pattern and its WHERE are matched from the distinct bindings that they share with the frame."""
        names = {n.name for n in A.walk(clause) if isinstance(n, (A.Variable, A.NodePattern, A.RelPattern, A.MapProjection))}
        outer, ids = self._outer(frame, clause)
        matched = self._match(replace(clause, optional=False), outer if outer.symbols else None)
        new = {n: s for n, s in matched.symbols.items() if n not in frame.symbols}
        columns = list(dict.fromkeys(c for s in new.values() for c in s.columns()))
        keys = {c: self.fresh("k") for c in ids if names & {n for n, s in frame.symbols.items() if c in s.columns()}}
        right = matched.df.select(*[quoted(c).alias(k) for c, k in keys.items()], *[quoted(c) for c in columns])
        # nulls of an earlier optional pattern match nothing, but a value that is only read may be null
        nodes = {s.column for s in frame.symbols.values() if s.kind in ("node", "rel")}
        on = [quoted(c) == quoted(k) if c in nodes else quoted(c).eqNullSafe(quoted(k)) for c, k in keys.items()]
        df = frame.df.join(right, on or F.lit(True), "left").drop(*keys.values())
        return Frame(df, frame.symbols | new)

    # UNWIND and CALL

    def _unwind(self, clause: A.Unwind, frame: Frame | None) -> Frame:
        frame, joined = self.prepare(frame or self.seed(), clause.value)
        value = self.expressions(frame, joined)(clause.value)
        column = clause.name if clause.name not in frame.df.columns else self.fresh("v")
        if value.kind == "list":
            rows = F.filter(value.col, lambda x: x.isNotNull())
            df = frame.df.select("*", F.explode(rows).alias(column))
        else:
            df = frame.df.withColumn(column, value.col).where(quoted(column).isNotNull())
        return Frame(df, frame.symbols | {clause.name: Symbol("value", column)})

    def _callprocedure(self, clause: A.CallProcedure, frame: Frame | None) -> Frame:
        procedure = self.procedures.get(clause.name.lower())
        if procedure is None:
            raise CypherSemanticError(f"there is no procedure {clause.name!r}")
        args = [self._constant(a) for a in clause.args]
        df = procedure(self, *args)
        yields = clause.yields or tuple((c, c) for c in df.columns)
        missing = [c for c, _ in yields if c not in df.columns]
        if missing:
            raise CypherSemanticError(f"{clause.name} yields no {missing[0]!r}")
        rows = df.select(*[quoted(c).alias(n) for c, n in yields])
        symbols = {n: Symbol("value", n) for _, n in yields}
        # a procedure's rows are a driver-side table: small
        out = Frame(rows, symbols) if frame is None else Frame(frame.df.crossJoin(rows), frame.symbols | symbols)
        return self.where(out, clause.where)

    def _constant(self, e: A.Node | None) -> Any:
        if isinstance(e, A.Literal):
            return e.value
        if isinstance(e, A.Parameter):
            if e.name not in self.parameters:
                raise CypherSemanticError(f"the parameter ${e.name} is not given")
            return self.parameters[e.name]
        seed = self.seed()
        return seed.df.select(self.expressions(seed)(e).col.alias("x")).first()[0]

    def _count(self, e: A.Node, what: str) -> int:
        n = self._constant(e)
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise CypherSemanticError(f"{what} needs a whole number, not {n!r}")
        return n

    # WITH and RETURN

    def names(self, items: tuple[A.Item, ...]) -> list[str]:
        """Output names: aliases; ``p.name`` gives ``name`` unless two items would share it."""
        short = [i.alias or (i.value.name if isinstance(i.value, (A.Property, A.Variable)) else A.render(i.value)) for i in items]
        return [n if i.alias or short.count(n) == 1 else A.render(i.value) for n, i in zip(short, items, strict=True)]

    def _projection(self, clause: A.Projection, frame: Frame | None) -> Frame:
        frame = frame or self.seed()
        items = clause.items
        if clause.star:
            starred = tuple(A.Item(A.Variable(n), n) for n in frame.symbols if not n.startswith("_"))
            items = tuple(i for i in starred if i.alias not in {x.alias for x in items}) + items
        if not items:
            raise CypherSemanticError("there is nothing to project")
        names = self.names(items)
        if len(set(names)) < len(names):
            raise CypherSemanticError(f"two columns are named {next(n for n in names if names.count(n) > 1)!r}")
        aggregating = self._aggregates(frame, [i.value for i in items])
        build = self._grouped if any(aggregating) else self._plain
        self.before = {} if any(aggregating) else frame.symbols
        out, hidden = build(clause, frame, items, names, aggregating)
        if clause.distinct:
            ids = [c for n in names for c in out.symbols[n].identity()]
            out = out.with_df(out.df.dropDuplicates(list(dict.fromkeys(ids))))
        out = self._modify(clause, out, hidden)
        if not clause.final:
            out = self.where(out, clause.where)
        keep = list(dict.fromkeys(c for n in names for c in out.symbols[n].columns()))
        symbols = {n: out.symbols[n] for n in names}
        if clause.final:
            return Frame(out.df.select(*[quoted(symbols[n].column).alias(n) for n in names]), {n: Symbol("value", n) for n in names})
        return Frame(out.df.select(*[quoted(c) for c in keep]), symbols)

    def _aggregates(self, frame: Frame, values: list[A.Node]) -> list[bool]:
        """min and max of one list are no aggregates."""
        compile_ = self.expressions(frame)

        def real(e: A.Node) -> bool:
            for n in A.walk(e):
                if not (isinstance(n, A.Call) and has_aggregate(n) and (n.star or n.name.lower() in ("min", "max") or has_aggregate(A.Call(n.name, ())))):
                    continue
                if n.star or n.name.lower() not in ("min", "max"):
                    return True
                try:
                    if compile_(n.args[0]).kind != "list":
                        return True
                except CypherSemanticError:
                    return True
            return False

        return [has_aggregate(e) and real(e) for e in values]

    def _passed(self, frame: Frame, e: A.Node) -> Symbol | None:
        """The symbol of a node, relationship or path that an item hands on."""
        if isinstance(e, A.Variable) and e.name in frame.symbols and frame.symbols[e.name].kind != "value":
            return frame.symbols[e.name]
        return None

    def _plain(self, clause: A.Projection, frame: Frame, items, names, _) -> tuple[Frame, dict]:
        frame, joined = self.prepare(frame, *[i.value for i in items], *[s.value for s in clause.order], clause.where)
        compile_ = self.expressions(frame, joined)
        added, symbols = [], {}
        for item, name in zip(items, names, strict=True):
            passed = self._passed(frame, item.value)
            if passed is not None:
                symbols[name] = passed
                continue
            column = self.fresh("v")
            added.append(compile_(item.value).col.alias(column))
            symbols[name] = Symbol("value", column)
        # variables before the projection stay in reach of ORDER BY and WHERE
        wide = Frame(frame.df.select("*", *added), frame.symbols | symbols)
        return wide, {e: c for e, c in joined.items()}

    def _grouped(self, clause: A.Projection, frame: Frame, items, names, aggregating) -> tuple[Frame, dict]:
        frame, joined = self.prepare(frame, *[i.value for i in items])
        compile_, inner = self.expressions(frame, joined), self.expressions(frame, joined, True)
        keys, firsts, aggs, symbols, known = [], [], [], {}, {}
        for item, name, agg in zip(items, names, aggregating, strict=True):
            passed = self._passed(frame, item.value)
            column = self.fresh("v")
            if passed is not None:
                keys += [quoted(c).alias(c) for c in passed.identity()]
                firsts += [c for c in passed.columns() if c not in passed.identity()]
                symbols[name] = passed
            elif agg:
                aggs.append(inner(item.value).col.alias(column))
                symbols[name] = Symbol("value", column)
                known[item.value] = column
            else:
                keys.append(compile_(item.value).col.alias(column))
                symbols[name] = Symbol("value", column)
                known[item.value] = column
        aggs += [F.first(quoted(c)).alias(c) for c in dict.fromkeys(firsts)]
        df = frame.df.groupBy(*keys).agg(*aggs) if keys else frame.df.agg(*aggs)
        return Frame(df, symbols), known

    def _modify(self, clause: A.Projection, out: Frame, known: dict) -> Frame:
        if clause.order:
            unprepared = [s.value for s in clause.order if s.value not in known]
            out, joined = self.prepare(out, *unprepared)
            compile_ = self.expressions(out, joined | known)
            sort = []
            before = self.expressions(Frame(out.df, out.symbols | self.before), joined | known)
            for s in clause.order:
                try:
                    c = compile_(s.value).col
                except CypherSemanticError:  # an alias may hide the variable that is meant
                    c = before(s.value).col
                nulls = s.nulls or "last"
                sort.append(getattr(c, f"{'desc' if s.descending else 'asc'}_nulls_{nulls}")())
            out = out.with_df(out.df.orderBy(*sort))
        if clause.skip is not None:
            out = out.with_df(out.df.offset(self._count(clause.skip, "SKIP")))
        if clause.limit is not None:
            out = out.with_df(out.df.limit(self._count(clause.limit, "LIMIT")))
        return out
