"""Clauses that change the graph.

Every update is a set-based rewrite of a table of the (immutable) graph: new rows are
unioned, changed ones come from one left join by id, deleted ones leave by anti joins.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.catalog import Relationship, union
from trellis.errors import CypherSemanticError
from trellis.operators.paths import _cut
from trellis.plans import ast as A
from trellis.plans.scope import ID, SOURCE, TARGET, Frame, Symbol, prop_column, quoted


class Updates:
    def __init__(self, compiler):
        self.c = compiler

    def apply(self, clause: A.Node, frame: Frame) -> Frame:
        return getattr(self, f"_{type(clause).__name__.lower()}")(clause, frame)

    # ids

    def _numbered(self, df: DataFrame, column: str, after: int) -> DataFrame:
        """Dense numbers from after + 1, from a cut table: the number of a row doesn't change when it is read again."""
        raw = self.c.fresh("n")
        df = _cut(df.withColumn(raw, F.monotonically_increasing_id()))
        part = F.shiftright(quoted(raw), 33)
        # a row for each partition
        p, base, before = self.c.fresh("p"), self.c.fresh("b"), Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        counts = df.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"))
        bases = counts.select(F.col("p").alias(p), (F.coalesce(F.sum("n").over(before), F.lit(0)) + after + 1).alias(base))
        joined = df.join(F.broadcast(bases), part == quoted(p))
        return joined.withColumn(column, quoted(base) + quoted(raw).bitwiseAND((1 << 33) - 1)).drop(raw, p, base)

    @staticmethod
    def _last_id(df: DataFrame | None) -> int:
        if df is None or ID not in df.columns:
            return 0
        found = df.agg(F.max(F.col(ID).cast("string").try_cast("long"))).first()[0]
        return found or 0

    # CREATE

    def _create(self, clause: A.Create, frame: Frame) -> Frame:
        for path in clause.paths:
            frame = self._create_path(path, frame)
        return frame

    def _create_path(self, path: A.PathPattern, frame: Frame) -> Frame:
        for node in path.nodes:
            if node.name not in frame.symbols:
                frame = self._create_node(node, frame)
        for k, rel in enumerate(path.rels):
            if rel.length is not None:
                raise CypherSemanticError("a relationship of variable length can't be created")
            ends = (path.nodes[k], path.nodes[k + 1]) if rel.direction != "in" else (path.nodes[k + 1], path.nodes[k])
            frame = self._create_rel(rel, *ends, frame)
        return frame

    def _values(self, given: A.Node | None, frame: Frame) -> tuple[Frame, dict]:
        if given is None:
            return frame, {}
        entries = given.entries if isinstance(given, A.MapLiteral) else tuple((k, A.Index(given, A.Literal(k))) for k in self.c.parameters.get(given.name, {}))
        frame, joined = self.c.prepare(frame, *[v for _, v in entries])
        compile_ = self.c.expressions(frame, joined)
        return frame, {k: compile_(v).col for k, v in entries}

    def _create_node(self, node: A.NodePattern, frame: Frame) -> Frame:
        label = node.labels[0] if node.labels else "Node"
        frame, values = self._values(node.properties, frame)
        table = self.c.graph.nodes.get(label)
        columns = {p: prop_column(node.name, p) for p in values}
        df = frame.df.select("*", *[v.alias(columns[p]) for p, v in values.items()])
        df = self._numbered(df, node.name, self._last_id(table))
        key = quoted(node.name)
        if table is not None and isinstance(table.schema[ID].dataType, T.StringType):
            df, key = df.withColumn(node.name, key.cast("string")), quoted(node.name)
        rows = df.select(key.alias(ID), *[quoted(c).alias(p) for p, c in columns.items()])
        self.c.graph = self.c.graph.with_node(label, rows if table is None else union([table, rows]))
        others = [p for p in (self.c.graph.nodes[label].columns) if p not in (ID, *columns)]
        extra = {p: prop_column(node.name, p) for p in others}
        schema = self.c.graph.nodes[label].schema
        df = df.select("*", *[F.lit(None).cast(schema[p].dataType).alias(c) for p, c in extra.items()])
        return Frame(df, frame.symbols | {node.name: Symbol("node", node.name, (label,), columns | extra)})

    def _create_rel(self, rel: A.RelPattern, start: A.NodePattern, end: A.NodePattern, frame: Frame) -> Frame:
        kind = rel.types[0] if rel.types else "REL"
        frame, values = self._values(rel.properties, frame)
        known = self.c.graph.rels.get(kind)
        names = {ID: self.c.fresh("e"), SOURCE: self.c.fresh("e"), TARGET: self.c.fresh("e")}
        columns = {p: prop_column(rel.name, p) for p in values}
        a, b = quoted(frame.symbol(start.name).column), quoted(frame.symbol(end.name).column)
        df = frame.df.select("*", a.alias(names[SOURCE]), b.alias(names[TARGET]), *[v.alias(columns[p]) for p, v in values.items()])
        df = self._numbered(df, names[ID], self._last_id(known.df if known else None))
        rows = df.select(*[quoted(n).alias(c) for c, n in names.items()], *[quoted(c).alias(p) for p, c in columns.items()])
        labels = [s.labels[0] if len(s.labels) == 1 else None for s in (frame.symbol(start.name), frame.symbol(end.name))]
        if known is None:
            new = Relationship(rows, *labels)
        else:
            same = [old if old == now else None for old, now in zip((known.source_label, known.target_label), labels, strict=True)]
            new = Relationship(union([known.df, rows]), *same, known.sound and None not in same)
        self.c.graph = self.c.graph.with_rel(kind, new)
        symbol = Symbol("rel", names[ID], (kind,), columns, None, names[SOURCE], names[TARGET])
        return Frame(df, frame.symbols | {rel.name: symbol})

    # SET and REMOVE

    def _setclause(self, clause: A.SetClause, frame: Frame) -> Frame:
        return self._assign(clause.items, frame)

    def _remove(self, clause: A.Remove, frame: Frame) -> Frame:
        return self._assign(clause.items, frame)

    def _assign(self, items: tuple[A.SetItem, ...], frame: Frame, only: str | None = None) -> Frame:
        """Assignments of one clause; those to one variable change its table once."""
        for target in dict.fromkeys(i.target for i in items if i.kind != "label"):
            symbol = frame.symbol(target)
            if symbol.kind not in ("node", "rel"):
                raise CypherSemanticError(f"{target!r} is no node or relationship")
            values: dict[str, object] = {}
            for item in (i for i in items if i.target == target):
                if item.kind == "label":
                    continue
                frame, joined = self.c.prepare(frame, item.value)
                value = self.c.expressions(frame, joined)(item.value)
                if item.kind == "property":
                    values[item.name] = value
                    continue
                fields = value.type.fieldNames() if isinstance(value.type, T.StructType) else None
                if fields is None:
                    raise CypherSemanticError("the properties to set must be a map of known keys")
                compile_ = self.c.expressions(frame, joined)
                values |= {f: compile_._field(value, f) for f in fields}
            frame = self._write(target, symbol, values, frame, only)
        return frame

    def _write(self, target: str, symbol: Symbol, values: dict, frame: Frame, only: str | None) -> Frame:
        new = {p: self.c.fresh("set") for p in values}
        df = frame.df.select("*", *[v.col.alias(new[p]) for p, v in values.items()])
        if only is not None:
            # a part of the rows: the others keep what they have
            kept = {p: quoted(symbol.props[p]) if p in symbol.props else F.lit(None) for p in values}
            df = df.select("*", *[F.when(quoted(only), quoted(c)).otherwise(kept[p]).alias(c + "x") for p, c in new.items()])
            df = df.drop(*new.values()).withColumnsRenamed({c + "x": c for c in new.values()})
        chosen = df.where(quoted(symbol.column).isNotNull())
        if only is not None:
            chosen = chosen.where(quoted(only))
        for label in symbol.labels:
            here = chosen if symbol.label_column is None else chosen.where(quoted(symbol.label_column) == label)
            rows = here.groupBy(quoted(symbol.column).alias("__key")).agg(*[F.last(quoted(c)).alias(c) for c in new.values()])
            rows = rows.withColumn("__hit", F.lit(True))
            table = self.c.graph.nodes[label] if symbol.kind == "node" else self.c.graph.rels[label].df
            self._replace(symbol, label, self._merged(table, rows, new))
        props = dict(symbol.props)
        for p, c in new.items():
            props[p] = c
        return Frame(df, frame.symbols | {target: replace(symbol, props=props)})

    def _merged(self, table: DataFrame, rows: DataFrame, new: dict[str, str]) -> DataFrame:
        joined = table.join(rows, quoted(ID) == F.col("__key"), "left")
        out = []
        for name in [*table.columns, *(p for p in new if p not in table.columns)]:
            if name not in new:
                out.append(quoted(name))
                continue
            changed = quoted(new[name])
            if name not in table.columns:
                out.append(changed.alias(name))
                continue
            was, now = table.schema[name].dataType, rows.schema[new[name]].dataType
            both_numbers = isinstance(was, T.NumericType) and isinstance(now, T.NumericType)
            old = quoted(name)
            if was != now and not both_numbers and not isinstance(now, T.NullType) and not isinstance(was, T.NullType):
                old, changed = old.cast("string"), changed.cast("string")
            out.append(F.when(F.col("__hit"), changed).otherwise(old).alias(name))
        return joined.select(*out)

    def _replace(self, symbol: Symbol, label: str, df: DataFrame) -> None:
        if symbol.kind == "node":
            self.c.graph = self.c.graph.with_node(label, df)
        else:
            self.c.graph = self.c.graph.with_rel(label, replace(self.c.graph.rels[label], df=df))

    # DELETE

    def _delete(self, clause: A.Delete, frame: Frame) -> Frame:
        for value in clause.values:
            if not isinstance(value, A.Variable):
                raise CypherSemanticError("DELETE needs variables")
            symbol = frame.symbol(value.name)
            if symbol.kind not in ("node", "rel"):
                raise CypherSemanticError(f"{value.name!r} is no node or relationship")
            for label in symbol.labels:
                here = frame.df if symbol.label_column is None else frame.df.where(quoted(symbol.label_column) == label)
                gone = _cut(here.select(quoted(symbol.column).alias("__key")).distinct())
                table = self.c.graph.nodes[label] if symbol.kind == "node" else self.c.graph.rels[label].df
                if symbol.kind == "node" and clause.detach:
                    self._detach(label, gone)
                elif symbol.kind == "node":  # edges may be left without an end
                    for kind, rel in self.c.graph.rels.items():
                        if rel.sound and label in (rel.source_label, rel.target_label):
                            self.c.graph = self.c.graph.with_rel(kind, replace(rel, sound=False))
                self._replace(symbol, label, table.join(gone, quoted(ID) == F.col("__key"), "left_anti"))
        return frame

    def _detach(self, label: str, gone: DataFrame) -> None:
        for kind, rel in self.c.graph.rels.items():
            df = rel.df
            for side, known in ((SOURCE, rel.source_label), (TARGET, rel.target_label)):
                if known in (None, label):
                    df = df.join(gone, quoted(side) == F.col("__key"), "left_anti")
            self.c.graph = self.c.graph.with_rel(kind, replace(rel, df=df))

    # MERGE

    def _merge(self, clause: A.Merge, frame: Frame) -> Frame:
        """For each distinct binding of what the pattern reads: its matches, or else a created one."""
        pattern = clause.path
        names = {n.name for n in A.walk(pattern) if isinstance(n, (A.Variable, A.NodePattern, A.RelPattern))}
        keys = list(dict.fromkeys(c for n, s in frame.symbols.items() if n in names for c in s.columns()))
        outer = {n: s for n, s in frame.symbols.items() if n in names}
        if keys:
            base = Frame(_cut(frame.df.select(*[quoted(k) for k in keys]).distinct()), outer)
        else:
            base = Frame(self.c.spark.range(1).select(), {})
        used, self.c.used = self.c.used, None
        try:
            matched = self.c._match(A.Match((pattern,)), base if base.symbols else None)
        finally:
            self.c.used = used
        hit, flag = matched.df, self.c.fresh("created")
        if keys:
            on = {k: self.c.fresh("k") for k in keys}
            there = hit.select(*[quoted(k).alias(n) for k, n in on.items()]).distinct()
            missing = base.df.join(there, reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(quoted(n)) for k, n in on.items()]), "left_anti")
        else:
            missing = base.df if hit.isEmpty() else base.df.limit(0)
        # values that the pattern reads decide which created rows are the same
        missing, unique, same = self._once(pattern, Frame(missing, base.symbols))
        made = self._create_path(pattern, Frame(unique, base.symbols))
        new = [n for n in made.symbols if n not in frame.symbols and not (n not in matched.symbols)]
        columns = list(dict.fromkeys(c for n in new for c in matched.symbols[n].columns()))
        pairs = {}
        for n in new:
            a, b = matched.symbols[n], made.symbols[n]
            pairs[a.column] = quoted(b.column)
            pairs |= {c: quoted(b.props[p]) if p in b.props else F.lit(None) for p, c in a.props.items()}
            if a.label_column:
                pairs[a.label_column] = F.lit(b.labels[0])
            if a.source:
                pairs |= {a.source: quoted(b.source), a.target: quoted(b.target)}
        left = hit.select(*[quoted(k) for k in keys], *[quoted(c) for c in columns], F.lit(False).alias(flag))
        others = {c: self.c.fresh("k") for c in same}
        created = made.df.select(*[quoted(c).alias(n) for c, n in others.items()], *[pairs[c].alias(c) for c in columns])
        on = [quoted(c).eqNullSafe(quoted(n)) for c, n in others.items()]
        right = missing.join(created, on or F.lit(True)).select(*[quoted(k) for k in keys], *[quoted(c) for c in columns], F.lit(True).alias(flag))
        both = _cut(left.unionByName(right))
        renamed = {k: self.c.fresh("k") for k in keys}
        both = both.withColumnsRenamed(renamed)
        on = [quoted(k).eqNullSafe(quoted(n)) for k, n in renamed.items()]
        df = frame.df.join(both, on or F.lit(True)).drop(*renamed.values())
        symbols = {n: matched.symbols[n] if not matched.symbols[n].kind == "node" or matched.symbols[n].labels else replace(matched.symbols[n], labels=made.symbols[n].labels) for n in new}
        symbols = {n: replace(s, labels=made.symbols[n].labels if len(s.labels) == 0 or n not in matched.symbols else s.labels) for n, s in symbols.items()}
        out = Frame(df, frame.symbols | symbols)
        if clause.on_create:
            out = self._assign(clause.on_create, out, flag)
        if clause.on_match:
            negated = self.c.fresh("matched")
            out = out.with_df(out.df.withColumn(negated, ~quoted(flag)))
            out = self._assign(clause.on_match, out, negated)
        return out

    def _once(self, pattern: A.PathPattern, frame: Frame) -> tuple[DataFrame, DataFrame, list[str]]:
        """The rows, one row for each thing that would be created, and the columns that tell these apart."""
        values = []
        for p in (*pattern.nodes, *pattern.rels):
            if isinstance(p.properties, A.MapLiteral):
                values += [v for _, v in p.properties.entries if not isinstance(v, (A.Literal, A.Parameter))]
        compile_ = self.c.expressions(frame)
        keys = {self.c.fresh("once"): compile_(v).col for v in values}
        df = frame.df.select("*", *[c.alias(k) for k, c in keys.items()])
        same = [*keys, *dict.fromkeys(frame.symbols[n.name].column for n in pattern.nodes if n.name in frame.symbols)]
        return df, df.dropDuplicates(same) if same else df, same

    # FOREACH

    def _foreach(self, clause: A.Foreach, frame: Frame) -> Frame:
        inner = self.c._unwind(A.Unwind(clause.source, clause.name), frame)
        for update in clause.updates:
            inner = self.apply(update, inner)
        return frame
