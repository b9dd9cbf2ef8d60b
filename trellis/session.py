"""The user's entry: a session over a Spark session and a graph of tables."""

from __future__ import annotations

import functools
import inspect
import logging
import re
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.analytics import QueryLog
from trellis.catalog import Graph, Relationship, properties
from trellis.errors import CypherSemanticError
from trellis.functions.typed import Typed, make
from trellis.operators.paths import _cut
from trellis.plans import ast as A
from trellis.plans.compiler import Compiler
from trellis.plans.limits import Limits
from trellis.plans.parser import parse
from trellis.plans.scope import ID, SOURCE, TARGET, quoted
from trellis.plans.validation import Finding, validate
from trellis.sources.normalise import as_entity, as_relationship, from_any

_PYTHON_TYPES = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType()}
#: Functions whose value differs from call to call: such queries are not cached.
_VOLATILE = {"rand", "randomuuid", "timestamp", "now", "date", "datetime", "localdatetime", "localtime", "localdate"}


class GraphSession:
    """Registers tables as labels and relationship types, and runs queries on them."""

    def __init__(self, spark: SparkSession, checkpoint_every: int = 20, limits: Limits | None = None):
        self.spark, self.graph, self.limits = spark, Graph(), limits
        self.checkpoint_every, self._writes = checkpoint_every, 0
        self.udfs: dict[str, Callable[..., Typed]] = {}
        self.procedures: dict[str, Callable] = {
            "db.labels": lambda c: self._table("label", sorted(c.graph.nodes)),
            "db.relationshiptypes": lambda c: self._table("relationshipType", sorted(c.graph.rels)),
            "db.propertykeys": lambda c: self._table(
                "propertyKey", sorted({p for t in [*c.graph.nodes.values(), *(r.df for r in c.graph.rels.values())] for p in properties(t)})
            ),
        }
        self._cache: ResultCache | None = None
        self._saved: list[tuple[str | None, Graph]] = []
        self.log = QueryLog()

    def _table(self, name: str, values: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(v,) for v in values], f"{name} string")

    # catalog

    def add_entity(self, label: str, data: Any, id_col: str | None = None, unique: bool = False) -> GraphSession:
        """``data``: DataFrame, pandas frame, Arrow table or list of dicts; ``unique`` tells that ids don't repeat."""
        self.graph = self.graph.with_node(label, as_entity(from_any(self.spark, data), id_col, unique))
        return self

    def add_relationship(
        self, kind: str, data: Any, source_col: str | None = None, target_col: str | None = None, source_label: str | None = None,
        target_label: str | None = None, id_col: str | None = None, multi_edges: bool = True, sound: bool = False,
        unique: str | None = None,
    ) -> GraphSession:
        """``sound`` tells that every end is a row of its label's table: a foreign key that holds; ``unique`` the end ("source" or "target") of which a node has one edge at most."""
        df = as_relationship(from_any(self.spark, data), source_col, target_col, id_col, multi_edges)
        self.graph = self.graph.with_rel(kind, Relationship(df, source_label, target_label, sound and source_label is not None and target_label is not None, unique))
        return self

    def entity(self, label: str) -> DataFrame:
        return self.graph.nodes[label]

    def relationship(self, kind: str) -> DataFrame:
        return self.graph.rels[kind].df

    # functions and procedures

    def register_function(self, name: str, fn: Callable, return_type: T.DataType | str | None = None, vectorised: bool = False) -> None:
        """A user's function: null for null arguments and where it raises (logged once in a worker); ``vectorised`` ones get pandas series."""
        hints = {k: v for k, v in inspect.get_annotations(fn, eval_str=True).items() if k == "return"}
        kind = return_type or _PYTHON_TYPES.get(hints.get("return"), T.StringType())
        if vectorised:
            udf = F.pandas_udf(fn, kind)
        else:

            seen: list[bool] = []

            @functools.wraps(fn)
            def safe(*args):
                if any(a is None for a in args):
                    return None
                try:
                    return fn(*args)
                except Exception:
                    if not seen:  # once in a worker: a wrong function looks like missing data otherwise
                        seen.append(True)
                        logging.getLogger("trellis").warning("the function %s raised an error and gave null", name, exc_info=True)
                    return None

            udf = F.udf(safe, kind, useArrow=True)
        self.udfs[name.lower()] = lambda *args: make(udf, *args)

    def cypher_function(self, fn: Callable) -> Callable:
        """Decorator form of register_function."""
        self.register_function(fn.__name__, fn)
        return fn

    def register_procedure(self, name: str, fn: Callable, schema: T.StructType | str | None = None) -> None:
        """``fn(session, *args)`` gives a DataFrame or a list of dicts."""

        def run(compiler: Compiler, *args):
            rows = fn(self, *args)
            return rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, schema)

        self.procedures[name.lower()] = run

    def enable_cache(self, entries: int = 64, seconds: float | None = None) -> ResultCache:
        """Results of read-only queries are kept until the graph changes: the ``entries`` used last, for ``seconds`` at most."""
        self._cache = ResultCache(entries, seconds)
        return self._cache

    # transactions: the graph is immutable, so a state is kept by its name

    def begin(self, savepoint: str | None = None) -> None:
        """Remember the present state, as a savepoint if named."""
        self._saved.append((savepoint, self.graph))

    def commit(self) -> None:
        """Keep what was done since the last ``begin`` without a name; its savepoints are forgotten."""
        self._back(None)

    def rollback(self, savepoint: str | None = None) -> None:
        """Return to the last ``begin``, or to the named savepoint, which stays."""
        graph = self._back(savepoint)
        if savepoint is not None:
            self._saved.append((savepoint, graph))
        self._set(graph)

    def _back(self, savepoint: str | None) -> Graph:
        while self._saved:
            name, graph = self._saved.pop()
            if name == savepoint:
                return graph
        raise CypherSemanticError(f"there is no savepoint {savepoint!r}" if savepoint else "no transaction has begun")

    @contextmanager
    def transaction(self) -> Iterator[GraphSession]:
        """All updates within take effect, or none if an error leaves the block."""
        self.begin()
        try:
            yield self
        except BaseException:
            self.rollback()
            raise
        self.commit()

    # queries

    def validate(self, query: str) -> list[Finding]:
        """What is wrong or doubtful in a query, before it runs."""
        return validate(query, self.graph, self.udfs, self.procedures)

    def cypher(self, query: str, parameters: dict[str, Any] | None = None, **more: Any) -> DataFrame:
        """Run a query; its updates take effect if all of it compiles.

        ``EXPLAIN query`` gives the lines of its plan and changes nothing; ``PROFILE query`` runs it, updates included,
        and gives (phase, seconds, rows).
        """
        word = re.match(r"\s*(EXPLAIN|PROFILE)\b", query, re.I)
        given = {**(parameters or {}), **more}
        if word is None:
            return self._timed(query, given)
        rest = query[word.end() :]
        if word[1].upper() == "EXPLAIN":
            lines = self.explain(rest, given).splitlines()
            return self.spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "line int, plan string")
        return self.spark.createDataFrame(self.profile(rest, given), "phase string, seconds double, rows long")

    def _timed(self, query: str, given: dict[str, Any]) -> DataFrame:
        if self.limits is not None:
            self.limits.check(query)
        began = time.perf_counter()
        try:
            out = self._run(query, given)
        except Exception:
            self.log.add(query, time.perf_counter() - began, True)
            raise
        self.log.add(query, time.perf_counter() - began)
        return out

    def profile(self, query: str, parameters: dict[str, Any] | None = None) -> list[tuple[str, float, int | None]]:
        """(phase, seconds, rows) of parsing, compiling, planning and running; rows are those of the result."""
        clock = [time.perf_counter()]
        parse.__wrapped__(query)
        clock.append(time.perf_counter())
        df = self._run(query, parameters or {})
        clock.append(time.perf_counter())
        df._jdf.queryExecution().executedPlan()
        clock.append(time.perf_counter())
        rows = df.count()
        clock.append(time.perf_counter())
        spent = [b - a for a, b in zip(clock, clock[1:], strict=False)]
        self.log.add(query, clock[-1] - clock[0])
        return [(phase, s, rows if phase == "run" else None) for phase, s in zip(("parse", "compile", "plan", "run"), spent, strict=True)]

    def _run(self, query: str, given: dict[str, Any]) -> DataFrame:
        tree = parse(query)
        key = (tree, repr(sorted(given.items())))
        reading = not any(isinstance(n, A.UPDATES) for n in A.walk(tree.statements))
        steady = not any(isinstance(n, A.Call) and n.name.lower() in _VOLATILE for n in A.walk(tree.statements))
        if self._cache is not None and reading and steady and (kept := self._cache.get(key)) is not None:
            return kept
        own = {n.name.lower() for n in A.walk(tree.statements) if isinstance(n, (A.Call, A.CallProcedure))} & (self.udfs.keys() | self.procedures.keys())
        if reading and steady and not own and (plan := self.graph.plan(key)) is not None:
            return plan if self._cache is None else self._cache.put(key, plan)
        graph, frames = self.graph, []
        for statement in tree.statements:
            compiler = Compiler(self.spark, graph, given, self.udfs, self.procedures)
            frames.append(compiler.run(statement))
            graph = compiler.graph
        out = self._result(tree, frames)
        if graph is not self.graph:
            self._commit(graph)
            return out
        if reading and steady and not own:
            graph.keep_plan(key, out)
        if self._cache is not None and reading and steady:
            out = self._cache.put(key, out)
        return out

    def _result(self, tree: A.Query, frames: list) -> DataFrame:
        parts = []
        for statement, frame in zip(tree.statements, frames, strict=True):
            last = statement[-1]
            if isinstance(last, A.Projection) and last.final:
                parts.append(frame.df)
            elif isinstance(last, A.CallProcedure) and len(statement) == 1:
                parts.append(frame.df.select(*[quoted(s.column).alias(n) for n, s in frame.symbols.items()]))
            else:
                parts.append(self.spark.range(0).select())
        if len(parts) == 1:
            return parts[0]
        columns = [set(p.columns) for p in parts]
        if any(c != columns[0] for c in columns):
            raise CypherSemanticError("the parts of a UNION return different columns")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out if tree.all else out.distinct()

    def _commit(self, graph: Graph) -> None:
        """Swap the graph; long chains of updates are cut by written tables."""
        self._writes += 1
        if self._writes % self.checkpoint_every == 0:
            for label, df in graph.nodes.items():
                if self.graph.nodes.get(label) is not df:
                    graph = graph.with_node(label, _cut(df))
        self._set(graph)

    def _set(self, graph: Graph) -> None:
        self.graph = graph
        if self._cache is not None:
            self._cache.clear()

    def explain(self, query: str, parameters: dict[str, Any] | None = None, mode: str = "formatted") -> str:
        """Spark's plan of a query; its updates don't take effect."""
        before = self.graph
        try:
            df = self._run(query, parameters or {})
        finally:
            self.graph = before
        return self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def run_all(self, queries: list[str]) -> list[DataFrame]:
        """Dependent queries in the order that their labels and properties require."""
        from trellis.plans.dependencies import ordered

        with self.transaction():
            return [self.cypher(q) for q in ordered(queries)]

    def compose(self, queries: list[str], parameters: dict[str, Any] | None = None) -> DataFrame:
        """Dependent queries as one: in the order that they require, all or none; the result of the last that returns rows.

        Every query reads the tables that those before it made, so what comes back is one lazy plan over all of them.
        """
        from trellis.plans.dependencies import ordered

        out = None
        with self.transaction():
            for q in ordered(list(dict.fromkeys(queries))):
                df = self.cypher(q, parameters)
                out = df if df.columns or out is None else out
        return out


class ResultCache:
    """Cached results: the ``entries`` used last, each for ``seconds`` at most."""

    def __init__(self, entries: int, seconds: float | None):
        self.entries, self.seconds = entries, seconds
        self.hits = self.misses = self.evictions = 0
        self._kept: OrderedDict[tuple, tuple[float, DataFrame]] = OrderedDict()

    def get(self, key: tuple) -> DataFrame | None:
        if key in self._kept:
            at, df = self._kept[key]
            if self.seconds is None or time.monotonic() - at <= self.seconds:
                self._kept.move_to_end(key)
                self.hits += 1
                return df
            self._drop(key)
        self.misses += 1
        return None

    def put(self, key: tuple, df: DataFrame) -> DataFrame:
        self._kept[key] = (time.monotonic(), df.cache())
        while len(self._kept) > self.entries:
            self._drop(next(iter(self._kept)))
        return self._kept[key][1] if key in self._kept else df

    def _drop(self, key: tuple) -> None:
        self._kept.pop(key)[1].unpersist()
        self.evictions += 1

    def clear(self) -> None:
        for _, df in self._kept.values():
            df.unpersist()
        self._kept.clear()


class GraphBuilder:
    """Fluent construction of a session."""

    def __init__(self, spark: SparkSession):
        self._session = GraphSession(spark)

    def add_entity(self, label: str, data: Any, **options: Any) -> GraphBuilder:
        self._session.add_entity(label, data, **options)
        return self

    def add_relationship(self, kind: str, data: Any, **options: Any) -> GraphBuilder:
        self._session.add_relationship(kind, data, **options)
        return self

    @classmethod
    def from_dict(cls, spark: SparkSession, entities: dict[str, Any], relationships: dict[str, Any] | None = None) -> GraphSession:
        builder = cls(spark)
        for label, data in entities.items():
            builder.add_entity(label, data)
        for kind, data in (relationships or {}).items():
            builder.add_relationship(kind, data)
        return builder.build()

    def build(self) -> GraphSession:
        return self._session


__all__ = ["ID", "SOURCE", "TARGET", "GraphBuilder", "GraphSession"]
