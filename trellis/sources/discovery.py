"""Graphs from what lies in a folder, and star schemas."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.plans.scope import ID, quoted
from trellis.session import GraphSession
from trellis.sources.normalise import from_any
from trellis.sources.readers import source_from_uri


def files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Tables of a folder by name: files or folders whose ending a source knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    out = {}
    for uri in sorted(s.getPath().toString() for s in found):
        name, dot, ending = uri.rpartition("/")[2].partition(".")
        if dot and ending.split(".")[0] in ("csv", "tsv", "parquet", "json", "jsonl", "ndjson", "orc"):
            out[name] = uri
    return out


def discover(spark: SparkSession, folder: str, entities: dict[str, tuple[str, str]], relationships: dict[str, tuple[str, str, str, str, str]] | None = None) -> GraphSession:
    """A graph of those tables that are there.

    ``entities``: {label: (table, id column)}; ``relationships``: {type: (table, source column, target column, source
    label, target label)}.  Of a table that is missing, label and types are left out.
    """
    known, s = files(spark, folder), GraphSession(spark)
    read = {t: source_from_uri(uri).read(spark) for t, uri in known.items() if t in {v[0] for v in [*entities.values(), *(relationships or {}).values()]}}
    for label, (table, key) in entities.items():
        if table in read:
            s.add_entity(label, read[table].withColumn("__key", quoted(key)), id_col="__key", unique=True)
    for kind, (table, a, b, source, target) in (relationships or {}).items():
        if table in read and {source, target} <= s.graph.nodes.keys():
            s.add_relationship(kind, read[table].select(quoted(a).alias("a"), quoted(b).alias("b")).dropna(), "a", "b", source, target)
    return s


class GraphPipeline:
    """Entities and relationships from frames, records and views, gathered into a session."""

    def __init__(self, spark: SparkSession):
        self.spark, self._session = spark, GraphSession(spark)

    def entity(self, label: str, data: Any, id_col: str | None = None) -> GraphPipeline:
        """``data``: DataFrame, pandas frame, Arrow table, records, or an incremental view (its present state)."""
        if hasattr(data, "as_entity"):
            data.as_entity(self._session, label)
        else:
            self._session.add_entity(label, data, id_col=id_col)
        return self

    def relationship(self, kind: str, data: Any, source: tuple[str, str], target: tuple[str, str]) -> GraphPipeline:
        """``source``, ``target``: (label, column)."""
        self._session.add_relationship(kind, data, source[1], target[1], source[0], target[0])
        return self

    def star(self, label: str, facts: Any, id_col: str, dimensions: dict[str, tuple[Any, str, str]]) -> GraphPipeline:
        """A table of facts and its dimensions: {label: (table, its key, the facts' column)}; edges are ``HAS_<LABEL>``."""
        df = from_any(self.spark, facts)
        self.entity(label, df.withColumn("__key", quoted(id_col)), "__key")
        for name, (table, key, column) in dimensions.items():
            known = from_any(self.spark, table)
            self.entity(name, known.withColumn("__key", quoted(key)), "__key")
            edges = df.select(quoted(id_col).alias("a"), quoted(column).alias("b")).dropna().join(known.select(quoted(key).alias("b")).distinct(), "b", "left_semi")
            self.relationship(f"HAS_{name.upper()}", edges.select(F.xxhash64("a", "b").alias(ID), "a", "b"), (label, "a"), (name, "b"))
        return self

    def build(self) -> GraphSession:
        return self._session


def describe(session: GraphSession) -> DataFrame:
    """(kind, name, property, type) of every property of the graph."""
    rows = [("label", n, f.name, f.dataType.simpleString()) for n, t in session.graph.nodes.items() for f in t.schema if not f.name.startswith("__")]
    rows += [("relationship", n, f.name, f.dataType.simpleString()) for n, r in session.graph.rels.items() for f in r.df.schema if not f.name.startswith("__")]
    return session.spark.createDataFrame(rows, "kind string, name string, property string, type string")
