"""Sources by address: files, SQL databases and tables in memory."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.errors import CypherSemanticError
from trellis.plans.scope import quoted
from trellis.sources.normalise import from_any

_DATABASES = ("postgresql", "mysql", "sqlite", "duckdb")
_SELECT = re.compile(r"\s*(?:--[^\n]*\n\s*)*(SELECT|WITH)\b", re.I)


def check_select(query: str) -> str:
    """Only a single SELECT, or WITH ... SELECT, reaches the engine."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", query)
    if not _SELECT.match(bare) or ";" in bare.rstrip().rstrip(";"):
        raise CypherSemanticError("a source's query must be one SELECT")
    if re.search(r"\b(INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|TRUNCATE|MERGE|COPY|ATTACH|CALL|SET)\b", bare, re.I):
        raise CypherSemanticError("a source's query may only read")
    return query.rstrip().rstrip(";")


@dataclass
class FileSource:
    """CSV, Parquet, JSON (lines, or with the option ``records`` an array) or ORC files; ``query`` is SQL over the view
    ``source``, ``schema_hints`` are casts."""

    uri: str
    format: str
    query: str | None = None
    schema_hints: dict[str, str] = field(default_factory=dict)
    options: dict[str, Any] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        defaults = {"csv": {"header": True, "inferSchema": True}}.get(self.format, {})
        options = defaults | self.options
        if options.pop("records", False):  # one JSON array, or records over several lines
            options["multiLine"] = True
        df = spark.read.format(self.format).options(**options).load(self.uri)
        if self.query:
            df = spark.sql(re.sub(r"\bsource\b", "{source}", check_select(self.query)), source=df)
        return df.withColumns({c: quoted(c).try_cast(t) for c, t in self.schema_hints.items() if c in df.columns})


@dataclass
class SqlSource:
    """A database over JDBC; needs a query."""

    uri: str
    query: str

    def read(self, spark: SparkSession) -> DataFrame:
        url = self.uri if self.uri.startswith("jdbc:") else f"jdbc:{self.uri}"
        return spark.read.format("jdbc").option("url", url).option("query", check_select(self.query)).load()


@dataclass
class MemorySource:
    data: Any

    def read(self, spark: SparkSession) -> DataFrame:
        return from_any(spark, self.data)


def source_from_uri(uri: Any, query: str | None = None, schema_hints: dict[str, str] | None = None, **options: Any):
    """A source by scheme or file ending; anything that is no text is data itself."""
    if not isinstance(uri, str):
        return MemorySource(uri)
    scheme = urlparse(uri).scheme.split("+")[0]
    if scheme == "jdbc" or scheme in _DATABASES:
        if not query:
            raise CypherSemanticError("a database source needs a query")
        return SqlSource(uri, query)
    ending = re.sub(r"(\.gz|\.bz2|\.zst)$", "", urlparse(uri).path.rstrip("/*").lower()).rpartition(".")[2]
    formats = {"csv": "csv", "tsv": "csv", "parquet": "parquet", "json": "json", "jsonl": "json", "ndjson": "json", "orc": "orc"}
    if ending not in formats:
        raise CypherSemanticError(f"no source is known for {uri!r}")
    if ending == "tsv":
        options = {"sep": "\t"} | options
    return FileSource(uri, formats[ending], query, schema_hints or {}, options)


def column_stats(df: DataFrame) -> DataFrame:
    """A row for each column: rows, nulls, distinct values (approximate), least and greatest as text; one pass."""
    parts = []
    for c in df.columns:
        x = quoted(c)
        parts.append(F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(x.isNull()).alias("nulls"), F.approx_count_distinct(x).alias("distinct"), F.min(x.cast("string")).alias("least"), F.max(x.cast("string")).alias("greatest")))
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def sample(df: DataFrame, n: int, strategy: str = "head") -> DataFrame:
    """``n`` rows: head, tail or random."""
    if strategy == "head":
        return df.limit(n)
    if strategy == "tail":
        return df.withColumn("__at", F.monotonically_increasing_id()).orderBy(F.desc("__at")).limit(n).orderBy("__at").drop("__at")
    if strategy == "random":
        return df.orderBy(F.rand()).limit(n)
    raise CypherSemanticError(f"there is no sampling strategy {strategy!r}")
