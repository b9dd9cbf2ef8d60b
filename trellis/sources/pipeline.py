"""Pipelines from a configuration: sources, functions, queries and outputs."""

from __future__ import annotations

import importlib
import logging
import os
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from trellis.errors import CypherSemanticError
from trellis.plans.dependencies import ordered
from trellis.session import GraphSession
from trellis.sources.readers import source_from_uri
from trellis.sources.sinks import write

_LOG = logging.getLogger(__name__)
#: Modules from which a configuration may take functions, besides those that it is run with (``allowed``).
ALLOWED = {"math", "statistics", "string", "textwrap", "unicodedata", "colorsys"}


def substituted(value: Any) -> Any:
    """``${NAME}`` in texts becomes the environment's value."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: os.environ[m[1]], value)
    if isinstance(value, dict):
        return {k: substituted(v) for k, v in value.items()}
    return [substituted(v) for v in value] if isinstance(value, list) else value


def load(path: str) -> dict:
    """YAML where the library for it is there, else JSON."""
    with open(path) as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        import json

        return substituted(json.loads(text))
    return substituted(yaml.safe_load(text))


def _source(spark: SparkSession, spec: dict, add) -> None:
    policy = spec.get("on_error", "fail")
    try:
        add(source_from_uri(spec["uri"], spec.get("query"), spec.get("schema_hints"), **spec.get("options", {})).read(spark))
    except Exception:
        if policy == "fail":
            raise
        if policy == "warn":
            _LOG.warning("source %s was left out", spec.get("id", spec["uri"]), exc_info=True)


def run(spark: SparkSession, config: dict, allowed: set[str] = frozenset()) -> dict[str, DataFrame]:
    """Load the sources, register functions, run the queries in their order and write the outputs.

    ``allowed``: modules of the caller's from which the configuration may take functions.
    """
    session = GraphSession(spark)
    sources = config.get("sources", {})
    for spec in sources.get("entities", []):
        _source(spark, spec, lambda df, s=spec: session.add_entity(s["entity_type"], df, id_col=s.get("id_col")))
    for spec in sources.get("relationships", []):
        _source(spark, spec, lambda df, s=spec: session.add_relationship(s["relationship_type"], df, s["source_col"], s["target_col"], s.get("source_label"), s.get("target_label"), s.get("id_col")))
    for spec in config.get("functions", []):
        module = spec["module"]
        if module not in ALLOWED | set(allowed):
            raise CypherSemanticError(f"functions can't come from {module!r}")
        found = importlib.import_module(module)
        for name in spec["names"]:
            session.register_function(name, getattr(found, name))
    queries = config.get("queries", [])
    if len({q["id"] for q in queries}) < len(queries):
        raise CypherSemanticError("two queries have the same id")
    results = {}
    for text in ordered(list(dict.fromkeys(q["inline"] for q in queries))):
        for q in queries:  # queries of equal texts are run each
            if q["inline"] == text:
                results[q["id"]] = session.cypher(text)
    for spec in config.get("output", []):
        write(results[spec["query_id"]], spec["uri"], spec.get("mode", "overwrite"))
    return results
