"""Sinks: files by ending, and batches for a graph database."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from trellis.errors import CypherSemanticError


def write(df: DataFrame, uri: str, mode: str = "overwrite", partition_by: list[str] = ()) -> None:
    """CSV, Parquet, JSON lines or ORC by the ending; a folder of part files, in any store that Spark reaches."""
    ending = uri.rstrip("/").rpartition(".")[2].lower()
    formats = {"csv": "csv", "parquet": "parquet", "json": "json", "jsonl": "json", "ndjson": "json", "orc": "orc"}
    if ending not in formats:
        raise CypherSemanticError(f"no sink is known for {uri!r}")
    writer = df.write.mode(mode).format(formats[ending])
    if ending == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(uri)


def node_statement(label: str, key: str) -> str:
    return f"UNWIND $rows AS row MERGE (n:`{label}` {{`{key}`: row.`{key}`}}) SET n += row"


def relationship_statement(kind: str, source: tuple[str, str], target: tuple[str, str]) -> str:
    """(label, key) of both ends; rows carry ``source``, ``target`` and ``props``."""
    return f"UNWIND $rows AS row MATCH (a:`{source[0]}` {{`{source[1]}`: row.source}}) MATCH (b:`{target[0]}` {{`{target[1]}`: row.target}}) MERGE (a)-[r:`{kind}`]->(b) SET r += row.props"


def write_graph(df: DataFrame, statement: str, connect: Callable[[], Callable[[str, dict], None]], batch_rows: int = 1000) -> None:
    """Send rows in batches from the executors; ``connect`` runs there and gives a function (statement, parameters)."""

    def send(rows):
        run, batch = connect(), []
        for row in rows:
            batch.append(row.asDict(recursive=True))
            if len(batch) == batch_rows:
                run(statement, {"rows": batch})
                batch = []
        if batch:
            run(statement, {"rows": batch})

    df.foreachPartition(send)
