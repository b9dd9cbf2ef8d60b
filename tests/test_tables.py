"""Sources, sinks, frames, edges, schemas and pipelines."""

import pytest
from pyspark.sql import types as T

from trellis.errors import CypherSemanticError
from trellis.operators import edges, frames, schemas
from trellis.sources import pipeline, readers, sinks


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "Alice", 1.5), (2, "Bob", None)], "id int, name string, value double")
    for ending in ("csv", "parquet", "json", "orc"):
        sinks.write(df, f"{tmp_path}/t.{ending}")
        back = readers.source_from_uri(f"{tmp_path}/t.{ending}", schema_hints={"id": "int"}).read(spark)
        assert sorted((r.id, r.name, r.value) for r in back.collect()) == [(1, "Alice", 1.5), (2, "Bob", None)]
    with pytest.raises(CypherSemanticError):
        readers.source_from_uri(f"{tmp_path}/t.parquet", "DROP TABLE source").read(spark)
    with pytest.raises(CypherSemanticError):
        readers.source_from_uri("x.unknown")
    assert readers.column_stats(df).where("column = 'value'").first().nulls == 1
    assert [r.id for r in readers.sample(df.coalesce(1), 1, "tail").collect()] == [2]


def test_pipeline(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (1, "again")], "pid int, name string").coalesce(1).write.parquet(f"{tmp_path}/p.parquet")
    spark.createDataFrame([(1, 2)], "x int, y int").write.parquet(f"{tmp_path}/k.parquet")
    config = {
        "sources": {
            "entities": [{"entity_type": "P", "uri": f"{tmp_path}/p.parquet", "id_col": "pid"}, {"entity_type": "Q", "uri": f"{tmp_path}/none.parquet", "on_error": "skip"}],
            "relationships": [{"relationship_type": "K", "uri": f"{tmp_path}/k.parquet", "source_col": "x", "target_col": "y"}],
        },
        "queries": [{"id": "out", "inline": "MATCH (p:P) RETURN p.name AS n, p.k AS k"}, {"id": "set", "inline": "MATCH (a:P)-[:K]->(b) WITH a, count(b) AS k SET a.k = k"}],
        "output": [{"query_id": "out", "uri": f"{tmp_path}/out.parquet"}],
    }
    pipeline.run(spark, config)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out.parquet").collect()), key=str) == [("a", 1), ("b", None)]


def test_frames_and_edges(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert frames.join(a, a.withColumnRenamed("v", "w"), ["k"], strategy="broadcast").count() == 2
    assert frames.join(a, a.where("k = 1"), ["k"], "anti").count() == 1
    assert frames.join_many([a.select("k")] * 3, "k").count() == 2 and frames.concat([a, a.select("k")]).count() == 4
    assert [r.k for r in frames.sort(a, ["k"], False).collect()] == [2, 1] and frames.memory_estimate_bytes(a) > 0
    rows = spark.createDataFrame([("01001020100", "1.0", "7"), ("99", None, "8")], "g string, s string, p string")
    assert [r["__TARGET__"] for r in edges.by_prefix(rows, "g", 5, spark.createDataFrame([("01001",)], "i string"), "i").collect()] == ["01001"]
    assert [r["__TARGET__"] for r in edges.by_composite(rows, "g", {"s": 2, "p": 5}).collect()] == ["0100007"]


def test_schemas_and_lineage():
    s = lambda **k: T.StructType([T.StructField(n, t) for n, t in k.items()])
    r = schemas.SchemaRegistry("backward")
    assert r.register("t", s(a=T.IntegerType())) == 1 and r.register("t", s(a=T.LongType(), b=T.StringType())) == 2
    with pytest.raises(CypherSemanticError):
        r.register("t", s(a=T.StringType()))
    assert r.diff("t", 1, 2) == {"added": ["b"], "removed": [], "changed": ["a"]} and r.rollback("t", 1) == 3
    assert schemas.merge(s(a=T.IntegerType()), s(a=T.DoubleType(), b=T.DateType()))["a"].dataType == T.DoubleType()
    lineage = schemas.Lineage()
    lineage.add("b", "a")
    lineage.add("c", "b")
    assert lineage.provenance("c") == {"a", "b"} and lineage.impact("a") == {"b", "c"} and lineage.order().index("a") == 0
    with pytest.raises(CypherSemanticError):
        lineage.add("a", "c")
