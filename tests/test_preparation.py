"""Archives, shapes, the log of queries and configured pipelines."""

import struct
import zipfile

import pytest

from trellis import analytics
from trellis.errors import CypherSemanticError
from trellis.sources import pipeline, preparation


def test_members_of_zip_archives(spark, tmp_path):
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            z.writestr("a.csv", f"id,name\n{k},first\n{k + 10},é\n")
            z.writestr("readme.txt", "id,name\n")
    out = preparation.zipped_csv(spark, f"{tmp_path}/*.zip", "id int, name string")
    assert sorted(map(tuple, out.collect())) == [(0, "first"), (1, "first"), (10, "é"), (11, "é")]


def shapefile(folder, name, shapes, names):
    body = b""
    for k, parts in enumerate(shapes):
        flat = [c for part in parts for p in part for c in p]
        begins = [sum(map(len, parts[:i])) for i in range(len(parts))]
        record = struct.pack("<i4d2i", 5, 0, 0, 1, 1, len(parts), len(flat) // 2) + struct.pack(f"<{len(begins)}i", *begins) + struct.pack(f"<{len(flat)}d", *flat)
        body += struct.pack(">2i", k + 1, len(record) // 2) + record
    body += struct.pack(">2i", len(shapes) + 1, 2) + struct.pack("<i", 0)  # a null shape
    (folder / f"{name}.shp").write_bytes(bytes(100) + body)
    field = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([8, 0]) + bytes(14)
    rows = b"".join(b" " + n.encode().ljust(8) for n in names)
    (folder / f"{name}.dbf").write_bytes(struct.pack("<4Bihh", 3, 0, 0, 0, len(names), 32 + 32 + 1, 9) + bytes(20) + field + b"\r" + rows)


def test_shapefiles_are_read_and_joined_with_points(spark, tmp_path):
    square = lambda x: [[(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0), (x, 0.0)]]
    shapefile(tmp_path, "one", [square(0.0), [*square(5.0), [(5.2, 0.2), (5.2, 0.8), (5.8, 0.8), (5.8, 0.2), (5.2, 0.2)]]], ["zero", "five", "none"])
    shapefile(tmp_path, "two", [square(-3.0)], ["minus", "none"])
    shapes = preparation.shapefiles(spark, str(tmp_path))
    assert sorted((r.file, r.number, r.attributes["NAME"]) for r in shapes.collect()) == [("one", 1, "zero"), ("one", 2, "five"), ("one", 3, "none"), ("two", 1, "minus"), ("two", 2, "none")]
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 5.1, 0.5), (3, 5.5, 0.5), (4, -2.5, 0.1), (5, 9.0, 9.0), (6, 1.0, 0.5)], "id int, x double, y double")
    for cell in (0.3, 1.0, 50.0):
        found = preparation.points_in_polygons(points, shapes, cell=cell)
        assert sorted((r.id, r.attributes["NAME"]) for r in found.collect()) == [(1, "zero"), (2, "five"), (4, "minus")]
    assert sorted(r.id for r in preparation.points_in_polygons(points, shapes, how="anti").collect()) == [3, 5, 6]


def test_fingerprints_and_log():
    assert analytics.fingerprint("MATCH (n) WHERE n.x > 5 RETURN n") == analytics.fingerprint("match (n)  where n.x > 77 return n")
    assert analytics.fingerprint("RETURN 'a'") != analytics.fingerprint("RETURN a")
    log = analytics.QueryLog(size=3)
    for k in range(5):
        log.add(f"RETURN {k}", k)
    assert [r[3] for r in log.rows] == [2.0, 3.0, 4.0]


def test_pipeline_functions_come_from_allowed_modules(spark, tmp_path):
    spark.createDataFrame([(4,)], "v int").write.parquet(f"{tmp_path}/p.parquet")
    config = {"sources": {"entities": [{"entity_type": "P", "uri": f"{tmp_path}/p.parquet", "id_col": "v"}]}, "functions": [{"module": "math", "names": ["floor"]}], "queries": [{"id": "q", "inline": "MATCH (p:P) RETURN count(*) AS c"}, {"id": "r", "inline": "MATCH (p:P) RETURN count(*) AS c"}]}
    assert [pipeline.run(spark, config)[k].first().c for k in "qr"] == [1, 1]
    for module in ("os", "posix", "runpy", "code", "trellis.session"):
        with pytest.raises(CypherSemanticError):
            pipeline.run(spark, config | {"functions": [{"module": module, "names": ["x"]}]})


def test_rewriting():
    from trellis.plans import ast as A
    from trellis.plans.parser import parse
    from trellis.plans.rewriter import apart, renamed, variables

    one, two = (parse(q).statements[0] for q in ("MATCH (a:P)-[r:K]->(b) WHERE a.x > 1 SET a.y = b.z", "MATCH (a:Q) RETURN a.v AS a"))
    new = renamed(one, {"a": "c"})
    assert variables(new) == {"c", "r", "b"} and renamed(new, {"c": "a"}) == one
    assert variables(apart([one, two])[1]) == {"a__1"} and apart([one, two])[0] == one
    assert [n.target for n in A.walk(new) if isinstance(n, A.SetItem)] == ["c"]


def test_complexity_and_rate():
    from trellis.errors import LimitExceededError
    from trellis.plans.limits import Limits, complexity

    small, large = "MATCH (n:A) RETURN n", "MATCH (a)-[:R*1..9]->(b), (c) WHERE EXISTS { (a)-->(c) } RETURN a"
    assert complexity(small) < complexity("MATCH (n:A)-[:R]->(m) RETURN n") < complexity(large)
    now = [0.0]
    limits = Limits(rate=2.0, burst=2, clock=lambda: now[0])
    limits.check(small), limits.check(small)
    with pytest.raises(LimitExceededError):
        limits.check(small)
    now[0] = 0.5
    limits.check(small)
    with pytest.raises(LimitExceededError):
        Limits(most=5).check(large)


def test_command_line(spark, tmp_path, capsys):
    from trellis.__main__ import main

    spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string").write.parquet(f"{tmp_path}/p.parquet")
    spark.createDataFrame([(1, 2)], "a int, b int").write.csv(f"{tmp_path}/k.csv", header=True)
    graph = ["--folder", str(tmp_path), "--entity", "P=p.id", "--relationship", "K=k.a>b:P>P"]
    assert main(["query", "MATCH (a:P)-[:K]->(b:P) RETURN a.name AS a, b.name AS b", *graph]) == 0
    assert "|x  |y  |" in capsys.readouterr().out
    assert main(["validate", "MATCH (a:P) RETURN b", *graph]) == 1 and main(["validate", "RETURN 1 AS x"]) == 0
    assert main(["schema", *graph]) == 0 and main(["explain", "MATCH (a:P) RETURN a.name", *graph]) == 0 and main(["profile", "MATCH (a:P) RETURN a.name", *graph]) == 0
    out = capsys.readouterr().out
    assert "'b' is not defined" in out and "2 rows" in out
