"""Hand-checked results on small graphs."""

import pytest

from trellis.errors import CypherError, CypherSemanticError, CypherSyntaxError
from trellis.plans.dependencies import ordered
from trellis.plans.parser import parse
from trellis.session import GraphBuilder, GraphSession


@pytest.fixture
def people(spark):
    s = GraphSession(spark)
    rows = [(11, "Ida", 41, "deck", 2100), (12, "Jon", 23, "galley", 1500), (13, "Kim", 52, "deck", 2600), (14, "Lou", 33, "engine", 1900)]
    s.add_entity("Person", spark.createDataFrame(rows, "__ID__ long, name string, age long, dept string, salary long"))
    s.add_relationship("KNOWS", spark.createDataFrame([(7, 11, 12, 1998), (8, 12, 13, 2004), (9, 13, 11, 1991)], "__ID__ long, __SOURCE__ long, __TARGET__ long, since long"))
    return s


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("MATCH (n:Person) WHERE n.age > 35 RETURN n.name ORDER BY n.name", [("Ida",), ("Kim",)]),
        ("MATCH (a:Person)-[r:KNOWS]->(b:Person) RETURN a.name, b.name, r.since ORDER BY r.since", [("Kim", "Ida", 1991), ("Ida", "Jon", 1998), ("Jon", "Kim", 2004)]),
        ("MATCH (a)-[:KNOWS]->(b)-[:KNOWS]->(c) RETURN a.name, c.name ORDER BY a.name", [("Ida", "Kim"), ("Jon", "Ida"), ("Kim", "Jon")]),
        ("MATCH (a:Person)<-[:KNOWS]-(b) WHERE a.name = 'Ida' RETURN b.name", [("Kim",)]),
        ("MATCH (a:Person)-[:KNOWS]-(b) RETURN count(*) AS n", [(6,)]),
        ("MATCH (a:Person) OPTIONAL MATCH (a)-[:KNOWS]->(b:Person) WHERE b.age > 35 RETURN a.name AS a, b.name AS b ORDER BY a", [("Ida", None), ("Jon", "Kim"), ("Kim", "Ida"), ("Lou", None)]),
        ("MATCH (a:Person) OPTIONAL MATCH (a)-[:KNOWS]->(b) OPTIONAL MATCH (b)-[:KNOWS]->(c) RETURN a.name AS a, c.name AS c ORDER BY a", [("Ida", "Kim"), ("Jon", "Ida"), ("Kim", "Jon"), ("Lou", None)]),
        ("MATCH (a:Person) WHERE NOT (a)-[:KNOWS]->() RETURN a.name", [("Lou",)]),
        ("MATCH (a:Person) WHERE a.dept = 'engine' OR EXISTS { (a)-[:KNOWS]->(b) WHERE b.age > 45 } RETURN a.name ORDER BY a.name", [("Jon",), ("Lou",)]),
        ("MATCH (a:Person) RETURN [(a)-[:KNOWS]->(b) | b.name] AS l ORDER BY a.name", [(["Jon"],), (["Kim"],), (["Ida"],), ([],)]),
        ("MATCH (a:Person)-[:KNOWS*1..3]->(b) RETURN count(*) AS n", [(9,)]),
        ("MATCH (a:Person {name: 'Ida'})-[:KNOWS*]->(b) RETURN DISTINCT b.name AS b ORDER BY b", [("Ida",), ("Jon",), ("Kim",)]),
        ("MATCH p = shortestPath((a:Person {name: 'Ida'})-[:KNOWS*]->(b:Person {name: 'Kim'})) RETURN length(p) AS l", [(2,)]),
        ("MATCH (n:Person) RETURN n.dept AS d, count(*) AS c, avg(n.salary) AS s ORDER BY d", [("deck", 2, 2350.0), ("engine", 1, 1900.0), ("galley", 1, 1500.0)]),
        ("MATCH (n:Person) RETURN percentileDisc(n.salary, 0.9) AS a, percentileCont(n.salary, 0.5) AS b", [(2100, 2000.0)]),
        ("MATCH (n:Person) WITH n.dept AS d, collect(n.name) AS l WHERE size(l) > 1 RETURN d", [("deck",)]),
        ("UNWIND [3, null, 1] AS x RETURN x ORDER BY x", [(1,), (3,)]),
        ("RETURN 7 / 2 AS a, -7 % 3 AS b, 1 / 0 AS c, 7.0 / 2 AS d, 2 ^ 3 AS e, 'a' + 1 AS f", [(3, -1, None, 3.5, 8, "a1")]),
        ("RETURN 1 IN [] AS a, 3 IN [1, null] AS b, null = 1 AS c, 'a' = 1 AS d, 1 < 2 < 3 AS e", [(False, None, None, False, True)]),
        ("RETURN [1, 2, 3][-1] AS a, [1, 2, 3][0..2] AS b, 'abc'[1] AS c, [1][5] AS d", [(3, [1, 2], "b", None)]),
        ("RETURN any(x IN [] WHERE x > 1) AS a, all(x IN [] WHERE x > 1) AS b, none(x IN [null] WHERE x > 1) AS c, single(x IN [1, 2] WHERE x > 1) AS d", [(False, True, True, True)]),
        ("RETURN range(5, 1, -2) AS a, range(5, 1) AS b, reduce(s = 0.5, x IN [1, 2] | s + x) AS c", [([5, 3, 1], [], 3.5)]),
        ("RETURN toInteger('3.9') AS a, toBoolean('0') AS b, toString(true) AS c, toFloat('x') AS d, trim('\\t x ') AS e", [(3, False, "true", None, "x")]),
        ("RETURN date('2024-01-31') + duration('P1M') AS a, duration('PT90M').minutes AS b, (date('2024-03-02') - date('2024-03-01')).days AS c", [("2024-02-29", 90, 1)]),
        ("RETURN split('a.b', '.') AS a, join(['x', 'y'], '-') AS b, lpad('a', 3, '*') AS c, charCodeAt('é', 0) AS d, char(128512) AS e, normalize('é') AS f", [(["a", "b"], "x-y", "**a", 233, "😀", "é")]),
        ("RETURN gcd(12, -18) AS a, lcm(4, 6) AS b, round(-2.5) AS c, round(2.5, 0, 'HALF_EVEN') AS d, sqrt(-1) AS e, bitXor(6, 3) AS f", [(6, 12, -3.0, 2.0, None, 5)]),
        ("MATCH (n:Person {name: 'Jon'}) RETURN n{.name, x: n.age + 1}.x AS x, keys(n) AS k, labels(n) AS l", [(24, ["name", "age", "dept", "salary"], ["Person"])]),
        ("RETURN 1 AS x UNION RETURN 1 AS x", [(1,)]),
        ("MATCH (n:Person) RETURN n.name AS n ORDER BY n.age DESC SKIP 1 LIMIT 2", [("Ida",), ("Lou",)]),
        ("CALL db.relationshipTypes() YIELD relationshipType AS t RETURN t", [("KNOWS",)]),
        ("OPTIONAL MATCH (x:Nothing) RETURN x", [(None,)]),
    ],
)
def test_queries(people, query, expected):
    assert rows(people.cypher(query)) == expected


def test_updates(people):
    people.cypher("MATCH (a:Person)<-[:KNOWS]-(b) WITH a, count(b) AS k SET a.k = k, a.flag = true")
    assert rows(people.cypher("MATCH (p:Person) RETURN p.k, p.flag ORDER BY p.name")) == [(1, True)] * 3 + [(None, None)]
    people.cypher("CREATE (x:Person {name: 'Eve'})-[:KNOWS {since: 2024}]->(y:City {name: 'Rome'})")
    assert rows(people.cypher("MATCH (x:Person)-[r:KNOWS]->(y:City) WHERE r.since = 2024 RETURN id(x), x.name, y.name")) == [(15, "Eve", "Rome")]
    people.cypher("MATCH (p:Person) WHERE p.dept IS NOT NULL MERGE (d:Dept {name: p.dept}) ON CREATE SET d.new = true MERGE (p)-[:IN]->(d)")
    assert rows(people.cypher("MATCH (p)-[:IN]->(d:Dept) RETURN d.name AS n, d.new AS new, count(p) AS c ORDER BY n")) == [("deck", True, 2), ("engine", True, 1), ("galley", True, 1)]
    people.cypher("MERGE (d:Dept {name: 'deck'}) ON CREATE SET d.again = 1 ON MATCH SET d += {seen: 2}")
    assert rows(people.cypher("MATCH (d:Dept) WHERE d.seen = 2 RETURN d.name")) == [("deck",)]
    people.cypher("MATCH (p:Person {name: 'Jon'}) DETACH DELETE p")
    assert rows(people.cypher("MATCH (a:Person)-[r:KNOWS]->(b:Person) WHERE r.since < 2024 RETURN a.name")) == [("Kim",)]
    people.cypher("MATCH (p:Person) REMOVE p.age")
    assert rows(people.cypher("MATCH (p:Person) RETURN count(p.age) AS n")) == [(0,)]
    people.cypher("FOREACH (i IN range(1, 2) | CREATE (:Tag {v: i}))")
    assert rows(people.cypher("MATCH (t:Tag) RETURN t.v ORDER BY t.v")) == [(1,), (2,)]


def test_failed_query_changes_nothing(people):
    before = people.graph
    with pytest.raises(CypherSemanticError):
        people.cypher("MATCH (p:Person) SET p.x = 1 RETURN q.name")
    assert people.graph is before


@pytest.mark.parametrize("query", ["", "MATCH (n", "MATCH (n)", "RETURN 1 RETURN 2", "MATCH (n) RETURN", "RETURN 'a", "FOO (n)"])
def test_syntax_errors(query):
    with pytest.raises(CypherSyntaxError):
        parse(query)


@pytest.mark.parametrize("query", ["RETURN x", "RETURN foo(1)", "RETURN count(count(1))", "RETURN $p", "MATCH (n:Person) RETURN 'a' * 2", "RETURN 1 LIMIT -1", "RETURN toUpper()"])
def test_semantic_errors(people, query):
    with pytest.raises(CypherError):
        people.cypher(query).collect()


def test_functions_procedures_and_cache(people):
    @people.cypher_function
    def shout(s: str) -> str:
        return s.upper() + "!"

    people.register_function("plus", lambda s: s + 1, "long", vectorised=True)
    people.register_procedure("pairs", lambda session, n: [{"a": i, "b": i * i} for i in range(n)], "a long, b long")
    people.enable_cache()
    assert rows(people.cypher("MATCH (n:Person {name: 'Jon'}) RETURN shout(n.name) AS s, plus(n.age) AS p")) == [("JON!", 24)]
    assert rows(people.cypher("CALL pairs(3) YIELD a, b WHERE b > 0 RETURN a, b ORDER BY a")) == [(1, 1), (2, 4)]
    q = "MATCH (n:Person) RETURN count(*) AS c"
    assert people.cypher(q) is people.cypher(q)
    people.cypher("CREATE (:Person {name: 'Z'})")
    assert rows(people.cypher(q)) == [(5,)]


def test_parameters_and_builder(spark):
    s = GraphBuilder.from_dict(spark, {"P": [{"__ID__": "a", "v": 1}, {"__ID__": "b", "v": 2}]}, {"R": [{"__SOURCE__": "a", "__TARGET__": "b"}]})
    assert rows(s.cypher("MATCH (x:P)-[:R]->(y:P) WHERE y.v IN $l RETURN x, y.v", {"l": [2, 3]})) == [("a", 2)]
    assert rows(s.cypher("UNWIND $rows AS r RETURN r.a AS a, r.b AS b ORDER BY a", rows=[{"a": 1}, {"a": 2, "b": "x"}])) == [(1, None), (2, "x")]


def test_order_of_dependent_queries():
    a = "MATCH (n:A) CREATE (:B {v: n.v})"
    b = "MATCH (n:B) SET n.w = n.v"
    c = "MATCH (n:B) RETURN n.w"
    assert ordered([c, b, a]) == [a, b, c] or ordered([c, b, a]).index(a) == 0


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 5, "x"), (2, 9, "y")], "k long, v long, w string").write.parquet(f"{tmp_path}/t")
    s = GraphSession(spark).add_entity("T", spark.read.parquet(f"{tmp_path}/t").withColumnRenamed("k", "__ID__"))
    plan = s.explain("MATCH (t:T) WHERE t.v > 6 RETURN t.v AS v")
    assert "GreaterThan(v,6)" in plan and "ReadSchema: struct<v:bigint>" in plan


def test_shortest_path_honours_bounds_over_twenty(spark):
    from trellis.operators.paths import shortest

    chain = spark.createDataFrame([(i, i + 1) for i in range(23)], "s long, t long")
    start = spark.createDataFrame([(0,)], "start long")
    assert sorted((r.end, r.hops) for r in shortest(start, chain, 20, 22).collect()) == [(20, 20), (21, 21), (22, 22)]
    assert max(r.hops for r in shortest(start, chain, 1, None).collect()) == 20


def test_plans_transactions_and_validation(people):
    lines = [r.plan for r in people.cypher("explain MATCH (n:Person) DETACH DELETE n RETURN 1 AS x").collect()]
    assert any("Range" in x or "Scan" in x for x in lines) and people.cypher("MATCH (n:Person) RETURN n.name").count() == 4
    phases = people.cypher("PROFILE MATCH (n:Person) SET n.seen = true RETURN n.name").collect()
    assert [r.phase for r in phases] == ["parse", "compile", "plan", "run"] and phases[-1].rows == 4
    assert rows(people.cypher("MATCH (n:Person) RETURN count(n.seen) AS c")) == [(4,)]
    with pytest.raises(CypherSemanticError), people.transaction():
        people.cypher("MATCH (n:Person) SET n.seen = false")
        people.cypher("RETURN unknown")
    assert rows(people.cypher("MATCH (n:Person) WHERE n.seen RETURN count(*) AS c")) == [(4,)]
    people.begin()
    people.cypher("MATCH (n:Person) DETACH DELETE n")
    people.begin("gone")
    people.cypher("CREATE (:Person {name: 'New'})")
    people.rollback("gone")
    assert people.cypher("MATCH (n:Person) RETURN n.name").count() == 0
    people.rollback()
    assert people.cypher("MATCH (n:Person) RETURN n.name").count() == 4
    with pytest.raises(CypherSemanticError):
        people.rollback("gone")
    messages = [f.message for f in people.validate("MATCH (n:Person), (m:Peron) WHERE n.agee > 1 RETURN x.name, count(count(n)), uper(n.name) ORDER BY z")]
    assert len(messages) == 7 and any("'Peron'" in m and "'Person'" in m for m in messages) and any("all pairs" in m for m in messages)
    assert people.validate("MATCH (n:Person)-[r:KNOWS]->(m) WITH n, count(m) AS c WHERE c > 0 RETURN [x IN range(1, c) | x] AS l, n.name AS s ORDER BY s") == []
    assert [f.severity for f in people.validate("MATCH (n")] == ["error"]
    assert len(people.log.rows) > 5 and any(failed for *_, failed in people.log.rows)


def test_result_cache_is_bounded(people):
    cache = people.enable_cache(entries=2)
    for k in (1, 2, 3, 3):
        people.cypher(f"MATCH (n:Person) WHERE n.age > {k} RETURN n.name")
    assert (cache.hits, cache.misses, cache.evictions) == (1, 3, 1)
    old = people.enable_cache(seconds=0.0)
    people.cypher("MATCH (n:Person) RETURN n.name")
    people.cypher("MATCH (n:Person) RETURN n.name")
    assert old.hits == 0


def test_paths_keep_their_nodes(people):
    got = rows(people.cypher("MATCH p = (a:Person)-[:KNOWS]->(b)-[:KNOWS]->(c) WITH DISTINCT p RETURN nodes(p) AS n, relationships(p) AS r ORDER BY nodes(p)[0]"))
    assert got == [([11, 12, 13], [7, 8]), ([12, 13, 11], [8, 9]), ([13, 11, 12], [9, 7])]
    with pytest.raises(CypherSemanticError):
        people.cypher("MATCH p = (a:Person)-[:KNOWS*1..2]->(b) RETURN nodes(p) AS n")


def test_ends_of_different_labels_with_equal_ids(spark):
    s = GraphSession(spark)
    for label in ("A", "B"):
        s.add_entity(label, spark.createDataFrame([(1, label + "1"), (2, label + "2")], "__ID__ long, name string"))
    s.add_relationship("AB", spark.createDataFrame([(1, 2)], "a long, b long"), "a", "b", "A", "B", sound=True)
    s.add_relationship("BA", spark.createDataFrame([(2, 2)], "a long, b long"), "a", "b", "B", "A", sound=True)
    assert rows(s.cypher("MATCH (x:A)-[r]->(y) RETURN x.name AS x, type(r) AS t, y.name AS y")) == [("A1", "AB", "B2")]
    assert sorted(rows(s.cypher("MATCH (x)-[r]-(y:A) RETURN x.name AS x, y.name AS y"))) == [("B2", "A1"), ("B2", "A2")]
    assert sorted(rows(s.cypher("MATCH (x:A {name: 'A1'})-[:AB|BA*1..2]->(y) RETURN labels(y)[0] AS l, y.name AS y"))) == [("A", "A2"), ("B", "B2")]
    assert rows(s.cypher("MATCH (x:A)-[:AB]->(y:B) RETURN count(*) AS c")) == [(1,)]
    assert "Join" not in s.explain("MATCH (:A)-[r:AB]->(:B) RETURN count(*) AS c")
    s.cypher("MATCH (b:B) DELETE b")
    assert rows(s.cypher("MATCH (x:A)-[:AB]->(y:B) RETURN count(*) AS c")) == [(0,)]


def test_created_ids_are_distinct_without_a_checkpoint_folder(spark):
    s = GraphSession(spark)
    s.cypher("UNWIND range(1, 5000) AS i WITH i % 700 AS k, count(*) AS c CREATE (:N {k: k})")
    assert rows(s.cypher("MATCH (n:N) RETURN count(DISTINCT id(n)) AS c, min(id(n)) AS lo, max(id(n)) AS hi")) == [(700, 1, 700)]
