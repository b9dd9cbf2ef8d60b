"""Patterns that close a cycle are joined by all keys at once, with the same results."""

import pytest

from trellis import suite
from trellis.session import GraphSession

DATA = "/root/testdata/sf0.01"


def joins(plan):
    """Rows that each join of an executed plan made."""
    inner = {"AdaptiveSparkPlanExec": "executedPlan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan", "ResultQueryStageExec": "plan"}.get(plan.getClass().getSimpleName())
    below = [getattr(plan, inner)()] if inner else [plan.children().apply(k) for k in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in plan.nodeName() else []
    return own + [n for x in below for n in joins(x)]


def test_no_join_makes_more_rows_than_the_largest_table(spark):
    df = suite.QUERIES["cyclic_pattern"](spark, DATA).select("*")
    assert len(df.collect()) == 25
    made = joins(df._jdf.queryExecution().executedPlan())
    assert len(made) >= 5
    assert max(made) <= spark.read.parquet(f"{DATA}/lineitem.parquet").count()


def shop(spark, **unique):
    """Buyers and sellers in two towns, goods that both deal in; some edges twice, one seller without a town."""
    s = GraphSession(spark)
    table = lambda rows, columns: spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, rows))} AS t({columns})")
    for label, n in (("Buyer", 6), ("Seller", 5), ("Town", 2), ("Good", 4)):
        s.add_entity(label, table([(k, f"{k % 3}", k) for k in range(n)], "__ID__, kind, size"))
    edge = lambda kind, pairs, a, b: s.add_relationship(kind, table([(k, x, y, k % 2) for k, (x, y) in enumerate(pairs)], "__ID__, a, b, w"), "a", "b", a, b, "__ID__", sound=True, unique=unique.get(kind))
    edge("LIVES", [(k, k % 2) for k in range(6)], "Buyer", "Town")
    edge("BASED", [(k, k % 2) for k in range(4)], "Seller", "Town")
    edge("WANTS", WANTS, "Buyer", "Good")
    edge("SELLS", SELLS, "Seller", "Good")
    edge("KNOWS", [(k, (k + 1) % 6) for k in range(6)] + [(2, 2), (0, 3), (3, 0)], "Buyer", "Buyer")
    edge("LIKES", [(k, 2 * k % 6) for k in range(5)], "Seller", "Buyer")
    return s


WANTS = [(k, j) for k in range(6) for j in range(4) if (k * j) % 3 != 1] + [(0, 0)]
SELLS = [(k, j) for k in range(5) for j in range(4) if (k + j) % 2] + [(1, 0), (1, 0)]
CIRCLE = "(b:Buyer)-[:LIVES]->(t:Town)<-[:BASED]-(s:Seller), (b)-[:WANTS]->(g:Good)<-[:SELLS]-(s)"


@pytest.mark.parametrize(
    "query",
    [
        f"MATCH {CIRCLE} WHERE g.size < 2 RETURN t.size AS t, count(*) AS c",
        f"MATCH {CIRCLE} WHERE g.size < 3 AND b.size > s.size AND g:Good RETURN id(b) AS b, id(s) AS s, id(g) AS g",
        f"MATCH {CIRCLE} WHERE NOT EXISTS {{ (b)-[:KNOWS]->(x:Buyer) WHERE x.size = g.size }} RETURN id(b) AS b, id(s) AS s, id(g) AS g",
        "MATCH (b:Buyer)-[l:LIVES]->(t)<-[h:BASED {w: 1}]-(s), (b)-[x:WANTS]->(g {kind: '0'})<-[y:SELLS]-(s {size: 1}) RETURN id(l) AS l, id(h) AS h, id(x) AS x, y.w AS y, id(y) AS i",
        f"MATCH (g:Good {{size: 0}}) MATCH {CIRCLE} RETURN id(b) AS b, id(s) AS s, id(g) AS g",
        f"MATCH (t:Town) WHERE t.size = 1 WITH t OPTIONAL MATCH {CIRCLE} RETURN id(t) AS t, id(b) AS b, s.size AS s, id(g) AS g",
        f"MATCH (k:Town) OPTIONAL MATCH {CIRCLE} WHERE t.size = k.size AND g.size > 1 RETURN id(k) AS k, id(b) AS b, s.size AS s, id(g) AS g",
        "MATCH (b)-[:KNOWS]->(c)-[:LIVES]->(t)<-[:LIVES]-(b) RETURN id(b) AS b, id(c) AS c, id(t) AS t",
        "MATCH (b)-[:WANTS]->(g)<-[:SELLS]-(s)-[:LIKES]->(b) RETURN id(b) AS b, id(s) AS s, id(g) AS g",
        "MATCH (b)-[:KNOWS]->(c)-[:KNOWS]->(b), (b)-[:LIVES]->(t)<-[:LIVES]-(c) RETURN id(b) AS b, id(c) AS c, t.size AS t",
        f"MATCH {CIRCLE}, (b)-[:KNOWS]->(c)-[:LIVES]->(t) RETURN id(b) AS b, id(c) AS c, id(s) AS s, id(g) AS g",
    ],
)
def test_the_order_does_not_change_results(spark, query):
    """Also where an end is told to be unique and is not."""
    told = [{}, {"LIVES": "source", "BASED": "source", "LIKES": "source"}, {"LIVES": "source", "SELLS": "source", "KNOWS": "source"}]
    expected, *others = (sorted((tuple(r) for r in shop(spark, **u).cypher(query).collect()), key=repr) for u in told)
    assert expected
    assert all(got == expected for got in others)


def test_a_cycle_against_plain_lists(spark):
    expected = sorted((b, s, g) for b, g in WANTS for s, h in SELLS if g == h and s < 4 and b % 2 == s % 2)
    s = shop(spark, LIVES="source", BASED="source")
    got = s.cypher(f"MATCH {CIRCLE} RETURN id(b) AS b, id(s) AS s, id(g) AS g").collect()
    assert sorted(map(tuple, got)) == expected
