"""Registered queries of the engine with their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.catalog import Graph
from trellis.session import GraphSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


_GRAPHS: dict[tuple[str, str], Graph] = {}


def graph(spark: SparkSession, sf_dir: str) -> GraphSession:
    """A session of its own over the tables as a property graph; the (immutable) graph is made once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS:
        _GRAPHS.clear()
        _GRAPHS[key] = _load(spark, sf_dir).graph
    session = GraphSession(spark)
    session.graph = _GRAPHS[key]
    return session


def _load(spark: SparkSession, sf_dir: str) -> GraphSession:
    """Ids are keys of their tables, so none is checked for repeats; edges are foreign keys, which hold."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    s = GraphSession(spark)
    keys = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Order": ("orders", "o_orderkey")}
    for label, (table, key) in keys.items():
        df = read(table)
        s.add_entity(label, df.withColumnRenamed(key, "__ID__").withColumn(key, F.col("__ID__")))
    edge = lambda kind, df, a, b, ends, *props, unique=None: s.add_relationship(
        kind, df.select(F.col(a).alias("__SOURCE__"), F.col(b).alias("__TARGET__"), *props), source_label=ends[0], target_label=ends[1], sound=True, unique=unique
    )
    edge("IN_REGION", read("nation"), "n_nationkey", "n_regionkey", ("Nation", "Region"), unique="source")
    edge("LIVES_IN", read("customer"), "c_custkey", "c_nationkey", ("Customer", "Nation"), unique="source")
    edge("BASED_IN", read("supplier"), "s_suppkey", "s_nationkey", ("Supplier", "Nation"), unique="source")
    edge("PLACED", read("orders"), "o_custkey", "o_orderkey", ("Customer", "Order"), "o_orderpriority", unique="target")
    line = read("lineitem")
    edge("CONTAINS", line, "l_orderkey", "l_partkey", ("Order", "Part"), "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    edge("SUPPLIES", line, "l_suppkey", "l_partkey", ("Supplier", "Part"), "l_quantity")
    chain = read("nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("int").alias("b"))
    edge("NEXT", chain, "a", "b", ("Nation", "Nation"), unique="source")
    return s


def cypher(name: str, query: str, sql: str | None = None, **parameters) -> None:
    QUERIES[name] = lambda spark, sf_dir: graph(spark, sf_dir).cypher(query, parameters)
    if sql is not None:
        ORACLE_SQL[name] = sql


def plain(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


# scans, filters, projections
cypher("scan_label", "MATCH (n:Nation) RETURN n.n_name AS name", "SELECT n_name AS name FROM nation")
cypher("filtered_scan", "MATCH (p:Part) WHERE p.p_size > 30 AND p.p_retailprice < 1500.0 RETURN p.p_partkey AS k, p.p_size AS size", "SELECT p_partkey AS k, p_size AS size FROM part WHERE p_size > 30 AND p_retailprice < 1500.0")
cypher("inline_properties", "MATCH (c:Customer {c_mktsegment: $seg}) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'", seg="BUILDING")
cypher("multi_label_scan", "MATCH (n) WHERE n:Nation OR n:Region RETURN labels(n)[0] AS label, count(*) AS c", "SELECT 'Nation' AS label, count(*) AS c FROM nation UNION ALL SELECT 'Region', count(*) FROM region")
cypher("unknown_property", "MATCH (n:Region) RETURN n.r_name AS name, n.nothing IS NULL AS missing", "SELECT r_name AS name, true AS missing FROM region")
cypher("string_predicates", "MATCH (c:Customer) WHERE c.c_name ENDS WITH '7' AND c.c_name CONTAINS '1' AND NOT c.c_name STARTS WITH 'X' RETURN c.c_name AS n", "SELECT c_name AS n FROM customer WHERE c_name LIKE '%7' AND c_name LIKE '%1%' AND NOT c_name LIKE 'X%'")
cypher("regex_predicate", "MATCH (p:Part) WHERE p.p_brand =~ 'Brand#[12].' RETURN count(*) AS c", "SELECT count(*) AS c FROM part WHERE regexp_full_match(p_brand, 'Brand#[12].')")
cypher("in_list", "MATCH (p:Part) WHERE p.p_size IN [1, 7, 49] RETURN p.p_size AS s, count(*) AS c", "SELECT p_size AS s, count(*) AS c FROM part WHERE p_size IN (1, 7, 49) GROUP BY 1")
cypher("three_valued_logic", "UNWIND [{a: true, b: null}, {a: false, b: null}, {a: null, b: null}] AS r RETURN r.a AS a, r.a AND r.b AS x, r.a OR r.b AS y, NOT r.a AS z, r.a XOR r.b AS w", "SELECT * FROM (VALUES (true, NULL::BOOLEAN, true, false, NULL::BOOLEAN), (false, false, NULL, true, NULL), (NULL, NULL, NULL, NULL, NULL)) t(a, x, y, z, w)")
cypher("case_simple", "MATCH (o:Order) RETURN CASE o.o_orderstatus WHEN 'F', 'O' THEN 'known' ELSE 'other' END AS kind, count(*) AS c", "SELECT CASE WHEN o_orderstatus IN ('F', 'O') THEN 'known' ELSE 'other' END AS kind, count(*) AS c FROM orders GROUP BY 1")
cypher("case_searched", "MATCH (p:Part) RETURN CASE WHEN p.p_size < 10 THEN 'small' WHEN p.p_size < 30 THEN 'middle' END AS kind, count(*) AS c", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' END AS kind, count(*) AS c FROM part GROUP BY 1")
cypher("chained_comparison", "MATCH (p:Part) WHERE 10 < p.p_size <= 20 RETURN count(*) AS c", "SELECT count(*) AS c FROM part WHERE p_size > 10 AND p_size <= 20")
cypher("arithmetic", "UNWIND range(-7, 7) AS x RETURN x, x / 2 AS q, x % 3 AS r, x * x AS s, x / 0 AS z, -x AS n, 2 ^ 3 AS p", "SELECT x, CAST(trunc(x / 2.0) AS BIGINT) AS q, x % 3 AS r, x * x AS s, NULL::BIGINT AS z, -x AS n, 8::BIGINT AS p FROM range(-7, 8) t(x)")
cypher("lists", "UNWIND range(1, 5) AS x WITH x, [y IN range(1, x) WHERE y % 2 = 1 | y * 10] AS odd RETURN x, size(odd) AS n, head(odd) AS first, last(odd) AS final, reduce(s = 0, y IN odd | s + y) AS total, any(y IN odd WHERE y > 20) AS some, all(y IN odd WHERE y > 0) AS every", "SELECT x, (x + 1) // 2 AS n, 10::BIGINT AS first, (x - 1 + x % 2) * 10 AS final, CAST(10 * ((x + 1) // 2) * ((x + 1) // 2) AS BIGINT) AS total, x >= 3 AS some, true AS every FROM range(1, 6) t(x)")
cypher("slices", "WITH [1, 2, 3, 4] AS l, 'hello' AS s RETURN l[-1] AS a, l[9] AS b, size(l[1..3]) AS c, s[1..3] AS d, s[0] AS e", "SELECT 4::BIGINT AS a, NULL::BIGINT AS b, 2::BIGINT AS c, 'el' AS d, 'h' AS e")
cypher("maps", "MATCH (r:Region) WITH r{.r_name, k: r.r_regionkey * 2} AS m RETURN m.r_name AS name, m.k AS k, size(keys(m)) AS n", "SELECT r_name AS name, r_regionkey * 2 AS k, 2::BIGINT AS n FROM region")

# hops and joins
cypher("single_hop", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN c.c_name AS c, n.n_name AS n", "SELECT c_name AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey")
cypher("filtered_hop", "MATCH (c:Customer)-[r:PLACED]->(o:Order) WHERE o.o_totalprice > 200000.0 AND r.o_orderpriority = '1-URGENT' RETURN c.c_custkey AS c, o.o_orderkey AS o", "SELECT o_custkey AS c, o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000.0 AND o_orderpriority = '1-URGENT'")
cypher("two_hop", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, count(c) AS customers", "SELECT r_name AS region, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
cypher("three_hop_aggregate", "MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE p.p_size = 10 RETURN n.n_name AS nation, sum(l.l_quantity) AS quantity, count(DISTINCT o) AS orders", "SELECT n_name AS nation, sum(l_quantity) AS quantity, count(DISTINCT o_orderkey) AS orders FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size = 10 GROUP BY 1")
cypher("incoming_hop", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.r_name AS r, count(n) AS n", "SELECT r_name AS r, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
cypher("undirected_hop", "MATCH (a:Nation {n_nationkey: 3})-[:NEXT]-(b:Nation) RETURN b.n_nationkey AS b", "WITH e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation) SELECT b FROM e WHERE a = 3 UNION ALL SELECT a FROM e WHERE b = 3 AND a <> b")
cypher("multi_type_hop", "MATCH (n:Nation)<-[r:LIVES_IN|BASED_IN]-() RETURN type(r) AS t, count(*) AS c", "SELECT 'LIVES_IN' AS t, count(*) AS c FROM customer UNION ALL SELECT 'BASED_IN', count(*) FROM supplier")
cypher("cyclic_pattern", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)<-[:BASED_IN]-(s:Supplier), (c)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part)<-[:SUPPLIES]-(s) WHERE p.p_size < 3 RETURN n.n_name AS n, count(*) AS c", "SELECT n_name AS n, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN part ON p_partkey = a.l_partkey JOIN lineitem b ON b.l_partkey = p_partkey AND b.l_suppkey = s_suppkey WHERE p_size < 3 GROUP BY 1")
cypher("self_return_cycle", "MATCH (a:Nation)-[:NEXT]->(b:Nation)-[:NEXT]->(a) RETURN a.n_nationkey AS a", "WITH e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation) SELECT x.a FROM e x JOIN e y ON x.b = y.a AND y.b = x.a")
cypher("multi_path_match", "MATCH (a:Region {r_regionkey: 0}), (b:Region) WHERE a.r_regionkey < b.r_regionkey RETURN a.r_name AS a, b.r_name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_regionkey = 0 AND a.r_regionkey < b.r_regionkey")
cypher("theta_join", "MATCH (a:Nation), (b:Nation) WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey RETURN a.n_name AS a, b.n_name AS b", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
cypher("successive_match", "MATCH (n:Nation) WHERE n.n_nationkey < 5 MATCH (n)<-[:BASED_IN]-(s:Supplier) RETURN n.n_name AS n, count(s) AS s", "SELECT n_name AS n, count(*) AS s FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey < 5 GROUP BY 1")
cypher("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000.0 RETURN c.c_custkey AS c, count(o) AS n", "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000.0 GROUP BY 1")
cypher("optional_missing_label", "OPTIONAL MATCH (x:Nothing) RETURN x", "SELECT NULL::BIGINT AS x")
cypher("exists_semi", "MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000.0 } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000.0)")
cypher("not_exists_anti", "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->() RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
cypher("exists_value", "MATCH (n:Nation) RETURN n.n_name AS n, EXISTS { MATCH (n)<-[:BASED_IN]-(s) WHERE s.s_acctbal < 0.0 RETURN s } AS debts", "SELECT n_name AS n, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0.0) AS debts FROM nation")
cypher("pattern_comprehension", "MATCH (r:Region) RETURN r.r_name AS r, size([(r)<-[:IN_REGION]-(n:Nation) WHERE n.n_nationkey > 4 | n.n_name]) AS n", "SELECT r_name AS r, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 4 GROUP BY 1")
_EDGE = "WITH e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), h1 AS (SELECT a, b FROM e), h2 AS (SELECT DISTINCT h1.a, e.b FROM h1 JOIN e ON h1.b = e.a), h3 AS (SELECT DISTINCT h2.a, e.b FROM h2 JOIN e ON h2.b = e.a)"
cypher("variable_length", "MATCH (a:Nation)-[:NEXT*1..3]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b", f"{_EDGE} SELECT a, b FROM h1 UNION ALL SELECT a, b FROM h2 UNION ALL SELECT a, b FROM h3")
cypher("variable_length_zero", "MATCH (a:Nation)-[:NEXT*0..1]->(b) RETURN count(*) AS c", "SELECT 2 * count(*) AS c FROM nation")
cypher("path_length", "MATCH p = (a:Nation {n_nationkey: 1})-[:NEXT*2..3]->(b) RETURN length(p) AS l, b.n_nationkey AS b", f"{_EDGE} SELECT 2::BIGINT AS l, b FROM h2 WHERE a = 1 UNION ALL SELECT 3, b FROM h3 WHERE a = 1")
cypher("shortest_path", "MATCH p = shortestPath((a:Nation {n_nationkey: 0})-[:NEXT*..5]->(b:Nation)) RETURN b.n_nationkey AS b, length(p) AS l", "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), w(b, l) AS (SELECT b, 1::BIGINT FROM e WHERE a = 0 UNION ALL SELECT e.b, w.l + 1 FROM w JOIN e ON w.b = e.a WHERE w.l < 5) SELECT b, min(l) AS l FROM w GROUP BY 1")

# aggregation, order, sets
cypher("aggregation_count", "MATCH (c:Customer) RETURN c.c_mktsegment AS s, count(c) AS c", "SELECT c_mktsegment AS s, count(*) AS c FROM customer GROUP BY 1")
cypher("aggregation_avg", "MATCH (:Order)-[l:CONTAINS]->(:Part) RETURN l.l_returnflag AS f, avg(l.l_quantity) AS q, min(l.l_quantity) AS lo, max(l.l_quantity) AS hi", "SELECT l_returnflag AS f, avg(l_quantity) AS q, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
cypher("pricing_summary", "MATCH (:Order)-[l:CONTAINS]->(:Part) RETURN l.l_returnflag AS l_returnflag, l.l_linestatus AS l_linestatus, sum(l.l_quantity) AS sum_qty, count(*) AS count_order ORDER BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS count_order FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2")
cypher("aggregate_empty", "MATCH (p:Part) WHERE p.p_size > 1000 RETURN count(*) AS c, sum(p.p_size) AS s, avg(p.p_size) AS a", "SELECT 0::BIGINT AS c, NULL::BIGINT AS s, NULL::DOUBLE AS a")
cypher("aggregate_arithmetic", "MATCH (p:Part) RETURN p.p_brand AS b, sum(p.p_size) * 2 + count(*) AS v", "SELECT p_brand AS b, CAST(sum(p_size) * 2 + count(*) AS BIGINT) AS v FROM part GROUP BY 1")
cypher("count_distinct", "MATCH (p:Part) RETURN count(DISTINCT p.p_brand) AS brands, count(p.p_brand) AS rows", "SELECT count(DISTINCT p_brand) AS brands, count(p_brand) AS rows FROM part")
cypher("percentiles", "MATCH (p:Part) RETURN percentileCont(p.p_size, 0.5) AS cont, percentileDisc(p.p_size, 0.9) AS disc", "SELECT quantile_cont(p_size, 0.5)::DOUBLE AS cont, list_sort(list(p_size))[CAST(floor((count(*) - 1) * 0.9) AS BIGINT) + 1] AS disc FROM part")
cypher("deviations", "MATCH (p:Part) RETURN round(stdev(p.p_size), 6) AS s, round(stdevp(p.p_size), 6) AS p", "SELECT round(stddev_samp(p_size), 6) AS s, round(stddev_pop(p_size), 6) AS p FROM part")
cypher("collect_list", "MATCH (n:Nation) WITH n.n_regionkey AS r, collect(n.n_nationkey) AS l RETURN r, size(l) AS n, reduce(s = 0, x IN l | s + x) AS total", "SELECT n_regionkey AS r, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation GROUP BY 1")
cypher("having", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n > 20 RETURN c.c_custkey AS c, n", "SELECT o_custkey AS c, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) > 20")
cypher("top_k", "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k LIMIT 10", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY 2 DESC, 1 LIMIT 10")
cypher("order_skip_limit", "MATCH (n:Nation) RETURN n.n_name AS n ORDER BY n.n_nationkey DESC SKIP 3 LIMIT 5", "SELECT n_name AS n FROM nation ORDER BY n_nationkey DESC LIMIT 5 OFFSET 3")
cypher("nulls_last", "UNWIND [{v: 2}, {v: null}, {v: 1}] AS r RETURN r.v AS v ORDER BY v DESC LIMIT 2", "SELECT * FROM (VALUES (2::BIGINT), (1)) t(v)")
cypher("distinct_rows", "MATCH (p:Part) RETURN DISTINCT p.p_brand AS b, p.p_size % 2 AS odd", "SELECT DISTINCT p_brand AS b, p_size % 2 AS odd FROM part")
cypher("union_distinct", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
cypher("union_all", "MATCH (r:Region) RETURN r.r_name AS n UNION ALL MATCH (r:Region) RETURN r.r_name AS n", "SELECT r_name AS n FROM region UNION ALL SELECT r_name FROM region")
cypher("unwind_nulls", "UNWIND [1, null, 3] AS x RETURN x", "SELECT * FROM (VALUES (1::BIGINT), (3)) t(x)")
cypher("with_barrier", "MATCH (n:Nation) WITH n ORDER BY n.n_nationkey LIMIT 4 MATCH (n)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n, r.r_name AS r", "SELECT n_name AS n, r_name AS r FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 4) JOIN region ON n_regionkey = r_regionkey")
cypher("procedures", "CALL db.labels() YIELD label WHERE label STARTS WITH 'P' RETURN label", "SELECT 'Part' AS label")

# functions
cypher("functions_string", "MATCH (n:Nation) RETURN n.n_nationkey AS k, toUpper(n.n_name) AS u, left(n.n_name, 2) AS l, right(n.n_name, 2) AS r, reverse(n.n_name) AS v, substring(n.n_name, 1, 3) AS s, replace(n.n_name, 'A', 'x') AS p, size(n.n_name) AS z, lpad(n.n_name, 20, '*') AS pad, indexOf(n.n_name, 'I') AS i, md5(n.n_name) AS h, sha256(n.n_name) AS sh",
       "SELECT n_nationkey AS k, upper(n_name) AS u, n_name[1:2] AS l, right(n_name, 2) AS r, reverse(n_name) AS v, substring(n_name, 2, 3) AS s, replace(n_name, 'A', 'x') AS p, length(n_name) AS z, lpad(n_name, 20, '*') AS pad, instr(n_name, 'I') - 1 AS i, md5(n_name) AS h, sha256(n_name) AS sh FROM nation")
cypher("functions_math", "UNWIND range(1, 9) AS x RETURN x, round(sqrt(x), 9) AS a, floor(x / 2.0) AS b, ceil(x / 2.0) AS c, sign(x - 5) AS d, round(log(x), 9) AS e, gcd(x, 6) AS g, lcm(x, 4) AS l, bitAnd(x, 5) AS n, bitXor(x, 3) AS o, round(exp(x), 3) AS p",
       "SELECT x, round(sqrt(x), 9) AS a, floor(x / 2.0)::DOUBLE AS b, ceil(x / 2.0)::DOUBLE AS c, sign(x - 5)::DOUBLE AS d, round(ln(x), 9) AS e, gcd(x, 6) AS g, lcm(x, 4) AS l, x & 5 AS n, xor(x, 3) AS o, round(exp(x), 3) AS p FROM range(1, 10) t(x)")
cypher("functions_conversion", "UNWIND ['1', '3.9', 'x', 'true'] AS s RETURN s, toInteger(s) AS i, toFloat(s) AS f, toBoolean(s) AS b, toString(toInteger(s)) AS t", "SELECT s, TRY_CAST(trunc(TRY_CAST(s AS DOUBLE)) AS BIGINT) AS i, TRY_CAST(s AS DOUBLE) AS f, CASE WHEN s IN ('1', 'true') THEN true END AS b, CAST(TRY_CAST(trunc(TRY_CAST(s AS DOUBLE)) AS BIGINT) AS VARCHAR) AS t FROM (VALUES ('1'), ('3.9'), ('x'), ('true')) v(s)")
cypher("functions_temporal", "UNWIND ['2024-01-31', '2023-12-05'] AS s WITH s, date(s) AS d RETURN d.year AS y, d.month AS m, d.day AS dd, d.quarter AS q, d.dayOfWeek AS w, d + duration('P1M') AS n, date.truncate('month', d) AS t", "SELECT year(d) AS y, month(d) AS m, day(d) AS dd, quarter(d) AS q, isodow(d) AS w, strftime(d + INTERVAL 1 MONTH, '%Y-%m-%d') AS n, strftime(date_trunc('month', d), '%Y-%m-%d') AS t FROM (VALUES (DATE '2024-01-31'), (DATE '2023-12-05')) v(d)")
cypher("functions_lists", "UNWIND [[3, 1, 2], [5, 4, 6]] AS l RETURN head(l) AS h, last(l) AS z, size(tail(l)) AS t, min(l) AS lo, max(l) AS hi, sort(l)[0] AS s, coalesce(null, l[1]) AS c, valueType(l) AS v", "SELECT * FROM (VALUES (3::BIGINT, 2::BIGINT, 2::BIGINT, 1::BIGINT, 3::BIGINT, 1::BIGINT, 1::BIGINT, 'LIST<INTEGER>'), (5, 6, 2, 4, 6, 4, 4, 'LIST<INTEGER>')) t(h, z, t, lo, hi, s, c, v)")
cypher("graph_functions", "MATCH (n:Nation {n_nationkey: 2})-[r:IN_REGION]->(x) RETURN id(n) AS id, labels(n)[0] AS l, type(r) AS t, startNode(r) AS a, endNode(r) AS b", "SELECT n_nationkey AS id, 'Nation' AS l, 'IN_REGION' AS t, n_nationkey AS a, n_regionkey AS b FROM nation WHERE n_nationkey = 2")


# updates: each runs a change and reads the graph back
def update(name: str, changes: list[str], query: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = graph(spark, sf_dir)
        for c in changes:
            s.cypher(c)
        return s.cypher(query)

    QUERIES[name], ORACLE_SQL[name] = run, sql


update("set_from_aggregate", ["MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer) WITH n, count(c) AS k SET n.customers = k"], "MATCH (n:Nation) RETURN n.n_name AS n, n.customers AS k", "SELECT n_name AS n, nullif(count(c_custkey), 0) AS k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
update("set_along_edge", ["MATCH (n:Nation)-[:IN_REGION]->(r:Region) SET n.region = r.r_name", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) SET c.region = n.region"], "MATCH (c:Customer) RETURN c.region AS r, count(*) AS c", "SELECT r_name AS r, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
update("create_nodes", ["UNWIND range(1, 3) AS i CREATE (:Region {r_name: 'new', r_regionkey: 100 + i})"], "MATCH (r:Region) WHERE r.r_name = 'new' RETURN id(r) AS id, r.r_regionkey AS k", "SELECT (SELECT max(r_regionkey) FROM region) + i AS id, 100 + i AS k FROM range(1, 4) t(i)")
update("create_relationships", ["MATCH (a:Nation), (b:Nation) WHERE a.n_nationkey = 0 AND b.n_nationkey < 3 CREATE (a)-[:LINK {w: b.n_nationkey * 2}]->(b)"], "MATCH (a)-[l:LINK]->(b:Nation) RETURN b.n_name AS b, l.w AS w", "SELECT n_name AS b, n_nationkey * 2 AS w FROM nation WHERE n_nationkey < 3")
update("merge_nodes", ["MATCH (p:Part) WHERE p.p_size < 5 MERGE (s:Size {v: p.p_size}) ON CREATE SET s.new = true", "MERGE (s:Size {v: 1}) ON MATCH SET s.seen = true"], "MATCH (s:Size) RETURN s.v AS v, s.new AS new, s.seen AS seen", "SELECT DISTINCT p_size AS v, true AS new, CASE WHEN p_size = 1 THEN true END AS seen FROM part WHERE p_size < 5")
update("detach_delete", ["MATCH (n:Nation) WHERE n.n_regionkey = 0 DETACH DELETE n"], "MATCH (c:Customer)-[:LIVES_IN]->(n) RETURN count(*) AS c", "SELECT count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0")
update("remove_property", ["MATCH (r:Region) WHERE r.r_regionkey < 2 REMOVE r.r_name"], "MATCH (r:Region) RETURN count(r.r_name) AS c", "SELECT count(*) AS c FROM region WHERE r_regionkey >= 2")
update("foreach_updates", ["MATCH (r:Region) FOREACH (i IN range(1, 2) | CREATE (:Copy {of: r.r_name, i: i}))"], "MATCH (c:Copy) RETURN c.of AS n, c.i AS i", "SELECT r_name AS n, i FROM region, range(1, 3) t(i)")


# streams, run over static tables; a streaming test drives the same functions
@plain("window_tumbling", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS window_count FROM events GROUP BY 1, 2")
def _tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.streaming import windows

    out = windows.tumbling(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 hour", ["event_type"], time_col="ts")
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "window_count")


@plain("window_sliding", "SELECT w.s AS window_start, count(*) AS window_count FROM events, LATERAL (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * i AS s FROM range(0, 2) r(i)) w GROUP BY 1")
def _sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.streaming import windows

    out = windows.sliding(spark.read.parquet(f"{sf_dir}/events.parquet"), "2 hours", "1 hour", time_col="ts")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "window_count")


@plain("window_session", "SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1")
def _session(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.streaming import windows

    out = windows.session(spark.read.parquet(f"{sf_dir}/events.parquet"), "30 minutes", ["user_id"], time_col="ts")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("window_count").alias("rows"))


@plain("stream_table_join", "SELECT event_id, c_name, c_custkey IS NOT NULL AS __table_match__ FROM events LEFT JOIN customer ON user_id = c_custkey")
def _stream_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.streaming.joins import stream_table_join

    events, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "customer"))
    out = stream_table_join(events.select("event_id", "user_id"), customers.select("c_custkey", "c_name"), "user_id", "c_custkey")
    return out.select("event_id", "c_name", "__table_match__")


@plain("latest_by_key", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.streaming.joins import latest

    return latest(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id"), "user_id", "event_id").select("user_id", "event_id")


@plain("changelog", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'UPDATE' WHEN o_orderkey % 3 = 1 THEN 'DELETE' END AS change_type, o_orderkey, o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS o_custkey FROM orders WHERE o_orderkey % 3 <> 2")
def _changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.streaming.views import changelog

    before = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    after = before.where("o_orderkey % 3 <> 1").withColumn("o_custkey", F.expr("o_custkey + if(o_orderkey % 3 = 0, 1, 0)"))
    return changelog(before, after, "o_orderkey")


@plain("derived_edges", "SELECT c_custkey AS a, c_nationkey AS b FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.operators.edges import by_column

    customers, nations = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    out = by_column(customers, "c_custkey", "c_nationkey", nations.where("n_regionkey = 1"), "n_nationkey")
    return out.select(F.col("__SOURCE__").alias("a"), F.col("__TARGET__").alias("b"))


@plain("frame_aggregate", "SELECT p_brand, sum(p_size) AS total, count(p_size) AS n, max(p_size) AS top FROM part GROUP BY 1")
def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.operators import frames

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return frames.aggregate(part, ["p_brand"], {"total": ("p_size", "sum"), "n": ("p_size", "count"), "top": ("p_size", "max")})


@plain("source_query", "SELECT p_brand, count(*) AS n FROM part WHERE p_size > 20 GROUP BY 1")
def _source_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.sources.readers import source_from_uri

    return source_from_uri(f"{sf_dir}/part.parquet", "SELECT p_brand, count(*) AS n FROM source WHERE p_size > 20 GROUP BY p_brand").read(spark)


@plain("column_stats", "SELECT 'r_name' AS \"column\", count(*) AS rows, 0::BIGINT AS nulls, min(r_name) AS least, max(r_name) AS greatest FROM region")
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.sources.readers import column_stats

    return column_stats(spark.read.parquet(f"{sf_dir}/region.parquet").select("r_name")).drop("distinct")


@plain("conditional_pivot", "SELECT o_orderstatus AS s, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1")
def _pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).cypher(
        "MATCH (o:Order) RETURN o.o_orderstatus AS s, sum(CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent, sum(CASE WHEN o.o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS low"
    )

from trellis import suite_functions  # noqa: E402, F401
