"""Registered queries of single functions and of what is used around queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.session import GraphSession
from trellis.suite import cypher, graph, plain, update

# strings
cypher("functions_case", "MATCH (n:Nation) RETURN n.n_nationkey AS k, toLower(n.n_name) AS a, upper(n.n_name) AS b, lower(n.n_name) AS c, str(n.n_nationkey) AS d, len(n.n_name) AS e, sha1(n.n_name) AS f, isEmpty(n.n_name) AS g, byteSize(n.n_name) AS h",
       "SELECT n_nationkey AS k, lower(n_name) AS a, upper(n_name) AS b, lower(n_name) AS c, CAST(n_nationkey AS VARCHAR) AS d, length(n_name) AS e, sha1(n_name) AS f, n_name = '' AS g, strlen(n_name) AS h FROM nation")
cypher("functions_trim", "MATCH (n:Nation) WITH n.n_nationkey AS k, '  ' + n.n_name + ' ' AS s RETURN k, trim(s) AS a, ltrim(s) AS b, rtrim(s) AS c, btrim(s) AS d, btrim(trim(s), 'AN') AS e",
       "SELECT n_nationkey AS k, n_name AS a, n_name || ' ' AS b, '  ' || n_name AS c, n_name AS d, trim(n_name, 'AN') AS e FROM nation")
cypher("functions_search", "MATCH (n:Nation) RETURN n.n_nationkey AS k, startsWith(n.n_name, 'A') AS a, endsWith(n.n_name, 'A') AS b, contains(n.n_name, 'AN') AS c, charAt(n.n_name, 1) AS d, charCodeAt(n.n_name, 0) AS e, char(65 + n.n_nationkey) AS f, repeat(n.n_name, 2) AS g, rpad(n.n_name, 20, '*') AS h, charAt(n.n_name, 99) AS i",
       "SELECT n_nationkey AS k, starts_with(n_name, 'A') AS a, ends_with(n_name, 'A') AS b, contains(n_name, 'AN') AS c, n_name[2] AS d, ord(n_name[1])::BIGINT AS e, chr(65 + n_nationkey) AS f, repeat(n_name, 2) AS g, rpad(n_name, 20, '*') AS h, NULL::VARCHAR AS i FROM nation")
cypher("functions_coding", "MATCH (n:Nation) RETURN n.n_nationkey AS k, encodeBase64(n.n_name) AS a, decodeBase64(encodeBase64(n.n_name)) AS b, normalize(n.n_name) AS c, normalize('é') AS d",
       "SELECT n_nationkey AS k, to_base64(encode(n_name)) AS a, n_name AS b, n_name AS c, 'é' AS d FROM nation")
cypher("functions_split", "MATCH (c:Customer) WITH c.c_custkey AS k, split(c.c_name, '#') AS l RETURN k, size(l) AS n, l[0] AS a, join(l, '-') AS b, size(split(l[0], '')) AS c",
       "SELECT c_custkey AS k, len(string_split(c_name, '#')) AS n, string_split(c_name, '#')[1] AS a, replace(c_name, '#', '-') AS b, 1::BIGINT AS c FROM customer")
# mathematics
cypher("functions_trigonometry", "UNWIND range(1, 9) AS x RETURN x, round(sin(x), 9) AS a, round(cos(x), 9) AS b, round(tan(x), 9) AS c, round(asin(x / 10.0), 9) AS d, round(acos(x / 10.0), 9) AS e, round(atan(x), 9) AS f, round(atan2(x, 3), 9) AS g, round(cot(x), 9) AS h, round(haversin(x), 9) AS i, asin(x + 1) IS NULL AS j",
       "SELECT x, round(sin(x), 9) AS a, round(cos(x), 9) AS b, round(tan(x), 9) AS c, round(asin(x / 10.0), 9) AS d, round(acos(x / 10.0), 9) AS e, round(atan(x), 9) AS f, round(atan2(x, 3), 9) AS g, round(cot(x), 9) AS h, round((1 - cos(x)) / 2, 9) AS i, true AS j FROM range(1, 10) t(x)")
cypher("functions_hyperbolic", "UNWIND range(1, 5) AS x RETURN x, round(sinh(x), 6) AS a, round(cosh(x), 6) AS b, round(tanh(x), 9) AS c, round(degrees(x), 9) AS d, round(radians(x), 9) AS e, round(pi(), 9) AS f, round(e(), 9) AS g",
       "SELECT x, round(sinh(x), 6) AS a, round(cosh(x), 6) AS b, round(tanh(x), 9) AS c, round(degrees(x), 9) AS d, round(radians(x), 9) AS e, round(pi(), 9) AS f, round(exp(1), 9) AS g FROM range(1, 6) t(x)")
cypher("functions_powers", "MATCH (p:Part) RETURN p.p_partkey AS k, abs(-p.p_size) AS a, round(cbrt(p.p_size), 9) AS b, round(log2(p.p_size), 9) AS c, round(log10(p.p_size), 9) AS d, round(pow(p.p_size, 1.5), 6) AS e, round(hypot(p.p_size, 7), 9) AS f, fmod(p.p_size, 7) AS g, fmod(p.p_size, 0) AS h",
       "SELECT p_partkey AS k, p_size AS a, round(cbrt(p_size), 9) AS b, round(log2(p_size), 9) AS c, round(log10(p_size), 9) AS d, round(pow(p_size, 1.5), 6) AS e, round(sqrt(p_size * p_size + 49), 9) AS f, (p_size % 7)::DOUBLE AS g, NULL::DOUBLE AS h FROM part")
cypher("functions_bits", "MATCH (o:Order) RETURN o.o_orderkey AS k, bitOr(o.o_orderkey, 9) AS a, bitNot(o.o_orderkey) AS b, bitShiftLeft(o.o_orderkey, 3) AS c, bitShiftRight(o.o_orderkey, 2) AS d",
       "SELECT o_orderkey AS k, o_orderkey | 9 AS a, -o_orderkey - 1 AS b, o_orderkey * 8 AS c, o_orderkey // 4 AS d FROM orders")
cypher("functions_finite", "UNWIND [1.5, 0.0] AS x WITH x, infinity() AS y RETURN x, isNaN(x) AS a, isInfinite(x) AS b, isFinite(x) AS c, isInfinite(y) AS d, isFinite(y) AS e, isNaN(y) AS f, y > 1e300 AS g",
       "SELECT x, false AS a, false AS b, true AS c, true AS d, false AS e, false AS f, true AS g FROM (VALUES (1.5::DOUBLE), (0.0)) t(x)")
cypher("functions_rounding", "UNWIND [2.5, -2.5, 3.45] AS x RETURN x, round(x) AS a, round(x, 1) AS b, round(x, 0, 'HALF_EVEN') AS c, round(x, 0, 'CEILING') AS d, round(x, 0, 'FLOOR') AS e, round(x, 0, 'UP') AS f, round(x, 0, 'DOWN') AS g",
       "SELECT * FROM (VALUES (2.5::DOUBLE, 3.0::DOUBLE, 2.5::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE, 2.0::DOUBLE), (-2.5, -3.0, -2.5, -2.0, -2.0, -3.0, -3.0, -2.0), (3.45, 3.0, 3.5, 3.0, 4.0, 3.0, 4.0, 3.0)) t(x, a, b, c, d, e, f, g)")
# conversion and types
cypher("functions_or_null", "UNWIND ['1', '3.9', 'x', 'true'] AS s RETURN s, toIntegerOrNull(s) AS a, toFloatOrNull(s) AS b, toBooleanOrNull(s) AS c, toStringOrNull(s) AS d, int(s) AS e, float(s) AS f, bool(s) AS g",
       "SELECT s, TRY_CAST(trunc(TRY_CAST(s AS DOUBLE)) AS BIGINT) AS a, TRY_CAST(s AS DOUBLE) AS b, CASE WHEN s IN ('1', 'true') THEN true END AS c, s AS d, TRY_CAST(trunc(TRY_CAST(s AS DOUBLE)) AS BIGINT) AS e, TRY_CAST(s AS DOUBLE) AS f, CASE WHEN s IN ('1', 'true') THEN true END AS g FROM (VALUES ('1'), ('3.9'), ('x'), ('true')) v(s)")
cypher("functions_list_conversion", "UNWIND [['1', 'x', '0']] AS l RETURN toIntegerList(l)[0] AS a, toIntegerList(l)[1] AS b, toFloatList(l)[2] AS c, toBooleanList(l)[0] AS d, toBooleanList(l)[1] AS e, toStringList([1, 2])[1] AS f, size(toStringList(l)) AS g",
       "SELECT 1::BIGINT AS a, NULL::BIGINT AS b, 0.0::DOUBLE AS c, true AS d, NULL::BOOLEAN AS e, '2' AS f, 3::BIGINT AS g")
cypher("functions_types", "MATCH (p:Part) RETURN p.p_partkey AS k, isString(p.p_name) AS a, isInteger(p.p_size) AS b, isFloat(p.p_retailprice) AS c, isBoolean(p.p_size > 3) AS d, isList([1]) AS e, isMap({a: 1}) AS f, isString(p.p_size) AS g, isInteger(p.p_name) AS h, isFloat(p.p_size) AS i, isBoolean(1) AS j, isList(1) AS l, isMap(1) AS m",
       "SELECT p_partkey AS k, true AS a, true AS b, true AS c, true AS d, true AS e, true AS f, false AS g, false AS h, false AS i, false AS j, false AS l, false AS m FROM part")
cypher("functions_nulls", "MATCH (p:Part) RETURN p.p_partkey AS k, nullIf(p.p_size, 10) AS a, exists(p.p_size) AS b, exists(p.nothing) AS c, isString(p.nothing) AS d, toUpper(p.nothing) AS e, coalesce(p.nothing, p.p_name) AS f",
       "SELECT p_partkey AS k, nullif(p_size, 10) AS a, true AS b, false AS c, NULL::BOOLEAN AS d, NULL::VARCHAR AS e, p_name AS f FROM part")
cypher("functions_maps", "MATCH (r:Region) WITH r, {a: r.r_regionkey, b: r.r_regionkey + 1} AS m, properties(r) AS p RETURN elementId(r) AS id, size(keys(m)) AS n, values(m)[1] AS v, p.r_name AS name, keys(m)[0] AS k",
       "SELECT r_regionkey AS id, 2::BIGINT AS n, r_regionkey + 1 AS v, r_name AS name, 'a' AS k FROM region")
cypher("functions_nested_lists", "UNWIND range(1, 4) AS x WITH x, flatten([[x, x + 1], [x * 10]]) AS l, toList(x) AS o RETURN x, size(l) AS n, l[2] AS last, size(o) AS one, o[0] AS same, size(toList([x, x])) AS two",
       "SELECT x, 3::BIGINT AS n, x * 10 AS last, 1::BIGINT AS one, x AS same, 2::BIGINT AS two FROM range(1, 5) t(x)")
# time
cypher("functions_datetime", "UNWIND ['2024-01-31T10:20:30', '2023-12-05T23:59:59'] AS s WITH s, datetime(s) AS d, localdatetime(s) AS l RETURN s, d.hour AS h, d.minute AS m, l.second AS c, l.week AS w, d.dayOfYear AS y, datetime.truncate('hour', d) AS t, localdatetime.truncate('year', l) AS u, (d + duration('PT2H')).hour AS p",
       "SELECT strftime(d, '%Y-%m-%dT%H:%M:%S') AS s, hour(d) AS h, minute(d) AS m, second(d) AS c, week(d) AS w, dayofyear(d) AS y, strftime(date_trunc('hour', d), '%Y-%m-%dT%H:%M:%S.%f') AS t, strftime(date_trunc('year', d), '%Y-%m-%dT%H:%M:%S.%f') AS u, hour(d + INTERVAL 2 HOUR) AS p FROM (VALUES (TIMESTAMP '2024-01-31 10:20:30'), (TIMESTAMP '2023-12-05 23:59:59')) v(d)")
cypher("functions_date_parts", "MATCH (o:Order) WITH o.o_orderkey AS k, date(toString(o.o_orderdate)) AS d RETURN k, d.year AS y, d.quarter AS q, date.truncate('quarter', d) AS t, date({year: d.year, month: 2, day: 28}) AS f, d + duration({days: 40}) AS n, (date('2030-01-01') - d).days AS left",
       "SELECT o_orderkey AS k, year(o_orderdate) AS y, quarter(o_orderdate) AS q, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS t, strftime(make_date(year(o_orderdate), 2, 28), '%Y-%m-%d') AS f, strftime(CAST(o_orderdate AS DATE) + 40, '%Y-%m-%d') AS n, date_diff('day', CAST(o_orderdate AS DATE), DATE '2030-01-01') AS left FROM orders")
cypher("functions_now", "WITH now() AS a, timestamp() AS b, date() AS c, localdate() AS d, localtime() AS e, datetime() AS f, localdatetime() AS g RETURN a > 1700000000000 AS a, b >= a AS b, size(c) AS c, c = d AS d, size(e) AS e, size(f) AS f, size(g) AS g",
       "SELECT true AS a, true AS b, 10::BIGINT AS c, true AS d, 15::BIGINT AS e, 26::BIGINT AS f, 26::BIGINT AS g")
cypher("functions_random", "UNWIND range(1, 1000) AS x WITH randomUUID() AS u, rand() AS r RETURN count(DISTINCT u) AS uuids, min(size(u)) AS length, min(r) >= 0.0 AS low, max(r) < 1.0 AS high, count(DISTINCT r) > 900 AS different",
       "SELECT 1000::BIGINT AS uuids, 36::BIGINT AS length, true AS low, true AS high, true AS different")

# aggregates, projections, patterns
cypher("aggregate_distinct", "MATCH (p:Part) RETURN size(collect(DISTINCT p.p_brand)) AS brands, sum(DISTINCT p.p_size) AS s, avg(DISTINCT p.p_size) AS a, count(DISTINCT p.p_size) AS c, min(DISTINCT p.p_size) AS lo",
       "SELECT count(DISTINCT p_brand) AS brands, CAST(sum(DISTINCT p_size) AS BIGINT) AS s, avg(DISTINCT p_size) AS a, count(DISTINCT p_size) AS c, min(DISTINCT p_size) AS lo FROM part")
cypher("aggregate_over_distinct", "MATCH (p:Part) WITH DISTINCT p.p_brand AS b, p.p_size % 5 AS s RETURN b, count(*) AS c", "SELECT b, count(*) AS c FROM (SELECT DISTINCT p_brand AS b, p_size % 5 AS s FROM part) GROUP BY 1")
cypher("return_star", "MATCH (n:Nation) WITH n.n_name AS name, n.n_regionkey AS k RETURN *", "SELECT n_name AS name, n_regionkey AS k FROM nation")
cypher("with_star", "MATCH (n:Nation) WITH *, n.n_regionkey * 2 AS twice WHERE twice > 2 RETURN n.n_name AS name, twice", "SELECT n_name AS name, (n_regionkey * 2)::BIGINT AS twice FROM nation WHERE n_regionkey > 1")
cypher("inferred_aliases", "MATCH (p:Part) RETURN p.p_name, p.p_size", "SELECT p_name, p_size FROM part")
cypher("where_before_projection", "MATCH (p:Part) WITH p.p_brand AS b WHERE p.p_size > 40 RETURN b, count(*) AS c", "SELECT p_brand AS b, count(*) AS c FROM part WHERE p_size > 40 GROUP BY 1")
cypher("untyped_hop", "MATCH (n:Nation)-[r]->(x) RETURN type(r) AS t, count(*) AS c", "SELECT 'IN_REGION' AS t, count(*) AS c FROM nation UNION ALL SELECT 'NEXT', count(*) FROM nation")
cypher("all_shortest_paths", "MATCH p = allShortestPaths((a:Nation {n_nationkey: 0})-[:NEXT*..5]->(b:Nation)) RETURN b.n_nationkey AS b, length(p) AS l", "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), w(b, l) AS (SELECT b, 1::BIGINT FROM e WHERE a = 0 UNION ALL SELECT e.b, w.l + 1 FROM w JOIN e ON w.b = e.a WHERE w.l < 5) SELECT b, min(l) AS l FROM w GROUP BY 1")
_FAR = "WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part WHERE p_partkey < 60), w(a, b, l) AS (SELECT a, b, 1::BIGINT FROM e UNION ALL SELECT w.a, e.b, w.l + 1 FROM w JOIN e ON w.b = e.a WHERE w.l < 30)"


def _chain(spark: SparkSession, sf_dir: str):
    """Parts in a row: a long chain next to the graph."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey < 60")
    s = graph(spark, sf_dir)
    s.add_relationship("THEN", part.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b")), "a", "b", "Part", "Part")
    return s


@plain("variable_length_far", f"{_FAR} SELECT a, b FROM w WHERE l >= 25")
def _far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir).cypher("MATCH (a:Part)-[:THEN*25..30]->(b:Part) RETURN a.p_partkey AS a, b.p_partkey AS b")


@plain("shortest_path_far", f"{_FAR} SELECT b, l FROM w WHERE a = 1")
def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir).cypher("MATCH p = shortestPath((a:Part {p_partkey: 1})-[:THEN*..30]->(b:Part)) RETURN b.p_partkey AS b, length(p) AS l")


cypher("variable_length_labels", "MATCH (n:Nation {n_nationkey: 3})<-[:LIVES_IN]-(c:Customer)-[:PLACED|CONTAINS*1..2]->(x) RETURN c.c_custkey AS c, labels(x)[0] AS l, count(*) AS n",
       "WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT c_custkey, o_orderkey FROM c JOIN orders ON o_custkey = c_custkey), p AS (SELECT DISTINCT c_custkey, l_partkey FROM o JOIN lineitem ON l_orderkey = o_orderkey) SELECT c_custkey AS c, 'Order' AS l, count(*) AS n FROM o GROUP BY 1 UNION ALL SELECT c_custkey, 'Part', count(*) FROM p GROUP BY 1")
cypher("unlabelled_ends", "MATCH (a)-[r:LIVES_IN|IN_REGION]->(b) RETURN labels(a)[0] AS a, type(r) AS t, labels(b)[0] AS b, count(*) AS c", "SELECT 'Customer' AS a, 'LIVES_IN' AS t, 'Nation' AS b, count(*) AS c FROM customer UNION ALL SELECT 'Nation', 'IN_REGION', 'Region', count(*) FROM nation")



# a graph of people: the customers, each of whom knows five others
def people(spark: SparkSession, sf_dir: str):
    """Person and KNOWS; made once for a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PEOPLE:
        _PEOPLE.clear()
        customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
        n = customer.agg(F.max("c_custkey")).first()[0]
        person = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("dept"), F.col("c_acctbal").alias("salary"), (F.col("c_custkey") % 60 + 18).alias("age"))
        other = ((F.col("id") * 7919 + F.col("since") * 104_729) % n + 1).cast(person.schema["id"].dataType)
        knows = person.select("id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("since")).select("id", other.alias("other"), "since")
        s = GraphSession(spark).add_entity("Person", person, id_col="id", unique=True)
        _PEOPLE[key] = s.add_relationship("KNOWS", knows, "id", "other", "Person", "Person", sound=True).graph
    s = GraphSession(spark)
    s.graph = _PEOPLE[key]
    return s


_PEOPLE: dict[tuple[str, str], object] = {}
_KNOWS = "WITH p AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS dept, c_acctbal AS salary, c_custkey % 60 + 18 AS age FROM customer), e AS (SELECT id AS a, (id * 7919 + since * 104729) % (SELECT max(c_custkey) FROM customer) + 1 AS b, since FROM p, range(1, 6) t(since))"


def _people_query(name: str, query: str, sql: str) -> None:
    plain(name, f"{_KNOWS} {sql}")(lambda spark, sf_dir: people(spark, sf_dir).cypher(query))


_people_query("people_scan", "MATCH (n:Person) RETURN n.name AS name", "SELECT name FROM p")
_people_query("people_filtered_scan", "MATCH (n:Person) WHERE n.age > 30 RETURN n.name AS name, n.age AS age", "SELECT name, age FROM p WHERE age > 30")
_people_query("people_single_hop", "MATCH (n:Person)-[r:KNOWS]->(m:Person) RETURN n.name AS a, m.name AS b", "SELECT x.name AS a, y.name AS b FROM p x JOIN e ON e.a = x.id JOIN p y ON e.b = y.id")
_people_query("people_filtered_hop", "MATCH (n:Person)-[r:KNOWS]->(m:Person) WHERE n.age > 25 RETURN n.name AS a, m.name AS b, r.since AS since", "SELECT x.name AS a, y.name AS b, since FROM p x JOIN e ON e.a = x.id JOIN p y ON e.b = y.id WHERE x.age > 25")
_people_query("people_two_hop", "MATCH (a:Person)-[:KNOWS]->(b:Person)-[:KNOWS]->(c:Person) RETURN a.name AS a, c.name AS c", "SELECT x.name AS a, y.name AS c FROM p x JOIN e f ON f.a = x.id JOIN e g ON g.a = f.b JOIN p y ON g.b = y.id")
_people_query("people_count", "MATCH (n:Person) RETURN n.dept AS dept, count(n) AS cnt", "SELECT dept, count(*) AS cnt FROM p GROUP BY 1")
_people_query("people_avg", "MATCH (n:Person) RETURN n.dept AS dept, round(avg(n.salary), 6) AS avg_sal", "SELECT dept, round(avg(salary), 6) AS avg_sal FROM p GROUP BY 1")
_people_query("people_variable_length", "MATCH (a:Person)-[:KNOWS*1..3]->(b:Person) RETURN a.name AS a, b.name AS b", ", h1 AS (SELECT DISTINCT a, b FROM e), h2 AS (SELECT DISTINCT h1.a, e.b FROM h1 JOIN e ON h1.b = e.a), h3 AS (SELECT DISTINCT h2.a, e.b FROM h2 JOIN e ON h2.b = e.a) SELECT x.name AS a, y.name AS b FROM (FROM h1 UNION ALL FROM h2 UNION ALL FROM h3) h JOIN p x ON x.id = h.a JOIN p y ON y.id = h.b")
_people_query("people_reachable", "MATCH (a:Person {id: 1})-[:KNOWS*1..4]->(b:Person) RETURN DISTINCT b.id AS b", ", h1 AS (SELECT DISTINCT b FROM e WHERE a = 1), h2 AS (SELECT DISTINCT e.b FROM h1 JOIN e ON h1.b = e.a), h3 AS (SELECT DISTINCT e.b FROM h2 JOIN e ON h2.b = e.a), h4 AS (SELECT DISTINCT e.b FROM h3 JOIN e ON h3.b = e.a) FROM h1 UNION FROM h2 UNION FROM h3 UNION FROM h4")

# updates
update("set_map", ["MATCH (r:Region) SET r += {extra: r.r_regionkey * 10, r_comment: 'none'}", "MATCH (r:Region) WHERE r.r_regionkey = 1 SET r = {extra: 5}"], "MATCH (r:Region) RETURN r.r_name AS n, r.extra AS e, r.r_comment AS c", "SELECT r_name AS n, CASE WHEN r_regionkey = 1 THEN 5 ELSE r_regionkey * 10 END::BIGINT AS e, 'none' AS c FROM region")
update("set_label", ["MATCH (r:Region) WHERE r.r_regionkey = 1 SET r:Big", "MATCH (r:Region) REMOVE r:Big"], "MATCH (r:Region) RETURN count(*) AS c", "SELECT count(*) AS c FROM region")
update("set_several", ["MATCH (p:Part) SET p.a = p.p_size + 1, p.b = p.p_brand SET p.c = p.a * 2"], "MATCH (p:Part) RETURN p.p_partkey AS k, p.a AS a, p.b AS b, p.c AS c", "SELECT p_partkey AS k, (p_size + 1)::BIGINT AS a, p_brand AS b, ((p_size + 1) * 2)::BIGINT AS c FROM part")
update("merge_relationships", ["MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region) MERGE (n)-[e:SERVES]->(r) ON CREATE SET e.made = 1"], "MATCH (n:Nation)-[e:SERVES]->(r:Region) RETURN n.n_name AS n, r.r_name AS r, e.made AS m", "SELECT DISTINCT n_name AS n, r_name AS r, 1::BIGINT AS m FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")


# sources and sinks: tables are written in a form and read back
def _folder(spark: SparkSession, name: str) -> str:
    from trellis.storage import new_dir

    return new_dir(spark, name)


def _round_trip(ending: str) -> None:
    @plain(f"round_trip_{ending}", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from trellis.sources.readers import source_from_uri
        from trellis.sources.sinks import write

        part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size", "p_retailprice")
        path = f"{_folder(spark, 'sink')}/part.{ending}"
        write(part, path)
        kinds = {f.name: f.dataType.simpleString() for f in part.schema}
        return source_from_uri(path, schema_hints=kinds).read(spark).select(*part.columns)


for _ending in ("csv", "json", "orc", "parquet"):
    _round_trip(_ending)


@plain("json_records", "SELECT n_nationkey AS k, n_name AS n FROM nation")
def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that holds one JSON array of records."""
    from trellis.sources.readers import source_from_uri

    path = f"{_folder(spark, 'sink')}/nation.json"
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))).alias("r"))
    rows.agg(F.concat(F.lit("[\n"), F.array_join(F.sort_array(F.collect_list("r")), ",\n"), F.lit("\n]")).alias("value")).coalesce(1).write.text(path)
    return source_from_uri(path, schema_hints={"k": "int"}, records=True).read(spark).select("k", "n")


@plain("memory_sources", "SELECT n_regionkey AS r, count(*) * 3 AS c FROM nation GROUP BY 1")
def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas frame, an Arrow table and a list of dicts as sources (nation has 25 rows)."""
    from trellis.sources.readers import source_from_uri

    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    frames = [nation.toPandas(), nation.toArrow(), [r.asDict() for r in nation.collect()]]
    found = [source_from_uri(f).read(spark).select(F.col("n_regionkey").cast("int").alias("r")) for f in frames]
    return found[0].union(found[1]).union(found[2]).groupBy("r").agg(F.count(F.lit(1)).alias("c"))


@plain("normalised_tables", "SELECT c_nationkey AS id, count(DISTINCT c_mktsegment) AS c FROM customer GROUP BY 1")
def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that repeat keep one row, parallel edges collapse, ids are made where there are none."""
    from trellis.session import GraphBuilder

    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    edges = customer.select(F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("b"))
    s = GraphBuilder(spark).add_entity("Home", customer.select("c_nationkey"), id_col="c_nationkey").add_entity("Segment", customer.select(F.col("c_mktsegment").alias("name")), id_col="name")
    s = s.add_relationship("BUYS", edges, source_col="a", target_col="b", source_label="Home", target_label="Segment", multi_edges=False).build()
    return s.cypher("MATCH (h:Home)-[e:BUYS]->(x:Segment) RETURN id(h) AS id, count(e) AS c")


@plain("context_from_dict", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def _from_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.session import GraphBuilder

    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nation, region = read("nation"), read("region")
    entities = {"N": nation.withColumnRenamed("n_nationkey", "__ID__"), "R": region.withColumnRenamed("r_regionkey", "__ID__")}
    edges = {"IN": nation.select(F.col("n_nationkey").alias("__SOURCE__"), F.col("n_regionkey").alias("__TARGET__"))}
    return GraphBuilder.from_dict(spark, entities, edges).cypher("MATCH (n:N)-[:IN]->(r:R) RETURN n.n_name AS n, r.r_name AS r")


@plain("configured_pipeline", "SELECT c_mktsegment AS s, n_name AS n, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def _configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources (one of which is missing and skipped), a dependent pair of queries and an output."""
    from trellis.sources import pipeline

    out = f"{_folder(spark, 'pipeline')}/out.parquet"
    config = {
        "sources": {
            "entities": [
                {"entity_type": "Customer", "uri": f"{sf_dir}/customer.parquet", "id_col": "c_custkey"},
                {"entity_type": "Nation", "uri": f"{sf_dir}/nation.parquet", "id_col": "n_nationkey"},
                {"entity_type": "Gone", "uri": f"{sf_dir}/there_is_none.parquet", "on_error": "skip"},
            ],
            "relationships": [{"relationship_type": "IN", "uri": f"{sf_dir}/customer.parquet", "query": "SELECT c_custkey, c_nationkey FROM source", "source_col": "c_custkey", "target_col": "c_nationkey", "source_label": "Customer", "target_label": "Nation"}],
        },
        "queries": [
            {"id": "count", "inline": "MATCH (c:Customer) RETURN c.segment AS s, c.nation AS n, count(*) AS c"},
            {"id": "again", "inline": "MATCH (c:Customer) RETURN c.segment AS s, c.nation AS n, count(*) AS c"},
            {"id": "set", "inline": "MATCH (c:Customer)-[:IN]->(n:Nation) SET c.segment = c.c_mktsegment, c.nation = n.n_name"},
        ],
        "output": [{"query_id": "count", "uri": out}],
    }
    pipeline.run(spark, config)
    return spark.read.parquet(out)


@plain("head_sample", "SELECT 50::BIGINT AS head, 50::BIGINT AS tail, 50::BIGINT AS random, (SELECT count(*) FROM part) >= 50 AS enough")
def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.sources.readers import sample

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    counts = [sample(part, 50, how).agg(F.count(F.lit(1)).alias(how)) for how in ("head", "tail", "random")]
    out = counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # rows of one aggregate each
    return out.withColumn("enough", F.lit(part.count() >= 50))


@plain("table_stats", """SELECT 'p_size' AS "column", count(*) AS rows, count(*) - count(p_size) AS nulls, min(p_size::VARCHAR) AS least, max(p_size::VARCHAR) AS greatest FROM part
    UNION ALL SELECT 'p_brand', count(*), count(*) - count(p_brand), min(p_brand), max(p_brand) FROM part""")
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.sources.readers import column_stats

    return column_stats(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size", "p_brand")).select("column", "rows", "nulls", "least", "greatest")


# derived edges
def _edges(out: DataFrame) -> DataFrame:
    return out.select(F.col("__SOURCE__").alias("a"), F.col("__TARGET__").alias("b"))


@plain("edges_by_prefix", "SELECT p_name AS a, p_name[1:4] AS b FROM part WHERE p_name[1:4] IN (SELECT p_name[1:4] FROM part WHERE p_size > 25)")
def _prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.operators.edges import by_prefix

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return _edges(by_prefix(part, "p_name", 4, part.where("p_size > 25").select(F.substring("p_name", 1, 4).alias("code")), "code"))


@plain("edges_by_crosswalk", "SELECT o_orderstatus || o_orderpriority AS a, o_custkey::VARCHAR || o_orderstatus AS b FROM orders")
def _crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.operators.edges import by_crosswalk

    return _edges(by_crosswalk(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderstatus", "o_orderpriority"], ["o_custkey", "o_orderstatus"]))


@plain("edges_by_composite", "SELECT s_suppkey AS a, lpad(s_nationkey::VARCHAR, 2, '0') || lpad(s_suppkey::VARCHAR, 6, '0') AS b FROM supplier")
def _composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.operators.edges import by_composite

    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumn("n", F.col("s_nationkey").cast("double"))
    return _edges(by_composite(supplier, "s_suppkey", {"n": 2, "s_suppkey": 6}))


@plain("edges_by_nullable_key", "SELECT o_orderkey AS a, nullif(o_custkey % 7, 0) AS b FROM orders WHERE o_custkey % 7 <> 0")
def _nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.operators.edges import by_column

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("k", F.expr("nullif(o_custkey % 7, 0)"))
    return _edges(by_column(orders, "o_orderkey", "k"))


# frame operators
@plain("frame_operators", "SELECT p_brand AS brand, p_size AS size, 1 AS one FROM part WHERE p_size > 10 AND p_partkey IN (SELECT l_partkey FROM lineitem) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) UNION SELECT DISTINCT p_brand, p_size, 2 FROM part WHERE p_size < 3")
def _frame_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.operators import frames as f

    part, line = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))
    keys = f.rename(line.select("l_partkey", "l_quantity"), {"l_partkey": "p_partkey"})
    kept = f.join(f.filter_rows(part, "p_size > 10"), f.drop_columns(keys, ["l_quantity"]), ["p_partkey"], "semi")
    kept = f.join(kept, f.filter_rows(keys, "l_quantity > 49"), ["p_partkey"], "anti")
    names = {"p_brand": "brand", "p_size": "size"}
    one = f.assign_column(f.rename(kept.select("p_brand", "p_size"), names), "one", 1)
    two = f.assign_column(f.rename(f.filter_rows(part, "p_size < 3").select("p_brand", "p_size"), names), "one", 2)
    return f.distinct(f.concat([one, two]))


@plain("frame_joins", "SELECT c_custkey AS k, n_name AS n, r_name AS r, o AS o FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _frame_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.operators import frames as f

    customer, nation, region, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "region", "orders"))
    out = f.rename(customer.select("c_custkey", "c_nationkey"), {"c_nationkey": "n_nationkey", "c_custkey": "k"})
    out = f.join(out, nation.select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"], strategy="broadcast")
    out = f.join(out, f.rename(region.select("r_regionkey", "r_name"), {"r_regionkey": "n_regionkey"}), ["n_regionkey"], strategy="hash")
    counts = f.aggregate(f.rename(orders.select("o_custkey"), {"o_custkey": "k"}), ["k"], {"o": ("*", "count")})
    return f.rename(f.join(out, counts, ["k"], "left", "merge").select("k", "n_name", "r_name", "o"), {"n_name": "n", "r_name": "r"})


@plain("frame_multiway_join", "SELECT o_custkey AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN events ON user_id = c_custkey GROUP BY 1")
def _multiway(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.operators import frames as f

    read = lambda t, c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(c).cast("long").alias("k"))
    joined = f.join_many([read("orders", "o_custkey"), read("customer", "c_custkey"), read("events", "user_id")], "k")
    return f.aggregate(joined, ["k"], {"n": ("*", "count")})


@plain("frame_order", "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def _frame_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.operators import frames as f

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return f.limit(f.skip(f.sort(orders, ["o_totalprice", "o_orderkey"], [False, True]), 5), 20).select(F.col("o_orderkey").alias("k"))


@plain("frame_facts", "SELECT count(*) AS rows, false AS empty, true AS none, true AS sized FROM part")
def _frame_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.operators import frames as f

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    facts = (f.row_count(part), f.is_empty(part), f.is_empty(f.filter_rows(part, "p_size < 0")), f.memory_estimate_bytes(part) > 0)
    return spark.createDataFrame([facts], "rows long, empty boolean, none boolean, sized boolean")


# functions and procedures of the user's own
@plain("user_functions", "SELECT n_nationkey AS k, upper(n_name) || '!' AS loud, (n_nationkey * 2 + 1)::BIGINT AS odd, NULL::BIGINT AS failed FROM nation")
def _user_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = graph(spark, sf_dir)

    @s.cypher_function
    def shout(text: str) -> str:
        return text.upper() + "!"

    s.register_function("odd", lambda x: x * 2 + 1, "long", vectorised=True)
    s.register_function("fails", lambda x: x // 0, "long")
    return s.cypher("MATCH (n:Nation) RETURN n.n_nationkey AS k, shout(n.n_name) AS loud, odd(n.n_nationkey) AS odd, fails(n.n_nationkey) AS failed")


@plain("user_procedure", "SELECT n_name AS n, n_nationkey + 100 AS v FROM nation WHERE n_nationkey + 100 > 110")
def _user_procedure(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = graph(spark, sf_dir)
    s.register_procedure("my.nations", lambda session, add: session.entity("Nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") + add).alias("value")))
    return s.cypher("CALL my.nations(100) YIELD name AS n, value AS v WHERE v > 110 RETURN n, v")


@plain("dependent_queries", "SELECT r_name AS r, count(*) AS c FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _dependent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given in the wrong order: the reading query runs after the one that sets what it reads."""
    found = graph(spark, sf_dir).run_all(["MATCH (r:Region) RETURN r.r_name AS r, r.nations AS c", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, count(n) AS k SET r.nations = k"])
    return next(f for f in found if f.columns == ["r", "c"])


cypher("procedure_types", "CALL db.relationshipTypes() YIELD relationshipType AS t RETURN t", "SELECT unnest(['BASED_IN', 'CONTAINS', 'IN_REGION', 'LIVES_IN', 'NEXT', 'PLACED', 'SUPPLIES']) AS t")
cypher("procedure_keys", "CALL db.propertyKeys() YIELD propertyKey AS k WHERE k STARTS WITH 'r_' RETURN k", "SELECT unnest(['r_name', 'r_regionkey']) AS k")


@plain("cached_query", "SELECT p_brand AS b, count(*) AS c FROM part GROUP BY 1")
def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = graph(spark, sf_dir)
    s.enable_cache()
    query = "MATCH (p:Part) RETURN p.p_brand AS b, count(*) AS c"
    s.cypher(query)
    return s.cypher(query)


# schemas and lineage
@plain("schema_versions", "SELECT 3::BIGINT AS version, 'p_price' AS added, 'p_size' AS changed, true AS refused")
def _schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.errors import CypherSemanticError
    from trellis.operators.schemas import SchemaRegistry, merge

    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").cast("int").alias("p_size"))
    registry = SchemaRegistry("backward")
    registry.register("part", part.schema)
    wide = merge(part.schema, part.select(F.col("p_size").cast("double").alias("p_size"), F.lit(1.0).alias("p_price")).withColumn("p_price", F.expr("nullif(p_price, 0.0)")).schema)
    registry.register("part", wide)
    try:
        registry.register("part", part.select(F.col("p_size").cast("string").alias("p_size")).schema)
        refused = False
    except CypherSemanticError:
        refused = True
    change = registry.diff("part", 1, 2)
    return spark.createDataFrame([(registry.rollback("part", 1), ",".join(change["added"]), ",".join(change["changed"]), refused)], "version long, added string, changed string, refused boolean")


@plain("lineage", "SELECT * FROM (VALUES ('report', 'nation'), ('report', 'joined'), ('report', 'customer'), ('joined', 'customer'), ('joined', 'nation')) t(name, source)")
def _lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.operators.schemas import Lineage

    lineage = Lineage()
    lineage.add("joined", "customer", "nation")
    lineage.add("report", "joined")
    return spark.createDataFrame([(n, s) for n in ("joined", "report") for s in sorted(lineage.provenance(n))], "name string, source string")


# preparation of data sets
@plain("flattened_claims", "SELECT n_nationkey AS item_id, 'P1' AS claim_property, 'c' || n_nationkey AS claim_id, 'normal' AS rank, 'P1' AS snak_property, 'Q' || n_regionkey AS snak_value, 'mainsnak' AS snak_type FROM nation UNION ALL SELECT n_nationkey, 'P1', 'c' || n_nationkey, 'normal', 'P2', n_name, 'qualifier' FROM nation")
def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.sources.preparation import flatten_claims

    shape = F.format_string('{"P1":[{"id":"c%d","mainsnak":{"property":"P1","datavalue":{"value":{"id":"Q%d","numeric":1}}},"qualifiers":{"P2":[{"property":"P2","datavalue":{"value":"%s"}}]}}]}', "n_nationkey", "n_regionkey", "n_name")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", shape.alias("claims"))
    return flatten_claims(nation, "n_nationkey").select("item_id", "claim_property", "claim_id", "rank", "snak_property", "snak_value", "snak_type")


@plain("geolocated_lines", "SELECT 'Q' || c_custkey AS id, c_name AS labels FROM customer WHERE c_custkey % 3 = 0")
def _geolocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.sources.preparation import geolocated

    place = F.when(F.col("c_custkey") % 3 == 0, '{"P625":{"latitude":1}}').otherwise("{}")
    shape = F.format_string('{"id":"Q%d","labels":{"en":"%s","de":"x"},"claims":%s},', "c_custkey", "c_name", place)
    lines = spark.read.parquet(f"{sf_dir}/customer.parquet").select(shape.alias("value"))
    return geolocated(lines.union(spark.createDataFrame([("latitude no json",), ("[",)], "value string"))).select("id", "labels")


@plain("tagged_nodes", "SELECT key, value, count(*) AS count FROM (SELECT 'brand' AS key, p_brand AS value FROM part WHERE p_size > 10 UNION ALL SELECT 'source:size', p_size::VARCHAR FROM part WHERE p_size > 10) GROUP BY 1, 2")
def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a trivial family alone don't keep a node."""
    from trellis.sources.preparation import tag_tally, tagged_nodes

    size = F.col("p_size").cast("string")
    tags = F.when(F.col("p_size") > 10, F.create_map(F.lit("brand"), "p_brand", F.lit("source:size"), size)).otherwise(F.create_map(F.lit("source:size"), size))
    return tag_tally(tagged_nodes(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", tags.alias("tags")), ["source", "note"]))


@plain("rows_by_either_code", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey::VARCHAR LIKE '11%' OR l_suppkey::VARCHAR LIKE '11%'")
def _either(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.sources.preparation import by_either

    return by_either(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_partkey", "l_suppkey"], "11").select("l_orderkey", "l_partkey")


@plain("points_in_polygons", "SELECT c_custkey AS k, i AS polygon FROM (SELECT c_custkey, c_acctbal / 1000.0 AS x, (c_custkey % 40) / 4.0 AS y FROM customer) p, range(0, 10) t(i) WHERE x >= i AND x < i + 1 AND y >= 0 AND y < i + 0.5 AND NOT (x >= i + 0.25 AND x < i + 0.75 AND y >= 0.125 AND y < 0.375)")
def _spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points, ten rectangles with a hole each as polygons."""
    from trellis.sources.preparation import points_in_polygons

    points = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 1000.0).alias("x"), ((F.col("c_custkey") % 40) / 4.0).alias("y"))
    place = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(float(y)).alias("y") if not hasattr(y, "cast") else y.cast("double").alias("y"))
    i, top = F.col("id"), F.col("id") + 0.5
    outer = F.array(place(i, 0), place(i + 1, 0), place(i + 1, top), place(i, top), place(i, 0))
    hole = F.array(place(i + 0.25, 0.125), place(i + 0.25, 0.375), place(i + 0.75, 0.375), place(i + 0.75, 0.125), place(i + 0.25, 0.125))
    polygons = spark.range(10).select(i.alias("polygon"), F.array(outer, hole).alias("rings"))
    return points_in_polygons(points, polygons).select("k", "polygon")


@plain("points_outside", "SELECT c_custkey AS k FROM customer WHERE NOT (c_acctbal >= 0 AND c_acctbal < 5000)")
def _outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.sources.preparation import points_in_polygons

    points = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 1000.0).alias("x"), F.lit(0.5).alias("y"))
    square = [[(0.0, 0.0), (5.0, 0.0), (5.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]
    return points_in_polygons(points, spark.createDataFrame([(square,)], "rings array<array<struct<x:double,y:double>>>"), how="anti").select("k")


# paths, plans, transactions, analytics
cypher("path_nodes", "MATCH p = (c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE n.n_nationkey < 3 RETURN nodes(p)[0] AS a, nodes(p)[1] AS b, nodes(p)[2] AS c, size(relationships(p)) AS d, length(p) AS l",
       "SELECT c_custkey AS a, c_nationkey AS b, n_regionkey AS c, 2::BIGINT AS d, 2::BIGINT AS l FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 3")


@plain("explain_clause", "SELECT true AS lines, 25::BIGINT AS nations")
def _explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = graph(spark, sf_dir)
    lines = s.cypher("EXPLAIN MATCH (n:Nation) DETACH DELETE n")
    return s.cypher("MATCH (n:Nation) RETURN count(n) AS nations").select(F.lit(lines.count() >= 0).alias("lines"), "nations")


@plain("profile_clause", "SELECT unnest(['parse', 'compile', 'plan', 'run']) AS phase, unnest([NULL, NULL, NULL, (SELECT count(*) FROM part WHERE p_size > 7)]) AS rows")
def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).cypher("PROFILE MATCH (p:Part) WHERE p.p_size > 7 RETURN p.p_name AS n").where("seconds >= 0").select("phase", "rows")


@plain("transactions", "SELECT count(*) AS kept, 0::BIGINT AS undone, 1::BIGINT AS saved FROM region WHERE r_regionkey < 2")
def _transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = graph(spark, sf_dir)
    with s.transaction():
        s.cypher("MATCH (r:Region) WHERE r.r_regionkey < 2 SET r.mark = 'kept'")
    try:
        with s.transaction():
            s.cypher("MATCH (r:Region) SET r.other = 1")
            s.cypher("MATCH (r:Region) RETURN no_such_function(r)")
    except ValueError:
        pass
    s.begin()
    s.cypher("MATCH (r:Region {r_regionkey: 3}) SET r.third = 1")
    s.begin("here")
    s.cypher("MATCH (r:Region) SET r.third = 2")
    s.rollback("here")
    s.commit()
    return s.cypher("MATCH (r:Region) RETURN count(r.mark) AS kept, count(r.other) AS undone, sum(r.third) AS saved")


@plain("composed_queries", "SELECT n_name AS n, count(c_custkey) AS c FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def _composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).compose(["MATCH (n:Nation) WHERE n.customers IS NOT NULL RETURN n.n_name AS n, n.customers AS c", "MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer) WITH n, count(c) AS k SET n.customers = k"])


@plain("validated_query", "SELECT * FROM (VALUES ('error', 'the variable ''m'' is not defined'), ('error', 'there is no function ''frobnicate'''), ('warning', 'there is no label ''Natoin''; did you mean ''Nation''?')) t(severity, message)")
def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph(spark, sf_dir).validate("MATCH (nation:Natoin) RETURN m.x AS x, frobnicate(nation.n_name) AS y")
    return spark.createDataFrame([(f.severity, f.message) for f in found], "severity string, message string")


@plain("query_analytics", "SELECT 30::BIGINT AS runs, 1::BIGINT AS failures, 15.5::DOUBLE AS mean, 15.5::DOUBLE AS p50, 1::BIGINT AS slower, 3::BIGINT AS hours, 30.0::DOUBLE AS worst")
def _analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis import analytics

    log = analytics.QueryLog()
    for k in range(30):
        log.add(f"MATCH (n) WHERE n.x > {k} RETURN n", k + 1.0, k == 0, 1_700_000_000 + 300 * k)
    frame = log.frame(spark)
    shown = analytics.latencies(frame).select("runs", "failures", "mean", "p50")
    slower = analytics.regressions(frame, recent=10, factor=1.5).agg(F.count(F.lit(1)).alias("slower"))
    hours = analytics.trends(frame, "1 hour").agg(F.count(F.lit(1)).alias("hours"))
    return shown.crossJoin(slower).crossJoin(hours).crossJoin(analytics.slowest(frame, 1).select(F.col("seconds").alias("worst")))  # one row each


# streams: the events table is read as a stream to its end
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(out: DataFrame, spark: SparkSession, name: str, mode: str) -> DataFrame:
    """The result of a streaming query that has read all there is."""
    path = _folder(spark, name)
    last = f"{path}/table"
    write = out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    write.foreachBatch(lambda batch, k: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(last)).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(last)


@plain("stream_tumbling", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS window_count FROM events GROUP BY 1, 2")
def _stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.streaming import windows

    out = windows.tumbling(_events(spark, sf_dir), "1 hour", ["event_type"], time_col="ts")
    return _drained(out, spark, "tumbling", "complete").select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "window_count")


@plain("stream_dedup", "SELECT count(DISTINCT user_id) AS users FROM events")
def _stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.streaming import windows

    out = windows.deduplicated(_events(spark, sf_dir), ["user_id"], "ts", "3650 days").select("user_id")
    return _drained(out, spark, "dedup", "append").agg(F.count("user_id").alias("users"))


@plain("stream_map_join", "SELECT event_type, c_mktsegment, count(*) AS c FROM events JOIN customer ON user_id = c_custkey WHERE event_type <> 'view' GROUP BY 1, 2")
def _stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered, joined with a table and aggregated on the way."""
    from trellis.streaming.joins import stream_table_join

    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    out = stream_table_join(_events(spark, sf_dir).where("event_type <> 'view'").select("event_type", "user_id"), customers, "user_id", "c_custkey", "inner")
    return _drained(out.groupBy("event_type", "c_mktsegment").agg(F.count(F.lit(1)).alias("c")), spark, "join", "complete")


@plain("stream_window_records", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, count(*) AS held FROM events GROUP BY 1")
def _stream_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.streaming import windows

    out = windows.records(spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id"), F.window("ts", "1 hour"), "ts")
    return out.select(F.col("__window_start__").cast("timestamp_ntz").alias("start"), F.col("__window_count__").alias("n"), F.size("__window_records__").cast("long").alias("held"))


@plain("punctuated_stream", "SELECT event_type, count(*) AS c FROM events WHERE event_type <> 'view' GROUP BY 1")
def _punctuated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one kind are watermarks only."""
    from trellis.streaming import windows

    out = windows.punctuated(_events(spark, sf_dir), "event_type", "view", "ts").groupBy("event_type").agg(F.count(F.lit(1)).alias("c"))
    return _drained(out, spark, "punctuated", "complete")


def _view(spark: SparkSession, name: str, batches: list[DataFrame], **more):
    from trellis.streaming.views import IncrementalView

    view = IncrementalView(_folder(spark, name), **more)
    for k, batch in enumerate(batches):
        view.apply(batch, k)
    return view


@plain("incremental_view", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey + 1 ELSE o_custkey END AS v FROM orders WHERE o_orderkey % 4 <> 1 AND o_orderkey % 5 <> 0")
def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts, then updates and deletes; the state becomes a label of a graph and is queried there."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"), F.lit("INSERT").alias("record_type"), F.lit(1).alias("at"))
    later = rows.where("k % 4 < 2").withColumn("record_type", F.expr("if(k % 4 = 0, 'UPDATE', 'DELETE')")).withColumns({"v": F.col("v") + 1, "at": F.lit(2)})
    view = _view(spark, "view", [rows, later], key="k", order="at")
    s = graph(spark, sf_dir)
    view.as_entity(s, "Live")
    kept = view.query(spark, "k % 5 <> 0").select(F.col("k").alias("q"))
    return s.cypher("MATCH (n:Live) RETURN id(n) AS k, n.v AS v").join(kept, F.col("k") == F.col("q"), "left_semi")


@plain("aggregating_view", "SELECT user_id, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def _aggregating(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id")
    batches = [events.where(f"event_id % 3 = {k}") for k in range(3)]
    made = {"n": ("event_id", "count"), "first": ("event_id", "min"), "last": ("event_id", "max")}
    return _view(spark, "aggregates", batches, key="user_id", order="event_id", aggregates=made).snapshot(spark)


@plain("stream_metrics", "SELECT count(*) AS processed, true AS batches FROM events")
def _stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.streaming import windows

    path = _folder(spark, "metrics")
    query = _events(spark, sf_dir).writeStream.format("noop").option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination()
    found = windows.metrics(query)
    return spark.createDataFrame([(int(found["processed"]), found["batches"] > 0)], "processed long, batches boolean")


# graphs of folders and stars, limits
@plain("discovered_graph", "SELECT n_name AS n, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.sources.discovery import discover

    entities = {"Customer": ("customer", "c_custkey"), "Nation": ("nation", "n_nationkey"), "Absent": ("absent", "id")}
    edges = {"IN": ("customer", "c_custkey", "c_nationkey", "Customer", "Nation"), "NOT": ("absent", "a", "b", "Absent", "Nation")}
    return discover(spark, sf_dir, entities, edges).cypher("MATCH (c:Customer)-[:IN]->(n:Nation) RETURN n.n_name AS n, count(c) AS c")


@plain("star_schema", "SELECT c_mktsegment AS s, o_orderstatus AS t, count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000.0 GROUP BY 1, 2")
def _star(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.sources.discovery import GraphPipeline

    orders, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    dimensions = {"Customer": (customers, "c_custkey", "o_custkey"), "Status": (orders.select(F.col("o_orderstatus").alias("status")), "status", "o_orderstatus")}
    s = GraphPipeline(spark).star("Sale", orders, "o_orderkey", dimensions).build()
    return s.cypher("MATCH (c:Customer)<-[:HAS_CUSTOMER]-(s:Sale)-[:HAS_STATUS]->(t:Status) WHERE s.o_totalprice > 100000.0 RETURN c.c_mktsegment AS s, t.status AS t, count(*) AS c")


@plain("query_limits", "SELECT 3::BIGINT AS allowed, true AS refused, true AS costly")
def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.errors import LimitExceededError
    from trellis.plans.limits import Limits

    s = graph(spark, sf_dir)
    s.limits, allowed, refused, costly = Limits(most=20, rate=1.0, burst=3, clock=lambda: 0.0), 0, False, False
    try:
        s.cypher("MATCH (a)-[:NEXT*]->(b) RETURN b")
    except LimitExceededError:
        costly = True
    for _ in range(4):
        try:
            s.cypher("MATCH (n:Nation) RETURN n.n_name AS n")
            allowed += 1
        except LimitExceededError:
            refused = True
    return spark.createDataFrame([(allowed, refused, costly)], "allowed long, refused boolean, costly boolean")


@plain("configured_functions", "SELECT p_partkey AS k, floor(sqrt(p_size))::BIGINT AS root FROM part")
def _configured_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function by module and name, and an output as CSV."""
    from trellis.sources import pipeline

    config = {
        "sources": {"entities": [{"entity_type": "Part", "uri": f"{sf_dir}/part.parquet", "id_col": "p_partkey"}]},
        "functions": [{"module": "math", "names": ["isqrt"]}],
        "queries": [{"id": "roots", "inline": "MATCH (p:Part) RETURN id(p) AS k, toInteger(isqrt(p.p_size)) AS root"}],
    }
    return pipeline.run(spark, config)["roots"]


@plain("graph_sink", "SELECT (SELECT count(*) FROM nation) AS nodes, (SELECT count(*) FROM customer) AS relationships, true AS batched")
def _graph_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements for a graph database, sent in batches; what arrives is counted."""
    from trellis.sources import sinks

    context = spark.sparkContext
    nodes, edges, batches = (context.accumulator(0) for _ in range(3))

    def connect(counter):
        def send(statement: str, parameters: dict) -> None:
            counter.add(len(parameters["rows"]) if statement.startswith("UNWIND $rows") else 0)
            batches.add(1)

        return lambda: send

    nation, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer"))
    sinks.write_graph(nation, sinks.node_statement("Nation", "n_nationkey"), connect(nodes), 10)
    links = customer.select(F.col("c_custkey").alias("source"), F.col("c_nationkey").alias("target"), F.create_map(F.lit("since"), F.lit(1)).alias("props"))
    sinks.write_graph(links, sinks.relationship_statement("LIVES_IN", ("Customer", "c_custkey"), ("Nation", "n_nationkey")), connect(edges), 100)
    return spark.createDataFrame([(nodes.value, edges.value, batches.value >= 4)], "nodes long, relationships long, batched boolean")
