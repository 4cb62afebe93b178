"""Queries of the graph engine over the driver's tables, each beside its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexloom.cypher import compile_query
from plexloom.graph import GraphView, commerce, event_graph
from plexloom.operators import enrich, search, summary, text, traverse, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def cy(name: str, query: str, labels: str, kinds: str, sql: str | None, graph=commerce) -> None:
    own = (lambda s, d: commerce(s, d, set(labels.split()), set(kinds.split()))) if graph is commerce else event_graph
    QUERIES[name] = lambda s, d: compile_query(own(s, d), query)
    if sql:
        ORACLE_SQL[name] = sql


def add(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- query language: patterns, predicates, joins
cy("cy_edge_join_agg", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.total > 100000 RETURN c.segment AS seg, COUNT(*) AS n", "Customer Order", "PLACED",
   "SELECT c_mktsegment AS seg, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1")
cy("cy_inbound", "MATCH (o:Order)<-[:PLACED]-(c:Customer) RETURN c.name AS name, MAX(o.total) AS top", "Customer Order", "PLACED",
   "SELECT c_name AS name, max(o_totalprice) AS top FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
cy("cy_undirected", "MATCH (n:Nation)-[:IN_REGION|IN_NATION]-(x) RETURN n.name AS name, x.label AS label, COUNT(*) AS n", "Region Nation Customer Supplier", "IN_REGION IN_NATION",
   "SELECT n_name AS name, 'Region' AS label, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT n_name, 'Customer', count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT n_name, 'Supplier', count(*) FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
cy("cy_chain3", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.name AS region, COUNT(o) AS n, COUNT(DISTINCT c.id) AS customers", "Region Nation Customer Order", "IN_REGION IN_NATION PLACED",
   "SELECT r_name AS region, count(*) AS n, count(DISTINCT c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1")
cy("cy_where_bool", "MATCH (c:Customer) WHERE (c.segment = 'BUILDING' OR c.balance < 0) AND NOT c.name ENDS WITH '7' RETURN c.id AS id", "Customer", "",
   "SELECT 'customer:' || c_custkey AS id FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND NOT c_name LIKE '%7'")
cy("cy_where_xor", "MATCH (p:Part) WHERE p.size > 25 XOR p.price < 1000 RETURN p.id AS id", "Part", "", "SELECT 'part:' || p_partkey AS id FROM part WHERE (p_size > 25) <> (p_retailprice < 1000)")
cy("cy_compare_coerce", "MATCH (p:Part) WHERE p.size >= '40' RETURN p.id AS id, p.size AS size", "Part", "", "SELECT 'part:' || p_partkey AS id, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size >= 40")
cy("cy_regex", "MATCH (p:Part) WHERE p.name =~ '^(red|blue) .*(bolt|ring)$' RETURN p.name AS name, COUNT(*) AS n", "Part", "", "SELECT p_name AS name, count(*) AS n FROM part WHERE regexp_matches(p_name, '^(red|blue) .*(bolt|ring)$') GROUP BY 1")
cy("cy_in_notin", "MATCH (o:Order) WHERE o.status IN ['O', 'P'] AND o.priority NOT IN ['5-LOW', null] RETURN o.status AS status, o.priority AS priority, COUNT(*) AS n", "Order", "",
   "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority <> '5-LOW' GROUP BY 1, 2")
cy("cy_string_preds", "MATCH (p:Part) WHERE p.name STARTS WITH 'red' OR p.name CONTAINS 'gear' OR p.type ENDS WITH 'ARD' RETURN p.id AS id", "Part", "", "SELECT 'part:' || p_partkey AS id FROM part WHERE p_name LIKE 'red%' OR p_name LIKE '%gear%' OR p_type LIKE '%ARD'")
cy("cy_null_preds", "MATCH (n:Customer|Supplier) WHERE n.segment IS NULL OR n.missing IS NOT NULL RETURN n.label AS label, COUNT(*) AS n", "Customer Supplier", "", "SELECT 'Supplier' AS label, count(*) AS n FROM supplier")
cy("cy_label_alt", "MATCH (n) WHERE n:Region|Nation RETURN n.label AS label, COUNT(*) AS n", "Region Nation Supplier", "", "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation")
cy("cy_case_searched", "MATCH (c:Customer) RETURN c.id AS id, CASE WHEN c.balance < 0 THEN 'debt' WHEN c.balance > 5000 THEN 'rich' ELSE c.segment END AS c", "Customer", "",
   "SELECT 'customer:' || c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE c_mktsegment END AS c FROM customer")
cy("cy_case_simple", "MATCH (o:Order) WITH CASE o.status WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS c, COUNT(*) AS n RETURN c, n", "Order", "", "SELECT CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS BIGINT) AS c, count(*) AS n FROM orders GROUP BY 1")
cy("cy_cross_product", "MATCH (a:Region), (b:Nation) RETURN a.name AS a, b.name AS b", "Region Nation", "", "SELECT r_name AS a, n_name AS b FROM region, nation")
cy("cy_shared_alias", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS name, COUNT(*) AS n", "Customer Supplier Nation", "IN_NATION",
   "SELECT n_name AS name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
cy("cy_optional", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {status: 'P'}) RETURN c.id AS id, COUNT(o) AS n", "Customer Order", "PLACED",
   "SELECT 'customer:' || c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")
cy("cy_optional_where", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.total > 300000 RETURN c.id AS id, COUNT(*) AS n", "Customer Order", "PLACED",
   "SELECT 'customer:' || c_custkey AS id, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000 GROUP BY 1")
cy("cy_exists", "MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(:Order {priority: '1-URGENT'}) } RETURN c.id AS id", "Customer Order", "PLACED", "SELECT 'customer:' || c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
cy("cy_not_exists", "MATCH (c:Customer) WHERE NOT EXISTS { (c)-[:PLACED]->(:Order {status: 'P'}) } RETURN c.id AS id", "Customer Order", "PLACED", "SELECT 'customer:' || c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
cy("cy_exists_or", "MATCH (c:Customer) WHERE c.balance < 0 OR EXISTS { (c)-[:PLACED]->(:Order {status: 'P'}) } RETURN c.id AS id", "Customer Order", "PLACED", "SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
_HOPS = "WITH e AS (SELECT DISTINCT event_type AS s, nx AS t FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NOT NULL), k AS (SELECT DISTINCT event_type AS v FROM events)"
cy("cy_varlen_1_2", "MATCH (a:EventType)-[:NEXT*1..2]->(b:EventType) RETURN a.name AS a, b.name AS b, COUNT(*) AS n", "", "", _HOPS + " SELECT a, b, count(*) AS n FROM (SELECT s AS a, t AS b FROM e UNION ALL SELECT x.s, y.t FROM e x JOIN e y ON x.t = y.s WHERE NOT (x.s = y.s AND x.t = y.t)) GROUP BY 1, 2", event_graph)
cy("cy_varlen_0_2", "MATCH (a:EventType)-[:NEXT*0..2]->(b:EventType) RETURN a.name AS a, b.name AS b, COUNT(*) AS n", "", "", _HOPS + " SELECT a, b, count(*) AS n FROM (SELECT v AS a, v AS b FROM k UNION ALL SELECT s AS a, t AS b FROM e UNION ALL SELECT x.s, y.t FROM e x JOIN e y ON x.t = y.s WHERE NOT (x.s = y.s AND x.t = y.t)) GROUP BY 1, 2", event_graph)
cy("cy_varlen_undirected", "MATCH (a:EventType)-[:NEXT*2..2]-(b:EventType) RETURN a.name AS a, b.name AS b, COUNT(*) AS n", "", "", _HOPS + ", u AS (SELECT s, t, s AS f, t AS g FROM e UNION ALL SELECT s, t, t, s FROM e WHERE s <> t) SELECT x.f AS a, y.g AS b, count(*) AS n FROM u x JOIN u y ON x.g = y.f WHERE NOT (x.s = y.s AND x.t = y.t) GROUP BY 1, 2", event_graph)
cy("cy_agg_all", "MATCH (p:Part) RETURN p.brand AS brand, COUNT(p) AS n, SUM(p.size) AS s, AVG(p.size) AS a, MIN(p.name) AS i, MAX(p.price) AS x", "Part", "", "SELECT p_brand AS brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, avg(p_size) AS a, min(p_name) AS i, max(p_retailprice) AS x FROM part GROUP BY 1")
cy("cy_agg_distinct", "MATCH (p:Part) RETURN COUNT(DISTINCT p.name) AS n, SUM(DISTINCT p.size) AS s, AVG(DISTINCT p.size) AS a", "Part", "", "SELECT count(DISTINCT p_name) AS n, CAST(sum(DISTINCT p_size) AS BIGINT) AS s, avg(DISTINCT p_size) AS a FROM part")
cy("cy_agg_empty", "MATCH (p:Part {name: 'no such part'}) RETURN COUNT(*) AS n, SUM(p.size) AS s, MAX(p.size) AS x", "Part", "", "SELECT count(*) AS n, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS s, CAST(max(p_size) AS BIGINT) AS x FROM part WHERE p_name = 'no such part'")
cy("cy_with_having", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c.name AS name, COUNT(o) AS n WHERE n > 15 RETURN name, n", "Customer Order", "PLACED", "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 15")
cy("cy_with_order_limit", "MATCH (c:Customer) WITH c.id AS id, c.balance AS balance ORDER BY balance DESC, id LIMIT 20 RETURN id, balance", "Customer", "", "SELECT 'customer:' || c_custkey AS id, c_acctbal AS balance FROM customer ORDER BY 2 DESC, 1 LIMIT 20")
cy("cy_with_distinct", "MATCH (p:Part) WITH DISTINCT p.brand AS brand, p.type AS type RETURN brand, COUNT(*) AS n", "Part", "", "SELECT p_brand AS brand, count(DISTINCT p_type) AS n FROM part GROUP BY 1")
cy("cy_unwind", "UNWIND ['AFRICA', 'ASIA'] AS x MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WHERE r.name = x RETURN x, n.name AS name", "Region Nation", "IN_REGION", "SELECT r_name AS x, n_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_name IN ('AFRICA', 'ASIA')")
cy("cy_union", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.name AS name UNION MATCH (n:Nation) RETURN n.name AS name", "Customer Nation", "IN_NATION", "SELECT n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT n_name FROM nation")
cy("cy_union_all", "MATCH (r:Region) RETURN r.name AS name UNION ALL MATCH (n:Nation) RETURN n.name AS name UNION ALL MATCH (r:Region) RETURN r.name AS name", "Region Nation", "", "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region")
cy("cy_union_mixed", "MATCH (r:Region) RETURN r.name AS name UNION ALL MATCH (r:Region) RETURN r.name AS name UNION MATCH (n:Nation) RETURN n.name AS name", "Region Nation", "", "SELECT r_name AS name FROM region UNION SELECT n_name FROM nation")
cy("cy_order_skip_limit", "MATCH (o:Order) RETURN o.id AS id, o.total AS total ORDER BY o.total DESC, o.id SKIP 10 LIMIT 25", "Order", "", "SELECT 'order:' || o_orderkey AS id, o_totalprice AS total FROM orders ORDER BY 2 DESC, 1 LIMIT 25 OFFSET 10")
cy("cy_order_nulls", "MATCH (n:Customer|Supplier) RETURN n.segment AS segment, n.id AS id ORDER BY n.segment, n.id LIMIT 40", "Customer Supplier", "", "SELECT * FROM (SELECT c_mktsegment AS segment, 'customer:' || c_custkey AS id FROM customer UNION ALL SELECT NULL, 'supplier:' || s_suppkey FROM supplier) ORDER BY segment NULLS FIRST, id LIMIT 40")
cy("fn_strings", "MATCH (p:Part) RETURN p.id AS id, toUpper(p.name) AS u, size(p.name) AS n, reverse(p.brand) AS r, substring(p.name, 2, 3) AS s, left(p.name, 4) AS l, right(p.name, 3) AS e, replace(p.brand, '#', '-') AS q, trim(p.name) AS w", "Part", "",
   "SELECT 'part:' || p_partkey AS id, upper(p_name) AS u, length(p_name) AS n, reverse(p_brand) AS r, substr(p_name, 3, 3) AS s, left(p_name, 4) AS l, right(p_name, 3) AS e, replace(p_brand, '#', '-') AS q, trim(p_name) AS w FROM part")
cy("fn_convert", "MATCH (p:Part) RETURN p.id AS id, toInteger(p.price) AS i, toFloat(p.size) AS f, toString(p.size) AS s, toInteger(p.name) AS bad, toBoolean('TRUE') AS b, toString(coalesce(p.missing, p.brand)) AS c", "Part", "",
   "SELECT 'part:' || p_partkey AS id, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS DOUBLE) AS f, CAST(p_size AS VARCHAR) AS s, CAST(NULL AS BIGINT) AS bad, true AS b, p_brand AS c FROM part")
cy("fn_entity", "MATCH (a:Nation)-[r:IN_REGION]->(b:Region) RETURN id(a) AS a, type(r) AS k, id(r) AS d, id(b) AS b", "Nation Region", "IN_REGION", "SELECT 'nation:' || n_nationkey AS a, 'IN_REGION' AS k, '' AS d, 'region:' || n_regionkey AS b FROM nation")
cy("cy_edge_props", "MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE toFloat(r.quantity) >= 49 RETURN p.brand AS brand, COUNT(*) AS n", "Order Part", "CONTAINS", "SELECT p_brand AS brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 49 GROUP BY 1")


@add("cy_collect", "SELECT r_name AS name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def _(s, d):
    df = compile_query(commerce(s, d, {"Region", "Nation"}, {"IN_REGION"}), "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.name AS name, COLLECT(n.name) AS nations")
    return df.withColumn("nations", F.array_join(F.array_sort("nations"), ","))


# -- summaries
_EDGES = "(SELECT 'customer:' || o_custkey AS s, 'order:' || o_orderkey AS t, 'PLACED' AS k FROM orders UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'IN_NATION' FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IN_NATION' FROM supplier)"


def _view(s, d) -> GraphView:
    return commerce(s, d, {"Customer", "Order", "Nation", "Supplier"}, {"PLACED", "IN_NATION"})


add("degree", f"SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT s AS id, 0 AS i, 1 AS o FROM {_EDGES} UNION ALL SELECT t, 1, 0 FROM {_EDGES}) GROUP BY 1")(lambda s, d: _view(s, d).degrees())
add("define_counts", "SELECT 'customer:' || o_custkey AS id, count(*) AS defined FROM orders GROUP BY 1")(lambda s, d: summary.define_counts(_view(s, d), "PLACED"))
add("graph_schema", "SELECT 'node' AS element, 'Customer' AS name, count(*) AS n, 'balance,segment' AS keys FROM customer UNION ALL SELECT 'node', 'Order', count(*), 'priority,status,total' FROM orders UNION ALL SELECT 'node', 'Nation', count(*), '' FROM nation UNION ALL SELECT 'node', 'Supplier', count(*), 'balance' FROM supplier"
    " UNION ALL SELECT 'edge', 'PLACED', count(*), '' FROM orders UNION ALL SELECT 'edge', 'IN_NATION', (SELECT count(*) FROM customer) + count(*), '' FROM supplier")(lambda s, d: summary.graph_schema(_view(s, d)).withColumn("keys", F.array_join("keys", ",")))  # fmt: skip
add("architecture_edge_types", f"SELECT k AS kind, count(*) AS n FROM {_EDGES} GROUP BY 1")(lambda s, d: summary.edge_types(_view(s, d)))
add("architecture_modules", "SELECT 'customer:' || c_custkey AS id, 'customer:' || c_custkey AS qualified_name, count(o_orderkey) AS defined FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")(lambda s, d: summary.modules(_view(s, d), "Customer", "PLACED"))
add("architecture_ranked", "SELECT 'nation:' || n_nationkey AS id, 'Nation' AS label, 'nation:' || n_nationkey AS qualified_name, n AS degree, n AS in_degree, CAST(0 AS BIGINT) AS out_degree FROM (SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation)")(lambda s, d: summary.ranked_by_degree(_view(s, d), ["Nation"]))
add("index_status", f"SELECT CAST(0 AS BIGINT) AS files, (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS nodes, (SELECT count(*) FROM {_EDGES}) AS edges")(lambda s, d: summary.status(_view(s, d)))
add("dead_code", "SELECT 'order:' || o_orderkey AS id, 'single' AS status FROM orders UNION ALL SELECT 'customer:' || c_custkey, 'dead' FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'dead' FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'dead' FROM supplier")(lambda s, d: summary.dead_code(_view(s, d), "PLACED"))


@add("layout_coords", "WITH k AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS DOUBLE) AS i, CAST(count(*) OVER () AS DOUBLE) AS n FROM (SELECT 'region:' || r_regionkey AS id FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation)), g AS (SELECT id, count(*) AS c FROM (SELECT 'region:' || n_regionkey AS id FROM nation UNION ALL SELECT 'nation:' || n_nationkey FROM nation) GROUP BY 1),"
     " y AS (SELECT k.*, 1 - 2 * (i + 0.5) / n AS h, i * (pi() * (3 - sqrt(5))) AS a FROM k) SELECT y.id, round(cos(a) * sqrt(1 - h * h) * cbrt(n), 4) AS x, round(h * cbrt(n), 4) AS y, round(sin(a) * sqrt(1 - h * h) * cbrt(n), 4) AS z, round(1 + ln(coalesce(c, 0) + 1.0), 4) AS size, coalesce(c, 0) AS degree, CAST(0 AS BIGINT) AS callers FROM y LEFT JOIN g ON y.id = g.id")  # fmt: skip
def _(s, d):
    out = summary.layout(commerce(s, d, {"Region", "Nation"}, {"IN_REGION"}))
    return out.withColumns({c: F.round(c, 4) for c in ("x", "y", "z", "size")})


_KEPT = "SELECT id FROM (SELECT 'customer:' || c_custkey AS id FROM customer UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'order:' || o_orderkey FROM orders UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier) ORDER BY id LIMIT 5000"


@add("layout_coords_all", f"WITH m AS MATERIALIZED ({_KEPT}), k AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS DOUBLE) AS i, CAST(count(*) OVER () AS DOUBLE) AS n FROM m), e AS (SELECT s, t FROM {_EDGES} WHERE s IN (SELECT id FROM m) AND t IN (SELECT id FROM m)), g AS (SELECT id, count(*) AS c FROM (SELECT s AS id FROM e UNION ALL SELECT t FROM e) GROUP BY 1),"
     " y AS (SELECT k.*, 1 - 2 * (i + 0.5) / n AS h, i * (pi() * (3 - sqrt(5))) AS a FROM k) SELECT y.id, round(cos(a) * sqrt(1 - h * h) * cbrt(n), 4) AS x, round(h * cbrt(n), 4) AS y, round(sin(a) * sqrt(1 - h * h) * cbrt(n), 4) AS z, round(1 + ln(coalesce(c, 0) + 1.0), 4) AS size, coalesce(c, 0) AS degree, CAST(0 AS BIGINT) AS callers FROM y LEFT JOIN g ON y.id = g.id")  # fmt: skip
def _(s, d):
    """A view with more nodes than the budget, from 0.01 on."""
    return summary.layout(_view(s, d)).withColumns({c: F.round(c, 4) for c in ("x", "y", "z", "size")})


# -- search
@add("search_filters", "SELECT 'customer:' || c_custkey AS id, n + 1 AS degree FROM (SELECT c_custkey, c_name, count(o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) WHERE n + 1 >= 8 AND regexp_matches(c_name, '#0000.*[13579]$')")
def _(s, d):
    return search.search_filter(_view(s, d), search.SearchRequest(name_pattern="#0000.*[13579]$", label="Customer", relationship="PLACED", min_degree=8)).select("id", "degree")


@add("search_page2", "SELECT 'supplier:' || s_suppkey AS id, s_name AS name FROM supplier ORDER BY 1 LIMIT 20 OFFSET 20")
def _(s, d):
    view = commerce(s, d, {"Supplier"}, {"IN_NATION"})
    first = search.SearchRequest(label="Supplier", limit=20)
    again = search.SearchRequest(label="Supplier", limit=20, cursor=first.next_cursor(1 << 40))
    return search.ranked(search.search_filter(view, again), again).offset(again.start()).limit(again.limit).select("id", "name")


add("resolve_symbol", "SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_name = 'Customer#000000042'")(lambda s, d: search.resolve_symbol(commerce(s, d, {"Customer"}, {"IN_NATION"}), "Customer#000000042").select("id"))
add("connected_names", "SELECT 'nation:' || n_nationkey AS id, r_name AS connected FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'region:' || r_regionkey, string_agg(n_name, ',' ORDER BY n_name) FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")(
    lambda s, d: search.connected_names(commerce(s, d, {"Region", "Nation"}, {"IN_REGION"}), "IN_REGION").withColumn("connected", F.array_join("connected", ","))
)
add("search_bm25", "WITH h AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS t FROM documents), c AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x = 'license')) AS a, len(list_filter(t, lambda x: x = 'the')) AS b FROM h),"
    " s AS (SELECT count(*) AS docs, avg(n) AS av, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS da, sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS db FROM c) SELECT doc_id, round(-(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (1 - 0.75 + 0.75 * n / av)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (1 - 0.75 + 0.75 * n / av))), 4) AS score FROM c, s WHERE a > 0 AND b > 0")(
    lambda s, d: search.bm25(t(s, d, "documents"), "doc_id", "text", ["License", "the"]).withColumn("score", F.round("score", 4))
)

# -- traversal


def _seed(s, key: str, level: bool = False) -> DataFrame:
    out = s.range(1).select(F.lit(key).alias("id"))
    return out.withColumn("level", F.lit(0)) if level else out


for _dir, _sql in (
    ("outbound", "WITH RECURSIVE r(c, h) AS (SELECT 'customer:7', 0 UNION ALL SELECT e.t, h + 1 FROM r JOIN e ON e.s = r.c WHERE h < 3)"),
    ("inbound", "WITH RECURSIVE r(c, h) AS (SELECT 'nation:3', 0 UNION ALL SELECT e.s, h + 1 FROM r JOIN e ON e.t = r.c WHERE h < 3)"),
):
    ORACLE_SQL[f"trace_{_dir}"] = _sql.replace("WITH RECURSIVE ", f"WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), ") + " SELECT c AS id, CAST(min(h) AS INTEGER) AS hop FROM r GROUP BY c HAVING min(h) > 0"
    QUERIES[f"trace_{_dir}"] = lambda s, d, _dir=_dir: traverse.trace(_view(s, d), _seed(s, "customer:7" if _dir == "outbound" else "nation:3"), _dir, 3).select("id", "hop")
add("trace_both", "SELECT 'nation:' || n_nationkey AS id, 1 AS hop FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'supplier:' || s_suppkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1")(
    lambda s, d: traverse.trace(commerce(s, d, {"Region", "Nation", "Supplier"}, {"IN_REGION", "IN_NATION"}), _seed(s, "region:1"), "both", 2).select("id", "hop")
)
add("impact", "SELECT 'nation:3' AS id, 0 AS level UNION ALL SELECT 'customer:' || c_custkey, 1 FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'supplier:' || s_suppkey, 1 FROM supplier WHERE s_nationkey = 3")(
    lambda s, d: traverse.impact(_view(s, d), _seed(s, "nation:3", True), 2)
)

# -- text
add("code_search_lines", "SELECT doc_id AS path, i AS line, content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(content, 'License.*Version')")(
    lambda s, d: text.line_matches(t(s, d, "documents"), "License Version", path="doc_id").withColumn("line", F.col("line").cast("long"))
)
add("dir_distribution", "SELECT source || '/' AS directory, count(*) AS n FROM (SELECT source, unnest(string_split(text, chr(10))) AS content FROM documents) WHERE regexp_matches(content, 'icensed under') GROUP BY 1")(
    lambda s, d: text.directories(text.line_matches(t(s, d, "documents").withColumn("path", F.concat_ws("/", "source", "doc_id")), "icensed under"))
)
_TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"
add("doc_frequency_idf", f"WITH w AS (SELECT unnest(list_distinct({_TOK})) AS token FROM benchmark), f AS (SELECT token, count(*) AS df FROM w GROUP BY 1) SELECT token, df, CAST(round(greatest(0, ln(((SELECT count(*) FROM benchmark) + 1) / (df + 1)) + 1) * 1000) AS BIGINT) AS idf_milli FROM f")(
    lambda s, d: text.document_frequency(t(s, d, "benchmark"), "item_id", search.tokens(F.col("text")))
)
add("tfidf_topk", f"WITH w AS (SELECT item_id, unnest({_TOK}) AS token FROM benchmark), tf AS (SELECT item_id, token, count(*) AS tf FROM w GROUP BY 1, 2), f AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), x AS (SELECT item_id, tf.token, tf * CAST(round(greatest(0, ln(((SELECT count(*) FROM benchmark) + 1) / (df + 1)) + 1) * 1000) AS BIGINT) / 1000.0::DOUBLE AS w FROM tf JOIN f ON tf.token = f.token),"
    " z AS (SELECT item_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM x) SELECT item_id, token, round(weight, 5) AS weight, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(weight, 6) DESC, token) AS rank FROM z) WHERE rank <= 3")(
    lambda s, d: text.top_terms(text.tfidf(t(s, d, "benchmark"), "item_id", search.tokens(F.col("text"))), "item_id", 3).withColumn("weight", F.round("weight", 5))
)
add("snippet_chunks", "SELECT item_id, CAST(i AS INTEGER) AS start, substr(text, i + 1, 256) AS piece FROM (SELECT item_id, text, unnest(range(0, greatest(1, length(text)), 256)) AS i FROM benchmark)")(
    lambda s, d: t(s, d, "benchmark").select("item_id", F.explode(text.chunks(F.col("text"), 256)).alias("c")).select("item_id", "c.start", "c.piece")
)

# the same over the corpus itself
add("doc_frequency_idf_all", ORACLE_SQL["doc_frequency_idf"].replace("benchmark", "documents"))(lambda s, d: text.document_frequency(t(s, d, "documents"), "doc_id", search.tokens(F.col("text"))))
add("tfidf_topk_all", ORACLE_SQL["tfidf_topk"].replace("benchmark", "documents").replace("item_id", "doc_id"))(
    lambda s, d: text.top_terms(text.tfidf(t(s, d, "documents"), "doc_id", search.tokens(F.col("text"))), "doc_id", 3).withColumn("weight", F.round("weight", 5))
)
add("snippet_chunks_all", ORACLE_SQL["snippet_chunks"].replace("benchmark", "documents").replace("item_id", "doc_id"))(
    lambda s, d: t(s, d, "documents").select("doc_id", F.explode(text.chunks(F.col("text"), 256)).alias("c")).select("doc_id", "c.start", "c.piece")
)


@add("tightest_span", "SELECT event_id AS path, k AS line, CASE WHEN k BETWEEN 10 AND 20 THEN 'in' WHEN k <= 50 THEN 'out' END AS span_id FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def _(s, d):
    lines = t(s, d, "events").select(F.col("event_id").cast("string").alias("path"), F.get_json_object("props", "$.k").cast("long").alias("line"))
    spans = t(s, d, "events").select(F.col("event_id").cast("string").alias("file_path"), F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(a).cast("long").alias("start_line"), F.lit(b).cast("long").alias("end_line")) for i, a, b in (("out", 0, 50), ("in", 10, 20))])).alias("x")).select("file_path", "x.*")
    return text.tightest_span(lines, spans).withColumn("path", F.col("path").cast("long"))


# -- vectors
_Q = "list_transform(embedding, lambda x: CAST(trunc(least(127, greatest(-127, CAST(x AS DOUBLE) * 127))) AS INTEGER))"
add("vector_quantise", f"SELECT vec_id, array_to_string({_Q}, ',') AS q FROM embeddings")(lambda s, d: t(s, d, "embeddings").select("vec_id", F.array_join(F.transform(vectors.quantise(F.col("embedding")), lambda x: x.cast("string")), ",").alias("q")))


@add("semantic_min_cosine", f"WITH q AS (SELECT vec_id, {_Q} AS v FROM embeddings), k AS (SELECT list_transform(range(0, 64), lambda i: CASE WHEN i % 2 = 0 THEN 127 ELSE 0 END) AS a, list_transform(range(0, 64), lambda i: CASE WHEN i < 32 THEN 127 ELSE -127 END) AS b),"
     " s AS (SELECT vec_id, list_dot_product(v::DOUBLE[], a::DOUBLE[]) / (sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[])) * sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[]))) AS x, list_dot_product(v::DOUBLE[], b::DOUBLE[]) / (sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[])) * sqrt(list_dot_product(b::DOUBLE[], b::DOUBLE[]))) AS y FROM q, k)"
     " SELECT vec_id, round(least(x, y), 5) AS score FROM (SELECT * FROM s ORDER BY x DESC, vec_id LIMIT 50) ORDER BY least(x, y) DESC, vec_id LIMIT 10")  # fmt: skip
def _(s, d):
    v = t(s, d, "embeddings").select("vec_id", vectors.quantise(F.col("embedding")).alias("vector"))
    a, b = [127 if i % 2 == 0 else 0 for i in range(64)], [127 if i < 32 else -127 for i in range(64)]
    return vectors.semantic_search(v, [a, b], 10, "vec_id").withColumn("score", F.round("score", 5))


@add("minhash_similarity")
def _(s, d):
    """The documents whose id is divisible by 50 are the queries, and are searched among all documents."""
    signed = lambda df: vectors.minhash(df, "doc_id", search.tokens(F.col("text")))
    docs = t(s, d, "documents")
    return vectors.similar_pairs(signed(docs.filter("doc_id % 50 = 0")), signed(docs), "doc_id")


# -- enrichment
add("route_canonical", r"SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS route FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '(.)/+$', '\1') AS p FROM pages)")(
    lambda s, d: t(s, d, "pages").select("page_id", enrich.canonical_route(F.col("url")).alias("route"))
)


_P = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '\$?\{[^}/]*\}|<[^>/]*>|:[A-Za-z_][A-Za-z0-9_]*', '{}', 'g'), '(.)/+$', '\1')"


@add("cross_route_link_all", f"WITH p AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, CASE WHEN {_P} = '' THEN '/' ELSE {_P} END AS path FROM pages)"
     " SELECT a.page_id AS caller, a.host AS project, b.host AS remote, min(b.page_id) AS handler, 0 AS priority FROM p a JOIN p b ON a.path = b.path AND a.host <> b.host GROUP BY 1, 2, 3")  # fmt: skip
def _(s, d):
    """Every page is linked on its whole path, with the first page of each other host that has it."""
    host = F.element_at(F.split(F.element_at(F.split("url", "://"), 2), "/"), 1)
    p = t(s, d, "pages").select("page_id", host.alias("project"), F.lit("GET").alias("method"), enrich.canonical_route(F.col("url")).alias("path"))
    return enrich.cross_routes(p.withColumnRenamed("page_id", "caller"), p.groupBy("project", "method", "path").agg(F.min("page_id").alias("handler")))


@add("data_flows", "SELECT DISTINCT 'customer:' || a.c_custkey AS source, 'supplier:' || s_suppkey AS target, 'nation:' || c_nationkey AS route FROM customer a JOIN supplier ON s_nationkey = c_nationkey")
def _(s, d):
    e = commerce(s, d, {"Nation"}, {"IN_NATION"}).edges
    return enrich.data_flows(e.withColumn("kind", F.when(F.col("source").startswith("customer"), "HTTP_CALLS").otherwise("HANDLES")))


add("config_link", "SELECT k.n AS key, p_partkey AS id, CASE WHEN regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g') = k.n THEN 0.85::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM part, (SELECT 'redring' AS n UNION ALL SELECT 'bolt') k WHERE contains(lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')), k.n)")(
    lambda s, d: enrich.config_links(s.range(1).select(F.explode(F.array(F.lit("redring"), F.lit("bolt"))).alias("key")), t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))).withColumn("confidence", F.col("confidence").cast("double"))
)
add("manifest_link", "SELECT DISTINCT source || '/' || lang AS module, source AS manifest FROM documents UNION SELECT DISTINCT source, source FROM documents")(
    lambda s, d: enrich.package_links(t(s, d, "documents").select(F.explode(F.array("source", F.concat_ws("/", "source", "lang"))).alias("module")).distinct(), t(s, d, "documents").select(F.col("source").alias("name"), F.col("source").alias("manifest")).distinct())
)


@add("next_definition", "SELECT user_id AS file, event_id AS at, (SELECT min(x.event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.event_id >= e.event_id) AS id FROM events e WHERE event_type = 'click'")
def _(s, d):
    e = t(s, d, "events")
    out = enrich.next_definition(e.filter("event_type = 'click'").select(F.col("user_id").alias("file"), F.col("event_id").alias("at")), e.filter("event_type = 'error'").select(F.col("user_id").alias("file"), F.col("event_id").alias("start"), F.col("event_id").cast("string").alias("id")))
    return out.withColumn("id", F.col("id").cast("long"))


def _commits(s, d) -> DataFrame:
    return t(s, d, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_linenumber").cast("long").alias("ts"), F.concat(F.lit("brand"), F.pmod("l_partkey", F.lit(40)).cast("string")).alias("path"))


_C = "WITH c AS (SELECT DISTINCT l_orderkey AS sha, 'brand' || (l_partkey % 40) AS path FROM lineitem), n AS (SELECT path, count(*) AS n FROM c GROUP BY 1)"
add("cochange", _C + " SELECT a, b, together, round(together / least(x.n, y.n), 6) AS score FROM (SELECT p.path AS a, q.path AS b, count(*) AS together FROM c p JOIN c q ON p.sha = q.sha AND p.path < q.path GROUP BY 1, 2 HAVING count(*) >= 3) g JOIN n x ON x.path = a JOIN n y ON y.path = b WHERE together / least(x.n, y.n) >= 0.01")(
    lambda s, d: enrich.co_changes(_commits(s, d), score=0.01).withColumn("score", F.round("score", 6))
)
add("file_history", _C + " SELECT path, n AS changes FROM n")(lambda s, d: enrich.file_history(_commits(s, d)).select("path", "changes"))


@add("runtime_traces", "SELECT event_type AS caller, nx AS callee, count(*) AS count FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    nx = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return enrich.runtime_traces(t(s, d, "events").select(F.col("event_type").alias("caller"), nx.alias("callee"), F.lit(None).cast("long").alias("count")))


@add("call_resolution_all", "WITH s AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'own' || c_custkey ELSE 'run' || (c_custkey % 50) END AS name FROM customer), u AS (SELECT name FROM s GROUP BY 1 HAVING count(*) = 1)"
     " SELECT o_orderkey AS call_id, CAST(o_custkey AS VARCHAR) AS target, CASE left(o_orderpriority, 1) WHEN '1' THEN 'receiver' WHEN '2' THEN 'import' WHEN '3' THEN 'container' WHEN '4' THEN 'suffix' ELSE 'unique' END AS strategy FROM orders JOIN s ON c_custkey = o_custkey WHERE o_orderpriority <> '5-LOW' OR name IN (SELECT name FROM u)")  # fmt: skip
def _(s, d):
    """All orders as calls of their customer's symbol; the priority says by what it can be known: its receiver, its file's
    import, its container, its dotted name, or the name alone, which leaves a call of a shared name unresolved."""
    key = F.col("c_custkey").cast("string")
    own = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("own"), key)).otherwise(F.concat(F.lit("run"), F.pmod("c_custkey", F.lit(50)).cast("string")))
    customers = t(s, d, "customer").select("c_custkey", key.alias("id"), F.concat(F.lit("m"), key).alias("type"), own.alias("name")).withColumn("container", F.concat_ws(".", F.lit("pkg"), "type"))
    symbols = customers.select("id", F.lit("f").alias("file"), "container", "name", F.concat_ws(".", "container", "name").alias("qualified_name"))
    kind, other = F.substring("o_orderpriority", 1, 1), F.concat(F.lit("pkg.m"), (F.col("o_custkey") + 50).cast("string"))  # often of the same name, but not the one meant
    calls = t(s, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("call_id"), F.when(kind == "2", F.concat(F.lit("g"), "id")).otherwise("f").alias("file"), F.when(kind == "3", F.col("container")).when(kind.isin("1", "2"), other).alias("container"),
        F.when(kind == "4", F.concat_ws(".", "type", "name")).otherwise(F.col("name")).alias("name"), F.when(kind == "1", F.col("type")).when(kind == "5", F.lit("absent")).alias("receiver"),
    )
    return enrich.resolve_calls(calls, symbols, customers.select(F.concat(F.lit("g"), "id").alias("file"), F.col("container").alias("module_path")))


@add("set_diff_all", "SELECT doc_id AS path, CASE WHEN lang = 'es' THEN 'deleted' WHEN source IN ('src1', 'src2') THEN 'changed' ELSE 'unchanged' END AS change FROM documents UNION ALL SELECT -1 - doc_id, 'new' FROM documents WHERE lang = 'fr'")
def _(s, d):
    """All documents against a state in which those of one language are gone, those of two sources are others, and copies
    of those of another language have been added."""
    from plexloom.sources.store import classify_files

    docs = t(s, d, "documents")
    new = docs.filter("lang <> 'es'").select(F.col("doc_id").alias("path"), F.md5(F.when(F.col("source").isin("src1", "src2"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    added = docs.filter("lang = 'fr'").select((-1 - F.col("doc_id")).alias("path"), F.md5("text").alias("content_hash"))
    return classify_files(docs.select(F.col("doc_id").alias("path"), F.md5("text").alias("content_hash")), new.unionByName(added))
