"""Further queries of the graph engine: typed properties, search, changes, passes that derive edges, names and lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plexloom.graph import GraphView, commerce, event_graph
from plexloom.operators import derive, enrich, names, search, summary, text, traverse, vectors
from plexloom.plans.queries import _EDGES, _HOPS, ORACLE_SQL, _view, add, cy, t
from plexloom.sources import repository
from plexloom.sources.store import Store
from plexloom.streaming import traces

# -- properties of the type that each row gives them
cy("cy_json_numbers", "MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE r.quantity >= 45 AND r.price < 70000 WITH p.brand AS brand, MAX(r.price) AS top, MIN(r.quantity) AS least, COUNT(*) AS n RETURN brand, toFloat(top) AS top, toFloat(least) AS least, n", "Order Part", "CONTAINS",
   "SELECT p_brand AS brand, max(l_extendedprice) AS top, CAST(min(l_quantity) AS DOUBLE) AS least, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 45 AND l_extendedprice < 70000 GROUP BY 1")
cy("cy_json_order", "MATCH (o:Order)-[r:CONTAINS]->(p:Part) RETURN p.id AS id, toFloat(r.price) AS price ORDER BY r.price DESC, p.id LIMIT 25", "Order Part", "CONTAINS",
   "SELECT 'part:' || l_partkey AS id, l_extendedprice AS price FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey ORDER BY 2 DESC, 1 LIMIT 25")
cy("cy_json_text_number", "MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE r.quantity > '48' AND r.quantity <> 'many' RETURN COUNT(*) AS n, COUNT(DISTINCT r.quantity) AS d", "Order Part", "CONTAINS",
   "SELECT count(*) AS n, count(DISTINCT l_quantity) AS d FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 48")
cy("cy_unwind_computed", "UNWIND split('AFRICA,EUROPE,MARS', ',') AS x MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WHERE r.name = x RETURN x, COUNT(n) AS n", "Region Nation", "IN_REGION", "SELECT r_name AS x, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_name IN ('AFRICA', 'EUROPE') GROUP BY 1")
cy("cy_optional_rebound", "MATCH (r:Region) OPTIONAL MATCH (r)<-[:IN_REGION]-(n:Nation {id: 'nation:3'}) MATCH (n)-[:IN_REGION]->(x:Region) RETURN r.name AS r, n.name AS n, x.name AS x", "Region Nation", "IN_REGION",
   "SELECT r.r_name AS r, n_name AS n, x.r_name AS x FROM region r JOIN nation ON CASE WHEN r.r_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3) THEN n_nationkey = 3 ELSE true END JOIN region x ON x.r_regionkey = n_regionkey")
cy("cy_repeated_alias", "MATCH (a:EventType)-[:NEXT]->(a) RETURN a.name AS name", "", "", _HOPS + " SELECT s AS name FROM e WHERE s = t", event_graph)
cy("fn_more", "MATCH (p:Part) RETURN p.id AS id, toLower(p.brand) AS w, size(split(p.name, ' ')) AS n, ltrim(p.name) AS l, rtrim(p.type) AS r, toBoolean(p.size) AS b, toInteger(p.brand) AS bad, labels(p) AS labels", "Part", "",
   "SELECT 'part:' || p_partkey AS id, lower(p_brand) AS w, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n, ltrim(p_name) AS l, rtrim(p_type) AS r, p_size <> 0 AS b, CAST(NULL AS BIGINT) AS bad, ['Part'] AS labels FROM part")

# -- search
_TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"
_BM = "ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * {i} * 2.2 / ({i} + 1.2 * (1 - 0.75 + 0.75 * n / av))"
_COUNTS = f"WITH h AS (SELECT doc_id, {_TOK} AS t FROM documents), c AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: starts_with(x, 'licens'))) AS a, len(list_filter(t, lambda x: x = 'apache')) AS b, len(list_filter(t, lambda x: x = 'license')) AS e, len(list_filter(t, lambda x: x = 'the')) AS f FROM h), s AS (SELECT count(*) AS docs, avg(n) AS av, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db, count(*) FILTER (WHERE e > 0) AS de, count(*) FILTER (WHERE f > 0) AS df FROM c)"
add("search_text_prefix", f"{_COUNTS} SELECT doc_id, round(-({_BM.format(i='a')}), 4) AS score FROM c, s WHERE a > 0 AND b = 0")(
    lambda s, d: search.text_search(t(s, d, "documents"), "doc_id", "text", "licens* NOT Apache").withColumn("score", F.round("score", 4))
)


def _scratch(s) -> str:
    return f"{traverse.scratch(s)}/{uuid.uuid4().hex}"


@add("search_text_index", f"{_COUNTS} SELECT doc_id, round(-({_BM.format(i='e')} + {_BM.format(i='f')}), 4) AS score FROM c, s WHERE e > 0 AND f > 0")
def _(s, d):
    """By the inverted index, made once: a query reads the postings of its terms."""
    path = _scratch(s)
    search.build_text_index(t(s, d, "documents"), "doc_id", "text", path)
    return search.search_text_index(s, path, "doc_id", "license AND the").withColumn("score", F.round("score", 4))


@add("search_graph_text", "SELECT 'part:' || p_partkey AS id, degree FROM (SELECT p_partkey, p_name, count(l_orderkey) AS degree FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2) WHERE (contains(p_name, 'red') AND contains(p_name, 'ring') OR contains(p_name, 'gear')) AND degree >= 20")
def _(s, d):
    view = commerce(s, d, {"Part", "Order"}, {"CONTAINS"})
    return search.search_filter(view, search.SearchRequest(query='"red ring" OR gear', label="Part", min_degree=20)).select("id", "degree")


add("trace_path", f"WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), r(c, h) AS (SELECT 'customer:42', 0 UNION ALL SELECT e.t, h + 1 FROM r JOIN e ON e.s = r.c WHERE h < 2) SELECT c AS id, CAST(min(h) AS INTEGER) AS hop FROM r GROUP BY c HAVING min(h) > 0")(
    lambda s, d: traverse.trace_path(_view(s, d), "Customer#000000042", "outbound", 2)[0].select("id", "hop")
)
add("impact_levels", "SELECT 'region:1' AS id, 0 AS level UNION ALL SELECT 'nation:' || n_nationkey, 1 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'customer:' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'supplier:' || s_suppkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1")(
    lambda s, d: traverse.impact(commerce(s, d, {"Region", "Nation", "Customer", "Supplier"}, {"IN_REGION", "IN_NATION"}), s.range(1).select(F.lit("region:1").alias("id"), F.lit(0).alias("level")), 3)
)


@add("detect_changes", "SELECT * FROM (SELECT 'nation:' || n_nationkey AS qualified_name, 'Nation' AS label, 'r' || n_regionkey AS file, 0 AS level FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', 'r2', 1 FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'customer:' || c_custkey, 'Customer', '', CAST(n_regionkey AS INTEGER) FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey IN (1, 2)) ORDER BY 1 LIMIT 1000")
def _(s, d):
    """Nations lie in files, one a region; customers depend on them.  The file of region 2 usually changes with that of 1."""
    view = commerce(s, d, {"Nation", "Customer", "Region"}, {"IN_NATION", "IN_REGION"})
    n = t(s, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("file_path"))
    nodes = view.nodes.drop("file_path").join(n, "id", "left").withColumn("label", F.when(F.col("label") == "Region", "Folder").otherwise(F.col("label")))
    one = lambda p: s.createDataFrame([(p,)], "path string")
    return traverse.detect_changes(GraphView(nodes, view.edges), one("r1"), one("r2"))[0].select("qualified_name", "label", "file", "level")


# -- code
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents"


@add("code_search_ranked", f"WITH l AS ({_LINES}), m AS (SELECT doc_id, i FROM l WHERE regexp_matches(content, 'icense.*ersion') AND doc_id % 2 = 0 AND NOT contains(content, 'Mozilla')), x AS (SELECT doc_id, CASE WHEN i <= 3 THEN 'head' WHEN i <= 300 THEN 'body' END AS part, i FROM m),"
     " g AS (SELECT 'd' || doc_id || '.' || part AS id, count(*) AS matches, min(i) AS first, CASE part WHEN 'head' THEN 10 ELSE 15 END + doc_id % 7 - 5 AS score FROM x WHERE part IS NOT NULL GROUP BY doc_id, part) SELECT id, matches, first, CAST(score AS BIGINT) AS score FROM g ORDER BY score DESC, id LIMIT 200")  # fmt: skip
def _(s, d):
    """Every document is a file with two symbols: a head of three lines, and a route around the next 297."""
    docs = t(s, d, "documents")
    files = docs.select(F.concat(F.when(F.col("doc_id") % 2 == 0, "tests/d").otherwise("lib/d"), "doc_id").alias("path"), F.regexp_replace("text", "(?m)^.*Mozilla.*$", "").alias("text"))
    part = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(label).alias("label"), F.lit(a).cast("long").alias("start_line"), F.lit(b).cast("long").alias("end_line")) for n, label, a, b in (("head", "Function", 1, 3), ("body", "Route", 1, 300))]))
    nodes = docs.select("doc_id", part.alias("p")).select(
        F.concat(F.lit("d"), "doc_id", F.lit("."), "p.n").alias("id"), F.col("p.n").alias("name"), F.concat(F.lit("d"), "doc_id", F.lit("."), "p.n").alias("qualified_name"), "p.label",
        F.concat(F.when(F.col("doc_id") % 2 == 0, "tests/d").otherwise("lib/d"), "doc_id").alias("file_path"), "p.start_line", "p.end_line", F.pmod("doc_id", F.lit(7)).alias("in_degree"),
    )
    found = text.search_code(files, nodes, "icense ersion", glob="tests/**")["results"]
    return found.select("id", "matches", F.element_at("lines", 1).alias("first"), F.col("score").cast("long").alias("score"))


add("identifier_tokens", "SELECT p_partkey AS id, array_to_string(list_concat(string_split(lower(p_name), ' '), ['type', lower(p_type), 'index', 'configuration']), ',') AS tokens FROM part")(
    lambda s, d: t(s, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.identifier_tokens(F.concat_ws(" ", "p_name", F.concat(F.lit("type_"), F.lower("p_type")))), ",").alias("t")).select("id", F.concat("t", F.lit(",index,configuration")).alias("tokens"))
)
add("languages", "SELECT lang AS language, count(*) AS files FROM documents WHERE lang IS NOT NULL GROUP BY 1")(
    lambda s, d: summary.languages(GraphView(t(s, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("file_path"), F.to_json(F.struct(F.col("lang").alias("language"))).alias("properties")), None))
)


def _flagged(s, d) -> GraphView:
    """Customers as symbols that their orders call; flags by segment."""
    view = commerce(s, d, {"Customer"}, {"PLACED"})
    props = F.to_json(F.struct((F.col("segment") == "BUILDING").alias("is_entry_point"), (F.col("segment") == "MACHINERY").alias("is_test")))
    back = view.edges.select("project", F.col("target").alias("source"), F.col("source").alias("target"), F.lit("CALLS").alias("kind"), "discriminator", "properties")
    return GraphView(view.nodes.withColumn("properties", props), back)


_N = "(SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)"
add("dead_code_all", f"SELECT 'customer:' || c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'entry' WHEN c_mktsegment = 'MACHINERY' THEN 'test' WHEN n = 0 THEN 'dead' WHEN n = 1 THEN 'single' ELSE 'normal' END AS status FROM {_N}")(lambda s, d: summary.dead_code(_flagged(s, d)))
add("entry_points", f"SELECT 'customer:' || c_custkey AS id, n AS degree, n AS in_degree, CAST(0 AS BIGINT) AS out_degree FROM {_N} WHERE c_mktsegment = 'BUILDING'")(lambda s, d: summary.entry_points(_flagged(s, d)).select("id", "degree", "in_degree", "out_degree"))
add("layout_filter", "SELECT 'customer:' || c_custkey AS source, 'nation:' || c_nationkey AS target FROM customer")(
    lambda s, d: summary.filter_layout(_view(s, d).nodes, _view(s, d).edges, ["Customer", "Nation", "Order"], ["IN_NATION"])[1].select("source", "target")
)


# -- history
def _co(s, d):
    from plexloom.plans.queries import _commits

    return enrich.co_changes(_commits(s, d), score=0.01)


add("coupled_files", f"SELECT a, b, together FROM ({ORACLE_SQL['cochange']}) WHERE a = 'brand3' OR b = 'brand3'")(lambda s, d: enrich.coupled_files(_co(s, d), "brand3").select("a", "b", "together"))
add("git_log", "SELECT lpad(CAST(l_orderkey AS VARCHAR), 8, '0') AS sha, CAST(l_orderkey AS BIGINT) AS ts, 'p' || l_partkey || '.rs' AS path FROM lineitem")(
    lambda s, d: repository.git_log(
        t(s, d, "orders").select(F.pmod("o_orderkey", F.lit(8)).cast("string").alias("repo"), (F.col("o_orderkey") * 100).alias("n"), F.concat(F.lit("COMMIT:"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(":"), "o_orderkey").alias("value"))
        .unionByName(t(s, d, "lineitem").repartition(repository.tasks(s), "l_orderkey").join(t(s, d, "orders").select("o_orderkey").repartition(repository.tasks(s), "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").withColumn("k", F.row_number().over(_order_lines())).select(F.pmod("l_orderkey", F.lit(8)).cast("string").alias("repo"), (F.col("l_orderkey") * 100 + F.col("k")).alias("n"), F.concat(F.lit("p"), "l_partkey", F.lit(".rs")).alias("value")))
    )
)


def _order_lines():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")


_PATH = "CASE p_size % 4 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'my_vendor/' ELSE 'src/' END || p_partkey || CASE p_size % 5 WHEN 0 THEN '.min.js' ELSE '.js' END"


def _path():
    folder = F.when(F.col("p_size") % 4 == 0, "vendor/").when(F.col("p_size") % 4 == 1, "my_vendor/").otherwise("src/")
    return F.concat(folder, "p_partkey", F.when(F.col("p_size") % 5 == 0, ".min.js").otherwise(".js"))


add("name_status", f"SELECT CASE WHEN p_size > 40 THEN 'R' ELSE 'M' END AS status, {_PATH} AS path, CASE WHEN p_size > 40 THEN 'old/' || p_partkey END AS old_path FROM part WHERE p_size % 4 <> 0 AND p_size % 5 <> 0 ORDER BY p_partkey LIMIT 10000")(
    lambda s, d: repository.name_status(t(s, d, "part").select(F.col("p_partkey").alias("n"), F.when(F.col("p_size") > 40, F.concat(F.lit("R087\told/"), "p_partkey", F.lit("\t"), _path())).otherwise(F.concat(F.lit("M\t"), _path())).alias("value")))
)
add("changed_files", f"SELECT DISTINCT {_PATH} AS path FROM part WHERE p_size % 4 <> 0 AND p_size % 5 <> 0")(
    lambda s, d: repository.changed_files(t(s, d, "part").filter("p_size > 20").select(_path().alias("path")), t(s, d, "part").filter("p_size <= 30").select(F.concat(F.lit(" M "), _path(), F.lit("\0?? "), _path(), F.lit("\0")).alias("value")))
)
add("file_language", "SELECT doc_id, CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'typescript' WHEN 'fr' THEN 'dockerfile' ELSE NULL END AS language FROM documents")(
    lambda s, d: t(s, d, "documents").select("doc_id", repository.language(F.when(F.col("lang") == "en", "a/b.PY").when(F.col("lang") == "de", "x.d.ts").when(F.col("lang") == "fr", "in/Dockerfile").otherwise("README")).alias("language"))
)
add("windowed_counts", "SELECT strftime(time_bucket(INTERVAL 5 MINUTE, CAST(ts AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda s, d: traces.windowed_counts(t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
)

# -- names and calls
add("name_functions", "SELECT p_partkey AS id, p_name AS literal, CASE WHEN p_size % 3 = 0 THEN 'GET' WHEN p_size % 3 = 1 THEN 'POST' END AS method, lower(p_type) AS key, 'a.b' AS parent, 'b.' || lower(p_type) AS tail, p_size % 2 = 0 AS same FROM part")(
    lambda s, d: t(s, d, "part").select(
        F.col("p_partkey").alias("id"), names.first_literal(F.concat(F.lit("run("), F.lit('"'), "p_name", F.lit("\", 'x')"))).alias("literal"),
        names.http_method(F.when(F.col("p_size") % 3 == 0, "c.get").when(F.col("p_size") % 3 == 1, "c.PostAsync").otherwise("c.send")).alias("method"),
        names.binding_key(F.concat(F.lit("a::b->"), F.lower("p_type"))).alias("key"), names.call_receiver(F.concat(F.lit("a/b."), F.lower("p_type"))).alias("parent"), names.class_method_tail(F.concat(F.lit("a.b."), F.lower("p_type"))).alias("tail"),
        names.tail_equal(F.lit("a.b.c"), F.when(F.col("p_size") % 2 == 0, "b::c").otherwise("bb::c")).alias("same"),
    )
)
add("numbered_names", "SELECT p_partkey AS id, CASE WHEN r > 1 THEN p_brand || '#' || r ELSE p_brand END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS r FROM part)")(
    lambda s, d: names.numbered(t(s, d, "part"), "p_brand", "p_partkey", "p_type").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))
)
add("module_proximity", "SELECT doc_id, round(1 + CASE WHEN source = 'src1' THEN CASE WHEN lang = 'en' THEN 2 ELSE 1 END ELSE 0 END / 2 * 0.1, 6) AS proximity FROM documents")(
    lambda s, d: t(s, d, "documents").select("doc_id", F.round(names.module_proximity(F.concat_ws("/", "source", "lang", "doc_id"), F.lit("src1/en/x")), 6).alias("proximity"))
)

# -- passes
add("scaffold", "SELECT 'branch:demo.__branch__.working-tree' AS source, 'file:' || source || '/' || doc_id AS target, 'CONTAINS_FILE' AS kind FROM documents UNION ALL SELECT 'project:demo', 'branch:demo.__branch__.working-tree', 'HAS_BRANCH'")(
    lambda s, d: derive.scaffold(t(s, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path")), "demo", "/demo").edges.select("source", "target", "kind")
)
add("environment_edges", "SELECT DISTINCT 'b' || p_size AS source, 'envvar:__env__' || upper(replace(p_brand, '#', '_')) AS target FROM part WHERE p_size > 25")(
    lambda s, d: derive.environment(t(s, d, "part").select(F.concat(F.lit("b"), "p_size").alias("source"), F.when(F.col("p_size") > 25, "os.getenv").otherwise("print").alias("callee"), F.concat(F.lit("os.getenv('"), F.upper(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("')")).alias("text")), "demo").edges.select("source", "target")
)
add("service_edges", f"SELECT DISTINCT 'page' AS source, 'route:__route__GET__' || route AS target, 'HTTP_CALLS' AS kind FROM ({ORACLE_SQL['route_canonical']})")(
    lambda s, d: derive.services(t(s, d, "pages").select(F.col("page_id").alias("call_id"), F.lit("page").alias("source"), F.lit("a.py").alias("file"), F.lit("http.get").alias("callee"), F.lit("get").alias("short"), F.concat(F.lit("http.get('"), "url", F.lit("')")).alias("text")),
        s.createDataFrame([("a.py", "http", "requests")], "file string, alias string, module string"), "demo").edges.select("source", "target", "kind")
)


@add("decorator_routes", "SELECT 'f' || c_custkey AS source, 'route:__route__' || CASE WHEN c_nationkey % 2 = 0 THEN 'GET' ELSE 'ANY' END || '__/c/' || c_custkey || '/{}' AS target FROM customer")
def _(s, d):
    """A file for each customer: an annotated route, and the function that handles it."""
    line = F.concat(F.lit("# ä\n@"), F.when(F.col("c_nationkey") % 2 == 0, "get").otherwise("route"), F.lit("('/c/"), "c_custkey", F.lit("/<id>')\n"))
    c = t(s, d, "customer").select("c_custkey", line.alias("head"))
    files = c.select(F.concat(F.lit("c"), "c_custkey").alias("path"), F.concat("head", F.lit("def f():\n  pass\ndef g():\n")).alias("text"))
    functions = c.select(F.explode(F.array(F.struct(F.lit("f").alias("n"), F.lit(0).alias("o")), F.struct(F.lit("g").alias("n"), F.lit(16).alias("o")))).alias("x"), "c_custkey", "head")
    functions = functions.select(F.concat("x.n", "c_custkey").alias("id"), F.concat("x.n", "c_custkey").alias("qualified_name"), F.concat(F.lit("c"), "c_custkey").alias("file_path"), (F.octet_length("head") + F.col("x.o")).cast("long").alias("start"))
    return derive.decorator_routes(files, functions, "demo").edges.select("source", "target")


@add("relation_resolution", "SELECT s_suppkey AS relation_id, CASE s_suppkey % 4 WHEN 3 THEN 'solo' || s_nationkey ELSE 'nation' || s_nationkey END AS target, CASE s_suppkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'import' WHEN 2 THEN 'module' ELSE 'unique' END AS strategy FROM supplier")
def _(s, d):
    """Suppliers' relations to types of their nation, all of one name, told by qualified name, import or module; or to a
    type of a name of its own."""
    n, k = t(s, d, "nation"), F.col("s_suppkey") % 4
    key = F.concat(F.lit("m"), "n_nationkey")
    types = n.select(F.concat(F.lit("nation"), "n_nationkey").alias("id"), key.alias("module"), F.lit("Base").alias("name"), F.concat(key, F.lit(".Base")).alias("qualified_name"))
    types = types.unionByName(n.select(F.concat(F.lit("solo"), "n_nationkey").alias("id"), key.alias("module"), F.concat(F.lit("Solo"), "n_nationkey").alias("name"), F.concat(key, F.lit(".Solo"), "n_nationkey").alias("qualified_name")))
    own = F.concat(F.lit("m"), "s_nationkey")
    sup = t(s, d, "supplier")
    relations = sup.select(F.col("s_suppkey").alias("relation_id"), F.concat(F.lit("f"), "s_suppkey").alias("file"), F.when(k == 0, F.concat(own, F.lit("::Base"))).when(k == 3, F.concat(F.lit("Solo"), "s_nationkey")).otherwise("Base").alias("name"))
    imports = sup.filter(k == 1).select(F.concat(F.lit("f"), "s_suppkey").alias("file"), own.alias("module_path"))
    modules = sup.filter(k == 2).select(F.concat(F.lit("f"), "s_suppkey").alias("file"), own.alias("module"))
    return enrich.resolve_relations(relations, types, imports, modules)


add("channel_link", "SELECT 'c' || c_custkey AS emitter, c_mktsegment AS project, 'p' || s_suppkey % 3 AS remote, min('s' || s_suppkey) AS listener FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE c_custkey % 2 = s_suppkey % 2 GROUP BY 1, 2, 3")(
    lambda s, d: enrich.channel_links(
        t(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("emitter"), F.col("c_mktsegment").alias("project"), F.when(F.col("c_custkey") % 2 == 0, "Kafka").otherwise("NATS").alias("transport"), F.col("c_nationkey").cast("string").alias("channel")),
        t(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("listener"), F.concat(F.lit("p"), (F.col("s_suppkey") % 3).cast("string")).alias("project"), F.when(F.col("s_suppkey") % 2 == 0, "kafka").otherwise("nats").alias("transport"), F.col("s_nationkey").cast("string").alias("channel")),
    )
)


@add("route_templates", "SELECT 'c' || c_custkey AS caller, CASE WHEN c_custkey % 2 = 0 THEN 'any' ELSE 'exact' END AS remote, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS priority FROM customer UNION ALL SELECT 'c' || c_custkey, 'wide', 2 FROM customer")
def _(s, d):
    """Calls of each customer's path: odd ones have a handler of just that path, even ones only one with a parameter."""
    c = t(s, d, "customer")
    path = F.concat_ws("/", F.lit(""), F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("odd"), F.col("c_custkey").cast("string"), F.lit("orders"))
    calls = c.select(F.concat(F.lit("c"), "c_custkey").alias("caller"), F.lit("me").alias("project"), F.lit("GET").alias("method"), path.alias("path"))
    own = c.filter("c_custkey % 2 = 1").select(F.concat(F.lit("h"), "c_custkey").alias("handler"), F.lit("exact").alias("project"), F.lit("GET").alias("method"), path.alias("path"))
    rest = s.createDataFrame([("t1", "any", "ANY", "/even/{}/orders"), ("t2", "wide", "GET", "/{}/{}/orders"), ("t3", "wide", "POST", "/{}/{}/{}"), ("t4", "me", "GET", "/{}/{}/orders")], "handler string, project string, method string, path string")
    return enrich.cross_routes(calls, own.unionByName(rest)).select("caller", "remote", "priority")


# -- vectors
add("float_cosine", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(0, len(embedding)), lambda i: CASE WHEN i % 3 = 0 THEN -1.0 ELSE 0.5 END)::DOUBLE[]), 5) AS c FROM embeddings")(
    lambda s, d: t(s, d, "embeddings").select("vec_id", F.round(vectors.float_cosine(F.transform("embedding", lambda x: x.cast("double")), F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.when(i % 3 == 0, -1.0).otherwise(0.5))), 5).alias("c"))
)
_Q = "list_transform(embedding, lambda x: CAST(trunc(least(127, greatest(-127, CAST(x AS DOUBLE) * 127))) AS BIGINT))"
add("signature_hex", f"SELECT vec_id, array_to_string(list_transform({_Q}, lambda x: lower(printf('%08X', x & 4294967295))), '') AS h FROM embeddings")(
    lambda s, d: t(s, d, "embeddings").select("vec_id", vectors.signature_hex(F.transform(vectors.quantise(F.col("embedding")), lambda x: x.cast("long"))).alias("h"))
)


# -- store
@add("store_changes", "SELECT 'customer:' || c_custkey AS source, 'nation:' || c_nationkey AS target, 'IN_NATION' AS kind FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'customer:' || min(c_custkey), 'nation:0', 'MOVED' FROM customer WHERE c_mktsegment <> 'BUILDING'")
def _(s, d):
    """A snapshot after its file of one segment was swapped for an edge, and the files were reconciled."""
    view = commerce(s, d, {"Customer", "Nation"}, {"IN_NATION"})
    view = GraphView(view.nodes.withColumn("file_path", F.col("segment")), view.edges.filter("source like 'customer:%'"))
    store = Store(s, _scratch(s))
    store.replace(view, "demo")
    kept = t(s, d, "customer").filter("c_mktsegment <> 'BUILDING'").agg(F.concat(F.lit("customer:"), F.min("c_custkey")).alias("source"))
    edge = kept.select(F.lit("demo").alias("project"), "source", F.lit("nation:0").alias("target"), F.lit("MOVED").alias("kind"), F.lit("").alias("discriminator"), F.lit("{}").alias("properties"))
    store.replace_file("demo", "BUILDING", view.nodes.limit(0), edge)
    store.reconcile("demo", t(s, d, "customer").select(F.col("c_mktsegment").alias("path")))
    return store.snapshot("demo").edges.select("source", "target", "kind")
