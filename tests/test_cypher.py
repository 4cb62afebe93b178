"""The query language on a small graph of a library: books, writers, readers and loans."""

import json

import pytest
from pyspark.sql import functions as F

from plexloom.cypher import CypherError, compile_query, parse_query, query_graph
from plexloom.cypher.compiler import Compiler
from plexloom.graph import GraphView

NODES = [
    ("w1", "Writer", "Ada Ørsted", {"born": 1901, "prizes": 9, "alive": False, "union": "guild"}),
    ("w2", "Writer", "Ben Okoro", {"born": 1950.5, "prizes": 10, "alive": True}),
    ("w3", "Writer", "Cy Lund", {"born": "1950.5", "prizes": 100, "alive": True, "tags": ["x", "y"]}),
    ("b1", "Book", "Tides", {"isbn": 9007199254740993, "stock": 3}),
    ("b2", "Book", "Ember", {"isbn": 9007199254740992, "stock": 0.5}),
    ("b3", "Book", "Quartz", {"isbn": "9007199254740993", "stock": None}),
    ("r1", "Reader", "Dee", {"card": {"level": 2}}),
    ("r2", "Reader", "Eli", {"card": {"level": "gold"}}),
]
EDGES = [
    ("w1", "b1", "WROTE", ""), ("w2", "b2", "WROTE", ""), ("w2", "b3", "WROTE", ""), ("r1", "b1", "LENT", "mon"), ("r1", "b1", "LENT", "tue"), ("r1", "b2", "LENT", "wed"),
    ("w1", "w2", "TAUGHT", ""), ("w2", "w3", "TAUGHT", ""), ("w3", "w1", "TAUGHT", ""), ("w3", "w3", "TAUGHT", "self"),
]


@pytest.fixture(scope="session")
def view(spark):
    nodes = spark.createDataFrame(
        [("lib", i, label, n, f"lib.{n}", f"{label.lower()}.txt", 1, 2, json.dumps(p)) for i, label, n, p in NODES],
        "project string, id string, label string, name string, qualified_name string, file_path string, start_line long, end_line long, properties string",
    ).coalesce(1).cache()
    edges = spark.createDataFrame([("lib", s, t, k, d, json.dumps({"day": d})) for s, t, k, d in EDGES], "project string, source string, target string, kind string, discriminator string, properties string").coalesce(1).cache()
    return GraphView(nodes, edges)


def rows(view, text):
    """Rows with Python values for variants."""
    one = lambda v: v.toPython() if hasattr(v, "toPython") else [one(x) for x in v] if isinstance(v, list) else v
    return [tuple(one(v) for v in r) for r in compile_query(view, text).collect()]


TYPED = [
    # booleans are no texts
    ("MATCH (w:Writer) WHERE w.alive = true RETURN w.id AS i ORDER BY i", [("w2",), ("w3",)]),
    ("MATCH (w:Writer) WHERE w.alive = 'true' RETURN w.id AS i", []),
    ("MATCH (w:Writer {alive: false}) RETURN w.id AS i", [("w1",)]),
    # numbers compare and sort as numbers
    ("MATCH (w:Writer) RETURN MAX(w.prizes) AS x, MIN(w.prizes) AS n, SUM(w.prizes) AS s, AVG(w.prizes) AS a", [(100, 9, 119, 119 / 3)]),
    ("MATCH (w:Writer) RETURN w.prizes AS p ORDER BY w.prizes", [(9,), (10,), (100,)]),
    ("MATCH (w:Writer) RETURN w.prizes AS p ORDER BY w.prizes DESC LIMIT 2", [(100,), (10,)]),
    ("MATCH (w:Writer) WHERE w.prizes > 9.5 RETURN w.id AS i ORDER BY i", [("w2",), ("w3",)]),
    ("MATCH (w:Writer) WHERE w.prizes >= '10' RETURN w.id AS i ORDER BY i", [("w2",), ("w3",)]),
    # a text that is a number equals it, but has its own place in an order, after numbers
    ("MATCH (w:Writer) WHERE w.born = 1950.5 RETURN w.id AS i ORDER BY i", [("w2",), ("w3",)]),
    ("MATCH (w:Writer) RETURN w.born AS b ORDER BY w.born", [(1901,), (1950.5,), ("1950.5",)]),
    ("MATCH (w:Writer) RETURN COUNT(DISTINCT w.born) AS n", [(3,)]),
    # whole numbers beyond 2**53 and doubles compare without loss
    ("MATCH (b:Book) WHERE b.isbn = 9007199254740993 RETURN b.id AS i ORDER BY i", [("b1",), ("b3",)]),
    ("MATCH (b:Book) WHERE b.isbn > 9007199254740992.0 RETURN b.id AS i ORDER BY i", [("b1",), ("b3",)]),
    ("MATCH (b:Book) WHERE b.isbn <= 9007199254740992 RETURN b.id AS i", [("b2",)]),
    ("MATCH (b:Book) WHERE b.isbn < 18446744073709551615 RETURN COUNT(*) AS n", [(3,)]),
    # whole sums stay whole, others are doubles, and JSON's null is null
    ("MATCH (b:Book) RETURN SUM(b.stock) AS s, COUNT(b.stock) AS n", [(3.5, 2)]),
    ("MATCH (b:Book) WHERE b.stock IS NULL RETURN b.id AS i", [("b3",)]),
    ("MATCH (b:Book {name: 'none'}) RETURN SUM(b.stock) AS s, MAX(b.stock) AS m, COLLECT(b.stock) AS c", [(0, None, [])]),
    ("MATCH (r:Reader) RETURN r.properties.card.level AS l ORDER BY r.id", [(2,), ("gold",)]),
    ("MATCH (w:Writer) RETURN COLLECT(w.born) AS b", [([1901, 1950.5, "1950.5"],)]),
    ("MATCH (w:Writer) WITH w.alive AS alive, COUNT(*) AS n WHERE alive = true RETURN alive, n", [(True, 2)]),
    ("MATCH (w:Writer) RETURN size(w.tags) AS n, toString(w.prizes) AS s, toInteger(w.born) AS i, toFloat(w.prizes) AS f, toBoolean(w.alive) AS b, toUpper(w.union) AS u ORDER BY w.id", [(None, "9", 1901, 9.0, False, "GUILD"), (None, "10", 1950, 10.0, True, None), (2, "100", None, 100.0, True, None)]),
    ("MATCH (w:Writer) RETURN CASE WHEN w.prizes > 50 THEN w.prizes ELSE 'few' END AS c ORDER BY c", [(100,), ("few",), ("few",)]),
    ("MATCH (w:Writer) RETURN coalesce(w.union, w.prizes) AS c ORDER BY c", [(10,), (100,), ("guild",)]),
    ("MATCH (w:Writer) WHERE w.union = 'guild' RETURN w.union", [("guild",)]),
    ("MATCH (w:Writer) WHERE w.born IN [1901, true] RETURN w.id AS i", [("w1",)]),
]
PATTERNS = [
    ("MATCH (w) WHERE w.name =~ '^\\\\p{Lu}.*\\\\p{L}$' AND w:Writer RETURN COUNT(*) AS n", [(3,)]),
    ("MATCH (x) WHERE x.label NOT IN ['Writer', 'Reader'] RETURN x.name ORDER BY x.name", [("Ember",), ("Quartz",), ("Tides",)]),
    ("MATCH (w:Writer {id: 'w1'})-[:TAUGHT*1..3]->(x) RETURN x.id AS i ORDER BY i", [("w1",), ("w2",), ("w3",), ("w3",)]),
    ("MATCH (w:Writer {id: 'w1'})-[:TAUGHT*0..1]->(x) RETURN x.id AS i ORDER BY i", [("w1",), ("w2",)]),
    ("MATCH (w)-[:TAUGHT]->(w) RETURN w.id AS i", [("w3",)]),
    ("MATCH (w:Writer {id: 'w3'})-[t:TAUGHT]-(x) RETURN x.id AS i, id(t) AS d ORDER BY i", [("w1", ""), ("w2", ""), ("w3", "self")]),
    ("MATCH (r:Reader) WHERE NOT EXISTS { (r)-[:LENT]->() } RETURN r.name", [("Eli",)]),
    ("MATCH (w:Writer) WHERE w.prizes = 100 OR EXISTS { (w)-[:WROTE]->(:Book {name: 'Tides'}) } RETURN w.id AS i ORDER BY i", [("w1",), ("w3",)]),
    ("MATCH (w:Writer)-[:WROTE]->(b) WITH w.id AS i, COUNT(b) AS n WHERE n >= '2' RETURN i, n", [("w2", 2)]),
    ("MATCH (w:Writer) OPTIONAL MATCH (w)-[:WROTE]->(b) RETURN w.id AS i, b.id AS b ORDER BY i, b", [("w1", "b1"), ("w2", "b2"), ("w2", "b3"), ("w3", None)]),
    ("MATCH (w:Writer) OPTIONAL MATCH (w)-[:WROTE]->(b) WHERE b.name = 'Ember' RETURN w.id AS i", [("w2",)]),
    # an alias left null is bound anew
    ("MATCH (w:Writer) OPTIONAL MATCH (w)-[:WROTE]->(b) MATCH (b)<-[:LENT]-(r) RETURN DISTINCT w.id AS i, b.id AS b ORDER BY i, b", [("w1", "b1"), ("w2", "b2"), ("w3", "b1"), ("w3", "b2")]),
    ("MATCH (r:Reader {name: 'Dee'})-[l:LENT]->(b) RETURN b.name AS b, l.day AS d ORDER BY d", [("Tides", "mon"), ("Tides", "tue"), ("Ember", "wed")]),
    ("UNWIND split('Dee,Eli,Dee', ',') AS n MATCH (r:Reader) WHERE r.name = n RETURN r.id AS i ORDER BY i", [("r1",), ("r1",), ("r2",)]),
    ("UNWIND [1, 'a', null, true] AS v MATCH (r:Reader {name: 'Dee'}) RETURN v ORDER BY v", [(True,), (1,), (None,), ("a",)]),
    ("UNWIND [] AS v MATCH (r:Reader) RETURN v", []),
    ("MATCH (r:Reader) RETURN r.name AS x UNION ALL MATCH (r:Reader) RETURN r.name AS x", [("Dee",), ("Eli",), ("Dee",), ("Eli",)]),
    ("MATCH (w:Writer) RETURN w.alive AS x UNION MATCH (r:Reader) RETURN r.name AS x", [(False,), (True,), ("Dee",), ("Eli",)]),
    ("MATCH (w:Writer) WHERE NOT (w.absent = 1) RETURN COUNT(*) AS n", [(3,)]),
    ("MATCH (w:Writer) WHERE w.absent <> 1 RETURN COUNT(*) AS n", [(0,)]),
    ("MATCH (w:Writer) RETURN DISTINCT w.alive AS a ORDER BY w.prizes DESC", [(True,), (False,)]),
    ("MATCH (b:Book) RETURN replace(b.name, '', '.') AS r, reverse(b.name) AS v, substring(b.name, 1, 2) AS s ORDER BY b.id SKIP 1 LIMIT 1", [(".E.m.b.e.r.", "rebmE", "mb")]),
    ("MATCH (b:Book {name: 'Tides'}) RETURN labels(b) AS l, keys(b) AS k, toInteger(' 1 ') AS a, toInteger('-7') AS c, toFloat('1e2') AS f", [(["Book"], ["name", "qualified_name", "label", "file_path", "start_line", "end_line", "isbn", "stock"], None, -7, 100.0)]),
    ("MATCH (b:Book) RETURN left(b.name, 2) AS l, right(b.name, 2) AS r, trim('  x ') AS t, toLower(b.name) AS w, split(b.name, 'e') AS p ORDER BY b.name LIMIT 1", [("Em", "er", "x", "ember", ["Emb", "r"])]),
]


@pytest.mark.parametrize(("text", "expected"), TYPED + PATTERNS)
def test_query(view, text, expected):
    got = rows(view, text)
    assert (got if "ORDER BY" in text else sorted(got, key=repr)) == (expected if "ORDER BY" in text else sorted(expected, key=repr))
    assert [tuple(map(type, r)) for r in sorted(got, key=repr)] == [tuple(map(type, r)) for r in sorted(expected, key=repr)]


def test_sum_of_texts(view):
    with pytest.raises(Exception, match="no number"):
        rows(view, "MATCH (w:Writer) RETURN SUM(w.union) AS s")


def test_result_metadata(view):
    got = query_graph(view, "MATCH (n) RETURN n.id ORDER BY n.id SKIP 3", 2)
    assert (got.total, [r[0] for r in got.rows], got.truncated) == (5, ["r1", "r2"], True)
    got = query_graph(view, "MATCH (w:Writer) RETURN w.born LIMIT 1")
    assert (got.rows[0][0], got.total, got.truncated) == (1901, 3, True)
    assert [r[0] for r in query_graph(view, "MATCH (w:Writer) RETURN w.id AS i", 2).rows] == ["w1", "w2"]
    got = query_graph(view, "MATCH (r:Reader) RETURN r.name AS n")
    assert (got.total, got.truncated, sorted(r[0] for r in got.rows)) == (2, False, ["Dee", "Eli"])
    got = query_graph(view, "MATCH (a)-[:WROTE*90..99]->(b) RETURN a.name")
    assert got.rows == [] and "clamped to 10" in got.warnings[0]
    with pytest.raises(CypherError):
        query_graph(view, "MATCH (n) RETURN n.id", 10_001)


def test_unstable_limit(view):
    """Without a stable order a limit needs no sort."""
    plan = compile_query(view, "MATCH (n) RETURN n.id AS i LIMIT 3", stable=False)
    assert plan.count() == 3 and "TakeOrdered" not in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text", ["DELETE (n) RETURN n", "MATCH (a)--(b) RETURN a", "MATCH (n) RETURN 'x'", "MATCH (n) RETURN max(*)", "MATCH (n) RETURN n.id SKIP 1 SKIP 2", "MATCH (n)", "MATCH (a)-[:X*5..4]->(b) RETURN a", "OPTIONAL MATCH (n) RETURN n.id"])
def test_rejected(text):
    with pytest.raises(CypherError):
        parse_query(text)


@pytest.mark.parametrize("pattern", ["(", "a(?=b)", "(a)\\\\1", "\\\\p{Nope}"])
def test_bad_patterns(view, pattern):
    with pytest.raises(CypherError):
        compile_query(view, f"MATCH (n) WHERE n.name =~ '{pattern}' RETURN n.id")


@pytest.mark.parametrize(
    "query",
    [
        "MATCH (a:Reader)-[r:LENT]->(b), (w:Writer)-[:WROTE]->(b) RETURN b.name AS k, COUNT(*) AS n",
        "MATCH (w:Writer)-[:WROTE]->(b), (a)-[r]->(b) RETURN w.name AS k, COUNT(*) AS n, COUNT(DISTINCT b.name) AS d, MIN(b.name) AS lo, MAX(b.name) AS hi",
        "MATCH (a)-[r:TAUGHT]->(b), (c)-[s:TAUGHT]->(d) RETURN COUNT(*) AS n",
        "MATCH (a)-[r:TAUGHT]->(b), (c)-[s:NONE]->(d) RETURN COUNT(*) AS n, COUNT(a) AS m",
        "MATCH (a)-[:TAUGHT]->(b), (b)-[:TAUGHT]->(c) MATCH (x)-[:LENT]->(y) WHERE a.name <> c.name RETURN c.name AS k, COUNT(a) AS n, COUNT(a.missing) AS m ORDER BY k",
        "MATCH (a)-[:TAUGHT]->(b), (x)-[:LENT]->(y) WHERE NOT EXISTS { (x)-[:LENT]->(:Book {id: 'b3'}) } WITH y.id AS k, COUNT(*) AS n WHERE n > 4 RETURN k, n",
    ],
)
def test_folded_patterns(view, query, monkeypatch):
    """Bindings that are only counted are joined with their number, and the result is that of all their pairs."""
    def plan():
        return compile_query(view, query)._jdf.queryExecution().optimizedPlan().toString()

    got, folded = sorted(rows(view, query)), plan()
    monkeypatch.setattr(Compiler, "_foldable", lambda self, q: None, raising=False)
    assert got == sorted(rows(view, query)) and got
    assert folded.count("Aggregate [") > plan().count("Aggregate [")


def test_folded_hub(spark):
    """A node that 70 000 others point to from each side: 4.9 thousand million pairs, which are counted."""
    ids = spark.range(70_000).select(F.explode(F.array(F.concat(F.lit("a"), "id"), F.concat(F.lit("b"), "id"))).alias("id"))
    columns = "project string, id string, label string, name string, qualified_name string, file_path string, start_line long, end_line long, properties string"
    hub = spark.createDataFrame([("p", "h", "H", "hub", "h", None, None, None, "{}")], columns)
    nodes = hub.unionByName(ids.select(F.lit("p").alias("project"), "id", F.upper(F.left("id", F.lit(1))).alias("label"), F.lit("x").alias("name"), F.col("id").alias("qualified_name")), allowMissingColumns=True)
    edges = ids.select(F.lit("p").alias("project"), F.col("id").alias("source"), F.lit("h").alias("target"), F.lit("E").alias("kind"), F.lit("").alias("discriminator"), F.lit("{}").alias("properties"))
    assert rows(GraphView(nodes, edges), "MATCH (a:A)-[:E]->(h:H), (b:B)-[:E]->(h) RETURN h.name AS k, COUNT(*) AS n") == [("hub", 70_000**2)]


def test_dynamic_values_once(view):
    """A function of a JSON property parses the JSON once a row, however often it looks at the value."""
    for f in ("toFloat", "toInteger", "toString", "size", "toUpper"):
        plan = compile_query(view, f"MATCH (w:Writer) RETURN {f}(w.born) AS x")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson(") == 1, f
