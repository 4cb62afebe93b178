"""Queries that take every row, against plain loops and counts of their input."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from plexloom.operators import enrich, search, vectors, text
from plexloom.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import check

SF = "/root/testdata/sf0.001"


def test_all_calls(spark):
    """Of all orders, only those of a name that several symbols have are unresolved, and every strategy decides."""
    got = Counter(r.strategy for r in QUERIES["call_resolution_all"](spark, SF).collect())
    n, low = duckdb.sql(f"SELECT count(*), sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) FROM '{SF}/orders.parquet'").fetchall()[0]
    assert set(got) == {"receiver", "import", "container", "suffix", "unique"} and sum(got.values()) - got["unique"] == n - low and got["unique"] <= low


def test_resolution_cascade(spark):
    symbols = [("1", "f", "a.A", "run", "a.A.run"), ("2", "f", "b.B", "run", "b.B.run"), ("3", "f", "b.B", "solo", "b.B.solo"), ("4", "g", "c.A", "run", "c.A.run")]
    calls = [
        (1, "h", "a.A", "run", "B"), (2, "h", "a.A", "run", "A"), (3, "i", "a.A", "run", None), (4, "h", "c.A", "run", None), (5, "h", None, "B.run", None),
        (6, "h", None, "A.run", None), (7, "h", None, "solo", "None"), (8, "h", None, "run", None), (9, "j", "c.A", "run", None), (10, "h", None, "nothing", "A"),
    ]
    imports = [("i", "b.B"), ("j", "a.A"), ("j", "b.B")]
    got = enrich.resolve_calls(
        spark.createDataFrame(calls, "call_id long, file string, container string, name string, receiver string"),
        spark.createDataFrame(symbols, "id string, file string, container string, name string, qualified_name string"),
        spark.createDataFrame(imports, "file string, module_path string"),
    )
    want = {(1, "2", "receiver"), (2, "1", "container"), (3, "2", "import"), (4, "4", "container"), (5, "2", "suffix"), (7, "3", "unique"), (9, "4", "container")}
    assert set(map(tuple, got.collect())) == want


def test_all_routes(spark, tmp_path):
    """Whole paths are linked, of all ids, and not only their first segments."""
    urls = ["http://a.org/fr/1?x=1", "https://b.org/fr/1#top", "http://b.org/fr/1/", "http://c.org/fr/2", "http://a.org/fr/2", "http://a.org/fr/1", "http://d.org", "http://e.org/?q", "http://a.org/u/{id}", "http://b.org/u/:key"]
    spark.createDataFrame(list(enumerate(urls, 1)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.caller, r.handler) for r in QUERIES["cross_route_link_all"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2), (6, 2), (2, 1), (3, 1), (4, 5), (5, 4), (7, 8), (8, 7), (9, 10), (10, 9)}


def test_all_routes_of_table(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    rows = con.execute(ORACLE_SQL["cross_route_link_all"]).fetchall()
    assert len({r[0] for r in rows}) > 4 and sorted(rows) == sorted(tuple(r[c] for c in ("caller", "project", "remote", "handler", "priority")) for r in QUERIES["cross_route_link_all"](spark, "/root/testdata/sf0.01").collect())


def brute(sig, threshold, chosen):
    rows = {r[0]: r[1] for r in sig.collect()}
    like = lambda a, b: sum(x == y for x, y in zip(rows[a], rows[b], strict=True)) / 64
    return {(a, b, like(a, b)) for a in rows if chosen(a) for b in rows if a != b and like(a, b) >= threshold}


def test_similar_pairs_of_table(spark):
    """Every id divisible by 50 is a query, and none of its neighbours is missed."""
    d = "/root/testdata/sf0.01"
    want = brute(vectors.minhash(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", search.tokens(F.col("text"))), 0.95, lambda i: i % 50 == 0)
    got = [tuple(r) for r in QUERIES["minhash_similarity"](spark, d).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("threshold", [0.95, 0.5, 1.0, 0.0])
def test_similar_pairs(spark, threshold, monkeypatch):
    """Copies with a few words changed, at and around each threshold, and queries in several blocks."""
    monkeypatch.setattr(vectors, "QUERY_ROWS", 4)
    body = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join([*body[: 400 - i], *[f"x{i}_{k}" for k in range(i)]])) for i in range(0, 120, 3)]
    sig = vectors.minhash(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", search.tokens(F.col("text")))
    want = brute(sig, threshold, lambda i: i % 2 == 0)
    got = [tuple(r) for r in vectors.similar_pairs(sig.filter("doc_id % 2 = 0"), sig, "doc_id", threshold).collect()]
    assert len(got) == len(want) and set(got) == want and (want or threshold == 1)


def test_minhash_weights(spark):
    """A trigram of two placeholders weighs 1, one without any 3; equal slots follow the weighted Jaccard likeness."""
    heavy = lambda tag, n: [x for i in range(n) for x in (f"{tag}{i}a", f"{tag}{i}b", f"{tag}{i}c")]
    light = lambda tag, n: [x for i in range(n) for x in ("I", "S", f"{tag}{i}")]
    rows = [(1, heavy("h", 200) + light("p", 200)), (2, heavy("h", 200) + light("q", 200)), (3, heavy("g", 200) + light("p", 200)), (4, ["I"] * 100), (5, ["a"] * 29)]
    got = {r.id: r.signature for r in vectors.minhash(spark.createDataFrame(rows, "id long, t array<string>"), "id", F.col("t")).collect()}
    assert set(got) == {1, 2, 3}

    def weights(tokens):
        return {g: sum(x not in "IS" for x in g) for g in zip(tokens, tokens[1:], tokens[2:], strict=False) if any(x not in "IS" for x in g)}

    w = {i: weights(tokens) for i, tokens in rows}
    for a, b in ((1, 2), (1, 3), (2, 3)):
        both = set(w[a]) | set(w[b])
        true = sum(min(w[a].get(g, 0), w[b].get(g, 0)) for g in both) / sum(max(w[a].get(g, 0), w[b].get(g, 0)) for g in both)
        assert abs(sum(x == y for x, y in zip(got[a], got[b], strict=True)) / 64 - true) < 0.2
    assert sum(x == y for x, y in zip(got[1], got[2], strict=True)) > sum(x == y for x, y in zip(got[1], got[3], strict=True))


@pytest.mark.parametrize("name", ["doc_frequency_idf_all", "tfidf_topk_all", "snippet_chunks_all", "layout_coords_all"])
def test_whole_corpus(spark, name):
    assert check(QUERIES[name](spark, "/root/testdata/sf0.01"), ORACLE_SQL[name], "/root/testdata/sf0.01") is None


def test_layout_budget(spark):
    n = duckdb.sql("SELECT (SELECT count(*) FROM '/root/testdata/sf0.01/customer.parquet') + count(*) FROM '/root/testdata/sf0.01/orders.parquet'").fetchall()[0][0]
    assert n > 5000 == QUERIES["layout_coords_all"](spark, "/root/testdata/sf0.01").count()


def test_chunks_of_long_texts(spark):
    """Every document is cut, the longest in more than a hundred pieces, and the pieces make up its text."""
    texts = dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    pieces = {}
    for r in QUERIES["snippet_chunks_all"](spark, "/root/testdata/sf0.01").orderBy("doc_id", "start").collect():
        pieces.setdefault(r.doc_id, []).append(r.piece)
    assert {k: "".join(v) for k, v in pieces.items()} == texts and max(map(len, pieces.values())) > 100


def test_band_keys(spark):
    """Signatures share a band's key exactly where both of its slots are equal."""
    a = list(range(64))
    rows = [(1, a), (2, [x if i % 4 < 2 else -x - 1 for i, x in enumerate(a)]), (3, [-x - 1 for x in a])]
    keys = {r.id: r.k for r in spark.createDataFrame(rows, "id long, s array<long>").select("id", vectors.band_keys(F.col("s")).alias("k")).collect()}
    assert len(keys[1]) == 32 and [x == y for x, y in zip(keys[1], keys[2], strict=True)] == [i % 2 == 0 for i in range(32)] and not set(keys[1]) & set(keys[3])


def test_config_links(spark):
    """Keys in symbols' names, of every length, against plain search."""
    keys, names = ["db.url", "x", "Server_Port", "a-b", "longer_than_any_symbol_here", "!!"], ["dbUrl", "getServerPort", "a_b", "box", "", "URL"]
    k, s = spark.createDataFrame([(x,) for x in keys], "key string"), spark.createDataFrame(list(enumerate(names)), "id long, name string")
    plain = lambda x: "".join(c for c in x if c.isalnum()).lower()
    want = {(x, i, 0.85 if plain(x) == plain(n) else 0.75) for x in keys for i, n in enumerate(names) if plain(x) and plain(x) in plain(n)}
    assert {(r.key, r.id, float(r.confidence)) for r in enrich.config_links(k, s).collect()} == want and len(want) == 4


def test_tfidf_shuffles(spark):
    """Rows that share a key are added up, and postings are dealt by their key once."""
    docs = spark.createDataFrame([(1, "a a b"), (1, "a c"), (2, "b"), (3, None)], "id long, text string")
    top = text.top_terms(text.tfidf(docs.filter("id < 3"), "id", search.tokens(F.col("text"))), "id", 3)
    size = (3.864**2 + 1.288**2 + 1.693**2) ** 0.5
    want = [(1, "a", 1, 3.864 / size), (1, "c", 2, 1.693 / size), (1, "b", 3, 1.288 / size), (2, "b", 1, 1.0)]
    got = sorted((r.id, r["rank"], r.token, r.weight) for r in top.collect())
    assert [(i, t, k) for i, k, t, _ in got] == [x[:3] for x in want] and all(abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, want, strict=True))
    plan = text.top_terms(text.tfidf(docs, "id", search.tokens(F.col("text"))), "id", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(id") == 1
