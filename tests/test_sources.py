"""Files, logs, the snapshot store and the trace stream."""

import json

import pytest
from pyspark.sql import functions as F

from plexloom.graph import GraphView, commerce
from plexloom.operators import enrich, search, text, traverse
from plexloom.sources import repository
from plexloom.sources.store import StaleGeneration, Store
from plexloom.streaming import traces

SF = "/root/testdata/sf0.001"


def test_discover(spark, tmp_path):
    for path, body in (("a/x.py", "print(1)"), ("node_modules/y.js", "no"), ("Makefile", "all:"), ("p.png", "no"), ("t.d.ts", "type T")):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(body)
    got = {r.path: r.language for r in repository.discover(spark, str(tmp_path)).collect()}
    assert got == {"a/x.py": "python", "Makefile": "make", "t.d.ts": "typescript"}


def test_ignore(spark):
    rows = spark.createDataFrame([("a.log",), ("keep.log",), ("build/x",), ("src/a.rs",)], "p string")
    assert sorted(r.p for r in rows.filter(repository.ignore_filter(F.col("p"), ["*.log", "!keep.log", "build/"])).collect()) == ["keep.log", "src/a.rs"]


def test_git(spark):
    lines = spark.createDataFrame(list(enumerate(["COMMIT:ab:10", "a.rs", "b.rs", "", "COMMIT:cd:20", "a.rs", "b.rs", "COMMIT:ef:30", "a.rs", "b.rs"])), "n long, value string")
    log = repository.git_log(lines)
    assert [tuple(r)[:3] for r in enrich.co_changes(log).collect()] == [("a.rs", "b.rs", 3)]
    assert {r.path: (r.changes, r["last"]) for r in enrich.file_history(log).collect()} == {"a.rs": (3, 30), "b.rs": (3, 30)}
    diff = spark.createDataFrame(list(enumerate(["+++ b/x.py", "@@ -1,2 +3,4 @@", "@@ -9 +12 @@"])), "n long, value string")
    assert sorted(tuple(r) for r in repository.diff_hunks(diff).collect()) == [("x.py", 3, 6), ("x.py", 12, 12)]


def test_git_log_blocks(spark, monkeypatch):
    """Logs in blocks against a plain loop: commits longer than several blocks, blocks without a line, lines before any
    header, a log without a name, and no task that has a whole log."""
    monkeypatch.setattr(repository, "BLOCK_LINES", 4)
    rows, want = [], []
    for repo, step in ((None, 1), ("a", 1), ("b", 7)):
        h = None
        for i, v in enumerate(["early", *(x for k in range(12) for x in (f"COMMIT:{k:02x}:{k}", *(f"{repo}/{k}_{j}" for j in range(k * k % 23)), ""))]):
            rows.append((repo, i * step - 20, v))
            if v.startswith("COMMIT:"):
                h = v.split(":")
            elif v and h:
                want.append((h[1], int(h[2]), v))
    log = repository.git_log(spark.createDataFrame(rows, "repo string, n long, value string").repartition(3))
    assert sorted(tuple(r) for r in log.collect()) == sorted(want) and len(want) > 200
    one = repository.git_log(spark.createDataFrame([(n, v) for r, n, v in rows if r == "a"], "n long, value string"))
    held = one.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in held) < sum(r["count"] for r in held) / 4


def small(spark):
    view = commerce(spark, SF, {"Region", "Nation"}, {"IN_REGION"})
    return GraphView(view.nodes.withColumn("file_path", F.when(F.col("label") == "Nation", F.lit("n.rs"))), view.edges)


def test_store(spark, tmp_path):
    view = small(spark)
    store = Store(spark, str(tmp_path / "s"))
    assert store.replace(view, "demo") == 1 and store.replace(view, "demo", expected=1) == 2
    with pytest.raises(StaleGeneration):
        store.replace(view, "demo", expected=1)
    with pytest.raises(ValueError, match="broken"):
        store.replace(GraphView(view.nodes.filter("label = 'Region'"), view.edges), "demo")
    assert store.snapshot("demo").nodes.count() == 30
    assert store.export("demo", str(tmp_path / "x"))["edges"] == 25 and store.load(str(tmp_path / "x"), "a/copy of it") == 1
    with pytest.raises(ValueError, match="bytes"):
        store.load(str(tmp_path / "x"), "b", most_bytes=10)
    assert sorted(tuple(r) for r in store.projects().collect()) == [("a/copy of it", 1, 30, 25, 0), ("demo", 2, 30, 25, 0)]
    store.delete("a/copy of it")
    assert store.generation("a/copy of it") == 0


def test_store_changes(spark, tmp_path):
    """Every change commits nodes, edges and files together, and can follow any other."""
    view, store = small(spark), Store(spark, str(tmp_path / "s"))
    files = spark.createDataFrame([("n.rs", "h1"), ("gone.rs", "h2")], "path string, content_hash string")
    store.replace(view, "p", files=files)
    one = view.nodes.filter("id = 'nation:3'").withColumn("file_path", F.lit("n.rs"))
    edge = view.edges.filter("source = 'nation:3'")
    old = store.snapshot("p")
    assert store.replace_file("p", "n.rs", one, edge, spark.createDataFrame([("n.rs", "h3")], "path string, content_hash string")) == 2
    assert old.nodes.count() == 30  # a reader keeps what it has opened
    now = store.snapshot("p")
    assert now.nodes.count() == 6 and now.edges.count() == 1 and [r.content_hash for r in store.files("p").collect()] == ["h2", "h3"]
    assert store.replace(view, "p") == 3 and store.snapshot("p").nodes.count() == 30 and store.files("p").count() == 2
    assert store.upsert_file("p", spark.createDataFrame([("new.rs", "h4")], "path string, content_hash string")) == 4 and store.files("p").count() == 3
    assert store.reconcile("p", spark.createDataFrame([("gone.rs",)], "path string")) == 5
    assert store.snapshot("p").nodes.count() == 5 and store.snapshot("p").edges.count() == 0 and [r.path for r in store.files("p").collect()] == ["gone.rs"]
    store.replace(view, "p")
    link = spark.createDataFrame([("nation:1", "else:9", "CROSS_HTTP_CALLS", "q", "{}")], "source string, target string, kind string, discriminator string, properties string")
    for _ in range(2):
        store.replace_cross_edges("p", link)
    assert store.snapshot("p").edges.count() == 26 and store.edges_to("p", ["else:9"]).count() == 1
    assert store.replace_cross_edges("p", link.limit(0)) == 9 and store.snapshot("p").edges.count() == 25
    with pytest.raises(StaleGeneration):
        store.replace_semantic_index("p", 8, {"signatures": link})
    store.replace_semantic_index("p", 9, {"signatures": link})
    assert store.semantic_index("p", "signatures").count() == 1 and store.semantic_index("p", "node_vectors") is None
    store.vacuum("p")
    assert store.generation("p") == 10 and store.snapshot("p").nodes.count() == 30 and len(list((tmp_path / "s" / "p" / "nodes").iterdir())) == 1


def test_store_failed_write(spark, tmp_path):
    """A write that fails between two tables leaves the snapshot as it was."""
    view, store = small(spark), Store(spark, str(tmp_path / "s"))
    store.replace(view, "p")
    bad = view.edges.withColumn("discriminator", F.expr("if(source = 'nation:1', raise_error('lost'), discriminator)"))
    with pytest.raises(Exception, match="lost"):
        store._commit("p", 1, {"nodes": view.nodes.limit(1), "edges": bad})
    assert store.generation("p") == 1 and store.snapshot("p").nodes.count() == 30
    store._fs().create(store._path(f"{tmp_path}/s/p/log/{2:012d}.json")).close()  # another writer commits first
    own, store.generation = store.generation, lambda p: 1
    try:
        with pytest.raises(StaleGeneration):
            store._commit("p", None, {"nodes": view.nodes.limit(1)})
    finally:
        store.generation = own


def test_store_lookups(spark, tmp_path):
    view, store = small(spark), Store(spark, str(tmp_path / "s"))
    store.replace(view, "p", files=spark.createDataFrame([("n.rs", "h")], "path string, content_hash string"))
    assert [r.id for r in store.scan_nodes("p").limit(2).collect()] == ["nation:0", "nation:1"]
    assert [r.source for r in store.scan_edges("p").limit(2).collect()] == ["nation:0", "nation:1"]
    assert store.node("p", "nation:4").first().name == store.node_by_name("p", "nation:4").first().name and store.file("p", "n.rs").count() == 1 and store.nodes_for_file("p", "n.rs").count() == 25
    assert store.edges_from("p", ["nation:4", "nation:5"]).count() == 2 and store.edges_to("p", spark.createDataFrame([("region:1",)], "id string")).count() == 5
    assert store.edges_from("p", [f"nation:{i}" for i in range(2000)]).count() == 25 and store.edges_from("p", []).count() == 0
    with pytest.raises(KeyError):
        store.files("q")


def test_git_history_in_store(spark, tmp_path):
    nodes = spark.createDataFrame([("p", f"f{i}", "File", f"{c}.rs", f"{c}.rs", f"{c}.rs", None, None, p) for i, (c, p) in enumerate([("a", "{}"), ("b", '{"x":1,"change_count":9}'), ("c", '{"last_modified":5}')])], "project string, id string, label string, name string, qualified_name string, file_path string, start_line long, end_line long, properties string")
    edges = spark.createDataFrame([], "project string, source string, target string, kind string, discriminator string, properties string")
    store = Store(spark, str(tmp_path / "s"))
    store.replace(GraphView(nodes, edges), "p")
    history = spark.createDataFrame([("a.rs", 3, 30), ("b.rs", 4, 40), ("z.rs", 1, 1)], "path string, changes long, last long")
    pairs = spark.createDataFrame([("a.rs", "b.rs", 3, 0.756, 30), ("a.rs", "z.rs", 3, 0.9, 30), ("a.rs", "a.rs", 3, 0.9, 30)], "a string, b string, together long, score double, last long")
    for _ in range(2):
        store.replace_git_history("p", history, pairs)
    props = {r.id: json.loads(r.properties) for r in store.scan_nodes("p").collect()}
    assert props == {"f0": {"last_modified": 30, "change_count": 3}, "f1": {"x": 1, "last_modified": 40, "change_count": 4}, "f2": {"last_modified": 5}}
    assert [(r.source, r.target, r.kind, json.loads(r.properties)) for r in store.scan_edges("p").collect()] == [("f0", "f1", "FILE_CHANGES_WITH", {"co_changes": 3, "coupling_score": 0.76, "last_co_change": 30})]


def test_stream(spark, tmp_path):
    rows = [("a", "b", None), ("a", "b", 3), ("", "b", 1), ("a", "c", -1)]
    spark.createDataFrame(rows, "caller string, callee string, count long").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = traces.ingest(spark.readStream.schema("caller string, callee string, count long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination()
    assert [tuple(r) for r in traces.stored(spark, str(tmp_path / "out")).collect()] == [("a", "b", 4)]


def test_search_pages(spark):
    view = commerce(spark, SF, {"Nation"}, {"IN_REGION"})
    r = search.SearchRequest(label="Nation", limit=10)
    page, total, cursor = search.search_graph(view, r)
    assert (page.count(), total) == (10, 25)
    with pytest.raises(ValueError, match="cursor"):
        search.SearchRequest(label="Region", cursor=cursor).start()
    assert search.literal_of("^abc$") == "abc" and search.literal_of("^a.c$") is None


def test_trace_limit(spark):
    view = commerce(spark, SF, {"Region", "Nation"}, {"IN_REGION"})
    rows, cut = traverse.trace_path(view, "ASIA", "inbound", limit=2)
    assert rows.count() == 2 and cut


def test_glob():
    import re

    assert re.match(text.glob_regex("src/**/*.rs"), "src/a/b.rs") and not re.match(text.glob_regex("*.rs"), "a/b.rs")
