"""Search, resolution, traces, changes, code search and version history, on small inputs."""

import pytest
from pyspark.sql import functions as F

from plexloom.graph import GraphView
from plexloom.operators import search, text, traverse
from plexloom.operators.text import term_counts
from plexloom.sources import repository

NODE = "project string, id string, label string, name string, qualified_name string, file_path string, start_line long, end_line long, properties string"
EDGE = "project string, source string, target string, kind string, discriminator string, properties string"


@pytest.fixture(scope="module")
def view(spark):
    rows = [
        ("f1", "Function", "parse", "app.parse", "src/a.rs"), ("f2", "Method", "parse", "app.Reader.parse", "src/b.rs"), ("c1", "Class", "Parse", "app.Parse", "src/c.rs"), ("c2", "Struct", "parse", "lib.parse", "vendor/d.rs"),
        ("f3", "Function", "read_all", "app.read_all", "src/a.rs"), ("m1", "Module", "app", "app", "src/a.rs"), ("x1", "File", "a.rs", "src/a.rs", "src/a.rs"), ("f4", "Function", "myparse", "app.myparse", "src/e.rs"),
    ]
    nodes = spark.createDataFrame([("p", i, label, n, q, f, 1 + k, 4 + k, '{"is_entry_point":true}' if i == "f3" else "{}") for k, (i, label, n, q, f) in enumerate(rows)], NODE)
    links = [("f3", "f1", "CALLS"), ("f3", "f2", "CALLS"), ("f1", "c1", "USES"), ("f1", "f3", "CALLS"), ("m1", "f1", "DEFINES"), ("x1", "f4", "IMPORTS"), ("f4", "f4", "CALLS")]
    return GraphView(nodes, spark.createDataFrame([("p", a, b, k, "", "{}") for a, b, k in links], EDGE))


def test_ranking(view):
    """Names as asked, then in other letters, types before callables."""
    page, total, _ = search.search_graph(view, search.SearchRequest(name_pattern="parse"))
    assert [r.id for r in page.collect()] == ["c2", "f2", "f1", "f4"] and total == 4
    page, _, _ = search.search_graph(view, search.SearchRequest(query="parse"))
    assert [r.id for r in page.collect()][:4] == ["c2", "f1", "f2", "c1"]


def test_filters(view):
    found = lambda **r: sorted(x.id for x in search.search_graph(view, search.SearchRequest(**r))[0].collect())
    assert found(query="parse NOT lib", label="Function") == ["f1"]
    assert found(query="read* OR \"app Reader\"") == ["f2", "f3"]
    assert found(min_degree=3) == ["f1", "f3", "f4"] and found(max_degree=0) == ["c2"]
    assert found(relationship="CALLS", exclude_entry_points=True) == ["f1", "f2", "f4"]
    assert found(query="nothing_at_all") == []
    page = search.search_graph(view, search.SearchRequest(label="Function", degrees=True, include_connected=True))[0].collect()
    assert [(r.id, r.in_degree, r.out_degree, r.connected) for r in page] == [("f4", 2, 1, ["myparse"]), ("f1", 2, 2, ["read_all"]), ("f3", 1, 2, ["parse"])]


def test_text_queries():
    parse = search.parse_text_query
    assert parse("One two*") == [[("one", False, False), ("two", True, False)]]
    assert parse('a OR "b c" NOT d') == [[("a", False, False)], [("b", False, False), ("c", False, False), ("d", False, True)]]
    assert parse("NOT x") == [] and parse("") == []


def test_accents(spark):
    docs = spark.createDataFrame([(1, "Café ÑANDÚ"), (2, "cafe\u0301_bar"), (3, "Größe caf")], "id long, body string")
    found = lambda q: sorted(r.id for r in search.text_search(docs, "id", "body", q, folded=True).collect())
    assert found("CAFÉ") == [1, 2] and found("nandu") == [1] and found("cafe_bar") == [2] and found("größe OR ñandú") == [1, 3] and found("caf*") == [1, 2, 3]


def test_index_is_the_scan(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "Red hen"), (3, None), (4, "fox"), (5, "reddish fox hen hen")], "id long, body string")
    search.build_text_index(docs, "id", "body", str(tmp_path))
    for query in ("red", "red* fox", "fox NOT hen", "hen OR fox", "absent"):
        a, b = ({r.id: round(r.score, 9) for r in df.collect()} for df in (search.text_search(docs, "id", "body", query), search.search_text_index(spark, str(tmp_path), "id", query)))
        assert a == b and (a or query == "absent")


def test_resolution(view):
    one = lambda name, **k: search.resolve_one(view, name, **k).first().id
    assert one("app.parse") == "f1" and one("Reader.parse") == "f2" and one("myparse") == "f4"
    with pytest.raises(search.AmbiguousSymbol) as e:
        one("parse")
    assert [i for i, _ in e.value.candidates] == ["f2", "f1", "c2"]
    with pytest.raises(search.SymbolNotFound) as e:
        one("PARS")
    assert [q for _, q in e.value.suggestions] == ["app.Parse", "app.Reader.parse", "app.myparse", "app.parse", "lib.parse"]
    with pytest.raises(search.SymbolNotFound):
        one("y.parse")  # no separator before it
    assert one("lib.parse") == "c2"
    with pytest.raises(search.SymbolNotFound):
        one("lib.parse", callables=True)


def test_trace(view):
    rows, cut = traverse.trace_path(view, "app.read_all", "outbound", 2)
    assert [(r.id, r.hop, r.via_source) for r in rows.collect()] == [("f2", 1, "f3"), ("f1", 1, "f3"), ("c1", 2, "f1")] and not cut
    with pytest.raises(search.AmbiguousSymbol):
        traverse.trace_path(view, "parse")


def test_changes(view, spark):
    files = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    rows, cut = traverse.detect_changes(view, files("src/c.rs"), files("src/e.rs"), 2)
    assert [(r.qualified_name, r.level) for r in rows.collect()] == [("app.Parse", 0), ("app.myparse", 1), ("app.parse", 1), ("app.read_all", 2)] and not cut
    rows, cut = traverse.detect_changes(view, files("src/c.rs"), None, 0)
    assert [r.qualified_name for r in rows.collect()] == ["app.Parse"]
    rows, cut = traverse.detect_changes(view, files("src/a.rs"), limit=2)
    assert rows.count() == 2 and cut and "src/a.rs" not in {r.qualified_name for r in rows.collect()}


CODE = [("src/a.rs", "fn parse() {\n  let x = 1;\n}\n" + "\n" * 300 + "let x = 2;"), ("tests/t.rs", "let x = 3;"), ("lib/z.py", "x = let")]


def test_search_code(spark):
    files = spark.createDataFrame(CODE, "path string, text string")
    nodes = spark.createDataFrame([("n1", "parse", "a.parse", "Function", "src/a.rs", 1, 3, 2), ("n2", "a", "a", "Module", "src/a.rs", 1, 600, 0), ("n3", "t", "t", "Module", "tests/t.rs", 9, 12, 0)], "id string, name string, qualified_name string, label string, file_path string, start_line long, end_line long, in_degree long")
    got = text.search_code(files, nodes, "let x")
    assert [(r.id, r.score, r.lines) for r in got["results"].collect()] == [("n1", 12, [2]), ("n2", 0, [304])]
    assert [(r.path, r.line) for r in got["raw"].collect()] == [("tests/t.rs", 1)] and (got["lines"], got["found"], got["raw_found"], got["ratio"]) == (3, 2, 1, "1.0x")
    assert {r.directory: r.n for r in got["directories"].collect()} == {"src/": 2}
    assert [r.file for r in text.search_code(files, nodes, "let", mode="files")["files"].collect()] == ["lib/z.py", "src/a.rs", "tests/t.rs"]
    full = {r.id: (r.shown_from, r.source) for r in text.search_code(files, nodes, "let x", mode="full")["results"].collect()}
    assert full["n1"] == (1, "fn parse() {\n  let x = 1;\n}") and full["n2"][0] == 299 and full["n2"][1].endswith("let x = 2;")
    near = {r.id: (r.shown_from, r.context) for r in text.search_code(files, nodes, "let x", context=1)["results"].collect()}
    assert near["n1"] == (1, "fn parse() {\n  let x = 1;\n}") and near["n2"][0] == 303
    assert text.search_code(files, nodes, "a|b")["warnings"] and text.search_code(files, nodes, "zzz")["ratio"] is None
    assert text.search_code(files, nodes, "x", glob="src/**", path_regex="a")["lines"] == 2
    for bad in ({"pattern": ""}, {"pattern": "x", "limit": 0}, {"pattern": "x", "mode": "odd"}):
        with pytest.raises(ValueError, match="empty pattern"):
            text.search_code(files, nodes, **bad)


def test_tightest_span(spark):
    """Against all pairs: spans over many blocks, nested, equal, and lines outside any."""
    spans = [(f"s{i}", "f" if i % 3 else "g", (i * 37) % 900, (i * 37) % 900 + (i * i) % 1500) for i in range(60)]
    lines = [("f" if i % 2 else "g", i * 13) for i in range(200)]
    got = text.tightest_span(spark.createDataFrame(lines, "path string, line long"), spark.createDataFrame(spans, "id string, file_path string, start_line long, end_line long"))
    best = lambda p, n: min(((b - a, i) for i, f, a, b in spans if f == p and a <= n <= b), default=(0, None))[1]
    assert {(r.path, r.line): r.span_id for r in got.collect()} == {(p, n): best(p, n) for p, n in lines}


def test_listings(spark):
    lines = ["M\tsrc/a.rs", "R100\told.rs\tnew.rs\r", "A\tvendor/x.rs", "", "D\tyarn.lock", "T\tb"]
    got = repository.name_status(spark.createDataFrame(list(enumerate(lines)), "n long, value string"))
    assert [tuple(r) for r in got.collect()] == [("M", "src/a.rs", None), ("R", "new.rs", "old.rs"), ("T", "b", None)]
    a, b = spark.createDataFrame([("z.rs",), ("a.rs",)], "path string"), spark.createDataFrame([(" M a.rs\0?? n.rs\0",), ("",)], "value string")
    assert [r.path for r in repository.changed_files(a, b).collect()] == ["a.rs", "n.rs", "z.rs"]


def test_git_context(tmp_path):
    assert not repository.git_context(str(tmp_path))["is_git"]
    git = tmp_path / ".git"
    (git / "refs/heads/feature").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/feature/x\n")
    (git / "refs/heads/feature/x").write_text("ab12\n")
    (tmp_path / "sub").mkdir()
    assert repository.git_context(str(tmp_path / "sub")) == {"is_git": True, "root": str(tmp_path.resolve()), "branch": "feature/x", "head": "ab12", "worktree": False}
    (git / "refs/heads/feature/x").unlink()
    (git / "packed-refs").write_text("# pack\ncd34 refs/heads/feature/x\n")
    assert repository.git_context(str(tmp_path))["head"] == "cd34"
    (git / "HEAD").write_text("ef56\n")
    assert repository.git_context(str(tmp_path))["branch"] is None and repository.git_context(str(tmp_path))["head"] == "ef56"


def test_hunks(spark):
    diff = ["+++ b/a.rs", "@@ -1 +5,0 @@", "@@ -1,2 +0,0 @@", "+++ b/vendor/v.rs", "@@ -1 +1,2 @@"]
    got = repository.diff_hunks(spark.createDataFrame(list(enumerate(diff)), "n long, value string"))
    assert [tuple(r) for r in got.collect()] == [("a.rs", 5, 5)]


def test_patterns(spark):
    assert spark.range(1).filter(F.lit("src/a/b.rs").rlike(text.glob_regex("src/**/*.rs"))).count() == 1


def test_policies(spark):
    ok = lambda p, fast=False: spark.range(1).select(repository.allowed(F.lit(p), fast)).first()[0]
    assert ok("src/a.rs") and not ok("a/.venv/x.py") and not ok("a/x.pyc") and not ok("tsconfig.json") and ok("docs/x.py") and ok("vendor.rs")
    assert not ok("docs/x.py", True) and not ok("a/mock_x.go", True) and not ok("LICENSE", True) and not ok("x.pdf", True) and ok("src/a.rs", True)
    rows = spark.createDataFrame([("a.log",), ("sub/a.log",), ("sub/keep.log",), ("sub/deep/keep.log",), ("sub/deep/x.txt",), ("node_modules/y.js",)], "p string")
    rules = [("sub/deep", ["*.txt", "!keep.log"]), ("", ["*.log", "!node_modules/"]), ("sub", ["!keep.log"])]
    assert sorted(r.p for r in rows.filter(repository.stacked_ignore(F.col("p"), rules)).collect()) == ["sub/deep/keep.log", "sub/keep.log"]
    assert spark.range(1).select(repository.language(F.lit("x.foo.py"), {".foo.py": "foo", ".py": "other"})).first()[0] == "foo"


def test_manifests(spark):
    from plexloom.operators import enrich

    files = [
        ("web/package.json", '{"name": "@x/web", "main": "./lib/index.js"}'), ("go.mod", "// c\n module example.com/tool \n"), ("core/Cargo.toml", "[workspace]\nname = 'no'\n[package]\nversion = '1'\nname = \"core\"\n[lib]\nname = \"other\"\n"),
        ("py/pyproject.toml", "[tool.poetry]\r\nname = 'pie'\r\n"), ("bad/package.json", "{"), ("none/Cargo.toml", "[lib]\nname = 'x'"), ("src/a.rs", "name = 'core'"),
    ]
    got = repository.manifests(spark.createDataFrame(files, "path string, text string"))
    assert sorted(map(tuple, got.collect())) == [("core/Cargo.toml", "core", "core", None), ("go.mod", "example.com/tool", "", None), ("py/pyproject.toml", "pie", "py", None), ("web/package.json", "@x/web", "web", "./lib/index.js")]
    paths = spark.createDataFrame([(p,) for p in ("web/lib/index.js", "web/a.js", "cmd/run.go", "core/src/lib.rs", "core/net.rs", "py/pie.py")], "path string")
    imports = spark.createDataFrame([(m,) for m in ("@x/web", "example.com/tool/cmd", "core::net", "core::src", "pie", "unknown", "corex")], "module string")
    assert dict(map(tuple, enrich.package_targets(imports, got, paths).collect())) == {"@x/web": "web/lib/index.js", "example.com/tool/cmd": "cmd/run.go", "core::net": "core/net.rs", "core::src": "core/src/lib.rs", "pie": "py/pie.py"}


def test_byte_chunks(spark):
    texts = [(1, "é" * 300), (2, ""), (3, None), (4, "😀" * 100 + "a"), (5, "x" * 256)]
    rows = text.byte_chunks(spark.createDataFrame(texts, "id long, text string"), "id", "text", 257).collect()
    by = {}
    for r in sorted(rows):
        by.setdefault(r.id, []).append(r)
    assert {i: "".join(r.piece for r in rs) for i, rs in by.items()} == {i: t for i, t in texts if t is not None}
    assert all(r.stop - r.start == len(r.piece.encode()) <= 257 for r in rows) and [r.start for r in by[1]] == [0, 256, 512] and len(by[2]) == 1
    with pytest.raises(ValueError, match="bytes"):
        text.byte_chunks(spark.createDataFrame(texts, "id long, text string"), "id", "text", 10)


def test_snippets(spark):
    import hashlib

    files = spark.createDataFrame([("a.rs", "one\ntwo\nthree", hashlib.sha256(b"one\ntwo\nthree").hexdigest()), ("b.rs", "x", "old")], "path string, text string, content_hash string")
    nodes = spark.createDataFrame([("n", "a.rs", 2, 3), ("m", "b.rs", 1, 1)], "id string, file_path string, start_line long, end_line long")
    assert sorted((r.id, r.source, r.fresh) for r in text.snippet(nodes, files).collect()) == [("m", "x", False), ("n", "two\nthree", True)]


def test_colours_and_linked_layout(spark, view):
    from plexloom.operators import summary

    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 % 2**32
        return summary.COLOURS[h % 12]

    labels = ["Function", "Class", "Größe"]
    got = spark.createDataFrame([(x,) for x in labels], "x string").select("x", summary.label_colour(F.col("x")).alias("c")).collect()
    assert {r.x: r.c for r in got} == {x: fnv(x) for x in labels}
    link = spark.createDataFrame([("p", "f1", "c1", "CROSS_HTTP_CALLS", "", '{"target_project":"q"}'), ("p", "f1", "c1", "CROSS_X", "", '{"target_project":"absent"}')], EDGE)
    other = GraphView(view.nodes.filter("id in ('c1', 'f1')").withColumn("id", F.concat(F.lit("q-"), "id")), view.edges.limit(0))
    nodes, links = summary.linked_layout(GraphView(view.nodes, view.edges.unionByName(link)), {"q": other})
    assert nodes.filter("linked = 'q'").count() == 2 and nodes.filter("linked = ''").count() == 8
    assert [tuple(r) for r in links.collect()] == [("f1", "q", "q-c1", "CROSS_HTTP_CALLS")]


def test_index_is_shuffled_once(spark, tmp_path):
    """Terms are counted where a text is read, also of null, empty and very long texts; only their order needs a shuffle."""
    from collections import Counter

    texts = [(1, "the license, THE end"), (2, None), (3, ""), (4, "!!"), (5, "Ünï ünï a_b " * 3000), (6, "the")]
    docs = spark.createDataFrame(texts, "id long, body string")
    got = term_counts(docs, "id", search.tokens(F.col("body")))
    want = {1: Counter("the license the end".split()), 5: Counter({"ünï": 6000, "a_b": 3000}), 6: Counter(["the"])}
    assert sorted(map(tuple, got.collect())) == sorted((k, sum(c.values()), w, n) for k, c in want.items() for w, n in c.items())
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
