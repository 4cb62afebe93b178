"""Passes over facts of code, on small sources, and the functions that read names and lines."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plexloom.graph import GraphView
from plexloom.operators import derive, enrich, names, vectors


def values(spark, made, rows, kind="string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, a {kind}" + (f", b {kind}" if isinstance(rows[0], tuple) else ""))
    out = df.select("i", made.alias("x")).orderBy("i").collect()
    return [r.x for r in out]


@pytest.fixture(autouse=True, scope="module")
def columns(spark):
    global A, B
    A, B = F.col("a"), F.col("b")


def test_literals(spark):
    texts = ["get('/a')", 'x("b\\"c", "d")', "`t`", "none", "open 'end", "''", "'" + "y" * 600 + "'", 'f("")("z")']
    assert values(spark, names.first_literal(A), texts) == ["/a", 'b"c', "t", None, None, None, "y" * 512, None]


def test_methods(spark):
    assert values(spark, names.http_method(A), ["axios.get", "c.PostAsync", "rest.getForObject", "x.fetch", "Get"]) == ["GET", "POST", "GET", None, None]
    assert values(spark, names.annotated_method(A), ["  @Get('/x')", "app.route('/x', DELETE)", "#[post(\"/y\")]", "@Entity", "return get(x)"]) == ["GET", "DELETE", "POST", "ANY", None]


def test_names(spark):
    odd = ["new  a::b->C", "'x\\y/z';", "$this->run", "a..b", ""]
    assert values(spark, names.normal_name(A), odd)[1:] == ["x.y.z", "this.run", "a.b", ""]
    assert values(spark, names.binding_key(A), ["a::b->C", "solo"]) == ["C", "solo"]
    assert values(spark, names.owner_type(A, B), [("m.Type.run", "run"), ("m.Type.run", "x"), ("run", "run")]) == ["Type", "Type", ""]
    assert values(spark, names.call_receiver(A), ["a.b.c", "c"]) == ["a.b", None]
    assert values(spark, names.tail_equal(A, B), [("a.b.c", "b::c"), ("c", "x.c"), ("bc", "c")]) == [True, True, False]
    assert values(spark, names.has_suffix(A, B), [("a.b.c", "b/c"), ("a.bb.c", "b.c")]) == [True, False]
    assert values(spark, names.import_reaches(A, B), [("m.x.f", "m.x"), ("p.m.x.f", "m.x"), ("p.m", "m"), ("mm.f", "m")]) == [True, True, True, False]
    assert values(spark, names.class_method_tail(A), ["a.b.C.m", "m"]) == ["C.m", None]


def test_protocol_names(spark):
    got = values(spark, names.grpc_method(A), ["pb.NewOrdersClient.Place", "stub = new UsersBlockingStub.find", "x.y", "Client.go"])
    assert [tuple(r) if r else None for r in got] == [("Orders", "Place"), ("Users", "find"), None, None]
    assert values(spark, names.graphql_operation(A), [" query Find($x: Int) {", "mutation{ add", "{ me }", "Only"]) == ["Find", None, None, "Only"]
    assert values(spark, names.trpc_procedure(A), ["api.trpc.user.byId.useQuery", "trpc.post.add.mutate", "a b", "user"]) == ["user.byId", "post.add", None, "user"]


def test_paths(spark):
    paths = ["src/a.rs", "vendor/x.rs", "yarn.lock", "a/Cargo.lock", "x.min.js", "", "my_vendor/x.rs"]
    assert values(spark, names.trackable(A), paths) == [True, False, False, False, False, False, True]
    assert values(spark, names.module_proximity(A, B), [("a", "b"), ("a/b/x", "a/b/y"), ("a/b/x", "a/c/y"), ("a/b/c/d", "a/x")]) == pytest.approx([1.0, 1.1, 1.05, 1 + 0.1 / 3])
    rows = spark.createDataFrame([("f", "m.a", 9), ("f", "m.a", 2), ("f", "m.b", 3), ("g", "m.a", 1), ("f", "m.a", 20)], "file string, qualified_name string, start int")
    assert sorted((r.file, r.start, r.qualified_name) for r in names.numbered(rows).collect()) == [("f", 2, "m.a"), ("f", 3, "m.b"), ("f", 9, "m.a#2"), ("f", 20, "m.a#3"), ("g", 1, "m.a")]


def test_routes(spark):
    urls = ["https://h/a/{id}/b?x", "/u/:key/z", "//h/<int:n>", "/t/a:b", "/x/${y}/", "http://h", "/v/{open"]
    assert values(spark, enrich.canonical_route(A), urls) == ["/a/{}/b", "/u/{}/z", "/{}", "/t/a:b", "/x/{}", "/", "/v/{}"]


def edges(view):
    return sorted((r.source, r.target, r.kind) for r in view.edges.collect())


def test_scaffold(spark):
    got = derive.scaffold(spark.createDataFrame([("a/x.py",), ("b.py",), ("b.py",)], "path string"), "p", "/root")
    assert edges(got) == [("branch:p.__branch__.working-tree", "file:a/x.py", "CONTAINS_FILE"), ("branch:p.__branch__.working-tree", "file:b.py", "CONTAINS_FILE"), ("project:p", "branch:p.__branch__.working-tree", "HAS_BRANCH")]
    assert {r.name for r in got.nodes.collect()} == {"p", "working-tree", "x.py", "b.py"} and got.problems().count() == 0
    again = derive.add(got, derive.scaffold(spark.createDataFrame([("b.py",), ("c.py",)], "path string"), "p", "/other"))
    assert again.nodes.count() == 5 and again.edges.count() == 4 and json.loads(again.nodes.filter("label = 'Project'").first().properties) == {"root_path": "/root"}


def test_settle(spark):
    node = "project string, id string, label string, name string, qualified_name string, file_path string, start_line long, end_line long, properties string"
    nodes = spark.createDataFrame([("p", "m", "Module", "m", "m", "b.py", 1, 1, "{}"), ("p", "m", "Module", "m", "m", "a.py", 1, 1, "{}"), ("p", "f", "Function", "f", "m.f", "a.py", 1, 1, "{}")], node)
    links = spark.createDataFrame([("p", "m", "f", "DEFINES", "", "{}"), ("p", "f", "gone", "CALLS", "", "{}")], "project string, source string, target string, kind string, discriminator string, properties string")
    got = derive.settle(GraphView(nodes, links))
    assert sorted(r.file_path for r in got.nodes.collect()) == ["a.py", "a.py"] and edges(got) == [("m", "f", "DEFINES")]


def test_environment(spark):
    calls = [("f", "os.getenv", "os.getenv('HOME_DIR')"), ("g", "std::env::var", 'var("HOME_DIR")'), ("f", "getenv", "getenv('lower')"), ("f", "getenv", "getenv(x)"), ("f", "print", "print('HOME')"), ("f", "getenv", "getenv('_1')")]
    got = derive.environment(spark.createDataFrame(calls, "source string, callee string, text string"), "p")
    assert edges(got) == [("f", "envvar:__env__HOME_DIR", "CONFIGURES"), ("g", "envvar:__env__HOME_DIR", "CONFIGURES")] and got.nodes.count() == 1


def test_services(spark):
    calls = [
        (1, "f", "a.ts", "axios.get", "get", "axios.get('/users/:id')"), (2, "f", "a.ts", "fetch", "fetch", "fetch('https://h/x')"), (3, "f", "a.ts", "fetch", "fetch", "fetch('/own')"), (4, "f", "a.ts", "k.send", "send", "k.send('topic')"),
        (5, "f", "a.ts", "q.client", "run", "gql('query Find { a }')"), (6, "f", "a.ts", "trpc.user.get.useQuery", "useQuery", "trpc.user.get.useQuery()"), (7, "f", "a.go", "pb.NewOrdersClient.Place", "Place", "Place(x)"), (8, "f", "a.ts", "other", "other", "other('/x')"),
    ]
    imports = [("a.ts", "k", "kafkajs"), ("a.ts", "q", "urql"), ("a.go", "pb", "google.golang.org/grpc/orders")]
    local = spark.createDataFrame([(3,)], "call_id long")
    got = derive.services(spark.createDataFrame(calls, "call_id long, source string, file string, callee string, short string, text string"), spark.createDataFrame(imports, "file string, alias string, module string"), "p", local)
    assert edges(got) == [
        ("f", "route:__graphql__Find", "GRAPHQL_CALLS"), ("f", "route:__grpc__Orders/Place", "GRPC_CALLS"), ("f", "route:__route__ANY__/x", "HTTP_CALLS"), ("f", "route:__route__GET__/users/{}", "HTTP_CALLS"),
        ("f", "route:__route__kafka__topic", "ASYNC_CALLS"), ("f", "route:__trpc__user.get", "TRPC_CALLS"),
    ]
    assert got.nodes.count() == 6


FILES = [
    ("api.py", "import x\n\n@app.get('/users/<id>')\ndef one():\n    pass\n@Post('/é')\n\ndef two():\n    pass\n@get('/lost')\n"),
    ("s.proto", "service Orders {\n  rpc Place (A) returns (B);\n}\nrpc Loose (A)\n"),
    ("q.graphql", "type Query {\n  # note\n  me: User\n  find(id: ID): User\n}\ntype User {\n  name: String\n}\n"),
    ("r.ts", "export const userRouter = createTRPCRouter({\n  byId: publicProcedure.query(() => {\n  }),\n});\nlate: publicProcedure.query()\n@Query()\nclass\n@KafkaListener(topics = 'orders')\n"),
]


def test_decorator_routes(spark):
    text = FILES[0][1]
    at = lambda word: len(text[: text.index(word)].encode())
    functions = spark.createDataFrame([("one", "m.one", "api.py", at("def one")), ("two", "m.two", "api.py", at("def two")), ("else", "m.else", "b.py", 999)], "id string, qualified_name string, file_path string, start long")
    got = derive.decorator_routes(spark.createDataFrame(FILES, "path string, text string"), functions, "p")
    assert edges(got) == [("one", "route:__route__GET__/users/{}", "HANDLES"), ("two", "route:__route__POST__/é", "HANDLES")]


def test_protocol_handlers(spark):
    files = spark.createDataFrame(FILES, "path string, text string")
    got = {(r.path, r.route, r.source, r.hint) for r in derive.declarations(files).collect()}
    assert got == {
        ("s.proto", "__grpc__Orders/Place", "grpc", "Place"), ("q.graphql", "__graphql__me", "graphql", "me"), ("q.graphql", "__graphql__find", "graphql", "find"), ("r.ts", "__trpc__user.byId", "trpc", "byId"),
        ("r.ts", "__graphql__", "graphql", None), ("r.ts", "__route__kafka__orders", "async_listener", None),
    }
    functions = spark.createDataFrame([("near", "byId", "m.byId", "r.ts", 40), ("far", "xbyId", "m.xbyId", "r.ts", 4000), ("next", "onOrder", "m.onOrder", "r.ts", 170), ("p", "doPlace", "m.doPlace", "s.proto", 500)], "id string, name string, qualified_name string, file_path string, start long")
    nodes = spark.createDataFrame([("file:q", "q.graphql", "q.graphql", "q.graphql")], "id string, name string, qualified_name string, file_path string")
    got = derive.protocol_handlers(files, functions, nodes, "p")
    text, at = FILES[3][1], 170
    assert text.index("@Kafka") < at
    assert edges(got) == [
        ("file:q", "route:__graphql__find", "HANDLES"), ("file:q", "route:__graphql__me", "HANDLES"), ("near", "route:__trpc__user.byId", "HANDLES"), ("next", "route:__graphql__onOrder", "HANDLES"),
        ("next", "route:__route__kafka__orders", "HANDLES"), ("p", "route:__grpc__Orders/Place", "HANDLES"),
    ]


def test_call_and_relation_edges(spark):
    types = spark.createDataFrame([("a", "m", "Base", "m.Base"), ("b", "n", "Base", "n.Base"), ("c", "n", "Solo", "n.Solo")], "id string, module string, name string, qualified_name string")
    relations = spark.createDataFrame([(1, "f", "n::Base"), (2, "f", "Base"), (3, "g", "Base"), (4, "h", "Solo"), (5, "h", "Base"), (6, "h", "None")], "relation_id long, file string, name string")
    got = enrich.resolve_relations(relations, types, spark.createDataFrame([("f", "m")], "file string, module_path string"), spark.createDataFrame([("g", "n")], "file string, module string"))
    assert sorted(map(tuple, got.collect())) == [(1, "b", "exact"), (2, "a", "import"), (3, "b", "module"), (4, "c", "unique")]
    made = derive.relation_edges(spark.createDataFrame([(1, "x", "INHERITS"), (2, "x", "IMPLEMENTS")], "relation_id long, source string, kind string"), got, "p")
    assert sorted((r.source, r.target, r.kind) for r in made.collect()) == [("x", "a", "IMPLEMENTS"), ("x", "b", "INHERITS")]
    calls = spark.createDataFrame([(1, "f", "g", 3, 40), (2, "f", "h", 4, 60)], "call_id long, source string, callee string, line long, start long")
    made = derive.call_edges(calls, spark.createDataFrame([(1, "g1", "unique")], "call_id long, target string, strategy string"), "p").collect()
    assert [(r.source, r.target, r.discriminator, json.loads(r.properties)) for r in made] == [("f", "g1", "40", {"callee": "g", "line": 3, "strategy": "unique"})]


def test_class_method_calls(spark):
    symbols = spark.createDataFrame([("1", "f", "pkg.A", "run", "pkg.A.run"), ("2", "f", "pkg.B", "run", "pkg.B.run")], "id string, file string, container string, name string, qualified_name string")
    calls = spark.createDataFrame([(1, "x", None, "com.other.A.run", None)], "call_id long, file string, container string, name string, receiver string")
    got = enrich.resolve_calls(calls, symbols, spark.createDataFrame([], "file string, module_path string"))
    assert [tuple(r) for r in got.collect()] == [(1, "1", "class_method")]


def test_cross_links(spark):
    calls = spark.createDataFrame([("c1", "p", "GET", "/u/7/x"), ("c2", "p", "POST", "/u/7/x"), ("c3", "p", "ANY", "/a"), ("c4", "q", "GET", "/a")], "caller string, project string, method string, path string")
    handlers = spark.createDataFrame([("h1", "q", "GET", "/u/{}/x"), ("h2", "r", "ANY", "/u/{}/{}"), ("h3", "r", "ANY", "/u/7/x"), ("h4", "q", "ANY", "/a"), ("h5", "q", "GET", "/a"), ("h0", "q", "GET", "/u/{}"), ("h6", "r", "ANY", "/a")], "handler string, project string, method string, path string")
    got = sorted(map(tuple, enrich.cross_routes(calls, handlers).collect()))
    assert got == [("c1", "p", "q", "h1", 2), ("c1", "p", "r", "h3", 1), ("c2", "p", "r", "h3", 1), ("c3", "p", "q", "h4", 0), ("c3", "p", "r", "h6", 0), ("c4", "q", "r", "h6", 1)]
    emits = spark.createDataFrame([("e", "p", "Kafka", "t"), ("e", "p", "Kafka", "T")], "emitter string, project string, transport string, channel string")
    listens = spark.createDataFrame([("l2", "q", "kafka", "t"), ("l1", "q", "KAFKA", "t"), ("l0", "p", "kafka", "t"), ("l3", "r", "nats", "t")], "listener string, project string, transport string, channel string")
    assert [tuple(r) for r in enrich.channel_links(emits, listens).collect()] == [("e", "p", "q", "l1")]
    links = spark.createDataFrame([("p", "f", "r1", "F", "f.rs", "q", "h", "r2", "H", None, "GET /x")], "project string, source string, target string, source_name string, source_file string, remote string, remote_source string, remote_target string, remote_name string, remote_file string, route string")
    made = {(r.project, r.source, r.target, r.discriminator): json.loads(r.properties) for r in enrich.cross_edges(links, "CROSS_HTTP_CALLS", route_qn="route").collect()}
    assert made == {("p", "f", "r1", "q"): {"target_project": "q", "target_name": "H", "target_file": "", "route_qn": "GET /x", "direction": "forward"}, ("q", "h", "r2", "p"): {"target_project": "p", "target_name": "F", "target_file": "f.rs", "route_qn": "GET /x", "direction": "reverse"}}


def test_codecs(spark):
    sig = spark.createDataFrame([(1, [(i * 7919 - 5) & 0xFFFFFFFF for i in range(64)])], "id long, s array<long>")
    row = sig.select("s", vectors.signature_hex(F.col("s")).alias("h")).select("s", "h", vectors.signature_of_hex(F.col("h")).alias("back"), vectors.signature_of_hex(F.lit("00")).alias("bad")).first()
    assert row.back == row.s and len(row.h) == 512 and row.bad is None and row.h[:8] == "fffffffb"
    text = ",".join(map(str, range(25)))
    row = spark.range(1).select(vectors.profile_of_text(F.lit(text)).alias("p"), vectors.profile_of_text(F.lit("1,2")).alias("few"), vectors.profile_of_text(F.lit(text.replace("24", "70000"))).alias("big")).first()
    assert row.p == list(range(25)) and row.few is None and row.big is None
    row = spark.createDataFrame([(list(range(25)),)], "p array<int>").select(vectors.profile_text(F.col("p")).alias("t"), vectors.profile_vector(F.col("p")).alias("v")).first()
    assert row.t == text and row.v[6] == 6 / 20 and row.v[24] == 24 / 2000 and len(row.v) == 25


def test_rotated_codes(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = rng.normal(size=(40, 768))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    rows[1] = 0.9 * rows[0] + 0.1 * rows[1]
    assert np.allclose(vectors.rotate(rows) @ vectors.rotate(rows).T, rows @ rows.T)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, vector array<double>")
    codes = vectors.encode_rotated(df).cache()
    assert len(codes.first().codes) == 512
    both = codes.select(F.struct("*").alias("a")).filter("a.id < 3").crossJoin(codes.select(F.struct("*").alias("b")))  # three rows
    for r in both.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), vectors.inner_product("a", "b").alias("x")).collect():
        assert abs(r.x - float(rows[r.i] @ rows[r.j])) < 0.05


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0], [0.0, 0.0], [1.0])], "a array<double>, b array<double>, z array<double>, s array<double>").select(
        vectors.float_cosine(F.col("a"), F.col("b")).alias("one"), vectors.float_cosine(F.col("a"), F.col("z")).alias("none"), vectors.float_cosine(F.col("a"), F.col("s")).alias("sizes"), vectors.normalised(F.col("a")).alias("n"), vectors.add_scaled(F.col("a"), F.col("b"), 0.5).alias("sum")
    ).first()
    assert (row.one, row.none, row.sizes, row.n, row["sum"]) == (pytest.approx(1), 0, 0, [0.6, 0.8], [6.0, 8.0])
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, vector array<double>")
    got = {r.id: r.vector for r in vectors.diffuse(v, spark.createDataFrame([(1, 2), (1, 3)], "id long, other long"), 0.5).collect()}
    assert got[2] == [0.0, 1.0] and got[1] == pytest.approx([0.75 / (0.75**2 + 0.5**2) ** 0.5, 0.5 / (0.75**2 + 0.5**2) ** 0.5])


def test_semantic_index(spark):
    weights = spark.createDataFrame([("n1", "alpha", 0.8), ("n1", "beta", 0.6), ("n2", "alpha", 1.0), ("n3", "gamma", 1.0)], "id string, token string, weight double")
    stored = spark.createDataFrame([("gamma", [127] + [0] * 767)], "token string, vector array<int>")
    got = {r.id: r.vector for r in vectors.node_vectors(weights, "id", stored).collect()}
    assert all(len(v) == 768 for v in got.values()) and got["n3"][0] == 127 and sum(map(abs, got["n3"])) == 127 and 4 <= sum(x != 0 for x in got["n2"]) <= 8
    nodes = spark.createDataFrame([("n1", "a", "m.a", "Function"), ("n2", "b", "m.b", "Module")], "id string, name string, qualified_name string, label string")
    assert [r.id for r in vectors.with_nodes(weights.select("id").distinct(), nodes, vectors.SEMANTIC_LABELS).collect()] == ["n1"]
    with pytest.raises(LookupError, match="n3"):
        vectors.with_nodes(weights, nodes, strict=True)
    assert [r.id for r in vectors.indexed_nodes(nodes, ["Module"]).collect()] == ["n1"]


def test_data_flows_of_one_route(spark, monkeypatch):
    """All pairs of a route that nearly everything meets in, each once, and in no task more than a small share of them."""
    monkeypatch.setattr(enrich, "FLOW_BLOCK", 16, raising=False)
    calls = [(f"c{i}", "r", "HTTP_CALLS") for i in range(300)] + [("c1", "r", "HTTP_CALLS"), ("x", "q", "HTTP_CALLS"), ("lone", "p", "HTTP_CALLS")]
    handles = [(f"h{i}", "r", "HANDLES") for i in range(200)] + [("c0", "r", "HANDLES"), ("x", "q", "HANDLES"), ("y", "q", "HANDLES"), ("y", "q", "HANDLES")]
    got = enrich.data_flows(spark.createDataFrame(calls + handles, "source string, target string, kind string"))
    rows = [tuple(r) for r in got.select("source", "target", "route", F.spark_partition_id()).collect()]
    want = {(f"c{i}", t, "r") for i in range(300) for t in [f"h{j}" for j in range(200)] + ["c0"] if f"c{i}" != t} | {("x", "y", "q")}
    assert len(rows) == len(want) and {r[:3] for r in rows} == want
    assert max(Counter(r[3] for r in rows).values()) < len(want) / 4
