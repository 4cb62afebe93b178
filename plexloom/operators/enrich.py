"""Passes that derive edges from facts: routes, links across projects, data flow, configuration, packages, calls and
files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexloom.operators.names import binding_key, normal_name

COMMIT_FILES, MIN_TOGETHER, MIN_SCORE = 20, 3, 0.3
#: Callers or handlers of a route in a block.
FLOW_BLOCK = 1024


def canonical_route(c):
    """The path of a url or route: without scheme, host, query and fragment, and without slashes at its end; its
    parameters, in braces or angles or after a colon that begins a segment, as {}."""
    path = F.regexp_replace(F.btrim(c, F.lit(" \t\r\n")), r"^(?:https?:)?//[^/?#]*", "")
    path = F.regexp_replace(path, r"(?s)[?#].*$", "")
    path = F.regexp_replace(path, r"\$?\{[^}]*\}?|<[^>]*>?|(?<=/|^):[^/]*", "{}")
    path = F.regexp_replace(path, r"(.)/+$", "$1")
    return F.when(path == "", F.lit("/")).otherwise(path)


def data_flows(edges: DataFrame, call: str = "HTTP_CALLS", handle: str = "HANDLES") -> DataFrame:
    """(source, target, route): callers of a route and its handlers, apart from themselves.

    The pairs of a route are as many as its callers times its handlers.  Both are dealt into blocks of some FLOW_BLOCK
    rows, and each block of callers meets each of handlers in a group of its own, so no task holds a whole route.  As both
    sides are distinct, so are their pairs."""
    callers = edges.filter(F.col("kind") == call).select("source", F.col("target").alias("route")).distinct()
    handlers = edges.filter(F.col("kind") == handle).select(F.col("source").alias("target"), F.col("target").alias("route")).distinct()
    blocks = lambda df, name: df.groupBy("route").agg(F.ceil(F.count("*") / FLOW_BLOCK).alias(name))
    routes = blocks(callers, "callers").join(blocks(handlers, "handlers"), "route")
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = callers.join(routes, "route").select("source", "route", deal("source", "callers").alias("a"), each("handlers").alias("b"))
    b = handlers.join(routes, "route").select("target", "route", each("callers").alias("a"), deal("target", "handlers").alias("b"))
    # a given number of partitions, as AQE would judge by the rows that go in, not by the pairs
    spark = edges.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    a, b = (df.repartition(n, "route", "a", "b") for df in (a, b))
    return a.hint("merge").join(b, ["route", "a", "b"]).filter("source <> target").select("source", "target", "route")


def _templates(callers: DataFrame, first: DataFrame) -> DataFrame:
    """Calls with the handlers of which the path has {} for some of the call's segments.

    The shapes of templates, that is where their {} stand, are few; a call is masked by each shape of its length, and the
    masked path is an equi-join key, so no call meets a template that doesn't fit."""
    cut = lambda c: F.split(c, "/")
    t = first.filter(F.contains("h_path", F.lit("{}"))).withColumn("shape", F.transform(cut("h_path"), lambda x: x == "{}"))
    shapes = t.select("shape", F.size("shape").alias("k")).distinct()
    masked = F.array_join(F.zip_with("segments", "shape", lambda x, open_: F.when(open_, "{}").otherwise(x)), "/")
    calls = callers.withColumn("segments", cut("path")).withColumn("k", F.size("segments")).join(shapes, "k").withColumn("masked", masked)
    fits = (F.col("path") != F.col("h_path")) & ((F.col("h_method") == "ANY") | (F.col("h_method") == F.col("method")))
    return calls.join(t.drop("shape"), F.col("masked") == F.col("h_path")).filter(fits)


def cross_routes(callers: DataFrame, handlers: DataFrame) -> DataFrame:
    """Links (caller, project, remote, handler, priority) of calls (caller, project, method, path) to handlers (handler,
    project, method, path) of other projects: of the same method first, then of any method, then by a template whose {}
    stand for the call's segments; of a project the first handler.  Handlers are reduced to the first of each project,
    method and path before any join."""
    first = handlers.groupBy(F.col("project").alias("remote"), F.col("method").alias("h_method"), F.col("path").alias("h_path")).agg(F.min("handler").alias("handler"))
    other = F.col("project") != F.col("remote")
    same = callers.join(first, (F.col("path") == F.col("h_path")) & (F.col("method") == F.col("h_method"))).withColumn("priority", F.lit(0))
    any_ = callers.filter("method <> 'ANY'").join(first.filter("h_method = 'ANY'"), F.col("path") == F.col("h_path")).withColumn("priority", F.lit(1))
    cols = ["caller", "project", "remote", "handler", "priority", "h_method", "h_path"]
    rows = same.select(cols).unionByName(any_.select(cols)).unionByName(_templates(callers, first).withColumn("priority", F.lit(2)).select(cols)).filter(other)
    best = F.min(F.struct("priority", "h_method", "h_path", "handler"))
    return rows.groupBy("caller", "project", "remote").agg(best.alias("b")).select("caller", "project", "remote", "b.handler", "b.priority")


def channel_links(emits: DataFrame, listens: DataFrame) -> DataFrame:
    """Links (emitter, project, remote, listener) of emitters (emitter, project, transport, channel) to the first listener
    (listener, project, transport, channel) of each other project: transports alike but for case, channels alike."""
    first = listens.groupBy(F.lower("transport").alias("t"), F.col("channel").alias("c"), F.col("project").alias("remote")).agg(F.min("listener").alias("listener"))
    both = emits.join(first, (F.lower("transport") == F.col("t")) & (F.col("channel") == F.col("c")) & (F.col("project") != F.col("remote")))
    return both.groupBy("emitter", "project", "remote").agg(F.min("listener").alias("listener"))


def cross_edges(links: DataFrame, kind: str, **ends: str) -> DataFrame:
    """Edges both ways for links: in the caller's project to its route or channel, and in the other one from the handler
    to its own.  links: project, source, target, source_name, source_file, remote, remote_source, remote_target,
    remote_name, remote_file, and the columns that `ends` names, as properties."""
    props = lambda project, name, file, way: F.to_json(F.struct(F.col(project).alias("target_project"), F.col(name).alias("target_name"), F.coalesce(F.col(file), F.lit("")).alias("target_file"), *[F.col(c).alias(k) for k, c in ends.items()], F.lit(way).alias("direction")))
    edge = lambda project, source, target, other, properties: links.select(F.col(project).alias("project"), F.col(source).alias("source"), F.col(target).alias("target"), F.lit(kind).alias("kind"), F.col(other).alias("discriminator"), properties.alias("properties"))
    there = edge("project", "source", "target", "remote", props("remote", "remote_name", "remote_file", "forward"))
    back = edge("remote", "remote_source", "remote_target", "project", props("project", "source_name", "source_file", "reverse"))
    return there.unionByName(back).dropDuplicates(["project", "source", "target", "kind", "discriminator"])


def config_links(keys: DataFrame, symbols: DataFrame) -> DataFrame:
    """(key, id, confidence): 0.85 if the normalised names are equal, 0.75 if the symbol's holds the key's."""
    norm = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    k = keys.select("key", norm(F.col("key")).alias("k")).filter("k <> ''")
    s = symbols.select("id", norm(F.col("name")).alias("s"))
    equal = k.join(s, F.col("k") == F.col("s")).select("key", "id", F.lit(0.85).alias("confidence"))
    # every stretch of a symbol as long as some key is an equi-join key, so no pair is tried in vain; lengths are those of
    # keys up to the longest symbol, so there are no more of them than that has letters
    longest = s.agg(F.coalesce(F.max(F.length("s")), F.lit(0)).alias("most"))
    lengths = k.select(F.length("k").alias("n")).distinct().join(F.broadcast(longest), F.col("n") < F.col("most")).groupBy().agg(F.collect_set("n").alias("ns"))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length("s") - n + 1), lambda i: F.substr("s", i, n))
    cut = s.crossJoin(F.broadcast(lengths)).select("id", F.explode(F.array_distinct(F.flatten(F.transform(F.filter("ns", lambda n: n < F.length("s")), of)))).alias("k"))  # lengths is one row
    return equal.unionByName(k.join(cut, "k").select("key", "id", F.lit(0.75).alias("confidence")))


def package_links(imports: DataFrame, manifests: DataFrame) -> DataFrame:
    """(module, manifest): a module is a package's name, or begins with it and one of / . :; the first manifest wins."""
    heads = F.array_distinct(F.concat(F.array("module"), F.transform(F.filter(F.sequence(F.lit(2), F.greatest(F.length("module"), F.lit(2))), lambda i: F.substr("module", i, F.lit(1)).isin("/", ".", ":")), lambda i: F.substr("module", F.lit(1), i - 1))))
    found = imports.select("module", F.explode(heads).alias("name")).join(manifests.select("name", "manifest"), "name")
    return found.groupBy("module").agg(F.min("manifest").alias("manifest"))


def package_targets(imports: DataFrame, manifests: DataFrame, paths: DataFrame) -> DataFrame:
    """(module, path): the file of paths (path) that an imported module stands for, by its package's manifest (manifest,
    name, root, entry): the manifest's entry, or what the module says after the package's name, with or without a
    suffix of its language, or the first file of a folder of that name."""
    named = package_links(imports, manifests).join(manifests, "manifest").filter((F.col("module") == F.col("name")) | F.startswith("module", F.col("name")))
    rest = F.regexp_replace(F.substr("module", F.length("name") + 1), r"^[/.:]+", "")
    entry = F.regexp_replace(F.coalesce("entry", rest), r"^(?:\./)+", "")
    want = named.select("module", F.array_join(F.filter(F.array("root", entry), lambda x: x != ""), "/").alias("joined"))
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    keys = F.array_distinct(F.concat(F.array("path", F.regexp_replace("path", r"\.(?:rs|go|py|js|ts)$", "")), F.when(F.size(parts) > 1, folders).otherwise(F.expr("cast(array() as array<string>)")), F.array(F.lit(""))))
    return want.join(paths.select("path", F.explode(keys).alias("joined")), "joined").groupBy("module").agg(F.min("path").alias("path"))


def _only(pairs: DataFrame, strategy: str, priority: int) -> DataFrame:
    """Calls for which a strategy leaves one target."""
    one = pairs.groupBy("call_id").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).filter("n = 1")
    return one.select("call_id", "target", F.lit(strategy).alias("strategy"), F.lit(priority).alias("p"))


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(call_id, target, strategy) for calls (call_id, file, container, name, receiver) to symbols (id, file, container,
    name, qualified_name): by receiver type, import, container, qualified suffix, class and method, then unique name; a
    strategy counts only if it leaves one symbol.

    Each strategy is an equi-join on all that it tells, never on the short name alone: the unique name is taken from the
    names that one symbol has."""
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    s = symbols.select(F.col("id").alias("target"), F.col("container").alias("s_container"), F.col("name").alias("s_name"), "qualified_name")
    c = calls.select("call_id", "file", "container", "name", "receiver", last("name").alias("short"))
    by_type = s.select("target", "s_name", last("s_container").alias("s_type"))
    receiver = c.join(by_type, (F.col("short") == F.col("s_name")) & (F.col("receiver") == F.col("s_type")))
    # an import reaches what lies under it: every beginning of a symbol's name, up to a point, is a key
    parts = F.split("qualified_name", r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    under = s.filter(F.contains("qualified_name", F.lit("."))).select("target", "s_name", F.explode(heads).alias("head"))
    imported = c.join(imports.select("file", "module_path").distinct(), "file").join(under, (F.col("module_path") == F.col("head")) & (F.col("short") == F.col("s_name")))
    inside = c.join(s, (F.col("short") == F.col("s_name")) & (F.col("container") == F.col("s_container")))
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    ends = s.filter(F.contains("qualified_name", F.lit("."))).select("target", F.explode(tails).alias("tail")).filter(F.contains("tail", F.lit(".")))
    dotted = c.filter(F.contains("name", F.lit(".")))
    suffix = dotted.join(ends, F.col("name") == F.col("tail"))
    # of a long dotted name only its class and method, as in languages of the JVM
    jvm = dotted.withColumn("cm", F.substring_index("name", ".", -2)).join(ends, F.col("cm") == F.col("tail"))
    single = s.groupBy("s_name").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).filter("n = 1").select("s_name", "target")
    unique = c.join(single, F.col("short") == F.col("s_name"))
    found = None
    for p, (name, pairs) in enumerate([("receiver", receiver), ("import", imported), ("container", inside), ("suffix", suffix), ("class_method", jvm), ("unique", unique)]):
        one = _only(pairs, name, p)
        found = one if found is None else found.unionByName(one)
    return found.groupBy("call_id").agg(F.min(F.struct("p", "target", "strategy")).alias("b")).select("call_id", "b.target", "b.strategy")


def resolve_relations(relations: DataFrame, types: DataFrame, imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(relation_id, target, strategy) of relations (relation_id, file, name), as of a class to what it inherits, to types
    (id, module, name, qualified_name): by exact qualified name, by an import of the file (file, module_path), in the
    file's own module (file, module), then by a name that one type has."""
    t = types.select(F.col("id").alias("target"), F.col("module").alias("t_module"), F.col("name").alias("t_name"), "qualified_name")
    r = relations.select("relation_id", "file", normal_name(F.col("name")).alias("name"), binding_key(F.col("name")).alias("short"))
    exact = r.join(t, F.col("name") == F.col("qualified_name"))
    imported = r.join(imports.select("file", "module_path").distinct(), "file").join(t, (F.col("short") == F.col("t_name")) & ((F.col("module_path") == F.col("t_module")) | (F.col("module_path") == F.col("qualified_name"))))
    own = r.join(modules.select("file", "module"), "file").join(t, (F.col("short") == F.col("t_name")) & (F.col("module") == F.col("t_module")))
    single = t.groupBy("t_name").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).filter("n = 1")
    unique = r.join(single.select("t_name", "target"), F.col("short") == F.col("t_name"))
    found = None
    for p, (name, pairs) in enumerate([("exact", exact), ("import", imported), ("module", own), ("unique", unique)]):
        one = _only(pairs.withColumnRenamed("relation_id", "call_id"), name, p)
        found = one if found is None else found.unionByName(one)
    return found.groupBy(F.col("call_id").alias("relation_id")).agg(F.min(F.struct("p", "target", "strategy")).alias("b")).select("relation_id", "b.target", "b.strategy")


def next_definition(marks: DataFrame, defs: DataFrame) -> DataFrame:
    """marks (file, at) with the id of the first definition (file, start, id) at or after each, by one sort a file."""
    rows = marks.select("file", F.col("at").alias("pos"), F.lit(1).alias("is_mark"), F.lit(None).cast("string").alias("id")).unionByName(defs.select("file", F.col("start").alias("pos"), F.lit(0).alias("is_mark"), "id"))
    after = Window.partitionBy("file").orderBy(F.col("pos").desc(), F.col("is_mark"), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("id", F.last("id", True).over(after)).filter("is_mark = 1").select("file", F.col("pos").alias("at"), "id")


def file_history(commits: DataFrame) -> DataFrame:
    """(path, changes, last) over commits (sha, ts, path) of at most COMMIT_FILES files."""
    return small_commits(commits).groupBy("path").agg(F.count("*").alias("changes"), F.max("ts").alias("last"))


def small_commits(commits: DataFrame) -> DataFrame:
    rows = commits.dropDuplicates(["sha", "path"])
    return rows.join(rows.groupBy("sha").agg(F.count("*").alias("n")).filter(F.col("n") <= COMMIT_FILES).select("sha"), "sha", "left_semi")


def co_changes(commits: DataFrame, least: int = MIN_TOGETHER, score: float = MIN_SCORE) -> DataFrame:
    """(a, b, together, score): files that change in the same commits; a commit gives at most COMMIT_FILES squared pairs,
    made inside its own row, so there is no self-join."""
    rows = small_commits(commits)
    files = rows.groupBy("sha").agg(F.array_sort(F.collect_set("path")).alias("f"))
    pairs = F.flatten(F.transform("f", lambda a: F.transform(F.filter("f", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    together = files.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("together")).filter(F.col("together") >= least)
    n = rows.groupBy("path").agg(F.count("*").alias("n"))
    both = together.join(n.select(F.col("path").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("path").alias("b"), F.col("n").alias("nb")), "b")
    return both.withColumn("score", F.col("together") / F.least("na", "nb")).filter(F.col("score") >= score).select("a", "b", "together", "score")


def coupled_files(pairs: DataFrame, path: str) -> DataFrame:
    return pairs.filter((F.col("a") == path) | (F.col("b") == path)).orderBy(F.desc("score"), F.desc("together"), "a", "b")


def runtime_traces(calls: DataFrame) -> DataFrame:
    """(caller, callee, count) of calls (caller, callee, count): bad ends and counts go, a null count is 1."""
    n = F.coalesce("count", F.lit(1)).cast("long")
    good = lambda c: F.col(c).isNotNull() & (F.col(c) != "") & ~F.contains(F.col(c), F.lit("\0")) & (F.octet_length(c) <= 1024)
    return calls.withColumn("count", n).filter(good("caller") & good("callee") & (F.col("count") > 0)).groupBy("caller", "callee").agg(F.sum("count").alias("count"))
