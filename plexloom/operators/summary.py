"""Schema, architecture and layout summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexloom.graph import GraphView

LAYOUT_NODES, LAYOUT_MOST, LINKED = 5_000, 250_000, 16
# Colours of labels.
COLOURS = "#7dd3fc #a78bfa #f472b6 #fb7185 #fbbf24 #4ade80 #2dd4bf #60a5fa #c084fc #f97316 #94a3b8 #e879f9".split()


def define_counts(view: GraphView, kind: str = "DEFINES") -> DataFrame:
    return view.edges.filter(F.col("kind") == kind).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("defined"))


def graph_schema(view: GraphView) -> DataFrame:
    """(element, name, n, keys): labels and kinds with the union of their property keys."""
    own = lambda df, element, c: df.groupBy(F.lit(element).alias("element"), F.col(c).alias("name")).agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.json_object_keys("properties"))))).alias("keys"))
    return own(view.nodes, "node", "label").unionByName(own(view.edges, "edge", "kind"))


def languages(view: GraphView) -> DataFrame:
    lang = F.get_json_object("properties", "$.language")
    return view.nodes.select(lang.alias("language"), "file_path").filter("language is not null and file_path is not null").groupBy("language").agg(F.count_distinct("file_path").alias("files")).orderBy(F.desc("files"), "language")


def edge_types(view: GraphView) -> DataFrame:
    return view.edges.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def modules(view: GraphView, label: str = "Module", kind: str = "DEFINES") -> DataFrame:
    own = view.nodes.filter(F.col("label") == label)
    return own.join(define_counts(view, kind), "id", "left").select("id", "qualified_name", F.coalesce("defined", F.lit(0)).alias("defined")).orderBy(F.desc("defined"), "qualified_name")


def ranked_by_degree(view: GraphView, labels: list[str]) -> DataFrame:
    own = view.nodes_with_degrees().filter(F.col("label").isin(labels))
    return own.select("id", "label", "qualified_name", "degree", "in_degree", "out_degree").orderBy(F.desc("degree"), F.desc("in_degree"), F.desc("out_degree"), "qualified_name")


def entry_points(view: GraphView) -> DataFrame:
    flag = lambda k: F.coalesce(F.get_json_object("properties", f"$.{k}") == "true", F.lit(False))
    own = view.nodes_with_degrees().filter(flag("is_entry_point") & ~flag("is_test") & ~F.coalesce(F.lower("file_path").contains("test"), F.lit(False)))
    return own.select("id", "qualified_name", "degree", "in_degree", "out_degree").orderBy(F.desc("degree"), F.desc("in_degree"), F.desc("out_degree"), "qualified_name")


def status(view: GraphView) -> DataFrame:
    """(files, nodes, edges) in one row."""
    n = view.nodes.agg(F.count_distinct("file_path").alias("files"), F.count("*").alias("nodes"))
    return n.crossJoin(F.broadcast(view.edges.agg(F.count("*").alias("edges"))))


def dead_code(view: GraphView, kind: str = "CALLS") -> DataFrame:
    """(id, status): entry, test, dead (no caller), single or normal."""
    callers = view.edges.filter(F.col("kind") == kind).groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("callers"))
    flag = lambda k: F.coalesce(F.get_json_object("properties", f"$.{k}") == "true", F.lit(False))
    n = F.coalesce("callers", F.lit(0))
    status_ = F.when(flag("is_entry_point"), "entry").when(flag("is_test"), "test").when(n == 0, "dead").when(n == 1, "single").otherwise("normal")
    return view.nodes.join(callers, "id", "left").select("id", status_.alias("status"))


def layout(view: GraphView, budget: int = LAYOUT_NODES, call_kind: str = "CALLS") -> DataFrame:
    """(id, x, y, z, size, degree, callers): the first `budget` nodes by id on a sphere; degrees count kept ends only."""
    if not 1 <= budget <= LAYOUT_MOST:
        raise ValueError("bad budget")
    kept = view.nodes.select("id").orderBy("id").limit(budget)
    kept = kept.withColumn("i", (F.row_number().over(Window.orderBy("id")) - 1).cast("double"))  # at most LAYOUT_MOST rows
    ids = kept.select("id")
    inner = view.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    ends = inner.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("c")), F.struct(F.col("target").alias("id"), (F.col("kind") == call_kind).cast("int").alias("c")))).alias("e"))
    degree = ends.groupBy("e.id").agg(F.count("*").alias("degree"), F.sum("e.c").alias("callers"))
    n = F.count("*").over(Window.partitionBy(F.lit(1))).cast("double")
    out = kept.withColumn("n", n).join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("callers", F.coalesce("callers", F.lit(0)))
    y = 1 - 2 * (F.col("i") + 0.5) / F.col("n")
    turn = F.col("i") * (math.pi * (3 - math.sqrt(5)))
    out = out.withColumn("y", y).withColumn("r", F.sqrt(1 - F.col("y") * F.col("y")))
    radius = F.cbrt("n")
    return out.select("id", (F.cos(turn) * F.col("r") * radius).alias("x"), (F.col("y") * radius).alias("y"), (F.sin(turn) * F.col("r") * radius).alias("z"), (1 + F.log(F.col("degree") + 1.0)).alias("size"), "degree", F.col("callers").cast("long").alias("callers"))


def filter_layout(nodes: DataFrame, edges: DataFrame, labels: list[str], kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the enabled labels and edges of the enabled kinds between them."""
    kept = nodes.filter(F.col("label").isin(labels))
    ids = kept.select("id")
    return kept, edges.filter(F.col("kind").isin(kinds)).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def label_colour(label):
    """A label's colour, by the FNV-1a hash (32 bits) of its bytes."""
    raw = F.hex(F.encode(label, "UTF-8"))
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(label)), lambda i: F.conv(F.substr(raw, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    h = F.aggregate(octets, F.lit(2166136261).cast("long"), lambda s, b: (s.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.element_at(F.array(*[F.lit(c) for c in COLOURS]), (F.pmod(h, F.lit(len(COLOURS))) + 1).cast("int"))


def linked_layout(view: GraphView, others: dict[str, GraphView], budget: int = LAYOUT_NODES) -> tuple[DataFrame, DataFrame]:
    """The layout of a project and of the projects that its CROSS_ edges name, at most LINKED by name: nodes (linked, id,
    x, ...), where linked is empty for the project itself, and cross edges (source, linked, target, kind) to the node
    of the other project that has the same qualified name as the edge's target."""
    cross = view.edges.filter(F.col("kind").startswith("CROSS_")).select("source", "target", "kind", F.get_json_object("properties", "$.target_project").alias("linked"))
    wanted = [r[0] for r in cross.filter("linked is not null").select("linked").distinct().orderBy("linked").limit(LINKED).collect() if r[0] in others]
    nodes = layout(view, budget).withColumn("linked", F.lit(""))
    names = None
    for name in wanted:
        nodes = nodes.unionByName(layout(others[name], budget).withColumn("linked", F.lit(name)))
        own = others[name].nodes.select(F.lit(name).alias("linked"), F.col("qualified_name").alias("__q"), F.col("id").alias("__id"))
        names = own if names is None else names.unionByName(own)
    if names is None:
        return nodes, cross.limit(0).select("source", "linked", "target", "kind")
    here = view.nodes.select(F.col("id").alias("target"), F.col("qualified_name").alias("__q"))
    found = cross.join(here, "target").join(names, ["linked", "__q"]).select("source", "linked", F.col("__id").alias("target"), "kind")
    return nodes, found.distinct()
