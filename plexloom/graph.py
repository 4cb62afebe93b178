"""Property graphs as two DataFrames, and builders over relational tables.

nodes: project, id, label, name, qualified_name, file_path, start_line, end_line, properties (JSON text), and any number
of typed property columns.  edges: project, source, target, kind, discriminator, properties.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODE_COLUMNS = ["project", "id", "label", "name", "qualified_name", "file_path", "start_line", "end_line", "properties"]
EDGE_COLUMNS = ["project", "source", "target", "kind", "discriminator", "properties"]


@dataclass(frozen=True)
class GraphView:
    nodes: DataFrame
    edges: DataFrame

    def degrees(self) -> DataFrame:
        """(id, in_degree, out_degree): one pass over edges; a self-loop counts in both."""
        ends = F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).cast("long").alias("i"), F.lit(1).cast("long").alias("o")), F.struct(F.col("target").alias("id"), F.lit(1).cast("long").alias("i"), F.lit(0).cast("long").alias("o"))))
        return self.edges.select(ends.alias("x")).groupBy("x.id").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))

    def nodes_with_degrees(self) -> DataFrame:
        d = self.degrees().withColumnRenamed("id", "__id")
        return (
            self.nodes.join(d, F.col("id") == F.col("__id"), "left").drop("__id")
            .withColumn("in_degree", F.coalesce("in_degree", F.lit(0).cast("long"))).withColumn("out_degree", F.coalesce("out_degree", F.lit(0).cast("long")))
            .withColumn("degree", F.col("in_degree") + F.col("out_degree"))
        )

    def problems(self) -> DataFrame:
        """(problem, id): repeated node ids and edges without one of their ends."""
        twice = self.nodes.groupBy("id").count().filter("count > 1").select(F.lit("repeated node").alias("problem"), "id")
        ends = self.edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        return twice.unionByName(ends.join(self.nodes.select("id"), "id", "left_anti").select(F.lit("missing node").alias("problem"), "id"))


def node_frame(df: DataFrame, label: str, key, name, project: str = "demo", file_path=None, **props) -> DataFrame:
    """Nodes of one label: id is lower(label):key."""
    node_id = F.concat(F.lit(label.lower() + ":"), key.cast("string"))
    none = F.lit(None)
    return df.select(
        F.lit(project).alias("project"), node_id.alias("id"), F.lit(label).alias("label"), name.alias("name"), node_id.alias("qualified_name"),
        (none.cast("string") if file_path is None else file_path).alias("file_path"), none.cast("long").alias("start_line"), none.cast("long").alias("end_line"),
        (F.to_json(F.struct(*[c.alias(k) for k, c in props.items()])) if props else F.lit("{}")).alias("properties"), *[c.alias(k) for k, c in props.items()],
    )


def edge_frame(df: DataFrame, source, target, kind: str, discriminator=None, project: str = "demo", **props) -> DataFrame:
    return df.select(
        F.lit(project).alias("project"), source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), (F.lit("") if discriminator is None else discriminator).alias("discriminator"),
        (F.to_json(F.struct(*[c.alias(k) for k, c in props.items()])) if props else F.lit("{}")).alias("properties"),
    )


def _stack(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def commerce(spark: SparkSession, sf_dir: str, labels: set[str] | None = None, kinds: set[str] | None = None) -> GraphView:
    """Regions, nations, customers, suppliers, parts and orders; only these labels and kinds if they are given, so that
    tables a query doesn't name aren't read."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    c = F.col
    key = lambda label, k: F.concat(F.lit(label + ":"), c(k).cast("string"))
    nodes = {
        "Region": lambda: node_frame(t("region"), "Region", c("r_regionkey"), c("r_name")),
        "Nation": lambda: node_frame(t("nation"), "Nation", c("n_nationkey"), c("n_name")),
        "Customer": lambda: node_frame(t("customer"), "Customer", c("c_custkey"), c("c_name"), balance=c("c_acctbal"), segment=c("c_mktsegment")),
        "Supplier": lambda: node_frame(t("supplier"), "Supplier", c("s_suppkey"), c("s_name"), balance=c("s_acctbal")),
        "Part": lambda: node_frame(t("part"), "Part", c("p_partkey"), c("p_name"), brand=c("p_brand"), type=c("p_type"), size=c("p_size").cast("long"), price=c("p_retailprice")),
        "Order": lambda: node_frame(t("orders"), "Order", c("o_orderkey"), F.concat(F.lit("Order#"), c("o_orderkey")), status=c("o_orderstatus"), total=c("o_totalprice"), priority=c("o_orderpriority")),
    }
    line = Window.partitionBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").orderBy("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    edges = {
        "IN_REGION": lambda: edge_frame(t("nation"), key("nation", "n_nationkey"), key("region", "n_regionkey"), "IN_REGION"),
        "IN_NATION": lambda: edge_frame(t("customer"), key("customer", "c_custkey"), key("nation", "c_nationkey"), "IN_NATION").unionByName(
            edge_frame(t("supplier"), key("supplier", "s_suppkey"), key("nation", "s_nationkey"), "IN_NATION")
        ),
        "PLACED": lambda: edge_frame(t("orders"), key("customer", "o_custkey"), key("order", "o_orderkey"), "PLACED"),
        "CONTAINS": lambda: edge_frame(
            t("lineitem").withColumn("occ", F.row_number().over(line)), key("order", "l_orderkey"), key("part", "l_partkey"), "CONTAINS",
            F.concat_ws("#", c("l_suppkey"), c("l_linenumber"), c("occ")), quantity=c("l_quantity"), price=c("l_extendedprice"), discount=c("l_discount"),
        ),
        "SUPPLIED_BY": lambda: edge_frame(t("lineitem").select("l_partkey", "l_suppkey").distinct(), key("part", "l_partkey"), key("supplier", "l_suppkey"), "SUPPLIED_BY"),
    }
    found = [f() for k, f in edges.items() if kinds is None or k in kinds]
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in EDGE_COLUMNS))
    return GraphView(_stack([f() for k, f in nodes.items() if labels is None or k in labels]), _stack(found or [none]))


def event_graph(spark: SparkSession, sf_dir: str) -> GraphView:
    """Users and event types: DID from a user to a type, NEXT between types that follow each other for some user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    user, kind = F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.concat(F.lit("eventtype:"), F.col("event_type"))
    nodes = node_frame(events.select("user_id").distinct(), "User", F.col("user_id"), F.concat(F.lit("user "), F.col("user_id").cast("string"))).unionByName(
        node_frame(events.select("event_type").distinct(), "EventType", F.col("event_type"), F.col("event_type"))
    )
    follow = events.withColumn("next", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("next is not null")
    follow = follow.select("event_type", "next").distinct()
    did = edge_frame(events.select("user_id", "event_type").distinct(), user, kind, "DID")
    return GraphView(nodes, did.unionByName(edge_frame(follow, kind, F.concat(F.lit("eventtype:"), F.col("next")), "NEXT")))
