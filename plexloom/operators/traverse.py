"""Breadth-first operators: each round is one equi-join of the frontier with the edges, and one anti-join with what has
been reached."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexloom.graph import GraphView

TRACE_DEPTH, TRACE_LIMIT, IMPACT_DEPTH, IMPACT_LIMIT = 5, 1_000, 15, 1_000
# Kinds that say how things are arranged, not how they depend on each other; labels of what is no symbol.
STRUCTURAL = ["DEFINES", "DEFINES_METHOD", "CONTAINS_FILE", "CONTAINS_FOLDER", "SIMILAR_TO", "SEMANTICALLY_RELATED", "FILE_CHANGES_WITH"]
NO_SYMBOLS = ["File", "Folder", "Project"]


def scratch(spark: SparkSession) -> str:
    """A folder for this application in that of spark.checkpoint.dir, or of the one given to setCheckpointDir; where
    neither is set, a temporary one in local mode (tests); on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="plexloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/plexloom/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the scratch folder."""
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select("kind", "source", "target", F.col("source").alias("from"), F.col("target").alias("to"))
    back = edges.select("kind", "source", "target", F.col("target").alias("from"), F.col("source").alias("to"))
    return {"outbound": out, "inbound": back, "both": out.unionByName(back)}[direction]


def trace(view: GraphView, seeds: DataFrame, direction: str = "outbound", depth: int = TRACE_DEPTH, kinds: list[str] | None = None) -> DataFrame:
    """(id, hop, via_kind, via_source, via_target): nodes reached from seeds (id), each at its smallest hop, by the first
    edge that reaches it there, in the order of source, target and kind."""
    if direction not in ("outbound", "inbound", "both") or not 1 <= depth <= TRACE_DEPTH:
        raise ValueError("bad direction or depth")
    steps = _steps(view.edges.filter(F.col("kind").isin(kinds)) if kinds else view.edges, direction)
    known = view.nodes.select(F.col("id").alias("to"))
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    frontier, out = seen, None
    for hop in range(1, depth + 1):
        found = frontier.join(steps, F.col("id") == F.col("from")).join(known, "to", "left_semi").join(seen.select(F.col("id").alias("to")), "to", "left_anti")
        found = found.groupBy("to").agg(F.min(F.struct("source", "target", "kind")).alias("e"))  # combined before the shuffle
        found = cut(found.select(F.col("to").alias("id"), F.lit(hop).alias("hop"), F.col("e.kind").alias("via_kind"), F.col("e.source").alias("via_source"), F.col("e.target").alias("via_target")))
        out = found if out is None else out.unionByName(found)
        if not found.limit(1).count():
            break
        frontier, seen = found.select("id"), seen.unionByName(found.select("id", "hop"))
    return out


def trace_path(view: GraphView, name: str, direction: str = "outbound", depth: int = TRACE_DEPTH, limit: int = TRACE_LIMIT, kinds: list[str] | None = None) -> tuple[DataFrame, bool]:
    """Nodes reached from the symbol of this name, nearest first, and whether the limit cut some.  A name of several
    symbols, or of none, is an error (search.resolve_one)."""
    if not 1 <= limit <= TRACE_LIMIT:
        raise ValueError(f"limit must be from 1 to {TRACE_LIMIT}")
    from plexloom.operators.search import resolve_one

    reached = trace(view, resolve_one(view, name), direction, depth, kinds)
    rows = reached.join(view.nodes.select("id", "name", "qualified_name", "label"), "id").orderBy("hop", "qualified_name", "id")
    return rows.limit(limit), rows.limit(limit + 1).count() > limit


def impact(view: GraphView, seeds: DataFrame, depth: int = 2, structural: list[str] = STRUCTURAL) -> DataFrame:
    """(id, level): what depends on seeds (id, level), through edges backwards; level is the least found."""
    if not 0 <= depth <= IMPACT_DEPTH:
        raise ValueError("bad depth")
    back = view.edges.filter(~F.col("kind").isin(structural)).select(F.col("target").alias("from"), F.col("source").alias("to")).distinct()
    best = cut(seeds.groupBy("id").agg(F.min("level").alias("level")))
    frontier = best
    for _ in range(depth):
        found = frontier.join(back, F.col("id") == F.col("from")).groupBy("to").agg((F.min("level") + 1).alias("level")).filter(F.col("level") <= depth)
        new = cut(found.join(best.select(F.col("id").alias("to"), F.col("level").alias("old")), "to", "left").filter("old is null or level < old").select(F.col("to").alias("id"), "level"))
        if not new.limit(1).count():
            break
        best = cut(best.unionByName(new).groupBy("id").agg(F.min("level").alias("level")))
        frontier = new
    return best


def detect_changes(view: GraphView, changed: DataFrame, coupled: DataFrame | None = None, depth: int = 2, limit: int = IMPACT_LIMIT) -> tuple[DataFrame, bool]:
    """(qualified_name, name, label, file, level) of the symbols that changed files (path) touch, by name, at most limit,
    and whether there are more: level 0 for the files' own symbols, 1 for those of files that usually change with them
    (path), one more for each dependence.  Files, folders and projects are passed through, but are no symbols; of
    symbols that share a qualified name one is reported."""
    symbols = view.nodes.filter(~F.col("label").isin(NO_SYMBOLS))
    own = lambda files, level: symbols.join(files.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select("id", F.lit(level).alias("level"))
    seeds = own(changed, 0)
    seeds = seeds.unionByName(own(coupled, 1)) if coupled is not None and depth else seeds
    found = impact(view, seeds, depth).join(symbols.select("id", "qualified_name", "name", "label", F.coalesce("file_path", F.lit("")).alias("file")), "id")
    first = found.groupBy("qualified_name").agg(F.min(F.struct("level", "id", "name", "label", "file")).alias("x")).select("qualified_name", "x.name", "x.label", "x.file", "x.level")
    first = cut(first)
    return first.orderBy("qualified_name").limit(limit), first.count() > limit
