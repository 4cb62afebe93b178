"""Snapshot store: each project's tables as Parquet, under a log of manifests.

A write puts new tables into folders of their own and then commits a manifest that names the folder of every table; the
commit is one rename, so nodes, edges, files and history change together or not at all, readers keep the snapshot they
have opened, and what a change doesn't touch isn't written again.  A manifest's number is the project's generation.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexloom.graph import GraphView

#: Manifests whose tables are kept by vacuum(), and the most bytes of an export that load() takes.
KEPT, MOST_BYTES = 2, 64 << 20
#: Ids that are looked up by a filter, which prunes files; more are joined.
LOOKUP = 1_000
_KEYS = ["source", "target", "kind", "discriminator"]


class StaleGeneration(RuntimeError):
    pass


def classify_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): new, deleted, changed or unchanged by content_hash."""
    o, n = old.select("path", F.col("content_hash").alias("o")), new.select("path", F.col("content_hash").alias("n"))
    both = o.withColumn("in_old", F.lit(True)).join(n.withColumn("in_new", F.lit(True)), "path", "full")
    change = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "deleted").when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("changed")
    return both.select("path", change.alias("change"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: an upsert of appended rows."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("__r = 1").drop("__r")


def without_loose_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes, one of each identity."""
    ids = nodes.select("id")
    both = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return both.dropDuplicates(_KEYS)


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # -- files of the log
    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, project: str) -> str:
        return f"{self.root}/{quote(project, safe='')}"

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def generation(self, project: str) -> int:
        return max((int(n[:-5]) for n in self._names(f"{self._folder(project)}/log") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _manifest(self, project: str, generation: int) -> dict:
        if not generation:
            return {"tables": {}, "rows": {}}
        stream = self._fs().open(self._path(f"{self._folder(project)}/log/{generation:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, project: str, expected: int | None, changes: dict[str, DataFrame | None]) -> int:
        """Write the changed tables and name them in the next manifest; a table that is None goes."""
        now = self.generation(project)
        if expected is not None and expected != now:
            raise StaleGeneration(f"{project} is at {now}, not {expected}")
        manifest, folder = self._manifest(project, now), self._folder(project)
        for table, df in changes.items():
            if df is None:
                manifest["tables"].pop(table, None), manifest["rows"].pop(table, None)
                continue
            name = f"{table}/{uuid.uuid4().hex}"
            df.write.parquet(f"{folder}/{name}")
            manifest["tables"][table], manifest["rows"][table] = name, self.spark.read.parquet(f"{folder}/{name}").count()
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        draft, final = self._path(f"{folder}/log/.{uuid.uuid4().hex}"), self._path(f"{folder}/log/{now + 1:012d}.json")
        out = self._fs().create(draft)
        out.write(bytearray(json.dumps(manifest | {"project": project, "generation": now + 1}).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        try:  # fails if another writer has committed this generation
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf).rename(self._fs().makeQualified(draft), self._fs().makeQualified(final), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs().delete(draft, False)
            raise StaleGeneration(f"{project} has been changed meanwhile") from e
        return now + 1

    # -- scans and lookups
    def table(self, project: str, name: str, generation: int | None = None) -> DataFrame | None:
        """A table of the newest snapshot, or of that generation; None if it has none."""
        at = self._manifest(project, self.generation(project) if generation is None else generation)["tables"].get(name)
        return None if at is None else self.spark.read.parquet(f"{self._folder(project)}/{at}")

    def _need(self, project: str, name: str) -> DataFrame:
        found = self.table(project, name)
        if found is None:
            raise KeyError(f"{project} has no {name}")
        return found

    def projects(self) -> DataFrame:
        """(project, generation, nodes, edges, files), from the manifests alone."""
        rows = []
        for name in self._names(self.root):
            project = unquote(name)
            generation = self.generation(project)
            if generation:
                n = self._manifest(project, generation)["rows"]
                rows.append((project, generation, n.get("nodes", 0), n.get("edges", 0), n.get("files", 0)))
        return self.spark.createDataFrame(rows, "project string, generation long, nodes long, edges long, files long")

    def snapshot(self, project: str) -> GraphView:
        generation = self.generation(project)
        return GraphView(self.table(project, "nodes", generation), self.table(project, "edges", generation))

    def scan_nodes(self, project: str) -> DataFrame:
        return self._need(project, "nodes").orderBy("qualified_name", "id")

    def scan_edges(self, project: str) -> DataFrame:
        return self._need(project, "edges").orderBy(*_KEYS)

    def files(self, project: str) -> DataFrame:
        return self._need(project, "files").orderBy("path")

    def node(self, project: str, node_id: str) -> DataFrame:
        return self._need(project, "nodes").filter(F.col("id") == node_id).limit(1)

    def node_by_name(self, project: str, qualified_name: str) -> DataFrame:
        return self._need(project, "nodes").filter(F.col("qualified_name") == qualified_name).orderBy("id").limit(1)

    def file(self, project: str, path: str) -> DataFrame:
        return self._need(project, "files").filter(F.col("path") == path).limit(1)

    def nodes_for_file(self, project: str, path: str) -> DataFrame:
        return self._need(project, "nodes").filter(F.col("file_path") == path).orderBy("qualified_name", "id")

    def edges_from(self, project: str, ids: list[str] | DataFrame) -> DataFrame:
        """Edges that leave these nodes; they are stored sorted by source."""
        return self._ends(self._need(project, "edges"), "source", ids)

    def edges_to(self, project: str, ids: list[str] | DataFrame) -> DataFrame:
        """Edges that reach these nodes, from a copy that is sorted by target."""
        return self._ends(self._need(project, "edges_in"), "target", ids)

    def _ends(self, edges: DataFrame, end: str, ids: list[str] | DataFrame) -> DataFrame:
        if isinstance(ids, DataFrame):
            return edges.join(ids.select(F.col("id").alias(end)).distinct(), end, "left_semi").select(*edges.columns)
        if len(ids) > LOOKUP:
            return self._ends(edges, end, self.spark.createDataFrame([(i,) for i in ids], "id string"))
        return edges.filter(F.col(end).isin(*ids) if ids else F.lit(False))

    # -- writes
    def _graph(self, project: str, view: GraphView) -> dict[str, DataFrame]:
        bad = view.problems().limit(5).collect()
        if bad:
            raise ValueError(f"broken graph: {bad}")
        own = lambda df: df.drop("generation").withColumn("project", F.lit(project))
        edges = own(view.edges)
        by = lambda df, *keys: df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        return {"nodes": by(own(view.nodes), "qualified_name", "id"), "edges": by(edges, "source", "target", "kind", "discriminator"), "edges_in": by(edges, "target", "source", "kind", "discriminator")}

    def replace(self, view: GraphView, project: str, expected: int | None = None, files: DataFrame | None = None) -> int:
        """Swap a project's graph, and its files (path, content_hash, ...) if they are given; the generation goes up by
        one.  Broken views and stale generations are rejected before anything is committed."""
        changes = self._graph(project, view)
        return self._commit(project, expected, changes | ({} if files is None else {"files": files}))

    def replace_file(self, project: str, file_path: str, nodes: DataFrame, edges: DataFrame, file: DataFrame | None = None, expected: int | None = None) -> int:
        """Swap one file's nodes, and its row of files; edges of nodes that went go with them."""
        own = self.snapshot(project)
        kept = own.nodes.filter(~F.col("file_path").eqNullSafe(F.lit(file_path))).unionByName(nodes, allowMissingColumns=True)
        changes: dict[str, DataFrame | None] = dict(self._graph(project, GraphView(kept, without_loose_ends(own.edges.unionByName(edges, allowMissingColumns=True), kept))))
        if file is not None:
            changes["files"] = self._with_files(project, file)
        return self._commit(project, expected, changes)

    def _with_files(self, project: str, files: DataFrame) -> DataFrame:
        old = self.table(project, "files")
        return files if old is None else latest(old.withColumn("__n", F.lit(0)).unionByName(files.withColumn("__n", F.lit(1)), allowMissingColumns=True), ["path"], "__n").drop("__n")

    def upsert_file(self, project: str, files: DataFrame, expected: int | None = None) -> int:
        """Add rows of files, or replace those of their paths."""
        return self._commit(project, expected, {"files": self._with_files(project, files)})

    def reconcile(self, project: str, seen: DataFrame, expected: int | None = None) -> int:
        """Delete what belongs to files that aren't in seen (path)."""
        own, paths = self.snapshot(project), seen.select("path").distinct()
        kept = own.nodes.filter("file_path is null").unionByName(own.nodes.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select(own.nodes.columns))
        changes: dict[str, DataFrame | None] = dict(self._graph(project, GraphView(kept, without_loose_ends(own.edges, kept))))
        files = self.table(project, "files")
        if files is not None:
            changes["files"] = files.join(paths, "path", "left_semi")
        return self._commit(project, expected, changes)

    def replace_cross_edges(self, project: str, links: DataFrame, expected: int | None = None) -> int:
        """Swap the edges of a kind that starts with CROSS_ for links; those may end in other projects' nodes."""
        own = self._need(project, "edges")
        edges = own.filter(~F.col("kind").startswith("CROSS_")).unionByName(links.withColumn("project", F.lit(project)), allowMissingColumns=True).dropDuplicates(_KEYS)
        by = lambda *keys: edges.repartitionByRange(*keys).sortWithinPartitions(*keys)
        return self._commit(project, expected, {"edges": by(*_KEYS), "edges_in": by("target", "source")})

    def replace_semantic_index(self, project: str, expected: int, tables: dict[str, DataFrame | None]) -> int:
        """Swap the tables of the semantic index (token_vectors, node_vectors, signatures) made for generation expected."""
        return self._commit(project, expected, {f"semantic_{k}": v for k, v in tables.items()})

    def semantic_index(self, project: str, name: str) -> DataFrame | None:
        return self.table(project, f"semantic_{name}")

    def replace_git_history(self, project: str, history: DataFrame, couplings: DataFrame, expected: int | None = None) -> int:
        """Swap the history: file histories (path, changes, last) and couplings (a, b, together, score, last).  File nodes
        get change_count and last_modified, and file pairs FILE_CHANGES_WITH edges with the score to two decimals."""
        own = self.snapshot(project)
        view = enrich_history(own, history, couplings)
        return self._commit(project, expected, self._graph(project, view) | {"history": history, "couplings": couplings})

    def delete(self, project: str) -> None:
        self._fs().delete(self._path(self._folder(project)), True)

    def vacuum(self, project: str, kept: int = KEPT) -> None:
        """Delete tables that none of the last manifests names, and older manifests."""
        folder, last = self._folder(project), self.generation(project)
        used = {t for g in range(max(1, last - kept + 1), last + 1) for t in self._manifest(project, g)["tables"].values()}
        for table in self._names(folder):
            for name in [] if table == "log" else self._names(f"{folder}/{table}"):
                if f"{table}/{name}" not in used:
                    self._fs().delete(self._path(f"{folder}/{table}/{name}"), True)
        for name in self._names(f"{folder}/log"):
            if name.endswith(".json") and name[:-5].isdigit() and int(name[:-5]) <= last - kept:
                self._fs().delete(self._path(f"{folder}/log/{name}"), False)

    # -- exports
    def _digest(self, path: str) -> tuple[str, int]:
        """sha-256 over the digests of a folder's files, and their bytes; made on the executors."""
        rows = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.sha2("content", 256).alias("h"), "length").collect()
        return hashlib.sha256("".join(sorted(r["h"] for r in rows)).encode()).hexdigest(), sum(r["length"] for r in rows)

    def export(self, project: str, out: str) -> dict:
        """A copy of the graph compressed with zstd, and a manifest of its counts, bytes and sha-256."""
        own = self.snapshot(project)
        manifest = {"project": project, "generation": self.generation(project)}
        for table, df in (("nodes", own.nodes), ("edges", own.edges)):
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{table}")
            digest, size = self._digest(f"{out}/{table}")
            manifest |= {table: df.count(), f"{table}_sha256": digest, f"{table}_bytes": size}
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest")
        return manifest

    def load(self, source: str, project: str, most_bytes: int = MOST_BYTES) -> int:
        """Import an export as a project; its bytes, digests and counts must be the manifest's."""
        manifest = json.loads(self.spark.read.text(f"{source}/manifest").first()[0])
        if sum(manifest[f"{t}_bytes"] for t in ("nodes", "edges")) > most_bytes:
            raise ValueError(f"the export has more than {most_bytes} bytes")
        view = GraphView(*[self.spark.read.parquet(f"{source}/{t}") for t in ("nodes", "edges")])
        for table, df in (("nodes", view.nodes), ("edges", view.edges)):
            if (self._digest(f"{source}/{table}"), df.count()) != ((manifest[f"{table}_sha256"], manifest[f"{table}_bytes"]), manifest[table]):
                raise ValueError(f"the export's {table} are not those of its manifest")
        return self.replace(view, project)


def enrich_history(view: GraphView, history: DataFrame, couplings: DataFrame) -> GraphView:
    """View with change_count and last_modified on File nodes and FILE_CHANGES_WITH edges between them; pairs of which a
    file is missing, and of a file with itself, are left out."""
    h = history.select(F.col("path").alias("__p"), F.col("changes").alias("__c"), F.col("last").alias("__l"))
    joined = view.nodes.join(h, (F.col("file_path") == F.col("__p")) & (F.col("label") == "File"), "left")
    bare = F.regexp_replace(F.coalesce("properties", F.lit("{}")), r',?\s*"(?:change_count|last_modified)"\s*:\s*(?:-?\d+|null)', "")
    head = F.regexp_replace(F.regexp_replace(bare, r"\}\s*$", ""), r"^\{\s*,\s*", "{")
    added = F.concat(F.lit('"last_modified":'), F.coalesce(F.col("__l").cast("string"), F.lit("null")), F.lit(',"change_count":'), F.col("__c").cast("string"), F.lit("}"))
    properties = F.when(F.col("__c").isNull(), F.col("properties")).otherwise(F.concat(head, F.when(F.trim(head) == "{", F.lit("")).otherwise(F.lit(",")), added))
    nodes = joined.withColumn("properties", properties).select(*view.nodes.columns)
    of = lambda c: view.nodes.filter(F.col("label") == "File").groupBy(F.col("file_path").alias(c)).agg(F.min("id").alias(f"{c}_id"))
    pairs = couplings.join(of("a"), "a").join(of("b"), "b").filter("a_id <> b_id")
    props = F.to_json(F.struct(F.col("together").alias("co_changes"), F.round("score", 2).alias("coupling_score"), (F.col("last") if "last" in couplings.columns else F.lit(None).cast("long")).alias("last_co_change")))
    project = view.nodes.select(F.first("project")).first()[0]
    links = pairs.select(F.lit(project).alias("project"), F.col("a_id").alias("source"), F.col("b_id").alias("target"), F.lit("FILE_CHANGES_WITH").alias("kind"), F.lit("").alias("discriminator"), props.alias("properties"))
    edges = view.edges.filter("kind <> 'FILE_CHANGES_WITH'").unionByName(links, allowMissingColumns=True)
    return GraphView(nodes, edges)
