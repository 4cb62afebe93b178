"""Line dedup by overlapping three-line windows, in DataFrame operations only.

A text is cut at \\n; a window is three consecutive lines, compared without blanks at either end of a line.  Of a
window found more than once anywhere, all but the occurrence with the smallest (doc_id, line) go: the lines they cover
are removed.  Overlapping windows merge, as a line is removed once however many windows cover it.

Defined cases: a null text stays null and an empty one empty; a text of fewer than three lines has no window and stays;
windows of three empty lines don't count; rows that share a doc_id each count as documents of that id (of equal
windows in such rows, at the same line, all stay); a null doc_id sorts last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexloom.llm.common import bounded_join, spool

#: Lines of a window.
SPAN = 3
#: Windows with at least this share of all occurrences are hot; there are at most 1 / HOT of them, so they are broadcast.
HOT = 1 / 2000


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, pos, w1, w2): one row for each window; w1 and w2 are 128 bits of hash."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\r\f\v")))
    hashed = (
        docs.select("doc_id", F.xxhash64("text").alias("row_key"), lines.alias("lines"))
        .filter(F.size("lines") >= SPAN)
        .select("doc_id", "row_key", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"), (x != "").alias("c"))).alias("h"))
    )
    at = lambda i, k: F.element_at("h", (i + k).cast("int"))
    each = F.transform(
        F.sequence(F.lit(1), F.size("h") - (SPAN - 1)),
        lambda i: F.struct(
            (i - 1).cast("long").alias("pos"),
            F.xxhash64(*[at(i, k)["a"] for k in range(SPAN)]).alias("w1"),
            F.xxhash64(*[at(i, k)["b"] for k in range(SPAN)]).alias("w2"),
            (at(i, 0)["c"] | at(i, 1)["c"] | at(i, 2)["c"]).alias("full"),
        ),
    )
    return hashed.select("doc_id", "row_key", F.explode(each).alias("w")).select("doc_id", "row_key", "w.*").filter("full").drop("full")


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, gone): for each row that loses lines, their positions in order."""
    found = spool(windows(docs))
    at = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("pos").alias("p"))
    twice = spool(
        found.groupBy("w1", "w2")
        .agg(F.min(at).alias("first"), F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .select("w1", "w2", F.col("first.d").alias("first_doc"), F.col("first.p").alias("first_pos"), "n")
    )
    least = max(10_000, int(found.count() * HOT))
    hot = spool(twice.filter(F.col("n") >= least).drop("n"))
    rest = twice.filter(F.col("n") < least).drop("n")
    seen = bounded_join(found, hot.withColumn("is_hot", F.lit(True)), ["w1", "w2"], "doc_id")
    own = [c for c in seen.columns if c not in ("first_doc", "first_pos", "is_hot")]
    both = seen.filter("is_hot").drop("is_hot").unionByName(seen.filter(F.col("is_hot").isNull()).select(*own).join(rest, ["w1", "w2"]))
    later = both.filter(~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("pos") == F.col("first_pos"))))
    return later.groupBy("doc_id", "row_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("pos", F.col("pos") + SPAN - 1))))).alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text cut, and n_lines, n_removed (long) and emptied (boolean: all lines went) added.

    Columns of docs that have these names are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "emptied")
    gone = removed_lines(docs).select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__row"), F.col("gone").alias("__gone"))
    joined = docs.withColumn("__key", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__row")), "left")
    lines = F.split("text", "\n")
    at = F.array_except(F.sequence(F.lit(0).cast("long"), (F.size(lines) - 1).cast("long")), "__gone")
    kept = F.array_join(F.transform(at, lambda i: F.get(lines, i.cast("int"))), "\n")
    count = lambda c, there: F.when(there.isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
    return (
        joined.withColumn("n_lines", count(lines, F.col("text")))
        .withColumn("n_removed", count(F.col("__gone"), F.col("__gone")))
        .withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept))
        .withColumn("emptied", (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines")))
        .select(*docs.columns, "n_lines", "n_removed", "emptied")
    )


#: DuckDB, over the view documents.
ORACLE = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
t AS (SELECT doc_id, ls, list_transform(ls, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11))) AS ts FROM l WHERE len(ls) >= 3),
w AS (SELECT doc_id, p, ts[p + 1] || chr(10) || ts[p + 2] || chr(10) || ts[p + 3] AS k FROM (SELECT doc_id, ts, unnest(range(0, len(ts) - 2)) AS p FROM t)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS i FROM w WHERE k <> chr(10) || chr(10)),
g AS (SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM r WHERE i > 1) GROUP BY doc_id)
SELECT l.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  coalesce(len(gone), 0) > 0 AND len(gone) = len(ls) AS emptied,
  CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(gone, i)), lambda i: ls[i + 1]), chr(10)), '') END AS text
FROM l LEFT JOIN g ON l.doc_id = g.doc_id
"""
