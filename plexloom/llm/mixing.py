"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Sources in code-point order, null last, take the weights in turn.  Together they are to give `budget` times all words;
each one's target is its weight times a level common to all, but at most `epochs` times its size: the level at which
the targets add up to the budget is where clamping sources and resharing their excess by weight comes to rest.  A
source's documents are taken whole floor(target / size) times; the fraction left is filled with further whole documents
in the order of a seeded hash, and the one at the edge gives its first words only, so that a source's taken words are
its target rounded.

Defined cases: a null or empty text has size 0 and takes 0; sources without words have target 0; rows that share a
doc_id are documents of their own (ties in the hash go by size); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexloom.llm.common import BROADCAST_ROWS, bounded_join, spool

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"
#: Hexadecimal digits of the hash by which the documents of a source are first counted: 4096 bins.
DIGITS = 3

WORD = r"[^\x20\x09-\x0D]+"


def _running(df: DataFrame, order: list, sums: dict[str, str], wide: bool) -> DataFrame:
    """df with a column for each of sums: the sum of its expression over the rows that come before in the order.

    Few rows are ordered in one task.  Of very many, ranges are ordered each by itself, and the totals of the ranges
    before, of which there are as many as shuffle partitions, are added.
    """
    before = lambda by: by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if not wide:
        return df.withColumns({k: F.coalesce(F.sum(F.expr(e)).over(before(Window.partitionBy())), F.lit(0)) for k, e in sums.items()})
    dealt = spool(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy("__range").agg(*[F.sum(F.expr(e)).alias(f"__{k}") for k, e in sums.items()])
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select("__range", *[F.coalesce(F.sum(f"__{k}").over(ahead), F.lit(0)).alias(f"__{k}") for k in sums])
    out = dealt.join(F.broadcast(totals), "__range")
    by = before(Window.partitionBy("__range"))
    return out.withColumns({k: F.coalesce(F.sum(F.expr(e)).over(by), F.lit(0)) + F.col(f"__{k}") for k, e in sums.items()}).drop("__range", *[f"__{k}" for k in sums])


def source_targets(sizes: DataFrame, weights=WEIGHTS, epochs=EPOCHS, budget: float = 1.0, most: int = BROADCAST_ROWS) -> DataFrame:
    """(source, source_size, weight, target) from (source, size); one row for each source, in one task up to `most`."""
    per = spool(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    wide = per.count() > most
    per = _running(per, [F.col("source").asc_nulls_last()], {"rank": "1"}, wide)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).drop("rank").withColumn("cap", F.col("source_size") * float(epochs))
    per = spool(_running(per, [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], {"caps": "cap", "weights": "weight"}, wide))
    whole = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()
    level = (F.lit(float(whole["n"]) * float(budget)) - F.col("caps")) / (F.lit(whole["w"]) - F.col("weights"))
    fits = per.withColumn("level", level).filter(F.col("level") * F.col("weight") <= F.col("cap"))
    v = F.lit(fits.agg(F.min(F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level").alias("v")))["v"]).first()[0]).cast("double")
    return per.select("source", "source_size", "weight", F.when(v.isNull() | (v * F.col("weight") > F.col("cap")), F.col("cap")).otherwise(v * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, epochs=EPOCHS, budget: float = 1.0, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, *carry, size, source_size, target, taken, repeats, part): part is the words of the last, cut copy.

    The documents of a source are never brought together: words are summed by source and bin, and only the bin that
    holds the edge is put in order.
    """
    sizes = docs.select(
        "doc_id", "source", *carry, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("u"),
    ).withColumn("bin", F.substring("u", 1, DIGITS))
    if not carry:
        sizes = spool(sizes)
    bins = spool(sizes.groupBy("source", "bin").agg(F.sum("size").alias("size")))
    per = spool(source_targets(bins, weights, epochs, budget))
    per = per.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn(
        "extra", (F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    )
    per = per.select("source", "source_size", "target", "whole", "extra")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("before", before)
    edge = (
        bins.join(per.select(F.col("source").alias("__s"), "extra"), F.col("source").eqNullSafe(F.col("__s")))
        .filter((F.col("before") < F.col("extra")) & (F.col("before") + F.col("size") >= F.col("extra")))
        .groupBy("source").agg(F.min(F.struct("bin", "before")).alias("e")).select("source", F.col("e.bin").alias("edge_bin"), F.col("e.before").alias("edge_before"))
    )
    per = spool(per.join(edge.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s"))
    out = bounded_join(sizes, per, ["source"], "doc_id")
    inside = out.filter(F.col("bin") == F.col("edge_bin"))
    so_far = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = inside.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("edge_before") - so_far)).cast("long"))
    outside = out.filter(~F.coalesce(F.col("bin") == F.col("edge_bin"), F.lit(False))).withColumn("more", F.when(F.col("bin") < F.col("edge_bin"), F.col("size")).otherwise(0).cast("long"))
    return inside.unionByName(outside).select(
        "doc_id", "source", *carry, "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("more")).alias("taken"),
        (F.col("whole") + F.when((F.col("more") > 0) & (F.col("more") == F.col("size")), 1).otherwise(0)).alias("repeats"),
        F.when(F.col("more") < F.col("size"), F.col("more")).otherwise(0).cast("long").alias("part"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row of docs for each copy, with copy (from 1), size, target and taken (words of that copy).

    A cut copy has the first words of its text, joined by blanks.  Columns of docs named like those of mix() go.
    """
    docs = docs.drop("copy", "size", "source_size", "target", "taken", "repeats", "part", "u", "bin", "whole", "extra", "edge_bin", "edge_before", "more")
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    rows = mix(docs, carry=carry, **options)
    n = (F.col("repeats") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("int")
    copies = rows.filter(F.col("taken") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), n)))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.greatest(F.lit(1), F.col("part").cast("int"))), " ")
    whole = F.col("copy") <= F.col("repeats")
    copies = copies.withColumn("taken", F.when(whole, F.col("size")).otherwise(F.col("part"))).withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    return copies.select(*docs.columns, F.col("copy").cast("long").alias("copy"), "size", "target", "taken")


#: DuckDB, over the view documents.
ORACLE = r"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS u FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
q AS (SELECT *, CAST([5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS cap FROM p),
v AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(CAST(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
  / CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev FROM q),
x AS (SELECT *, first_value(lev) OVER (ORDER BY CASE WHEN lev * w <= cap THEN 0 ELSE 1 END, cap / w, source NULLS LAST) AS f,
  max(CASE WHEN lev * w <= cap THEN 1 ELSE 0 END) OVER () AS any_fits FROM v),
t AS (SELECT source, source_size, CASE WHEN any_fits = 0 OR f * w > cap THEN cap ELSE f * w END AS target FROM x),
z AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (SELECT s.doc_id, s.size, z.source_size, z.target, z.whole, CAST(round(z.target) AS BIGINT) - z.whole * z.source_size AS extra,
  coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.u, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s JOIN z ON s.source IS NOT DISTINCT FROM z.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, extra - before)) AS BIGINT) AS taken FROM c
"""
