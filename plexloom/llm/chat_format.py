"""Chat formatting of reply trees, in DataFrame operations only.

Messages form trees by their parent.  The root-to-leaf paths are enumerated by self-joins that double the distance
looked back in every round, so a tree of depth n takes log2(n) rounds; a tree's leaves are ranked by the mean score of
their path, and the best ones are formatted, a conversation each.

The template is START role SEP text END for each turn.  Inside roles and texts, a backslash is doubled and one is put
after each < and [, so no marker, and neither </s> nor [INST], can occur there, and unescape() gives every text back.

Defined cases: a null role or text is empty; rows that share tree and position are turns one after the other, by role
and text; a null tree id is a tree of its own; a node whose parent is absent is a root; nodes in a cycle have no leaf
and aren't formatted; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexloom.llm.common import spool

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(c) -> F.Column:
    return F.regexp_replace(c, r"([\\<\[])", r"$1\\")


def unescape(c) -> F.Column:
    return F.regexp_replace(c, r"([\\<\[])\\", "$1")


def chain(rows: DataFrame, tree: str, order: str) -> DataFrame:
    """Messages of linear conversations as trees: each row's parent is the one before it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    node = F.row_number().over(Window.partitionBy(tree).orderBy(order, role, text)).cast("long")
    return rows.select(F.col(tree).alias("tree"), node.alias("node"), role.alias("role"), text.alias("text")).select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, node, back): the nodes of each tree's `top` best paths; back is the distance from the leaf.

    messages: tree, node, parent, score; a node id is unique in its tree.
    """
    nodes = spool(messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    here = nodes.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("score").alias("s2"))
    up = nodes.filter(F.col("parent").isNotNull()).join(here, same("tree", "t2") & (F.col("parent") == F.col("n2"))).select("tree", "node", F.col("parent").alias("up"))
    up = spool(up)
    parents = up.select(F.col("tree").alias("t2"), F.col("up").alias("n2")).distinct()
    paths = spool(nodes.join(parents, same("tree", "t2") & (F.col("node") == F.col("n2")), "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back")))
    step, most = 1, nodes.count()
    while step <= most and up.limit(1).count():
        far = up.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("u2"))
        more = paths.join(far, same("tree", "t2") & (F.col("node") == F.col("n2"))).select("tree", "leaf", F.col("u2").alias("node"), (F.col("back") + step).alias("back"))
        paths = spool(paths.unionByName(more))
        up = spool(up.join(far, same("tree", "t2") & (F.col("up") == F.col("n2"))).select("tree", "node", F.col("u2").alias("up")))
        step *= 2
    scored = paths.join(here, same("tree", "t2") & (F.col("node") == F.col("n2"))).groupBy("tree", "leaf").agg(F.avg("s2").alias("mean"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("mean").desc(), F.col("leaf")))
    best = scored.withColumn("rank", rank).filter(F.col("rank") <= top).select(F.col("tree").alias("t3"), F.col("leaf").alias("l3"))
    return paths.join(best, same("tree", "t3") & (F.col("leaf") == F.col("l3")), "left_semi")


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, formatted, loss): loss lists the code points of `formatted`, [start, end), that are learnt."""
    paths = best_paths(messages, top).withColumnsRenamed({"tree": "t2", "node": "n2"})
    turns = messages.select("tree", "node", "role", "text").join(paths, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")))
    turn = F.struct((-F.col("back")).alias("at"), escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"), (F.col("role") == LOSS_ROLE).alias("learn"))
    rows = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head, tail = len(START) + len(SEP), len(END)
    start = lambda acc, x: acc["at"] + head + F.length(x["role"])
    zero = F.struct(F.lit(0).cast("int").alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    spans = F.aggregate(
        "turns",
        zero,
        lambda acc, x: F.struct(
            (start(acc, x) + F.length(x["text"]) + tail).alias("at"),
            F.when(x["learn"], F.concat(acc["spans"], F.array(F.struct(start(acc, x).alias("start"), (start(acc, x) + F.length(x["text"])).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    one = lambda x: F.concat(F.lit(START), x["role"], F.lit(SEP), x["text"], F.lit(END))
    return rows.select("tree", "leaf", F.array_join(F.transform("turns", one), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and loss_text, both read from the formatted string and its loss spans alone."""
    parts = F.filter(F.split("formatted", r"\Q" + END + r"\E"), lambda x: x != "")
    turn = lambda x: F.struct(unescape(F.substring_index(F.substr(x, F.lit(len(START) + 1)), SEP, 1)).alias("role"), unescape(F.substring_index(x, SEP, -1)).alias("text"))
    learnt = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", F.array_join(learnt, ""))


#: DuckDB, over the view conversations.
ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(role, '([\\<\[])', '\1\\', 'g') AS er, regexp_replace(text, '([\\<\[])', '\1\\', 'g') AS et FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(er) + length(et) + 32) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
