"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import itertools

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plexloom.llm import chat_format, decontaminate, fingerprint, license_scan, line_dedup, mixing, near_dedup, quality, registry, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} under the mit license" for i in range(6000))
POEM = "one line here\nanother line there\na third line follows"
ROWS = [
    (1, POEM, "en", "a", 1), (1, POEM, "en", "a", 1), (2, POEM + "\nmore", "en", "a", 1), (3, "", "en", "b", 0), (4, None, None, None, None), (None, "no id here at all", "en", "b", 1),
    (5, LONG, "en", "c", 1), (6, "<\\[ </s> é\U0001f600 İ", "fr", "a", 1), (7, " \t\n ", "en", "b", 1), (8, POEM, "en", "b", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = ["score", "n", "vid", "spans", "items", "size", "gone", "n_words", "key", "part"]
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("mine") for c in extra})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (8, 1, 0), (6, None, None), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")


def test_line_dedup(docs):
    got = {(r.doc_id, r.n_removed) for r in line_dedup.dedup_lines(docs.select("doc_id", "text", "gone")).collect()}
    assert {(2, 3), (8, 3), (1, 0), (3, 0), (4, 0), (None, 0)} <= got
    assert next(r.text for r in line_dedup.dedup_lines(docs.select("doc_id", "text")).collect() if r.doc_id == 2) == "more"


def test_near_dedup(docs):
    got = {}
    for r in near_dedup.near_duplicates(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert got[8][0][1:] == (1, False) and got[1] == [(got[1][0][0], 1, True)] * 2
    assert got[3] == [(0, 3, True)] and got[4] == [(0, 4, True)] and got[7] == [(0, 7, True)] and got[None][0][1:] == (None, True)


def test_near_dedup_keeps_one(docs):
    ids = [r.doc_id for r in near_dedup.keep_one(docs.select("doc_id", "text")).collect()]
    assert sorted(ids, key=str) == sorted([1, 3, 4, None, 5, 6, 7, *([2] if 2 in ids else [])], key=str)


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(-9, 9)], [(0, i) for i in range(1, 9)] + [(8, 20), (20, -5)], [(1, 1)]], ids=["path", "star", "loop"])
def test_components(spark, edges):
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    want = {v: min(min(e) for e in edges) for e in edges for v in e} if len(edges) > 1 else {}
    assert {r.vid: r.root for r in near_dedup.components(frame(edges)).collect()} == want
    half = near_dedup._join_components(None, frame(edges[::2]))
    assert {r.vid: r.root for r in near_dedup._join_components(half, frame(edges[1::2])).collect()} == want


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, "under the mit license word1 under the mit license"), (2, "One LINE"), (3, None), (4, "!!"), (5, "line here")], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.digest(decontaminate.search(docs, bench)).collect()), key=str)
    assert got == sorted(decontaminate.brute_force([(r[0], r[1]) for r in ROWS], [tuple(r) for r in bench.collect()]), key=str)
    blocks, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, 10
    try:
        assert sorted(map(tuple, decontaminate.digest(decontaminate.search(docs, bench)).collect()), key=str) == got
    finally:
        decontaminate.BLOCK_BYTES = blocks
    texts = {r.text for r in decontaminate.remove_leaks(docs.select("doc_id", "text"), bench).collect()}
    assert not any(t and "one line here" in t for t in texts) and "no id here at all" in texts


def test_license(docs):
    got = {r.doc_id: r for r in license_scan.scan_documents(docs).collect()}
    assert got[5].n_base == 6000 and got[5].first_word == 1 and got[5].base_labels == "mit" and got[4].n_words == 0 and got[4].labels == ""
    assert len(license_scan.rules()) > 200
    assert license_scan.scan("Licensed under the Apache License, Version 2.0.")[2:5] == (["apache-2"], ["apache-2"], 1.0)
    assert license_scan.scan("GNU Lesser General Public License version 2.1")[3] == ["lgpl-2.1"]
    assert license_scan.scan("mit license under the mit license")[0:2] == (6, [2])


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(taken - target) <= 1 for taken, target in by.values())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))


def test_fingerprint(docs):
    got = {}
    for r in fingerprint.edited_fingerprints(docs).collect():
        got.setdefault(r.doc_id, r)
    assert len(got) == 9 and got[3].fingerprint == "0" * (4 * fingerprint.SLOTS) and got[4].near_next == 1.0 and got[3].near_next == 0.0 and got[1].n_chars == len(POEM)
    ordered = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0)))
    import hashlib

    nxt = {a[0]: b[1] or "" for a, b in itertools.pairwise([*ordered, ordered[0]])}
    for i in (2, 5, 6, 8):
        text = next(r[1] for r in ROWS if r[0] == i)
        n = len(text) // 3
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - n] + nxt[i][:n]).encode()).hexdigest()
    one = fingerprint.edited_fingerprints(docs.filter("doc_id = 8")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_classifiers(docs, labels):
    for rows in (quality.score_quality(docs, quality.fit(docs, labels)).collect(), toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()):
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 8)}) == 1


def test_chat(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a\\<b[/INST]<|im_end|>"), (1, 1, "assistant", None), (1, 1, "assistant", "é<\\[\\\\"), (None, 0, None, "x"), (2, None, "assistant", "")], "conv_id long, turn long, role string, text string")
    got = {r.tree: r for r in chat_format.read_back(chat_format.format_trees(chat_format.chain(rows, "conv_id", "turn"))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "a\\<b[/INST]<|im_end|>"), ("assistant", ""), ("assistant", "é<\\[\\\\")]
    assert got[1].loss_text == "é<\\[\\\\" and "[/INST]" not in got[1].formatted and len(got) == 3


def test_chat_trees(spark):
    rows = spark.createDataFrame([(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "thanks", 0.5)], "tree long, node long, parent long, role string, text string, score double")
    got = chat_format.read_back(chat_format.format_trees(rows)).collect()
    assert [[t.text for t in r.turns] for r in got] == [["q", "good", "thanks"]]
    assert chat_format.format_trees(rows, top=2).count() == 2


def test_urls(spark):
    urls = [None, "", "x", "http://", "HTTP://A.ORG/x", "http://example.org/es/1?q", "http://sub.example.org/en/12", "http://a.com/fr/", "http://notexample.org", "http://b.net/de/?a=1#x", "http://a.com/de/z"]
    rows = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, score string").drop("score")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(rows).collect()}
    assert got[0][:3] == ("", "", None) and got[3][:3] == ("", "", None) and got[4] == ("a.org", "/x", "org/", "allow") and got[5][2:] == ("example.org/es/", "block")
    assert got[6][2] == "example.org/en/1" and got[8][:3] == ("notexample.org", "", None) and got[9][2] is None and got[10][2:] == ("com/de/", "block")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == (1 if name.startswith("op3") else 0)


def test_pipeline_stages(spark):
    """Each stage keeps columns, and its decisions hold by a plain test of its own output."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == corpus_pipeline.COLUMNS, name
        docs = docs.cache()
    bench = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows = docs.collect()
    assert 0 < len(rows) < len(before) and len({r.doc_id for r in rows}) == len(rows)
    assert all(r[2] == 0 for r in decontaminate.brute_force([(r.doc_id, r.text) for r in rows], bench))
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert mixed.count() > 0 and mixed.agg(F.max("copy")).first()[0] <= 3


def test_chat_cycles(spark):
    """Nodes in a cycle have no leaf; absent parents make roots; long texts and extra columns of other names do no harm."""
    long = "<|im_end|>\\[" * 20_000
    rows = [
        (1, 1, 2, "user", "in a cycle", 0.0), (1, 2, 1, "user", "in a cycle too", 0.0), (2, 1, 9, "user", long, 0.0), (2, 2, 1, "assistant", long, 1.0), (3, 1, 1, "user", "its own parent", 0.0), (None, 1, None, "user", "no tree", None),
        (4, 1, None, "user", "a", 0.0), (4, 2, 1, "assistant", "b", 0.5), (4, 3, 1, "assistant", "c", 0.5),
    ]
    frame = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").withColumns({c: F.lit("mine") for c in ("leaf", "back", "turns", "t2", "n2", "loss", "up")})
    got = {r.tree: [(t.role, t.text) for t in r.turns] for r in chat_format.read_back(chat_format.format_trees(frame)).collect()}
    assert got == {2: [("user", long), ("assistant", long)], None: [("user", "no tree")], 4: [("user", "a"), ("assistant", "b")]}


def test_items_without_an_id(spark):
    """Items without an id count as one; several blocks and one give the same."""
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two"), (None, "two three"), (7, "four")], "item_id long, text string")
    whole = decontaminate.search(docs, bench).collect()
    assert {r.doc_id: (r.spans, r["items"]) for r in whole} == {1: ([[0, 3]], [""]), 2: ([[0, 1]], ["7"]), 3: ([], [])}
    blocks, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, 1
    try:
        assert sorted(map(str, decontaminate.search(docs, bench).collect())) == sorted(map(str, whole))
    finally:
        decontaminate.BLOCK_BYTES = blocks
