"""Fixed columns of the queries and the pipeline's stages, against plain loops over whole tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from plexloom.llm import decontaminate, fingerprint, mixing, quality, registry, url_filter
from tests.llm.test_near_dedup import classes

SF = "/root/testdata/sf0.001"


def table(name, sf=SF):
    return duckdb.sql(f"SELECT * FROM '{sf}/{name}.parquet'").fetchall()


def judge(url):
    """(host, path, rule, verdict of the rule) by the contract's words."""
    host = path = ""
    if url and "://" in url:
        host, path = re.fullmatch(r"(?s)([^/?#]*)([^?#]*).*", url.split("://", 1)[1]).groups()
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [r for r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    rule = max(fits, key=len, default=None)
    return host, path, rule, url_filter.RULES.get(rule)


def test_op1(spark):
    d = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in registry.QUERIES["op1_url_filters"](spark, d).collect()}
    pages = duckdb.sql(f"SELECT page_id, url FROM '{d}/pages.parquet'").fetchall()
    assert len(got) == len(pages)
    for i, url in pages:
        host, path, rule, verdict = judge(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict == (verdict or ("block" if got[i].score >= 0.5 else "allow"))


def test_url_features_leave_their_own_label_out():
    suffixes = url_filter.Suffixes().learn(["http://a.xyz/p"] * 5, url_filter.np.array([1, 1, 1, 1, 0]))
    assert suffixes.rate(("suffix", "xyz"), 1) == suffixes.rate(("suffix", "xyz"), 1.0) < suffixes.rate(("suffix", "xyz"), 0)


def test_boosted_trees_learn(spark):
    """Held-out urls of a pattern are judged by the trees, long and null ones and a single class included."""
    urls = [(f"http://h{i}.{'biz' if i % 3 == 0 else 'net'}/{'x' * (i % 7)}{'?id=' + str(i) if i % 3 == 0 else ''}", int(i % 3 == 0)) for i in range(900)]
    labelled = spark.createDataFrame(urls[:600], "url string, blocked int")
    rows = spark.createDataFrame([(u, y, "mine") for u, y in urls[600:]] + [(None, 0, ""), ("http://" + "a" * 100_000, 0, "")], "url string, y int, host string")
    got = [(r.url, r.y, r.verdict) for r in url_filter.filter_urls(rows, {}, labelled).collect()]
    right = [(v == "block") == (y == 1) for u, y, v in got if u and len(u) < 1000]
    assert len(got) == 302 and sum(right) / len(right) > 0.97
    assert {r.verdict for r in url_filter.filter_urls(rows, {}, labelled.filter("blocked = 0")).collect()} == {"allow"}
    assert url_filter.filter_urls(rows, {}, labelled.limit(0)).count() == 302


@pytest.mark.parametrize("name", ["op2_toxicity", "op7_quality"])
def test_held_out_column(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    least = 0.5 if name.startswith("op2") else 0.3
    assert len(rows) == len(table("documents"))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= least) for r in rows)


def test_fitting_sample_is_bounded_by_bytes(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows, y = quality.fitting_rows(docs, labels, "quality", quality._features, 1000, 60_000)
    every, _ = quality.fitting_rows(docs, labels, "quality", quality._features, 1000)
    assert 0 < len(rows) == len(y) < len(every) and sum(4 * len(r) for r in rows) <= 60_000


def weighted(text):
    return Counter(text.encode("utf-8", "replace").lower().split())


@pytest.mark.parametrize("rows", [20, 4000])
def test_op10(spark, monkeypatch, rows):
    """Edited texts by brute force, with one range and with many, and likenesses near generalised Jaccard similarities."""
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", rows)
    docs = sorted(((r[0], r[1] or "") for r in table("documents")), reverse=True)
    got = {r.doc_id: r for r in registry.QUERIES["op10_fingerprints"](spark, SF).collect()}
    errors = []
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for like, other in ((got[i].near_edited, edited), (got[i].near_next, following)):
            a, b = weighted(text), weighted(other)
            whole = sum((a | b).values())
            errors.append(like - (sum((a & b).values()) / whole if whole else 1.0))
    assert math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.06 and max(map(abs, errors)) < 0.25
    plain = {r.doc_id: r.fingerprint for r in fingerprint.fingerprint_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert plain == {i: r.fingerprint for i, r in got.items()}


def test_fingerprint_ties(spark, monkeypatch):
    """Rows of one id at the edge of ranges, and one id alone, each follow another row exactly once."""
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 3)
    docs = [(i // 4, f"text {i} " * (i % 5 + 1)) for i in range(24)] + [(None, "last"), (None, None)]
    rows = fingerprint.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    order = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).digest()))
    want = Counter()
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        want[(i, hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in rows) == want


def test_many_sources(spark):
    """Targets ordered in ranges are those ordered in one task."""
    sizes = spark.createDataFrame([(f"s{i % 97}", (i * 7919) % 400 + (50_000 if i % 97 == 3 else 0)) for i in range(500)] + [(None, 9), ("empty", 0)], "source string, size long")
    got = [{r.source: (r.source_size, r.weight, round(r.target, 6)) for r in mixing.source_targets(sizes, most=most).collect()} for most in (0, 1000)]
    assert got[0] == got[1] and len(got[0]) == 99
    total = sum(n for n, _, _ in got[0].values())
    assert abs(sum(t for *_, t in got[0].values()) - total) < 1e-3 and all(t <= 3 * n + 1e-6 for n, _, t in got[0].values())


def test_stages_by_brute_force(spark):
    """Each stage's decisions, on what the one before kept."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    score = {r.doc_id: r.predicted for r in registry.QUERIES["op7_quality"](spark, SF).collect()}
    kept = stages["quality classifier"](spark, docs, SF).cache()
    assert {r.doc_id for r in kept.collect()} == {i for i, p in score.items() if p == 1}
    lines = stages["line dedup"](spark, kept, SF).cache()
    con = duckdb.connect()
    con.register("documents", kept.toPandas())
    want = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, text FROM ({registry.ORACLE_SQL['op4_line_dedup']}) WHERE NOT emptied").fetchall()}
    assert {r.doc_id: r.text for r in lines.collect()} == want
    near = stages["minhash near-dedup"](spark, lines, SF).cache()
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in classes([(r.doc_id, r.text) for r in lines.collect()]).items() if i == c}
    clean = stages["benchmark decontamination"](spark, near, SF).cache()
    items = [(r[0], r[1]) for r in table("benchmark")]
    hits = {r[0]: r for r in decontaminate.brute_force([(r.doc_id, r.text) for r in near.collect()], items)}
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert set(texts) == {i for i, r in hits.items() if r[2] == 0 or r[2] < r[1]}
    assert all(texts[r.doc_id] == r.text for r in near.collect() if hits[r.doc_id][2] == 0)
    assert all(len(decontaminate.plain_words(texts[i])) == hits[i][1] - hits[i][2] for i in texts)
    mixed = stages["mixing to target weights"](spark, clean, SF).collect()
    taken = Counter()
    for r in mixed:
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == r.taken
        taken[r.source] += r.taken
    targets = {r.source: r.target for r in mixing.source_targets(mixing.mix(clean).select("source", "size")).collect()}
    assert all(abs(taken[s] - t) <= 1 for s, t in targets.items())


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Empty tables; then null and repeated ids, null and empty texts, and an extra column."""
    for rows in (0, 1):
        d = tmp_path / str(rows)
        for t in ("documents", "labels", "benchmark"):
            df = spark.read.parquet(f"{SF}/{t}.parquet")
            if t == "documents":
                df = df.limit(60 * rows)
                if rows:
                    df = df.unionByName(df.limit(5)).unionByName(spark.createDataFrame([(None, "alone here", "en", None, 1), (3, None, None, "s", 0), (3, "", "en", "s", 0)], df.schema)).withColumn("size", df["n_chars"])
            (df if rows else df.limit(0)).write.parquet(f"{d}/{t}.parquet")
        out = corpus_pipeline.run(spark, str(d))
        assert (out.count() > 0) == bool(rows) and {"doc_id", "text", "copy", "taken"} <= set(out.columns)
