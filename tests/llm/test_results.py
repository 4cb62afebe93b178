"""Whole queries against SQL, brute force and held-out labels."""

import duckdb
import pytest

from plexloom.llm import decontaminate, license_scan, registry
from tests.oracle import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, name):
    assert check(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF) is None


def test_decontamination(spark):
    read = lambda t: duckdb.sql(f"SELECT * FROM '{SF}/{t}.parquet'").fetchall()
    docs, items = [(r[0], r[1]) for r in read("documents")], [(r[0], r[1]) for r in read("benchmark")]
    assert sorted(map(tuple, registry.QUERIES["op5_decontamination"](spark, SF).collect())) == sorted(decontaminate.brute_force(docs, items))


@pytest.mark.parametrize(("name", "label", "least"), [("op2_toxicity", "toxic", 0.9), ("op7_quality", "quality", 0.95)])
def test_held_out(spark, name, label, least):
    got = {r.doc_id: r for r in registry.QUERIES[name](spark, "/root/testdata/sf0.01").collect()}
    rows = [(got[d].predicted, y) for d, y in duckdb.sql(f"SELECT doc_id, {label} FROM '/root/testdata/sf0.01/labels.parquet'").fetchall() if got[d].held_out]
    assert sum(a == b for a, b in rows) / len(rows) >= least


def test_license_places(spark):
    for r in registry.QUERIES["op6_license_scans"](spark, SF).collect():
        assert r.n_base == 0 or (r.first_word <= r.last_word < r.n_words and set(r.base_labels.split(",")) <= set(r.labels.split(",")))
    text = "Under the MIT License"
    assert license_scan.scan(f"{text} {text}")[1] == [0, 4]


def test_fingerprint_estimates_weighted_jaccard():
    from plexloom.llm.fingerprint import Sampler, likeness

    s = Sampler()
    a, b = {b"%d" % i: 1 + i % 4 for i in range(200)}, {b"%d" % i: 1 + i % 3 for i in range(80, 280)}
    keys = set(a) | set(b)
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    assert abs(likeness(s.slots(a), s.slots(b)) - true) < 0.15


def test_draws_keep_what_is_asked_for(monkeypatch):
    """A full table forgets rare terms, draws frequent ones once, and its fingerprints are those of a table that never fills."""
    from plexloom.llm import fingerprint

    texts = [" ".join([*(f"w{i}" for i in range(60)), *(f"x{k}_{i}" for i in range(40)), "w1 w2 w2"]) for k in range(40)]
    plain = [fingerprint.Sampler().fingerprint(t).tolist() for t in texts]
    monkeypatch.setattr(fingerprint, "CACHE", 4 * fingerprint.BLOCK)
    drawn, draws = [], fingerprint.draws
    monkeypatch.setattr(fingerprint, "draws", lambda terms: drawn.extend(terms) or draws(terms))
    sampler = fingerprint.Sampler()
    assert [sampler.fingerprint(t).tolist() for t in texts] == plain
    assert len(sampler.single.rows) <= 4 * fingerprint.BLOCK < len(drawn) and drawn.count(b"w5") == 1 and drawn.count(b"w2") == 1
