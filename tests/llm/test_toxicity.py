"""The label model on votes alone, the classifier trained on its posterior, and defined cases."""

import duckdb
import numpy as np
import pytest

from plexloom.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def f1(guess, y):
    hit = int((guess & (y == 1)).sum())
    return 2 * hit / max(1, int(guess.sum()) + int((y == 1).sum()))


def test_label_model_finds_accuracies():
    """Voters of known rates, three of them copies of one: better than any voter, and the copies don't count thrice."""
    rng = np.random.default_rng(3)
    y = (rng.random(6000) < 0.15).astype(int)
    rates = [(0.6, 0.01), (0.5, 0.02), (0.4, 0.01), (0.5, 0.05), (0.3, 0.005)]
    votes = np.stack([np.where(y == 1, rng.random(6000) < a, rng.random(6000) < b) for a, b in rates], 1)
    votes = np.concatenate([votes, votes[:, 3:4], votes[:, 3:4]], 1).astype(np.float32)
    post, accuracy, together = toxicity.label_model(votes)
    assert f1(post > 0.5, y) > max(f1(votes[:, k] > 0, y) for k in range(7))
    true = [(votes[:, k] * y).sum() / votes[:, k].sum() for k in range(5)]
    assert np.argmin(accuracy[:5]) == np.argmin(true) == 3
    assert together[5, 3] > 0.95 and together[6, 3] > 0.95 and together[0, 1] < 0.5


def test_posterior_without_labels(spark):
    """On rows of the corpus, the posterior of the votes alone beats the best single voter, and held-out rows are judged right."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.sample(docs, labels)
    columns = toxicity.propose(rows)
    patterns = toxicity._Patterns(columns)
    made = [(toxicity.features(r.text, patterns), r.y) for r in rows.collect()]
    y = np.array([k for _, k in made])
    model = toxicity.ToxicityModel(columns).fit([x for x, _ in made], y)
    place = {k: i for i, k in enumerate(model.voters)}
    votes = np.zeros((len(made), len(place)), bool)
    for i, (x, _) in enumerate(made):
        votes[i, [place[k] for k in x.tolist() if k in place]] = True
    known = y >= 0
    assert (y < 0).sum() > 2000
    best = max(f1(votes[known, k], y[known]) for k in range(len(place)))
    assert f1(model.posterior[known] > 0.5, y[known]) > best + 0.1
    got = {r.doc_id: r for r in quality.judged(toxicity.score_toxicity(docs, model), 0.5).collect()}
    pairs = [(got[d].predicted, k) for d, k in duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall() if got[d].held_out]
    assert sum(a == b for a, b in pairs) / len(pairs) >= 0.98


@pytest.mark.parametrize("rows", [[], [(1, 1, 1)], [(1, 1, 0), (2, 1, 0)], [(1, None, None)], [(1, 1, 1), (1, 0, 0), (None, 1, 1)]], ids=["none", "toxic only", "clean only", "null", "several"])
def test_label_sets(spark, rows):
    docs = spark.createDataFrame([(1, "you are an idiot and a clown"), (2, "a plain text"), (3, None), (3, ""), (None, "scum")], "doc_id long, text string")
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()
    score = {r.text: r.score for r in got}
    assert len(got) == 5 and all(0 <= s <= 1 for s in score.values()) and score[None] == score[""] == score["a plain text"] <= score["you are an idiot and a clown"]
    assert len(quality.score_quality(docs, quality.fit(docs, labels)).collect()) == 5
