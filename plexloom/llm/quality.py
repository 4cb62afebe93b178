"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: words, word pairs, and shapes of words (runs of capitals, small letters, digits and
marks) and their pairs, hashed into 2**BITS bins.  Each is scaled by its class log-count ratio; a linear hinge-loss
model is fitted on the scaled, length-normalised rows by dual coordinate descent; a logistic map of its margin, fitted
on the same rows, gives the score.

The model is fitted on at most SAMPLE labelled rows that are not held out, of at most SAMPLE_BYTES of features, chosen by
a hash of the id; every whole text is scored.  Labels, lang, source and doc_id never enter a score.

Defined cases: null, empty and blank texts have no n-gram and score like any text without a known one; unlabelled rows
are scored only; labels that are null or of one class alone give a constant score; repeated rows score alike.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexloom.llm.common import held_out, labelled_sample, map_batches, spool

#: Bounds of the fitting sample: rows, and bytes of their features.
SAMPLE, SAMPLE_BYTES = 6_000, 48_000_000
BITS = 18
#: A score from this on is predicted as 1.
THRESHOLD = 0.3
COST, EPOCHS, ALPHA = 1.0, 12, 1.0
CACHE = 400_000

_MARKS = re.compile(r"[^\W\d_]+|\d+|\s+|[\W_]", re.UNICODE)
_MASK = np.uint64((1 << BITS) - 1)


def shape(word: str) -> str:
    """Runs of letters as a (small), A (capitals), Aa (mixed), digits as 0, marks as themselves, at most twice in a row."""
    out = []
    for run in _MARKS.findall(word):
        if run[0].isalpha():
            s = "a" if run.islower() else "A" if run.isupper() and len(run) > 1 else "Aa"
        else:
            s = "0" if run[0].isdigit() else run
        if len(out) < 2 or not out[-1] == out[-2] == s:
            out.append(s)
    return "".join(out[:12])


class _Names(dict):
    """word -> (hash of the word, hash of its shape)."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= CACHE:
            self.clear()
        self[word] = out = (xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "replace")), xxhash.xxh3_64_intdigest(shape(word).encode("utf-8", "replace"), seed=1))
        return out


def _pairs(h: np.ndarray, seed: int) -> np.ndarray:
    x = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed))
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(20)


def ngrams(text: str | None, names: _Names) -> np.ndarray:
    """Sorted distinct bins of a text's n-grams."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter((x for w in words for x in names[w]), np.uint64, 2 * len(words)).reshape(-1, 2)
    word, form = h[:, 0], h[:, 1]
    return np.unique(np.concatenate([word, form, _pairs(word, 1), _pairs(form, 2)]) & _MASK).astype(np.int64)


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, size: int, epochs: int, seed: int = 7) -> np.ndarray:
    """Weights of a linear L1-hinge-loss model over sparse rows (bins, values); y is 1 or -1."""
    w, alpha, rng = np.zeros(size), np.zeros(len(rows)), np.random.default_rng(seed)
    norm = np.array([float(v @ v) for _, v in rows])
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            if norm[i] == 0:
                continue
            bins, values = rows[i]
            gradient = y[i] * float(w[bins] @ values) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[bins] += (new - alpha[i]) * y[i] * values
                alpha[i] = new
    return w


def logistic_map(margin: np.ndarray, y01: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a margin + b))) by Newton steps on smoothed targets, halved until the loss falls."""
    pos, neg = float(y01.sum()), float((1 - y01).sum())
    t = np.where(y01 > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(a: float, b: float) -> float:
        z = a * margin + b
        return float((np.logaddexp(0, z) - t * z).sum())

    a, b = 0.0, math.log((pos + 1) / (neg + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g, s = p - t, np.maximum(p * (1 - p), 1e-9)
        haa, hab, hbb = float((s * margin * margin).sum()) + 1e-6, float((s * margin).sum()), float(s.sum()) + 1e-6
        ga, gb = float((g * margin).sum()), float(g.sum())
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db, step, now = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det, 1.0, loss(a, b)
        while step > 1e-4 and loss(a - step * da, b - step * db) > now:
            step /= 2
        if step <= 1e-4:
            break
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-6:
            break
    return float(max(a, 0.0)), float(b)


class NBSVM:
    """Fitted by fit(); score() gives values from 0 to 1 for arrays of bins."""

    def __init__(self) -> None:
        self.weights = np.zeros(1 << BITS, np.float32)
        self.ratio = np.zeros(1 << BITS, np.float32)
        self.bias = self.a = 0.0
        self.b = 0.0

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> NBSVM:
        y = np.asarray(y)
        if len(set(y.tolist())) < 2:
            self.b = 4.0 if len(y) and y[0] == 1 else -4.0 if len(y) else 0.0
            return self
        p, q = (np.bincount(np.concatenate([r for r, k in zip(rows, y, strict=True) if k == c] or [np.zeros(0, np.int64)]), minlength=1 << BITS) + ALPHA for c in (1, 0))
        self.ratio = np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)
        self.ratio[(p + q) < 2 * ALPHA + 2] = 0  # seen in fewer than two rows
        scaled = [(np.append(r, 1 << BITS), np.append(self._values(r), 0.2)) for r in rows]
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        w = dual_descent(scaled, np.where(y == 1, 1.0, -1.0), COST * weight, (1 << BITS) + 1, EPOCHS)
        self.weights, self.bias = w[:-1].astype(np.float32), float(w[-1]) * 0.2
        self.a, self.b = logistic_map(np.array([self.margin(r) for r in rows]), y)
        return self

    def _values(self, bins: np.ndarray) -> np.ndarray:
        v = self.ratio[bins].astype(np.float64)
        n = np.sqrt(v @ v)
        return v / n if n > 0 else v

    def margin(self, bins: np.ndarray) -> float:
        return float(self.weights[bins] @ self._values(bins)) + self.bias

    def score(self, bins: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(bins) + self.b, -35, 35))))


def fitting_rows(docs: DataFrame, labels: DataFrame, label: str, make: Callable[[], Callable[[str | None], np.ndarray]], bound: int, most_bytes: int = SAMPLE_BYTES) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of the bounded sample, in the order of a hash of its ids; features are made on the executors.

    Rows are taken in that order until their features come to most_bytes; the driver takes no more."""

    def run(batches):
        of = make()
        for batch in batches:
            made = [of(t).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(map(len, made), pa.int64()), pa.array(made, pa.binary())], names=["id", "y", "size", "x"])

    rows = map_batches(labelled_sample(docs, labels, label, bound).select(F.md5(F.col("doc_id").cast("string")), "text", "__y"), run, "id string, y int, size long, x binary")
    rows = spool(rows)
    total, last = 0, ""
    for r in sorted(rows.groupBy("id").agg(F.sum("size").alias("size")).collect()):  # at most `bound` ids
        total += r["size"]
        if total > most_bytes:
            break
        last = r["id"]
    got = sorted((r[0], r[1], bytes(r[2])) for r in rows.filter(F.col("id") <= last).select("id", "y", "x").collect())
    return [np.frombuffer(x, np.int32) for *_, x in got], np.array([y for _, y, _ in got], np.int64)


def _features() -> Callable[[str | None], np.ndarray]:
    names = _Names()
    return lambda text: ngrams(text, names)


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> NBSVM:
    return NBSVM().fit(*fitting_rows(docs, labels, "quality", _features, bound))


def add_score(docs: DataFrame, make: Callable[[], Callable[[str | None], float]], name: str = "score") -> DataFrame:
    """docs with a column of scores of whole texts; make() gives a worker its scoring function."""
    kept = [c for c in docs.columns if c != name]
    docs = docs.select(*kept)

    def run(batches):
        of = make()
        for batch in batches:
            texts = batch.column(kept.index("text")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([of(t) for t in texts], pa.float64())], names=[*kept, name])

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score_quality(docs: DataFrame, model: NBSVM) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        of = _features()
        return lambda text: held.value.score(of(text))

    return add_score(docs, make)


def judged(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    return docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted to be of low quality."""
    return score_quality(docs, fit(docs, labels)).filter(F.col("score") >= THRESHOLD).select(*docs.columns)
