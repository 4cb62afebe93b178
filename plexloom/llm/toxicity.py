"""Toxicity by weak supervision.

Many voters look at a text and fire or abstain: lexicons of insults in several languages, forms of address and ways of
writing, and patterns (words and beginnings of words) that are proposed from labelled rows, where they lean to toxic
ones.  Labels only propose and vet voters, and later choose the threshold; they never vote.

A generative label model is fitted on the votes alone, of labelled and unlabelled rows: by EM it estimates how often
each voter fires on toxic and on clean texts, and so its accuracy, and in every round the correlations of voters within
the classes; voters that fire together beyond what the classes explain share their weight.  That no voter fires at all
is one more observation.  A linear classifier is trained on the posterior labels of these rows, over votes and all
proposed patterns, also those that didn't become voters.

What is fitted, is fitted on at most LABELLED labelled and UNLABELLED further rows, none held out, chosen by a hash of
the id; what the driver takes is at most CANDIDATES patterns and their places in these rows.  Every whole text is scored.
Labels, lang, source and doc_id never enter a score.

Defined cases: null and empty texts have no vote and no pattern and get the intercept's score; unlabelled rows are
scored only; of several labels of one id the greatest counts; without labels no pattern is proposed and the written
voters alone are taken, unvetted; without toxic or without clean labels the threshold stays the label model's; without
any row to fit on, each written voter weighs the same; repeated rows score alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexloom.llm.common import held_out, map_batches, plain_words
from plexloom.llm.quality import add_score, logistic_map

#: Bounds of the rows that are fitted on.
LABELLED, UNLABELLED = 10_000, 6_000
THRESHOLD = 0.5
#: Words and beginnings are counted in 2**BITS bins, so that counting takes bounded memory.
BITS = 22
#: Lengths of the word beginnings that are patterns beside whole words; a pattern is one of these, found in as many
#: words of a text as its level says.
STEMS, LEVELS = (3, 4, 5, 6, 7), (1, 2, 3)
#: Patterns need so many toxic rows and such log-odds; the most of them, and the most voters made of them.
SUPPORT, ODDS, CANDIDATES, MOST_VOTERS = 5, 2.5, 4_000, 150
#: Share of toxic rows among the labelled ones on which a voter fires, at least; overlap of two voters, at most.
PRECISE, OVERLAP = 0.9, 0.8
#: Rounds of EM before correlations are estimated; a correlation below NOISE counts as none.
SETTLE, NOISE = 4, 0.1
CACHE = 400_000

# Lexicons, one voter each.
LEXICONS = {
    "stupidity": "idiot idiots stupid moron morons dumb imbecile fool dunce halfwit cretin brainless",
    "worth": "worthless pathetic useless loser losers failure disgrace nobody",
    "filth": "trash garbage scum filth filthy vermin dirtbag slime sewage",
    "disgust": "disgusting repulsive revolting vile gross sickening nauseating hideous",
    "ridicule": "clown clowns joke laughable ridiculous buffoon jester",
    "animals": "pig pigs rat rats dog cockroach snake weasel",
    "anger": "hate hated hates despise loathe detest damn hell",
    "threat": "kill die hurt destroy smash punish beat",
    "profanity": "crap bastard ass jerk screw bloody",
    "german": "dumm idiot trottel depp blöd abschaum versager widerlich müll",
    "french": "imbécile stupide nul débile ordure minable dégoûtant crétin",
    "spanish": "estúpido tonto imbécil basura patético inútil asqueroso payaso",
}
# Patterns over words, one voter each.
PATTERNS = {
    "you_are": r" you (?:are|re) (?:a |an |such )",
    "shut": r" (?:shut up|go away|get lost) ",
    "nobody": r" (?:nobody|no one) (?:likes|wants|needs) you ",
    "all_of_you": r" (?:all of you|you people|those people) ",
}
WRITTEN = [*LEXICONS, *PATTERNS, "twice", "shouting"]
_LEX = {w.encode(): i for i, ws in reversed(list(enumerate(LEXICONS.values()))) for w in ws.split()}
_RX = [re.compile(p.encode()) for p in PATTERNS.values()]
_STARTS = {b"you", b"shut", b"nobody", b"no", b"get", b"go", b"all", b"those"}
_MASK = (1 << BITS) - 1


class _Patterns(dict):
    """word -> bins of the word and its beginnings; only those of which `columns` holds some level, if it is given."""

    def __init__(self, columns: dict[int, int] | None = None) -> None:
        super().__init__()
        self.columns = columns
        self.bins = None if columns is None else {c // len(LEVELS) for c in columns}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        letters = word.decode("utf-8", "replace")
        bins = [xxhash.xxh3_64_intdigest(word) & _MASK]
        bins += [xxhash.xxh3_64_intdigest(letters[:k].encode("utf-8"), seed=k) & _MASK for k in STEMS if len(letters) > k]
        out = tuple(bins) if self.bins is None else tuple(b for b in bins if b in self.bins)
        if len(word) <= 64:
            self[word] = out
        return out

    def found(self, words: list[bytes]) -> list[int]:
        """Patterns of a text as bin * len(LEVELS) + level, or as their columns."""
        n: dict[int, int] = {}
        for w in words:
            for b in self[w]:
                n[b] = n.get(b, 0) + 1
        out = [b * len(LEVELS) + i for b, k in n.items() for i, level in enumerate(LEVELS) if k >= level]
        return out if self.columns is None else [self.columns[x] for x in out if x in self.columns]


def written_votes(text: str, words: list[bytes], distinct: set[bytes]) -> set[int]:
    votes = {_LEX[w] for w in distinct if w in _LEX}
    if not distinct.isdisjoint(_STARTS):
        line = b" " + b" ".join(words) + b" "
        votes |= {len(LEXICONS) + k for k, rx in enumerate(_RX) if rx.search(line)}
    if votes and sum(w in _LEX for w in words) >= 2:
        votes.add(len(WRITTEN) - 2)
    if text.count("!") >= 3 and text.isupper():
        votes.add(len(WRITTEN) - 1)
    return votes


def features(text: str | None, patterns: _Patterns) -> np.ndarray:
    """Written voters that fire (from 0) and columns of patterns (after them), sorted."""
    words = plain_words(text)
    distinct = set(words)
    votes = written_votes(text, words, distinct) if words else set()
    return np.array(sorted(votes) + [len(WRITTEN) + c for c in sorted(patterns.found(words))], np.int64)


def label_model(votes: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each row, accuracy of each voter, correlations of the voters) of 0/1 votes, by EM on them alone.

    How a voter fires on toxic and on clean rows is estimated from what the other voters make of each row, less those
    it is correlated with, so that no voter vouches for itself.  A voter is taken to be no worse than chance, which
    settles which class is the toxic one."""
    n, k = votes.shape
    silent = ~votes.any(axis=1) if k else np.ones(n, bool)
    prior, on, off, together, post = 0.1, np.full(k, 0.3), np.full(k, 0.01), np.eye(k, dtype=np.float32), np.full(n, 0.1)
    quiet = np.log(0.05 / 0.9)
    odds = lambda p: np.log(p / (1 - p))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -35, 35)))
    for r in range(rounds):
        # of voters that fire on a row, each counts one over the number of them that it goes along with
        said = votes / np.maximum(votes @ together, 1) * np.maximum(np.log(on / off), 0)
        new = sigmoid(odds(prior) + said.sum(axis=1) + silent * min(quiet, 0))
        moved, post = float(np.abs(new - post).max(initial=0)), new
        apart = np.clip(1 - together, 0, 1)
        others = sigmoid(odds(prior) + said @ apart + np.clip(1 - votes @ apart, 0, 1) * min(quiet, 0)) * votes
        bad, good = post.sum(), (1 - post).sum()
        on, off = np.clip((others.sum(axis=0) + 0.1) / (bad + 1), 1e-4, 0.9999), np.clip(((votes - others).sum(axis=0) + 0.05) / (good + 10), 1e-5, 0.9999)
        quiet = np.log((post[silent].sum() + 0.5) / (bad + 1)) - np.log(((1 - post)[silent].sum() + 0.5) / (good + 1))
        prior = float(np.clip(post.mean(), 0.002, 0.5))
        if r < SETTLE:  # correlations within classes that aren't known yet would be those between them
            continue
        rest = votes - (post[:, None] * on + (1 - post[:, None]) * off)
        size = np.sqrt((rest**2).sum(axis=0)) + 1e-9
        together = np.clip((np.abs(rest.T @ rest / np.outer(size, size)) - NOISE) / (1 - NOISE), 0, 1).astype(np.float32)
        if moved < 1e-4:
            break
    return post, prior * on / (prior * on + (1 - prior) * off), together


class ToxicityModel:
    """Scores from columns of features(); columns gives the column of each pattern."""

    def __init__(self, columns: dict[int, int] | None = None) -> None:
        self.columns = columns or {}
        self.weights, self.bias, self.a, self.b = np.full(len(WRITTEN) + len(self.columns), 0.0), -3.0, 1.0, 0.0
        self.weights[: len(WRITTEN)] = 4.0
        self.voters: list[int] = list(range(len(WRITTEN)))

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> ToxicityModel:
        """y is 1, 0 or -1 for rows without a label."""
        if not rows:
            return self
        size, n = len(self.weights), len(rows)
        flat, own = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
        self.voters = self._vetted(flat, own, y, size)
        place = np.full(size, -1)
        place[self.voters] = np.arange(len(self.voters))
        votes = np.zeros((n, len(self.voters)), np.float32)
        keep = place[flat] >= 0
        votes[own[keep], place[flat[keep]]] = 1
        self.posterior, self.accuracy, self.together = label_model(votes)
        self._descend(flat, own, self.posterior, n)
        known = y >= 0
        if len(set(y[known].tolist())) == 2:
            self.a, self.b = logistic_map(np.array([self.margin(r) for r, k in zip(rows, known, strict=True) if k]), y[known])
        return self

    def _vetted(self, flat: np.ndarray, own: np.ndarray, y: np.ndarray, size: int) -> list[int]:
        """Voters: written ones unless labels speak against them, and precise patterns that fire on rows of their own."""
        bad, good = np.bincount(flat[y[own] == 1], minlength=size), np.bincount(flat[y[own] == 0], minlength=size)
        precise = bad >= PRECISE * (bad + good)
        out = [k for k in range(len(WRITTEN)) if precise[k] or bad[k] + good[k] < SUPPORT]
        toxic = np.flatnonzero(y == 1)
        at = np.full(len(y), -1)
        at[toxic] = np.arange(len(toxic))
        fires = np.zeros((size, len(toxic)), np.float32)
        here = at[own] >= 0
        fires[flat[here], at[own[here]]] = 1
        ranked = [k for k in np.argsort(-bad, kind="stable").tolist() if k >= len(WRITTEN) and precise[k] and bad[k] >= SUPPORT]
        taken: list[int] = []
        for k in ranked:
            if len(taken) == MOST_VOTERS:
                break
            both = fires[taken] @ fires[k] if taken else np.zeros(0)
            if not (both > OVERLAP * (bad[taken] + bad[k] - both)).any():
                taken.append(k)
        return out + taken

    def _descend(self, cols: np.ndarray, own: np.ndarray, post: np.ndarray, n: int) -> None:
        """Logistic loss on posterior labels with a small L2 term and weights from 0, by accelerated gradient steps."""
        size, mean = len(self.weights), float(np.clip(post.mean(), 1e-4, 0.9999))
        w, b, count = np.zeros(size), float(np.log(mean / (1 - mean))), np.bincount(cols, minlength=size) + 1.0
        vw, vb = np.zeros(size), 0.0
        for _ in range(400):
            z = np.bincount(own, w[cols], n) + b
            g = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - post
            gw = (np.bincount(cols, g[own], size) + 0.5 * w) / np.sqrt(count * count.max())
            vw, vb = 0.9 * vw - gw / 4, 0.9 * vb - g.mean()
            w, b = np.maximum(w + vw, 0), b + vb
        self.weights, self.bias = w, b

    def margin(self, columns: np.ndarray) -> float:
        return float(self.weights[columns].sum() + self.bias)

    def score(self, columns: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(columns) + self.b, -35, 35))))


def sample(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> DataFrame:
    """(text, y) of the rows to fit on: y is 1, 0 or, for rows taken without their label, -1.  The chosen ids, of which
    the bounds are parameters, are broadcast, so documents are neither shuffled nor collected."""
    order = F.md5(F.col("__id").cast("string"))
    free = F.col("__id").isNotNull() & ~held_out(F.col("__id"))
    known = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("y")).filter(free & F.col("y").isin(0, 1)).orderBy(order, "y").limit(labelled)
    other = docs.select(F.col("doc_id").alias("__id"), F.lit(-1).alias("y")).filter(free).orderBy(order).limit(unlabelled)
    chosen = known.unionByName(other).groupBy("__id").agg(F.max("y").alias("y"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("text", "y")


def propose(rows: DataFrame) -> dict[int, int]:
    """Patterns that lean to toxic rows of (text, y), with a column number each."""

    def run(batches):
        patterns, every = _Patterns(), (_MASK + 1) * len(LEVELS)
        counts = np.zeros((2, every + 1), np.uint16)  # the last one counts the rows, which are fewer than 2**16
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[y, [*patterns.found(plain_words(text)), every]] += 1
        at = np.flatnonzero(counts.any(axis=0))
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[0, part], pa.int64()), pa.array(counts[1, part], pa.int64())], names=["bin", "good", "bad"])

    last = (_MASK + 1) * len(LEVELS)
    counted = map_batches(rows.filter("y >= 0"), run, "bin long, good long, bad long").groupBy("bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    all_ = counted.filter(F.col("bin") == last).select(F.col("good").alias("all_good"), F.col("bad").alias("all_bad"))
    lean = F.log((F.col("bad") + 0.1) / (F.col("good") + 0.1)) - F.log((F.col("all_bad") + 0.1) / (F.col("all_good") + 0.1))
    best = counted.filter((F.col("bin") < last) & (F.col("bad") >= SUPPORT)).crossJoin(F.broadcast(all_)).filter(lean >= ODDS)  # all_ is one row
    return {r["bin"]: k for k, r in enumerate(best.orderBy(F.desc("bad"), "bin").limit(CANDIDATES).select("bin").collect())}


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> ToxicityModel:
    rows = sample(docs, labels, labelled, unlabelled)
    columns = propose(rows)

    def run(batches):
        patterns = _Patterns(columns)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([features(t, patterns).astype(np.int16).tobytes() for t in batch.column(0).to_pylist()], pa.binary())], names=["y", "x"])

    # at most CANDIDATES numbers of two bytes a row
    got = sorted((r[0], bytes(r[1])) for r in map_batches(rows, run, "y int, x binary").collect())
    return ToxicityModel(columns).fit([np.frombuffer(x, np.int16).astype(np.int64) for _, x in got], np.array([y for y, _ in got], np.int64))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    slim = ToxicityModel(model.columns)
    slim.weights, slim.bias, slim.a, slim.b = model.weights, model.bias, model.a, model.b
    held = docs.sparkSession.sparkContext.broadcast(slim)

    def make() -> Callable[[str | None], float]:
        patterns = _Patterns({b: c for b, c in held.value.columns.items() if held.value.weights[len(WRITTEN) + c] > 0})
        return lambda text: held.value.score(features(text, patterns))

    return add_score(docs, make)
