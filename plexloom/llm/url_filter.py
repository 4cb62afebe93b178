"""URL filters: ordered rules, then gradient-boosted trees on lexical features.

A rule is host and path, like example.org/es/; it fits its host and all subdomains if the url's path starts with the
rule's, and the longest rule that fits gives the verdict.  Urls that no rule fits are judged by gradient-boosted trees
over lexical features (lengths, depth, digit ratio, entropy, parameter counts, suffix statistics), trained from
labelled urls; the thin query takes as labelled the urls that a rule fits.

The trees are fitted on at most SAMPLE labelled urls of at most SAMPLE_BYTES, chosen by a hash of the url; every url is
judged.  Suffix statistics of a url that is fitted on leave that url out, so that they don't tell its own label.

Defined cases: a null url, or one without ://, has an empty host and path, fits no rule and is judged by the trees like
any other; without labelled urls of both classes all scores are the only class's, or allow; repeated rows judge alike;
columns of the input named host, path, rule, score or verdict are replaced; urls are taken whole, however long.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, SAMPLE_BYTES = 20_000, 16_000_000
TREES, DEPTH, RATE, BINS, LEAST = 40, 3, 0.2, 32, 10

# Rules and verdicts.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url) -> tuple[F.Column, F.Column]:
    """Host and path columns of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1), F.lit(""))
    return host, path


def judge_by_rules(urls: DataFrame, rules: dict[str, str]) -> DataFrame:
    """urls (with a column url) with host, path, rule and rule_verdict added; rules are a bounded list, in the plan."""
    host, path = parts(F.col("url"))
    out = urls.withColumn("host", host).withColumn("path", path)
    rule = verdict = F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        h, _, p = text.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(rules[text])).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


NAMES = ["length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "params", "hyphens", "query_length", "host_digits", "longest_run", "suffix", "first", "ending"]


class Suffixes(dict):
    """key -> (labelled urls that have it, blocked ones): hosts' last labels, first path segments and file endings."""

    base = 0.5

    def learn(self, urls: list[str], y: np.ndarray) -> Suffixes:
        for u, k in zip(urls, y.tolist(), strict=True):
            for key in tokens(u):
                n, blocked = self.get(key, (0, 0))
                self[key] = n + 1, blocked + k
        self.base = float(y.mean()) if len(y) else 0.5
        return self

    def rate(self, key: tuple, own: float | None = None) -> float:
        """Smoothed share of blocked urls, without the one whose label is own; the share of all for rare keys."""
        n, blocked = self.get(key, (0, 0))
        if own is not None:
            n, blocked = n - 1, blocked - own
        return (blocked + 4 * self.base) / (n + 4) if n >= 4 else self.base


def tokens(url: str | None) -> list[tuple]:
    _, _, rest = (url or "").partition("://")
    m = re.match(r"([^/?#]*)(/[^?#]*)?", rest)
    host, path = m[1].lower(), m[2] or ""
    return [("suffix", host.rpartition(".")[2]), ("first", path[1:].partition("/")[0]), ("ending", path.rpartition("/")[2].rpartition(".")[2] if "." in path.rpartition("/")[2] else "")]


def lexical(urls: list[str | None], suffixes: Suffixes, y: np.ndarray | None = None) -> np.ndarray:
    """Features of urls; y has the labels of those that the suffix statistics were learnt from."""
    out = np.zeros((len(urls), len(NAMES)))
    for i, url in enumerate(urls):
        u = url or ""
        rest = u.partition("://")[2] or u
        host, path, query = re.match(r"([^/?#]*)([^?#]*)\??([^#]*)", rest).groups()
        n = len(u)
        counts = Counter(u).values()
        out[i, :12] = (
            n, len(host), len(path), path.count("/"), host.count(".") + 1 if host else 0, sum(c.isdigit() for c in u) / n if n else 0,
            -sum(c / n * math.log2(c / n) for c in counts), query.count("=") + query.count("&"), host.count("-"), len(query), sum(c.isdigit() for c in host), max(map(len, re.findall(r"[a-z]+", host)), default=0),
        )
        out[i, 12:] = [suffixes.rate(t, None if y is None else y[i]) for t in tokens(u)]
    return out


class Boosted:
    """Binary gradient boosting with histograms; score() gives the probability of class 1."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.trees, rate = [], float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.01
        self.base = math.log(rate / (1 - rate))
        if len(set(y.tolist())) < 2:
            return self
        self.cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        f = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(binned, p - y, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            f += self._walk(tree, binned)
        return self

    def _grow(self, x, g, h, rows, depth):
        leaf = -RATE * g[rows].sum() / (h[rows].sum() + 1.0)
        best = (1e-6, None, None)
        total = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for k in range(x.shape[1] if depth and len(rows) >= 2 * LEAST else 0):
            n = len(self.cuts[k]) + 1
            gs, hs, cs = (np.cumsum(np.bincount(x[rows, k], w, n))[:-1] for w in (g[rows], h[rows], None))
            if not len(gs):
                continue
            gain = gs**2 / (hs + 1.0) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1.0) - total
            gain[(cs < LEAST) | (len(rows) - cs < LEAST)] = 0
            at = int(gain.argmax())
            best = max(best, (float(gain[at]), k, at), key=lambda b: b[0])
        if best[1] is None:
            return leaf
        left = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, g, h, rows[left], depth - 1), self._grow(x, g, h, rows[~left], depth - 1)

    def _walk(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        return np.where(x[:, tree[0]] <= tree[1], self._walk(tree[2], x), self._walk(tree[3], x))

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        if self.trees and len(x):
            binned = np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)], 1)
            for tree in self.trees:
                f += self._walk(tree, binned)
        return 1 / (1 + np.exp(-f))


def fit(labelled: DataFrame, bound: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[Suffixes, Boosted]:
    """From (url, blocked 0/1); the bounded sample is collected."""
    chosen = labelled.filter("url is not null and blocked is not null").select("url", "blocked").orderBy(F.md5("url"), "url", "blocked").limit(bound)
    size = F.sum(F.octet_length("url")).over(Window.orderBy(F.md5("url"), "url", "blocked").rowsBetween(Window.unboundedPreceding, 0))  # over `bound` rows
    rows = chosen.withColumn("__size", size).filter(F.col("__size") <= most_bytes).drop("__size").collect()
    urls, y = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    suffixes = Suffixes().learn(urls, y)
    return suffixes, Boosted().fit(lexical(urls, suffixes, y), y)


def filter_urls(urls: DataFrame, rules: dict[str, str] | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """urls with host, path, rule, score (probability to block) and verdict added."""
    urls = urls.drop("host", "path", "rule", "rule_verdict", "score", "verdict")
    judged = judge_by_rules(urls, RULES if rules is None else rules)
    if labelled is None:
        labelled = judged.filter("rule is not null").select("url", (F.col("rule_verdict") == "block").cast("int").alias("blocked"))
    held = urls.sparkSession.sparkContext.broadcast(fit(labelled))

    @F.pandas_udf("double")
    def score(url: pd.Series) -> pd.Series:
        suffixes, model = held.value
        return pd.Series(model.score(lexical(list(url), suffixes)) if len(url) else [], dtype=float)

    out = judged.withColumn("score", score("url"))
    return out.withColumn("verdict", F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))).drop("rule_verdict")


#: DuckDB, over the view pages: what the fixed rules say.
ORACLE_RULES = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(rule, host_rule, path_rule, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS rule_verdict FROM h JOIN r ON (host = host_rule OR ends_with(host, '.' || host_rule)) AND starts_with(path, path_rule) GROUP BY 1)
SELECT h.page_id, host, path, rule, rule_verdict FROM h LEFT JOIN f ON h.page_id = f.page_id
"""
