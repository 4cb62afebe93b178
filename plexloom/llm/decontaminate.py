"""Benchmark decontamination with an FM-index per training shard.

Texts are words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z is lower-cased.  A window is eight consecutive words of a
benchmark item, or the whole of a shorter item; a document word inside any occurrence of a window is hit.

A shard is a run of documents of one partition, up to SHARD_SYMBOLS symbols.  The alphabet is the benchmark's words;
any other word is a separator, as is a document's end, and a run of benchmark words shorter than the shortest window is
dropped, since no window can lie in it.  The shard's suffix array gives its Burrows-Wheeler transform, kept as a
wavelet tree of rank tables; all windows are searched backwards at once, occurrences are located by walking to sampled
suffix positions, and the spans of words they cover are merged per document.

The benchmark is taken in blocks of at most BLOCK_BYTES, so what is broadcast is bounded; each block passes over all
documents, and a row's spans go with it from block to block and are merged there, without any join.

Defined cases: a null or empty text has no words; an item without words has no window; equal windows of several items
count for each of them; items without an item_id count as one of an empty id; repeated rows are judged each by itself;
without documents or items nothing is hit; columns of docs named n_words, spans or items are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexloom.llm.common import map_batches, plain_words

WINDOW = 8
#: Symbols of a shard, after dropping.
SHARD_SYMBOLS = 300_000
#: Words of a shard's documents, before dropping.
SHARD_WORDS = 3_000_000
#: Bytes of benchmark text searched in one pass.
BLOCK_BYTES = 2_000_000
#: Every so many-th text position is kept for locating.
SAMPLE = 16
#: Items of which windows occur in a document before it counts as contaminated.
MIN_ITEMS = 2

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Wavelet:
    """Rank tables of a sequence over 0 .. size-1, one level for each bit; arrays of queries are answered together."""

    def __init__(self, seq: np.ndarray, size: int) -> None:
        self.bits = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo, hi = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at these positions, and how often each stands before its position."""
        lo, hi, symbol = np.zeros_like(at), at, np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a, b = ones[lo], ones[hi]
            bit = ones[hi + 1] - b == 1
            lo, hi, symbol = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b), symbol * 2 + bit
        return symbol, hi - lo


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol must be smaller than any other."""
    order = np.argsort(seq, kind="stable")
    rank = np.empty(len(seq), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], np.diff(seq[order]) != 0]))
    k = 1
    while rank[order[-1]] < len(seq) - 1:
        nxt = np.zeros(len(seq), np.int64)
        nxt[:-k] = rank[k:] + 1
        key = rank * (len(seq) + 1) + nxt
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        k *= 2
    return order


class FMIndex:
    def __init__(self, seq: np.ndarray, size: int) -> None:
        """seq: symbols from 1; 0 is added as the end."""
        seq = np.concatenate([seq.astype(np.int64), [0]])
        order = suffix_array(seq)
        self.tree = Wavelet(seq[order - 1], size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=size))]).astype(np.int64)
        sampled = order % SAMPLE == 0
        self.where = np.concatenate([[0], np.cumsum(sampled)])
        self.kept, self.sampled = order[sampled], sampled

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array intervals of equally long phrases, one a row."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.first[-1], np.int64)
        for symbol in phrases.T[::-1]:
            lo, hi = self.first[symbol] + self.tree.rank(symbol, lo), self.first[symbol] + self.tree.rank(symbol, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by steps back to a sampled one."""
        at, steps, out, todo = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64), np.arange(len(rows))
        while len(todo):
            here = self.sampled[at]
            done = todo[here]
            out[done] = self.kept[self.where[at[here]]] + steps[done]
            todo, at = todo[~here], at[~here]
            if len(todo):
                symbol, before = self.tree.access(at)
                at = self.first[symbol] + before
                steps[todo] += 1
        return out


class Phrases:
    """The windows of benchmark items as symbol sequences (from 2; 1 separates), grouped by length."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW) -> None:
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            symbols = [self.ids.setdefault(w, len(self.ids) + 2) for w in plain_words(text)]
            for i in range(max(1, len(symbols) - window + 1) if symbols else 0):
                found.setdefault(tuple(symbols[i : i + window]), set()).add(item)
        self.size = len(self.ids) + 2
        self.least = min(map(len, found), default=0)
        lengths = sorted({len(x) for x in found})
        self.groups = [(n, np.array([x for x in found if len(x) == n], np.int64), [sorted(v) for x, v in found.items() if len(x) == n]) for n in lengths]


def _hits(shard: list[tuple[np.ndarray, int]], phrases: Phrases) -> list[tuple[list[list[int]], set[int]]]:
    """For each document of symbols: the merged [start, end) spans of hit words, and the items found."""
    out: list[tuple[list[list[int]], set[int]]] = [([], set()) for _ in shard]
    pieces, doc, pos = [], [], []
    for d, (symbols, _) in enumerate(shard):
        known = np.concatenate([[False], symbols > 1, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= phrases.least:
                pieces += [symbols[a:b], [1]]
                doc.append(np.full(b - a + 1, d))
                pos.append(np.arange(a, b + 1))
    if not pieces:
        return out
    seq, doc, pos = np.concatenate(pieces), np.concatenate(doc), np.concatenate(pos)
    index = FMIndex(seq, phrases.size)
    marks: dict[int, list[tuple[int, int]]] = {}
    for n, rows, items in phrases.groups:
        lo, hi = index.search(rows)
        count = hi - lo
        which = np.repeat(np.arange(len(rows)), count)
        if not len(which):
            continue
        at = index.locate(np.repeat(lo, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count))
        for w, d, p in zip(which.tolist(), doc[at].tolist(), pos[at].tolist(), strict=True):
            out[d][1].update(items[w])
            marks.setdefault(d, []).append((p, p + n))
    for d, spans in marks.items():
        out[d][0].extend(_merge(spans))
    return out


def find_spans(texts: Iterator[str | None], phrases: Phrases) -> Iterator[tuple[int, list[list[int]], set[int]]]:
    """(words, merged spans of hit words, items) for each text in turn, shard by shard."""
    shard, symbols, words, get = [], 0, 0, phrases.ids.get
    for text in texts:
        own = plain_words(text)
        seq = np.fromiter((get(w, 1) for w in own), np.int64, len(own)) if phrases.least else np.ones(0, np.int64)
        shard.append((seq if len(own) >= phrases.least else np.ones(0, np.int64), len(own)))
        symbols, words = symbols + int((seq > 1).sum()), words + len(own)
        if symbols >= SHARD_SYMBOLS or words >= SHARD_WORDS:
            for (_, n), (spans, items) in zip(shard, _hits(shard, phrases), strict=True):
                yield n, spans, items
            shard, symbols, words = [], 0, 0
    for (_, n), (spans, items) in zip(shard, _hits(shard, phrases), strict=True):
        yield n, spans, items


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    block, size = [], 0
    for row in benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).toLocalIterator():
        block.append(("" if row[0] is None else str(row[0]), row[1]))
        size += len(row[1].encode("utf-8", "replace")) + 16
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    yield block


_ADDED = "n_words bigint, spans array<array<bigint>>, items array<string>"


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _search(docs: DataFrame, phrases: Phrases, first: bool) -> DataFrame:
    """docs with what phrases find in them; after the first block, merged with what the ones before have found."""
    held = docs.sparkSession.sparkContext.broadcast(phrases)
    names = [c for c in docs.columns if first or c not in ("n_words", "spans", "items")]
    schema = T.StructType([*[docs.schema[c] for c in names], *T._parse_datatype_string(_ADDED).fields])

    def run(batches):
        waiting: list[pa.RecordBatch] = []

        def texts():
            for batch in batches:
                waiting.append(batch)
                yield from batch.column(names.index("text")).to_pylist()

        got: list[tuple] = []
        for found in find_spans(texts(), held.value):
            got.append(found)
            while waiting and len(got) >= waiting[0].num_rows:
                batch = waiting.pop(0)
                own, got = got[: batch.num_rows], got[batch.num_rows :]
                spans, items = [x[1] for x in own], [x[2] for x in own]
                if not first:
                    spans = [_merge(x + y) for x, y in zip(spans, batch.column("spans").to_pylist(), strict=True)]
                    items = [x.union(y) for x, y in zip(items, batch.column("items").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in names], pa.array([x[0] for x in own], pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=[*names, "n_words", "spans", "items"],
                )

    return map_batches(docs.select(*names, *([] if first else ["spans", "items"])), run, schema)


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with n_words, spans (merged [start, end) of hit words) and items (ids as sorted strings) added."""
    out = docs.drop("n_words", "spans", "items")
    for k, block in enumerate(_blocks(benchmark)):
        out = _search(out, Phrases(block), k == 0)
    return out


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= MIN_ITEMS).alias("contaminated"))


def cut(text: str, spans: list[list[int]]) -> str:
    """text without the words of these spans and without what stands between them."""
    lowered = text.translate(_LOWER)
    at = [m.span() for m in WORD.finditer(lowered)]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return "".join([*out, text[end:]])


_LOWER = {c: c + 32 for c in range(65, 91)}


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the hit spans cut from their texts; a document of which no word is left goes.

    Columns of docs named n_words, spans or items go."""
    docs = docs.drop("n_words", "spans", "items")
    found = search(docs, benchmark)
    names = docs.columns

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [cut(t, s) if t and s else t for t, s in zip(batch.column(at).to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(c).type) if c == "text" else batch.column(c) for c in names], names=names)

    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return map_batches(found.filter((covered == 0) | (covered < F.col("n_words"))), run, docs.schema)


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) by plain search, for tests."""
    wins = []
    for item, text in items:
        words = [w.decode() for w in plain_words(text)]
        wins += [(item, words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1) if words else 0)]
    out = []
    for doc, text in docs:
        words = WORD.findall((text or "").translate(_LOWER))
        hit, found = set(), set()
        for item, w in wins:
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(item)
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), sha, len(found) >= MIN_ITEMS))
    return out


#: DuckDB, over the views documents and benchmark.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT item, ws, least(8, len(ws)) AS n FROM b WHERE len(ws) > 0),
w AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(ws[i + 1 : i + n], ' ') AS x FROM (SELECT item, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM k)),
l AS (SELECT DISTINCT n FROM w),
p AS (SELECT doc_id, n, i, array_to_string(ws[i + 1 : i + n], ' ') AS x FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM d, l WHERE len(ws) >= n)),
h AS MATERIALIZED (SELECT doc_id, i, p.n, item FROM p JOIN w ON p.n = w.n AND p.x = w.x),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
