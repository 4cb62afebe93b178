"""Document fingerprints by consistent weighted sampling.

A text's terms are its words (runs without ASCII blanks, A-Z lower-cased), weighted by their number.  For each of
SLOTS slots, every term has gamma-distributed r and c and a uniform beta, drawn from its hash; t = floor(ln w / r + beta)
and the term with the least ln c - r (t - beta + 1) is the slot's sample.  Two fingerprints agree in a slot, which keeps
16 bits of (term, t), with the probability that is the texts' generalised Jaccard similarity.

The edited text of the contract needs the next document by descending id.  Ids are cut into ranges by quantiles, texts
are compressed and shuffled once by range, and each range is read in order with one row of lookahead; the last row of a
range finds its successor in a copy of the next range's first one.

Defined cases: a null text counts as empty; an empty or blank text has a fingerprint of zeros, which is like another
one of zeros (1) and like nothing else (0); rows that share a doc_id follow each other by the hash of their text; a null
doc_id comes after all others; a single row is its own successor; repeated rows give equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexloom.llm.common import blank_words, map_batches

SLOTS = 128
#: Terms whose samples a worker remembers (82 MB); it remembers the draws of a quarter as many that are there several times (61 MB).
CACHE = 160_000
#: Terms that are compared at once; their draws fit into a core's cache.
BLOCK = 256
#: Rows of a range, about, and the most ranges.
RANGE_ROWS, MOST_RANGES = 4_000, 20_000


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalise hashes; x is changed in place where it is large."""
    x = x.copy() if x.ndim == 1 else x
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEPS = np.arange(1, 2 * SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _unit(bits: np.ndarray, shift: int, size: int) -> np.ndarray:
    """Uniform numbers strictly between 0 and 1 from `size` bits of each hash, at most 23."""
    out = ((bits >> np.uint64(shift)).astype(np.uint32) & np.uint32((1 << size) - 1)).astype(np.float32)
    out += np.float32(0.5)
    out *= np.float32(2.0**-size)
    return out


def draws(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, and r, ln c and beta for each slot, of terms."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))
    bits = _mix(h[:, None] + _STEPS)
    # two hashes a slot: twice 23 bits of each for the gammas, 18 bits of one for beta
    gamma = _unit(bits, 0, 23)
    gamma *= _unit(bits, 23, 23)
    np.negative(np.log(gamma, out=gamma), out=gamma)
    return h, gamma[:, :SLOTS], np.log(gamma[:, SLOTS:]), _unit(bits[:, :SLOTS], 46, 18)


class Draws:
    """What is drawn for a term, remembered for so many terms; where the table is full, the half that was asked for least
    makes room.  It is r, ln c and beta, or of terms that are there once only their sample ln c - r (1 - beta)."""

    def __init__(self, size: int, once: bool) -> None:
        self.size, self.once = size, once
        self.rows: dict[bytes, int] = {}
        self.free, self.asked = np.arange(size), np.zeros(size, np.int64)
        self.drawn = np.empty((size, SLOTS) if once else (size, 3, SLOTS), np.float32)
        self.held = np.empty((BLOCK, *self.drawn.shape[1:]), np.float32)
        self.name = np.empty(size, np.uint64)

    def find(self, terms: list[bytes]) -> np.ndarray:
        """Rows of at most BLOCK distinct terms."""
        at = np.fromiter(map(self.rows.get, terms, repeat(-1)), np.int64, len(terms))
        missing = np.flatnonzero(at < 0)
        if len(missing) > len(self.free):
            self._evict()
            return self.find(terms)
        if len(missing):
            new, own = [terms[i] for i in missing], self.free[: len(missing)]
            at[missing], self.free = own, self.free[len(missing) :]
            self.rows.update(zip(new, own.tolist(), strict=True))
            self.name[own], r, c, beta = draws(new)
            if self.once:
                self.drawn[own] = c - r * (1 - beta)
            else:
                self.drawn[own, 0], self.drawn[own, 1], self.drawn[own, 2] = r, c, beta
        self.asked[at] += 1
        return at

    def _evict(self) -> None:
        kept = np.zeros(self.size, bool)
        kept[np.argpartition(self.asked, self.size // 2)[self.size // 2 :]] = True
        kept[self.free] = False
        self.rows = {t: i for t, i in self.rows.items() if kept[i]}
        self.free = np.flatnonzero(~kept)
        self.asked >>= 1
        self.asked[self.free] = 0

    def take(self, at: np.ndarray) -> np.ndarray:
        """Rows in an array that is used again, as new ones of this size cost more than what is computed in them."""
        return self.drawn.take(at, 0, out=self.held[: len(at)], mode="clip")  # with "raise", it makes a copy of its own


class Sampler:
    def __init__(self) -> None:
        self.single, self.several = Draws(CACHE, True), Draws(CACHE // 4, False)
        self.t, self.slot = np.empty((BLOCK, SLOTS), np.float32), np.arange(SLOTS)

    def slots(self, counts: dict[bytes, int]) -> np.ndarray:
        """16 bits for each slot, never 0; all 0 for no terms."""
        if not counts:
            return np.zeros(SLOTS, np.uint16)
        best, name, step = np.full(SLOTS, np.inf, np.float32), np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.float32)
        once, more = [t for t, n in counts.items() if n == 1], {t: n for t, n in counts.items() if n > 1}
        number, more = np.log(np.fromiter(more.values(), np.float32, len(more))), list(more)
        for terms, table in ((once, self.single), (more, self.several)):
            for i in range(0, len(terms), BLOCK):
                part = terms[i : i + BLOCK]
                at = table.find(part)
                if terms is once:  # ln w is 0, so t is 0
                    a, t = table.take(at), None
                else:
                    r, a, beta = table.take(at).swapaxes(0, 1)
                    t = np.divide(number[i : i + BLOCK, None], r, out=self.t[: len(at)])
                    t += beta
                    np.floor(t, out=t)
                    np.subtract(t, beta, out=beta)
                    beta += 1
                    beta *= r
                    a -= beta
                row = a.argmin(axis=0)
                low = a[row, self.slot]
                better = np.flatnonzero(low < best)
                row = row[better]
                best[better], name[better] = low[better], table.name[at[row]]
                step[better] = 0 if t is None else t[row, better]
        return (_mix(name + step.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def fingerprint(self, text: str | None) -> np.ndarray:
        return self.slots(Counter(blank_words(text)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n] if n else text


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for each row, without the edited texts."""

    def run(batches):
        sampler = Sampler()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sampler.fingerprint(t).astype(">u2").tobytes().hex() for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """(part, ahead, doc_id, pack) in ranges of descending doc_id, each sorted; pack is the compressed text, and the rows
    with ahead are the copies of the first ones of the next range."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    cuts = sorted(set(ids.filter("doc_id is not null").stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    cuts = [int(c) for c in cuts]
    top = len(cuts)
    # range 0 has the greatest ids; nulls are in a last one
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def place(c: pd.Series) -> pd.Series:
        return pd.Series(top - edges.searchsorted(c.to_numpy(np.int64), "right"))

    part = lambda c: F.when(c.isNull(), F.lit(top + 1)).otherwise(place(F.coalesce(c, F.lit(0).cast("long"))))
    first = {r["part"]: r["m"] for r in ids.groupBy(part(F.col("doc_id")).alias("part")).agg(F.max("doc_id").alias("m")).collect()}
    order = sorted(first)
    before = {first[p]: order[i - 1] for i, p in enumerate(order)}  # first id of a range -> the range that looks ahead to it; order[-1] closes the ring

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = []
            for p, i, t in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                data = (t or "").encode("utf-8")
                rows.append((p, False, i, press.compress(data), hashlib.md5(data).digest()))
                if i in before:
                    rows.append((before[i], True, *rows[-1][2:]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()), strict=True)] if rows else [pa.array([], k) for k in (pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())], names=["part", "ahead", "doc_id", "pack", "hash"])

    packed = map_batches(docs.select(part(F.col("doc_id").cast("long")).cast("int").alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text"), pack, "part int, ahead boolean, doc_id long, pack binary, hash binary")
    dealt = packed.repartition(max(1, min(len(order), 4 * docs.sparkSession.sparkContext.defaultParallelism + len(order) // 8)), "part")
    return dealt.sortWithinPartitions("part", "ahead", F.col("doc_id").desc_nulls_last(), "hash")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        sampler, unpack, out = Sampler(), zstandard.ZstdDecompressor(), []
        last = None  # part, doc_id, text, fingerprint: waits for its successor
        for batch in batches:
            for part, ahead, doc, blob in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if ahead and (last is None or last[0] != part):
                    continue
                text = unpack.decompress(blob).decode("utf-8") if blob else ""
                own = sampler.fingerprint(text)
                if last is not None and last[0] == part:
                    new = edited(last[2], text)
                    changed = last[3] if new == last[2] else sampler.fingerprint(new)
                    hexed = [x.astype(">u2").tobytes().hex() for x in (last[3], changed)]
                    out.append((last[1], len(last[2]), hashlib.sha256(new.encode("utf-8")).hexdigest(), *hexed, likeness(last[3], changed), likeness(last[3], own)))
                last = None if ahead else (part, doc, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []

    return map_batches(in_order(docs), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


#: DuckDB, over the view documents: lengths and digests of the edited texts.
ORACLE_EDITED = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS x FROM d)
SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 3) || left(x, length(t) // 3)) AS edited_sha256 FROM n
"""
