"""Near-duplicate detection with SetSketch registers.

A document's set is its distinct 5-word shingles.  A register is the truncated, exponentially spaced minimum of the
set's exponential hashes (base 1.001, rate 20, 16 bits), so registers of parts merge by maximum and two sets agree in
one with a probability close to their Jaccard similarity.  Documents with equal sets are one class.  Classes that agree
in a band of registers are candidates; their similarity is estimated by joint likelihood from how many registers are
greater, smaller and equal, far ones go, and the rest are confirmed on their full sets.

A band's bucket never gives all its pairs.  Each of STARS rounds pairs a bucket's members with one centre only, the one
that is in the fullest buckets, and confirmed links merge classes into components; the centre, held against all others,
leaves its bucket, and the next round takes only buckets that still hold several components.  At last, in these, each
member outside the bucket's main component is held against the others on full sets, in blocks of bounded size, and only
links that merge components come out; so no candidate is lost.  At similarity 0.75 a pair shares no band with probability 5e-6; the estimate's margin is over four standard
deviations.

Defined cases: a null or blank text has the empty set and is linked with nothing; fewer than five words are one
shingle; rows that share a doc_id are classes of their own but of the same id; a null doc_id is linked with nothing and
has a null component.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexloom.llm.common import hot_keys, map_batches, salted_join, spool

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE, RATE, LIMIT = 1.001, 20.0, 2**16 - 2
#: Candidates estimated below this go.
ESTIMATE = 0.55
STARS = 2
#: Members and shingles of a block in which full sets are compared.
BLOCK_ROWS, BLOCK_SHINGLES = 3_000, 1_500_000
#: Bytes of text that are hashed at once; a longer word makes its block longer.
BLOCK_BYTES = 1_000_000

_rng = np.random.default_rng(90125)
_MULTIPLY = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a worker remembers, and the longest of them in bytes.
CACHE, LONG_WORD = 300_000, 64
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """word -> xxh3, 64 bits; words() gives those of the words [^\\x20\\x09-\\x0D]+ of a text in UTF-8, in order."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE:
                self.clear()
            self[word] = h
        return h

    def words(self, text: str | None) -> np.ndarray:
        raw, at, out = text.encode("utf-8", "replace").lower() if text else b"", 0, []
        while at < len(raw):
            cut = _BLANK.search(raw, at + BLOCK_BYTES)
            to = cut.start() if cut else len(raw)
            block = raw[at:to].split()
            out.append(np.fromiter(map(self.__getitem__, block), np.uint64, len(block)))
            at = to
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    h = hashes.words(text)
    if not len(h):
        return h
    span = min(SHINGLE, len(h))
    out = np.full(len(h) - span + 1, np.uint64(span))
    for k in range(span):
        out *= _PRIME
        out += h[k : len(h) - span + 1 + k]
    out = np.sort(_mix(out))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def minima(own: np.ndarray) -> np.ndarray:
    """The least hash of a set, not empty, under each register's permutation."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 512):
        np.minimum(least, (own[i : i + 512, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """Registers from minima, of one set or of many in rows."""
    x = -np.log1p(-((least >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def bands(regs: np.ndarray) -> np.ndarray:
    """Keys of the bands, of registers of many sets in rows."""
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(regs), 1))
    for k in range(ROWS):
        key = _mix(key * _PRIME + regs.reshape(-1, BANDS, ROWS)[:, :, k].astype(np.uint64))
    return key.view(np.int64)


def _vertex(own: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _names(sets: list[np.ndarray]) -> list[pa.Array]:
    """Both halves of the sets' names."""
    halves = np.frombuffer(b"".join(map(_vertex, sets)), np.int64).reshape(-1, 2)
    return [pa.array(halves[:, 0]), pa.array(halves[:, 1])]


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, n, regs, bands): h1 and h2 name the set, n is its size."""

    def run(batches):
        hashes = WordHash()
        for batch in batches:
            sets = [shingle_set(t, hashes) for t in batch.column(1).to_pylist()]
            regs = registers(np.array([minima(s) for s in sets], np.uint64).reshape(-1, REGISTERS))
            keys, full = bands(regs), np.array([len(s) > 0 for s in sets], bool)
            offsets = pa.array(np.concatenate(([0], np.cumsum(full * BANDS))), pa.int32(), mask=np.concatenate((~full, [False])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *_names(sets), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([r.tobytes() if f else None for r, f in zip(regs, full, strict=True)], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys[full].ravel(), pa.int64())),
                ],
                names=["doc_id", "h1", "h2", "n", "regs", "bands"],
            )

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, h1 long, h2 long, n long, regs binary, bands array<long>")


def classes(own: DataFrame) -> DataFrame:
    """(vid, h1, h2, doc, n, regs, bands): one row for each set; vid is h1, or of sets that share h1 another number for
    all but the first."""
    found = spool(own.filter("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands")))
    twins = spool(found.groupBy("h1").agg(F.count("*").alias("c")).filter("c > 1").select("h1"))
    if not twins.limit(1).count():
        return found.withColumn("vid", F.col("h1"))
    rank = F.row_number().over(Window.partitionBy("h1").orderBy("h2"))
    several = found.join(twins, "h1", "left_semi").withColumn("r", rank).withColumn("vid", F.when(F.col("r") == 1, F.col("h1")).otherwise(F.xxhash64("h1", "h2", "r"))).drop("r")
    return spool(found.join(twins, "h1", "left_anti").withColumn("vid", F.col("h1")).unionByName(several))


_GRID = np.linspace(0.0, 1.0, 101)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity by joint likelihood, for rows of registers of sets of known sizes."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    grid = np.minimum(_GRID[None, :], np.minimum(u, v) / np.maximum(u, v))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    p_more, p_less = np.clip(p(u - v * grid), 1e-12, 1), np.clip(p(v - u * grid), 1e-12, 1)
    equal = np.clip(1 - p_more - p_less, 1e-12, 1)
    like = more * np.log(p_more) + less * np.log(p_less) + (a.shape[1] - more - less) * np.log(equal)
    return grid[np.arange(len(grid)), like.argmax(axis=1)]


def _likely(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    if not len(ra):
        return pd.Series([], dtype=float)
    rows = lambda s: np.frombuffer(b"".join(s), np.uint16).reshape(len(s), REGISTERS)
    return pd.Series(estimate(rows(ra), rows(rb), na.to_numpy(float), nb.to_numpy(float)))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(vid, own): the shingle hashes of the classes in wanted (vid, h1, h2, doc)."""
    want = wanted.select("vid", "h1", "h2", F.col("doc").alias("__doc"))
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(want, F.col("__id") == F.col("__doc")).select("vid", "h1", "h2", "text")

    def run(batches):
        hashes = WordHash()
        for batch in batches:
            sets = [shingle_set(t, hashes) for t in batch.column(3).to_pylist()]
            halves = [x.to_numpy() for x in _names(sets)]
            at = np.flatnonzero((halves[0] == batch.column(1).to_numpy()) & (halves[1] == batch.column(2).to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([sets[i].view(np.int64) for i in at], pa.list_(pa.int64()))], names=["vid", "own"])

    return map_batches(texts, run, "vid long, own array<long>").dropDuplicates(["vid"])


def confirm(pairs: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of the pairs (c, v) of centre and member whose full sets are similar enough.

    A member has few centres, so it is joined by itself; a centre of very many members is copied, and they are dealt by
    salt, so its set is never repeated in a shuffle for each of them.
    """
    hot = hot_keys(pairs.groupBy("c").agg(F.count("*").alias("n")), "c", pairs.count(), count="n")
    side = lambda df, x, cols: df.select(F.col("vid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])
    near = salted_join(pairs.join(side(reps, "v", ["n", "regs"]), "v"), side(reps, "c", ["n", "regs"]), "c", hot, "v")
    near = near.filter(F.least("n_c", "n_v") * 100 >= F.greatest("n_c", "n_v") * PERCENT)
    near = near.withColumn("likely", F.pandas_udf(_likely, "double")("regs_c", "regs_v", "n_c", "n_v")).filter(F.col("likely") >= ESTIMATE).select("c", "v", "n_c", "n_v")
    both = salted_join(near.join(side(sets, "v", ["own"]), "v"), side(sets, "c", ["own"]), "c", hot, "v")
    shared = F.size(F.array_intersect("own_c", "own_v"))
    return both.filter(shared * 100 >= (F.col("n_c") + F.col("n_v") - shared) * PERCENT).select(F.least("c", "v").alias("a"), F.greatest("c", "v").alias("b")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether no vertex has two edges (a, b) as a, or is a of one and b of another."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("low")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("low")))
    tangled = ends.groupBy("v").agg(F.sum("low").alias("n"), F.min("low").alias("least")).filter("n > least")
    return not tangled.limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(vid, root) of every vertex with an edge (a, b): root is the smallest vertex reachable.

    Alternating large-star and small-star steps until a large-star step leaves stars only; edges stay as many as
    vertices, and none is collected.  The edges of a vertex of very many are dealt by salt.
    """
    now = spool(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())

    def least(df: DataFrame) -> tuple[DataFrame, list]:
        per = df.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
        return per.select("a", "m"), hot_keys(per, "a", df.count(), 10_000)

    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        per, hot = least(both)
        large = salted_join(both, per.select("a", F.least("a", "m").alias("m")), "a", hot, "b").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = spool(large)
        if _stars(large):
            break
        per, hot = least(large)
        small = salted_join(large, per, "a", hot, "b").select(F.col("b").alias("x"), "a", "m")
        small = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        now = spool(small)
    roots = large.select(F.col("a").alias("vid"), F.col("b").alias("root"))
    return spool(roots.unionByName(roots.select(F.col("root").alias("vid"), "root")).distinct())


def _join_components(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """components() of former ones, if there are any, and new links; these are first moved to the roots."""
    if roots is None:
        return components(links)
    name = lambda x: roots.select(F.col("vid").alias(x), F.col("root").alias(f"root_{x}"))
    moved = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    return components(moved.unionByName(roots.select(F.col("vid").alias("a"), F.col("root").alias("b"))))


def _open_buckets(member: DataFrame, roots: DataFrame | None, hot: list) -> DataFrame:
    """Members (key, vid, w, root, core) of the buckets of several components; core is the bucket's main one's root."""
    left = member.withColumn("root", F.col("vid"))
    if roots is not None:
        left = member.join(roots, "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    left = spool(left)
    per = left.groupBy("key", "root").agg(F.count("*").alias("c"))
    mixed = per.groupBy("key").agg(F.count("*").alias("k"), F.max_by("root", F.struct("c", "root")).alias("core")).filter("k > 1")
    return spool(salted_join(left, mixed.select("key", "core"), "key", hot, "vid"))


def _compare_blocks(left: DataFrame, reps: DataFrame, sets: DataFrame, hot: list) -> DataFrame:
    """Links (a, b) between the members outside their bucket's main component and all its other members.

    A bucket is one block unless it has too many members or shingles; then the blocks of both sides are paired.
    """
    rows = left.join(reps.select("vid", "n"), "vid").withColumn("odd", F.col("root") != F.col("core"))
    parts = lambda c: F.ceil(F.greatest(F.count(c) / BLOCK_ROWS, F.sum(F.when(c.isNotNull(), F.col("n"))) / BLOCK_SHINGLES)).cast("int")
    sizes = spool(rows.groupBy("key").agg(parts(F.lit(1)).alias("nr"), parts(F.when(F.col("odd"), 1)).alias("nl")))
    rows = salted_join(rows, sizes, "key", hot, "vid").select("key", "vid", "root", "odd", "nl", "nr")
    every = F.lit(0), F.col("nl") - 1
    right = rows.withColumn("rb", F.pmod(F.xxhash64("vid"), F.col("nr")).cast("int")).withColumn("lb", F.explode(F.sequence(*every))).withColumn("odd", F.lit(False))
    odd = rows.filter("odd").withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("nr") - 1))).withColumn("lb", F.pmod(F.xxhash64("vid"), F.col("nl")).cast("int"))
    cols = ["key", "lb", "rb", "vid", "root", "odd"]
    placed = odd.select(*cols).unionByName(right.select(*cols)).groupBy("key", "lb", "rb", "vid").agg(F.first("root").alias("root"), F.max("odd").alias("odd"), F.min("odd").alias("only_odd"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        roots, vids, n = pdf["root"].to_numpy(), pdf["vid"].to_numpy(), np.array([len(x) for x in pdf["own"]])
        odd_at, right_at = np.flatnonzero(pdf["odd"].to_numpy()), np.flatnonzero(~pdf["only_odd"].to_numpy())
        out: list[tuple[int, int]] = []
        if len(odd_at) and len(right_at):
            _, term = np.unique(np.concatenate(list(pdf["own"])), return_inverse=True)
            own = np.repeat(np.arange(len(pdf)), n)
            common = np.bincount(term) > 1
            term, own = (np.cumsum(common) - 1)[term[keep := common[term]]], own[keep]
            shared = np.zeros((len(odd_at), len(right_at)), np.float32)
            width = max(1, min(int(common.sum()), max(256, 8_000_000 // len(pdf))))
            for t in range(0, int(common.sum()), width):
                grid = np.zeros((len(pdf), width), np.float32)
                here = (term >= t) & (term < t + width)
                grid[own[here], term[here] - t] = 1
                shared += grid[odd_at] @ grid[right_at].T
            whole = n[odd_at][:, None] + n[right_at][None, :] - shared
            linked = (shared * 100 >= whole * PERCENT) & (roots[odd_at][:, None] != roots[right_at][None, :])
            name = dict.fromkeys(roots.tolist())
            name = {r: r for r in name}

            def top(r):
                while name[r] != r:
                    name[r] = r = name[name[r]]
                return r

            lefts, right_of = np.nonzero(linked)
            names, code = np.unique(roots, return_inverse=True)
            _, once = np.unique(code[odd_at[lefts]] * len(names) + code[right_at[right_of]], return_index=True)
            for i, j in zip(odd_at[lefts[once]].tolist(), right_at[right_of[once]].tolist(), strict=True):
                a, b = top(int(roots[i])), top(int(roots[j]))
                if a != b:
                    name[a] = b
                    out.append((int(vids[i]), int(vids[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return placed.join(sets, "vid").groupBy("key", "lb", "rb").applyInPandas(compare, "a long, b long").distinct()


def _placed(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, n, component_id, root), one row for each row of docs; root names the component, null for empty
    sets."""
    own = spool(sketches(docs))
    reps = classes(own)
    member = reps.select("vid", F.explode("bands").alias("key"))
    shared = spool(member.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"))
    total = shared.agg(F.sum("c")).first()[0] or 0
    hot = hot_keys(shared, "key", total)
    member = spool(salted_join(member, shared, "key", hot, "vid"))
    weight = spool(member.groupBy("vid").agg(F.sum("c").alias("w")))
    wanted = reps.join(weight, "vid", "left_semi").select("vid", "h1", "h2", "doc")
    sets = spool(full_sets(docs, wanted))
    member = spool(member.join(weight, "vid").select("key", "vid", "w"))
    roots, left = None, member.withColumn("root", F.col("vid"))  # at first every bucket holds several components
    for star in range(STARS + 1):
        if star < STARS:
            centre = left.filter("root <> core") if star else left
            centre = spool(centre.groupBy("key").agg(F.max_by(F.struct("vid", "root"), F.struct("w", "vid")).alias("m")))
            left = salted_join(left, centre, "key", hot, "vid")
            pairs = left.filter("root <> m.root").select(F.col("m.vid").alias("c"), F.col("vid").alias("v")).distinct()
            found = spool(confirm(spool(pairs), reps, sets))
            member = left.filter("vid <> m.vid").select("key", "vid", "w")
        else:
            found = spool(_compare_blocks(left, reps, sets, hot))
        if found.limit(1).count():
            roots = _join_components(roots, found)
        if star < STARS:
            left = _open_buckets(member, roots, hot)
            if not left.limit(1).count():
                break
    known = reps.select("vid", "h1", "h2", "doc")
    if roots is None:
        named = known.select("h1", "h2", F.col("doc").alias("component_id"), F.col("vid").alias("root"))
    else:
        first = spool(roots.join(known, "vid").groupBy("root").agg(F.min("doc").alias("first"), F.count("*").alias("c")))
        linked = salted_join(roots, first.select("root", "first"), "root", hot_keys(first, "root", first.agg(F.sum("c")).first()[0] or 0), "vid")
        named = known.join(linked, "vid", "left").select("h1", "h2", F.coalesce("first", "doc").alias("component_id"), F.coalesce("root", "vid").alias("root"))
    named = spool(named)
    # both sides are shuffled by the set's name alone, so adaptive execution splits a class of very many copies
    cols = ["doc_id", "h1", "h2", "n", "component_id", "root"]
    empty = own.filter("n = 0").select("doc_id", "h1", "h2", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    out = own.filter("n > 0").select("doc_id", "h1", "h2", "n").join(named, ["h1", "h2"], "left").select(*cols).unionByName(empty)
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs."""
    return _placed(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates: of its smallest doc_id, and of several such rows the one of
    the smallest set name, then the smallest text and other columns.  Rows without a doc_id all stay; of rows without words
    one of each doc_id stays.  Where ids are shared, rows are told apart by their sets, which are made anew."""
    placed = spool(_placed(docs).filter("doc_id is not null").select("doc_id", "h1", "h2", "component_id", "root"))
    kept = spool(
        placed.filter("doc_id = component_id").groupBy("doc_id", "root").agg(F.min(F.struct("h1", "h2")).alias("k"))
        .select(F.col("doc_id").alias("__id"), F.col("k.h1").alias("__h1"), F.col("k.h2").alias("__h2")).distinct()
    )
    shared = spool(placed.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("c")).filter("c > 1").select("__id"))
    none = docs.filter(F.col("doc_id").isNull())
    if not shared.limit(1).count():
        return docs.join(kept, F.col("doc_id") == F.col("__id"), "left_semi").unionByName(none)
    single = docs.join(kept.join(shared, "__id", "left_anti"), F.col("doc_id") == F.col("__id"), "left_semi")
    names = docs.columns

    def run(batches):
        hashes = WordHash()
        for batch in batches:
            sets = [shingle_set(t, hashes) for t in batch.column(names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *_names(sets)], names=[*names, "__own1", "__own2"])

    several = docs.join(kept.join(shared, "__id", "left_semi"), F.col("doc_id") == F.col("__id"), "left_semi")
    several = map_batches(several, run, T.StructType([*docs.schema.fields, T.StructField("__own1", T.LongType()), T.StructField("__own2", T.LongType())]))
    several = several.join(kept, (F.col("doc_id") == F.col("__id")) & (F.col("__own1") == F.col("__h1")) & (F.col("__own2") == F.col("__h2")), "left_semi")
    order = Window.partitionBy("doc_id", "__own1", "__own2").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    several = several.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r", "__own1", "__own2")
    return single.unionByName(several).unionByName(none)


#: DuckDB, over the view documents: all pairs that share a shingle, then the closure of their links.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.d AND r.c < p.b),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT s.doc_id, CAST(coalesce(len(sh), 0) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept FROM s JOIN m ON s.doc_id = m.d
"""
