"""Quantised vectors and semantic search with array functions; MinHash similarity in Arrow batches."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYWORDS, SEARCH_LIMIT, SLOTS = 32, 200, 64
BANDS, BAND_ROWS = 32, 2
#: Signatures of queries broadcast at once (16 MB), and rows of one Arrow batch.
QUERY_ROWS, ARROW_ROWS = 32_768, 512


def quantise(c):
    """Each component times 127, clamped and cut to a whole number."""
    return F.transform(c, lambda x: F.least(F.lit(127.0), F.greatest(F.lit(-127.0), x.cast("double") * 127)).cast("int"))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y), F.lit(0).cast("long"), lambda s, x: s + x)


def cosine(a, b):
    """Of whole-number vectors; 0 if one has no length."""
    size = F.sqrt(dot(a, a).cast("double")) * F.sqrt(dot(b, b).cast("double"))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def semantic_search(vectors: DataFrame, keywords: list[list[int]], limit: int = 16, key: str = "id", vector: str = "vector") -> DataFrame:
    """(key, score): the least cosine with the keywords' vectors, among the 5 * limit nearest to the first one.

    The keywords' vectors are one broadcast row, not literals of the plan, and their lengths are counted once."""
    if not 1 <= len(keywords) <= KEYWORDS or not 1 <= limit <= SEARCH_LIMIT:
        raise ValueError(f"from 1 to {KEYWORDS} keywords and results from 1 to {SEARCH_LIMIT}")
    words = [([int(x) for x in v], math.sqrt(sum(int(x) ** 2 for x in v))) for v in keywords]
    one = F.broadcast(vectors.sparkSession.createDataFrame([(words,)], "__k array<struct<v:array<int>,size:double>>"))
    size = lambda v: F.sqrt(dot(v, v).cast("double"))
    near = lambda k: F.when(F.col("__n") * k["size"] > 0, dot(F.col(vector), k["v"]) / (F.col("__n") * k["size"])).otherwise(0.0)
    held = vectors.crossJoin(one).withColumn("__n", size(F.col(vector)))  # one row of keywords
    first = held.withColumn("first", near(F.element_at("__k", 1))).orderBy(F.desc("first"), key).limit(5 * limit)
    score = F.array_min(F.transform("__k", near))
    return first.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(limit)


def sparse_vector(token, size: int = 768, entries: int = 8):
    """A random index vector of a token: `entries` components of 1 or -1 chosen by its hash."""
    at = F.transform(F.sequence(F.lit(0), F.lit(entries - 1)), lambda i: F.xxhash64(token, i))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.aggregate(at, F.lit(0), lambda s, h: s + F.when(F.pmod(h, F.lit(size)) == k, F.when(F.shiftright(h, 40) % 2 == 0, 1).otherwise(-1)).otherwise(0)))


def trigrams(tokens):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(tokens) - 2), lambda i: F.concat_ws(" ", F.slice(tokens, i, F.lit(3)))))


#: What a token may be normalised to; a trigram weighs as many repetitions as it has other tokens.
PLACEHOLDERS = ("I", "S", "N", "T")


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow over batches cut to ARROW_ROWS rows; the session's settings stay as they are."""

    def run(batches):
        return fn(batch.slice(at, ARROW_ROWS) for batch in batches for at in range(0, batch.num_rows, ARROW_ROWS))

    return df.mapInArrow(run, schema)


def minhash(docs: DataFrame, key: str, tokens, min_tokens: int = 30, min_unique: int = 32) -> DataFrame:
    """(key, signature): SLOTS minima over weighted token trigrams, of rows with enough tokens and distinct trigrams.

    A trigram weighs its tokens other than PLACEHOLDERS, and gives one hash a slot for each; at weight 0 it is no trigram.
    """
    held = docs.select(key, tokens.alias("t")).filter(F.size("t") >= max(3, min_tokens))
    hashed = held.select(key, F.transform("t", lambda x: F.xxhash64(x)).alias("h"), F.transform("t", lambda x: (~x.isin(*PLACEHOLDERS)).cast("tinyint")).alias("w"))
    step = np.uint64(0x9E3779B97F4A7C15)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            ends = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
            h, w = _mix(lists.flatten().to_numpy().view(np.uint64)), batch.column(2).flatten().to_numpy()
            own = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            tri, weight, row = _mix(_mix(h[:-2] + step) + h[1:-1] * np.uint64(3)) + h[2:], w[:-2] + w[1:-1] + w[2:], own[:-2]
            good = (row == own[2:]) & (weight > 0)
            tri, weight, row = tri[good], weight[good], row[good]
            at = np.lexsort((tri, row))
            at = at[np.append(True, (np.diff(row[at]) != 0) | (np.diff(tri[at]) != 0))] if len(at) else at
            n = np.bincount(row[at], minlength=len(ends))
            at = at[n[row[at]] >= min_unique]
            tri, weight, row = tri[at], weight[at], row[at]
            kept, starts = np.unique(row, return_index=True)
            out = np.empty((len(kept), SLOTS), np.int64)
            for i in range(SLOTS if len(kept) else 0):
                best = np.full(len(tri), np.iinfo(np.uint64).max, np.uint64)
                for r in range(3):
                    seed = step * np.uint64(3 * i + r + 1)
                    best = np.where(weight > r, np.minimum(best, _mix(tri ^ seed)), best)
                out[:, i] = np.minimum.reduceat(best, starts).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * SLOTS, pa.int32()), pa.array(out.ravel()))], names=[key, "signature"])

    return _batches(hashed, run, f"`{key}` {docs.schema[key].dataType.simpleString()}, signature array<long>")


def signature_similarity(a, b):
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / float(SLOTS)


def similarity_search(signatures: DataFrame, key: str, origin, threshold: float = 0.95, limit: int = 10) -> DataFrame:
    """(key, similarity) of the rows most like the one whose key is origin."""
    one = signatures.filter(F.col(key) == origin).limit(1).select(F.col("signature").alias("__o"))
    both = signatures.filter(F.col(key) != origin).crossJoin(F.broadcast(one)).withColumn("similarity", signature_similarity(F.col("signature"), F.col("__o")))
    return both.filter(F.col("similarity") >= threshold).select(key, "similarity").orderBy(F.desc("similarity"), key).limit(limit)


def similar_pairs(queries: DataFrame, signatures: DataFrame, key: str, threshold: float = 0.95) -> DataFrame:
    """(query, key, similarity): for each row of queries (key, signature), all other rows at least that alike.

    At most SLOTS less the slots wanted differ, so of one band more than that at least one is equal: candidates are the
    rows that share a band, and no pair is missed.  Queries are broadcast in blocks of QUERY_ROWS; each passes over all rows.
    """
    wanted = max(1, math.ceil(threshold * SLOTS - 1e-9))
    bands = np.array_split(np.arange(SLOTS), SLOTS - wanted + 1)
    kind = signatures.schema[key].dataType.simpleString()
    schema = f"query {kind}, `{key}` {kind}, similarity double"

    def search(block) -> DataFrame:
        ids, sig = [r[0] for r in block], np.stack([r[1] for r in block])
        held = signatures.sparkSession.sparkContext.broadcast((ids, sig))

        def run(batches):
            ids, sig = held.value
            tables = []
            for b in bands:
                k = _band(sig, b)
                order = np.argsort(k, kind="stable")
                tables.append((b, order, k[order]))
            for batch in batches:
                own = batch.column(1).flatten().to_numpy().reshape(-1, SLOTS)
                pairs = []
                for b, order, sorted_keys in tables:
                    k = _band(own, b)
                    lo, hi = np.searchsorted(sorted_keys, k), np.searchsorted(sorted_keys, k, "right")
                    n = hi - lo
                    mine = np.repeat(np.arange(len(k)), n)
                    pairs.append(mine * len(ids) + order[np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(lo, n)])
                pairs = np.unique(np.concatenate(pairs))
                for part in np.array_split(pairs, len(pairs) // 50_000 + 1):
                    mine, his = np.divmod(part, len(ids))
                    same = (own[mine] == sig[his]).sum(1)
                    good = same >= wanted
                    keys = batch.column(0).take(pa.array(mine[good]))
                    query = pa.array([ids[i] for i in his[good]], keys.type)
                    rows = pa.RecordBatch.from_arrays([query, keys, pa.array(same[good] / SLOTS)], names=["query", key, "similarity"])
                    yield rows.filter(pc.not_equal(query, keys))

        return _batches(signatures.select(key, "signature"), run, schema)

    out, block = None, []
    for row in itertools.chain(queries.select(key, "signature").toLocalIterator(), [None]):
        if row is not None:
            block.append((row[0], np.array(row[1], np.int64)))
        if block and (row is None or len(block) == QUERY_ROWS):
            found = search(block)
            out, block = found if out is None else out.unionByName(found), []
    return signatures.sparkSession.createDataFrame([], schema) if out is None else out


def _band(sig: np.ndarray, columns: np.ndarray) -> np.ndarray:
    k = np.zeros(len(sig), np.uint64)
    for c in columns:
        k = _mix(k + sig[:, c].view(np.uint64))
    return k


def band_keys(signature):
    """LSH keys: one for each band of rows."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice(signature, b * BAND_ROWS + 1, F.lit(BAND_ROWS))))


# -- codecs of signatures, vectors and profiles
def signature_hex(signature):
    """A signature as text: eight hexadecimal digits for each slot, which keeps the low 32 bits."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def signature_of_hex(text):
    """Back to the low 32 bits of each slot; null for a text that isn't SLOTS times eight digits."""
    at = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.conv(F.substr(text, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return F.when(text.rlike(f"^[0-9a-fA-F]{{{8 * SLOTS}}}$"), at)


def normalised(c):
    """A vector of length 1; one of (nearly) no length stays."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm < EPSILON, c).otherwise(F.transform(c, lambda x: x / norm))


def float_cosine(a, b):
    """0 for vectors of different sizes, or if one has (nearly) no length."""
    sum_ = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(sum_(a, a)) * F.sqrt(sum_(b, b))
    return F.when((F.size(a) != F.size(b)) | (size < EPSILON), 0.0).otherwise(sum_(a, b) / size)


def add_scaled(a, b, scale: float):
    return F.zip_with(a, b, lambda x, y: x + y * scale)


def diffuse(vectors: DataFrame, edges: DataFrame, alpha: float, key: str = "id", vector: str = "vector") -> DataFrame:
    """vectors with a share alpha of each replaced by the mean of its neighbours' over edges (key, other), scaled to length
    1; those without neighbours stay."""
    v = vectors.select(F.col(key).alias("other"), F.posexplode(vector).alias("at", "x"))
    mean = edges.select(key, "other").join(v, "other").groupBy(key, "at").agg(F.avg("x").alias("x")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("m"))
    out = vectors.join(mean, key, "left")
    mixed = F.zip_with(vector, F.transform("m", lambda p: p["x"]), lambda x, m: x * (1 - alpha) + m * alpha)
    return out.withColumn(vector, F.when(F.col("m").isNull(), F.col(vector)).otherwise(normalised(mixed))).drop("m")


EPSILON = 1e-8
#: Dimensions that are rotated, and levels of the scalar codes.
ROTATED, LEVELS = 1024, 15


def rotation(size: int, seed: int = 2024) -> np.ndarray:
    """Signs of the rotation's diagonal, by a hash of the place."""
    return np.where(_mix(np.arange(size, dtype=np.uint64) + np.uint64(seed)) & np.uint64(1), 1.0, -1.0)


def rotate(vectors: np.ndarray) -> np.ndarray:
    """Rows with random signs, then a fast Walsh-Hadamard transform, scaled so that inner products stay."""
    out = np.zeros((len(vectors), ROTATED))
    out[:, : vectors.shape[1]] = vectors * rotation(vectors.shape[1])
    step = 1
    while step < ROTATED:
        parts = out.reshape(len(out), -1, 2, step)
        out = np.concatenate([parts[:, :, :1] + parts[:, :, 1:], parts[:, :, :1] - parts[:, :, 1:]], 2).reshape(len(out), ROTATED)
        step *= 2
    return out / math.sqrt(ROTATED)


def encode_rotated(vectors: DataFrame, key: str = "id", vector: str = "vector") -> DataFrame:
    """(key, codes, scale, low, total): rotated vectors of at most ROTATED dimensions as 4-bit codes, two in a byte."""

    def run(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            grid = np.zeros((len(rows), max(map(len, rows), default=1)))
            for i, r in enumerate(rows):
                grid[i, : len(r)] = r
            turned = rotate(grid)
            low, high = turned.min(1), turned.max(1)
            scale = np.where(high > low, (high - low) / LEVELS, 1.0)
            codes = np.clip(((turned - low[:, None]) / scale[:, None] + 0.5).astype(np.int64), 0, LEVELS)
            packed = (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(scale), pa.array(low), pa.array(codes.sum(1))], names=[key, "codes", "scale", "low", "total"])

    return _batches(vectors.select(key, vector), run, f"`{key}` {vectors.schema[key].dataType.simpleString()}, codes binary, scale double, low double, total long")


def _code_products(a: pd.Series, b: pd.Series) -> pd.Series:
    rows = lambda s: np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1).astype(np.int64)
    x, y = rows(a), rows(b)
    return pd.Series(((x & 15) * (y & 15) + (x >> 4) * (y >> 4)).sum(1).astype(float)) if len(a) else pd.Series([], dtype=float)


def inner_product(a: str, b: str):
    """The estimated inner product of two structs of encode_rotated()."""
    f = lambda s, c: F.col(f"{s}.{c}")
    return f(a, "low") * f(b, "low") * ROTATED + f(a, "low") * f(b, "scale") * f(b, "total") + f(b, "low") * f(a, "scale") * f(a, "total") + f(a, "scale") * f(b, "scale") * F.pandas_udf(_code_products, "double")(f(a, "codes"), f(b, "codes"))


# What a profile of a function's syntax counts, and the number by which each is scaled.
PROFILE = {
    "if_count": 100, "for_count": 100, "while_count": 100, "switch_count": 100, "try_count": 100, "return_count": 100, "max_nesting_depth": 20, "avg_nesting_depth_x10": 200, "comparison_ops": 100,
    "arithmetic_ops": 100, "logical_ops": 100, "assignment_count": 100, "string_literals": 100, "number_literals": 100, "bool_literals": 100, "param_count": 20, "params_in_returns": 100,
    "params_in_conditions": 100, "variable_reassigns": 100, "unique_operators": 200, "unique_operands": 200, "total_operators": 200, "total_operands": 200, "body_lines": 2000, "body_tokens": 2000,
}
PROFILE_TEXT = 200


def profile_text(c):
    """A profile (array of counts in PROFILE's order) as text, its numbers joined by commas."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def profile_of_text(text):
    """Counts of a text of profile_text(), null unless it has as many numbers from 0 to 65535 as PROFILE."""
    parts = F.transform(F.split(text, ","), lambda x: F.when(x.rlike(r"^\d{1,5}$"), x.cast("int")))
    good = (F.length(text) <= PROFILE_TEXT) & (F.size(parts) == len(PROFILE)) & F.forall(parts, lambda x: F.coalesce(x.between(0, 65535), F.lit(False)))
    return F.when(good, parts)


def profile_vector(c):
    scale = F.array(*[F.lit(float(v)) for v in PROFILE.values()])
    return F.zip_with(c, scale, lambda x, s: x / s)


# -- semantic index
def token_vectors(spark, path: str) -> DataFrame:
    """(token, vector) of a stored table of token vectors, in whole numbers; tokens without one get sparse_vector()."""
    return spark.read.parquet(path).select("token", F.col("vector").cast("array<int>").alias("vector"))


def token_vector(token, stored=None):
    """A token's vector of length 1: the stored one (whole numbers, 127 for 1), else its sparse random one."""
    sparse = F.transform(sparse_vector(token), lambda x: x.cast("double"))
    own = sparse if stored is None else F.coalesce(F.transform(stored, lambda x: x / 127.0), sparse)
    return normalised(own)


def node_vectors(weights: DataFrame, key: str, stored: DataFrame | None = None) -> DataFrame:
    """(key, vector) of nodes by the weights (key, token, weight) of their tokens: the sum of the tokens' vectors, scaled
    to length 1 and quantised.  Each distinct token's vector is made once; sums are combined before the shuffle."""
    tokens = weights.select("token").distinct()
    if stored is not None:
        tokens = tokens.join(stored.withColumnRenamed("vector", "stored"), "token", "left")
    made = tokens.select("token", token_vector(F.col("token"), F.col("stored") if stored is not None else None).alias("v"))
    parts = weights.join(made, "token").select(key, "weight", F.posexplode("v").alias("at", "x")).filter("x <> 0")
    summed = parts.groupBy(key, "at").agg(F.sum(F.col("x") * F.col("weight")).alias("x"))
    packed = summed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return packed.select(key, quantise(normalised(whole)).alias("vector"))


DIMENSIONS = 768
# Labels that a semantic search gives, and how many nodes an index holds at most.
SEMANTIC_LABELS, INDEXED = ["Function", "Method", "Class"], 512


def indexed_nodes(nodes: DataFrame, structural: list[str], most: int = INDEXED) -> DataFrame:
    """The first nodes by qualified name that are no structure: the ones that an index is built for."""
    return nodes.filter(~F.col("label").isin(structural)).orderBy("qualified_name", "id").limit(most)


def with_nodes(records: DataFrame, nodes: DataFrame, labels: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Records of an index (id, ...) joined with their nodes, of these labels if any are given; if strict, a record of an
    absent node is an error."""
    if strict:
        missing = records.join(nodes.select("id"), "id", "left_anti").select("id").limit(5).collect()
        if missing:
            raise LookupError(f"records without a node: {[r[0] for r in missing]}")
    own = nodes if labels is None else nodes.filter(F.col("label").isin(labels))
    return records.join(own.select("id", "name", "qualified_name", "label"), "id")
