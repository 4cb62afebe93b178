"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker turns into objects at once; Spark bounds the bytes of the batches they are cut from
#: (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB).
ARROW_ROWS = 512
#: Rows of a side that may be broadcast; a larger side is joined by a salted shuffle.
BROADCAST_ROWS = 50_000
#: Salts of that join.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one given to setCheckpointDir; where neither is set, a temporary one in
    local mode (tests), and an error on a cluster, whose machines don't share such a folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="plexloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_made: ContextVar[list[str] | None] = ContextVar("spooled tables of the current scope", default=None)


@contextmanager
def spools():
    """Collects the paths of the tables spooled inside, so that sweep() can delete them."""
    token = _made.set(paths := [])
    try:
        yield paths
    finally:
        _made.reset(token)


def spool(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    Cuts lineage, survives the loss of executors, and is compressed and column-pruned, unlike checkpoint().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plexloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (paths := _made.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, paths: list[str]) -> None:
    """Delete spooled tables; call it once what was made from them is written."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of at most ARROW_ROWS rows; the session's settings stay as they are."""

    def run(batches):
        return fn(batch.slice(at, ARROW_ROWS) for batch in batches for at in range(0, batch.num_rows, ARROW_ROWS))

    return df.mapInArrow(run, schema)


def bounded_join(big: DataFrame, small: DataFrame, on: list[str], salt: str, how: str = "left") -> DataFrame:
    """Join big with small, unique in `on`, whatever the skew of the keys in big.

    small is counted (it should be spooled) and broadcast up to BROADCAST_ROWS rows; beyond that the join is shuffled
    by key and by a salt drawn from column `salt`, so no key stays in one task.  Null keys match null keys.
    """
    n = small.count()
    right = small.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], *[c for c in small.columns if c not in on])
    cond = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(on)]
    if n <= BROADCAST_ROWS:
        right = F.broadcast(right)
    else:
        big = big.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
        right = right.withColumn("__salt2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        cond.append(F.col("__salt") == F.col("__salt2"))
    return big.join(right, cond, how).drop("__salt", "__salt2", *[f"__k{i}" for i in range(len(on))])


#: A key with this share of all rows, or more, is hot; there are at most 1 / HOT of them.
HOT = 1 / 2000


def hot_keys(counts: DataFrame, key: str, total: int, least: int = 1000, count: str = "c") -> list:
    """The hot keys of counts (key, count), of which count adds up to total at most: no more than 1 / HOT of them."""
    bound = max(least, total * HOT)
    return [r[0] for r in counts.filter(F.col(count) >= bound).select(key).collect()] if total >= least else []


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: list, salt: str, how: str = "inner") -> DataFrame:
    """Join big with small, unique in key, on key; big's rows of hot_keys() are dealt over all tasks by column salt, and
    small's rows of them are copied, so that no key stays in one task."""
    if not hot:
        return big.join(small, key, how)
    salts = min(4096, max(32, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    is_hot, zero = F.col(key).isin(hot), F.lit(0).cast("long")
    left = big.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(salt), F.lit(salts))).otherwise(zero))
    right = small.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(zero, F.lit(salts - 1).cast("long"))).otherwise(F.array(zero))))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def held_out(doc_id) -> F.Column:
    """Rows that no classifier learns from: crc32 of the id as text is divisible by five."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, label) of at most `bound` labelled rows that are not held out, chosen by a hash of their id.

    The chosen ids, at most `bound`, are broadcast, so documents are neither shuffled nor collected.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__y"))
        .orderBy(F.md5(F.col("__id").cast("string")), "__y")
        .limit(bound)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__y")


#: bytes.translate tables: A-Z lower-cased; the second also turns ASCII outside 0-9 and a-z into blanks.
_WORD = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z is lower-cased, in UTF-8; none for a null."""
    return text.encode("utf-8", "replace").translate(_WORD).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after A-Z is lower-cased, in UTF-8; none for a null."""
    return text.encode("utf-8", "replace").lower().split() if text else []
