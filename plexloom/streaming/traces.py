"""Runtime traces as a stream: calls are summed by caller and callee, additively over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plexloom.operators.enrich import runtime_traces


def add_batch(spark, batch: DataFrame, batch_id: int, path: str) -> None:
    """Write a batch's sums in a folder of its own; a batch that is run again replaces only its own folder."""
    runtime_traces(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def stored(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("caller", "callee").agg(F.sum("count").alias("count"))


def ingest(calls: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start ingesting a streaming DataFrame (caller, callee, count); what is available is taken, then it ends."""
    spark = calls.sparkSession
    return calls.writeStream.foreachBatch(lambda df, i: add_batch(spark, df, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events per type and window of event time (ts, event_type), for streams: late rows are taken up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
