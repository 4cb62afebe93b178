"""The corpus operators' queries over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexloom.llm import chat_format, decontaminate, fingerprint, license_scan, line_dedup, mixing, near_dedup, quality, toxicity, url_filter
from plexloom.llm.common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), toxicity.THRESHOLD)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, '{said}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat_format.read_back(chat_format.format_trees(chat_format.chain(rows, "conv_id", "turn")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, sf_dir, "documents")).drop("detections")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), quality.THRESHOLD)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that the fixed rules settle."""
    return url_filter.judge_by_rules(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.RULES).drop("url")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that the base phrases settle."""
    return op6_license_scans(spark, sf_dir).drop("labels", "score")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that don't depend on draws."""
    return op10_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filters, op2_toxicity, op3_chat_formatting, op4_line_dedup, op5_decontamination, op6_license_scans, op7_quality, op8_mixing, op9_near_dedup, op10_fingerprints, url_rules, license_base, edited_texts)
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_formatting": chat_format.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op9_near_dedup": near_dedup.ORACLE,
    "url_rules": url_filter.ORACLE_RULES,
    "license_base": license_scan.ORACLE_BASE,
    "edited_texts": fingerprint.ORACLE_EDITED,
}
