"""A training-corpus pipeline over documents: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plexloom.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from plexloom.llm.common import spool, spools, sweep, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Null and empty texts are scored as the others; repeated rows and rows of
    shared or null ids are judged each by itself; columns other than those of documents go; no rows give no rows."""
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut; a document that loses all its lines goes.  Null and empty texts and
    those of fewer than three lines stay; of repeated rows with one id and text all lose the same lines."""
    return line_dedup.dedup_lines(docs.select(*COLUMNS)).filter("not emptied").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.  Rows that share an id and are
    not alike all stay, as do rows without an id; of rows without words one of each id stays."""
    return near_dedup.keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows are cut; a document of which no word is left goes.  Null and empty texts stay; an
    empty benchmark cuts nothing; each row is judged by itself."""
    return decontaminate.remove_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes; documents without words have none.  Null sources are one source; rows of a
    shared id are documents of their own."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing_stage),
]

#: Classifier, registers and index have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what a stage has spooled is deleted once the next stage's documents are written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        with spools() as made:
            docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            with spools() as own:
                docs = spool(docs)
            sweep(spark, before + made)
            before = own
    return docs
