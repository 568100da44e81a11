"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage works on all that its predecessor kept; its output is written as Parquet in the
shared scratch folder and read again.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm import decontam, line_dedup, ngram_join, packing, quality
from commitlens.llm.common import materialise, strip_white, table, text_or_empty

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE_WORDS, SIMILARITY_PCT = 5, 80


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``; ``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above their host's limit go from the others."""
    return _documents(quality.quality_rules(docs.select(*COLUMNS), clean_texts=True))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so does a document that has no word left."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return _documents(kept.where(strip_white(F.translate(text_or_empty(F.col("text")), "\n", " ")) != ""))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by the n-gram Jaccard join the document with the smallest id stays; null ids stay."""
    links = ngram_join.link_documents(docs, k=SHINGLE_WORDS, pct=SIMILARITY_PCT)
    copies = links.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(copies, "doc_id", "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat or paraphrase a benchmark item go."""
    leaks = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(leaks, "doc_id", "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of all that is left."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage), ("line_dedup", line_stage), ("ngram_jaccard", near_duplicate_stage),
    ("decontamination", decontamination_stage), ("packing", packing_stage)]

ORACLE_SQL = None   # components and the latent search have no SQL form; tests/llm/test_pipeline.py has a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
