"""Thin queries over the given tables, one per operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm import decontam, importance, language, line_dedup, ngram_join, packing, projection_passes, quality, ranked_search, revisits, secrets, suffix_dedup, surrogates
from commitlens.llm.common import row_key, table, text_or_empty  # noqa: F401

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty(F.col("text")), 256).alias("kept_sha256"))


@query
def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = revisits.resolve(revisits.records_of_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return out.select("record_id", F.expr("record_id div 2").alias("page_id"), "url_key", "refers_to", "resolved", "reason",
                      F.when(F.col("headers").isNotNull(), F.array_join(pairs, ";")).alias("headers"), "digest")


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.find_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), shared=suffix_dedup.SHARED)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"), "n_shared")


@query
def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), "a key kept outside the data")
    total = F.aggregate("entities", F.lit(0), lambda a, e: a + e["n"]).cast("long")
    kinds = F.array_join(F.transform("entities", lambda e: F.concat_ws("=", e["kind"], e["n"])), ",")
    return out.select("doc_id", total.alias("n_entities"), kinds.alias("kinds"), "text")


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.quality_rules(docs)


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    out, _ = language.train_and_identify(docs, F.col("doc_id").isNotNull() & ~held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = tuple(r.name for r in secrets.BASE)
    # a first delivery (the English documents) under the base rules, then the whole table under all rules: old blobs meet
    # the further rules only, new blobs all
    first = table(spark, sf_dir, "documents").where(F.col("lang") == "en").select("doc_id", "text")
    found = secrets.scan_increments([(first, secrets.BASE), (docs, secrets.RULES)])
    count = lambda n: F.size(F.filter("found", lambda s: s["rule"] == n)).cast("long").alias(f"n_{n}")
    return found.select("doc_id", *[count(n) for n in names],
                        F.sha2(secrets.span_list(F.col("found"), names), 256).alias("base_sha256"),
                        secrets.span_list(F.col("found")).alias("spans"))


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search.rank_documents(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = importance.resample(docs, table(spark, sf_dir, "benchmark").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return projection_passes.link_vectors(vectors).select("vec_id", "n_links", "component_id", "kept")
