"""Operator 7 - quality rules with cross-document line frequency (native expressions only).

Base rules look at one text.  The method then hashes normalised lines, counts
distinct documents per host and line, removes lines above the host's limit (the first
document with the line keeps it), and rejects documents that this depletes.

Shuffles: distinct (host, line, id) and (host, id) keys, their join with the frequent lines,
removed characters by document.  No text moves unless ``clean_texts`` is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import (WHITE, ascii_lower, digest, kept_lines, let, lines, row_key, skew_join, strip_white,
                                   text_or_empty, words)

SYMBOLS = "#*$%&|<>"
WINDOW = 8              # words in a repeat window
MIN_WORDS = 20          # fewer fail
MAX_REPEAT_PCT = 30     # more repeated words (per cent) fail
MIN_DOCS = 20           # a line in at most this many documents of its host is never boilerplate
HOST_SHARE = 0.02       # nor one in at most this share of them
MIN_LEFT = 0.5          # a document needs this share of its word characters outside removed lines


def repeat_words(w: Column, window: int = WINDOW) -> Column:
    """Words inside windows found twice or more in the array ``w`` (first included); n log n.

    Windows are compared by a 64-bit hash within one text.
    """
    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda a, b: a["h"] == b["h"]
        found = let(pairs, lambda p: F.transform(
            F.filter(p, lambda x, k: F.coalesce(same(x, F.get(p, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(p, k + 1)), F.lit(False))),
            lambda x: x["i"]))
        return let(F.sort_array(found), lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(x - F.get(p, k - 1), F.lit(window)))),
            F.lit(0), lambda a, b: a + b))

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
    return F.when(F.size(w) <= window, 0).otherwise(let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))).cast("long")


def base_rules(text: Column) -> Column:
    """Struct of the per-text figures."""
    t = text_or_empty(text)
    real = F.filter(lines(t), lambda x: strip_white(x) != "")
    return let(words(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(real, lambda r: F.size(r) - F.size(F.array_distinct(r))).cast("long").alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words")))


def host_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(_x_id, _x_rk, _x_host, _x_pos, _x_h, _x_chars): one row per line with a word; null hosts form one host."""
    text = F.col(f"`{text_col}`")
    keyed = F.transform(lines(text), lambda x: ascii_lower(strip_white(x)))
    return (docs.where(F.col(f"`{id_col}`").isNotNull() & text.isNotNull())
            .select(F.col(f"`{id_col}`").alias("_x_id"), row_key(text).alias("_x_rk"),
                    F.xxhash64(F.col(f"`{host_col}`").isNull(), F.col(f"`{host_col}`")).alias("_x_host"),
                    F.posexplode(keyed).alias("_x_pos", "_x_key"))
            .where(F.col("_x_key") != "")
            .select("_x_id", "_x_rk", "_x_host", "_x_pos", digest(F.col("_x_key")).alias("_x_h"),
                    F.length(F.translate("_x_key", WHITE, "")).alias("_x_chars")))


def frequent_lines(found: DataFrame, docs: DataFrame, id_col: str, host_col: str, min_docs: int, share: float) -> DataFrame:
    """(_x_host, _x_h, _x_keep): lines above their host's limit, and the first document with each."""
    counts = (found.select("_x_host", "_x_h", "_x_id").distinct().groupBy("_x_host", "_x_h")
              .agg(F.count(F.lit(1)).alias("_x_docs"), F.min("_x_id").alias("_x_keep"))
              .where(F.col("_x_docs") > min_docs))
    hosts = (docs.where(F.col(f"`{id_col}`").isNotNull())
             .select(F.xxhash64(F.col(f"`{host_col}`").isNull(), F.col(f"`{host_col}`")).alias("_x_host"),
                     F.col(f"`{id_col}`").alias("_x_id"))
             .distinct().groupBy("_x_host").agg(F.count(F.lit(1)).alias("_x_all")))
    return (skew_join(counts, hosts, ["_x_host"])
            .where(F.col("_x_docs") > share * F.col("_x_all")).select("_x_host", "_x_h", "_x_keep"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, min_left: float = MIN_LEFT,
                  clean_texts: bool = False) -> DataFrame:
    """One row per input row: id, the base figures, ``base_failed``, ``removed_chars``, ``kept``.

    With ``clean_texts`` the input rows come back instead: the kept ones,
    with the lines above the limit removed.

    Defined results: null and empty texts have no words and fail the base rules;
    rows with a null id are judged by the base rules alone; null hosts are one host;
    repeated rows are one document in the counts and repeat in the result.
    """
    found = host_lines(docs, id_col, text_col, host_col)
    frequent = frequent_lines(found, docs, id_col, host_col, min_docs, host_share)
    over = skew_join(found, frequent, ["_x_host", "_x_h"]).where(F.col("_x_id") != F.col("_x_keep"))
    once = over.groupBy("_x_id", "_x_rk", "_x_pos").agg(F.max("_x_chars").alias("_x_c"))     # repeated rows count once
    positions = [F.collect_list("_x_pos").alias("_x_gone")] if clean_texts else []
    removed = (once.groupBy("_x_id", "_x_rk").agg(F.sum("_x_c").alias("_x_removed"), *positions)
               .withColumnsRenamed({"_x_id": "_x_gid", "_x_rk": "_x_grk"}))
    text = F.col(f"`{text_col}`")
    stats = docs.select(F.col(f"`{id_col}`").alias("_x_id"), row_key(text).alias("_x_rk"), base_rules(text).alias("_x_b"))
    judged = (stats.join(removed, (F.col("_x_id") == F.col("_x_gid")) & (F.col("_x_rk") == F.col("_x_grk")), "left")
              .select("_x_id", "_x_rk", "_x_b.*", F.coalesce("_x_removed", F.lit(0)).cast("long").alias("removed_chars"), *(["_x_gone"] if clean_texts else []))
              .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))
              # one expression over both sides of the join: a part of it must not be pushed down and repeat the base rules
              .withColumn("kept", F.when(F.col("removed_chars") > (1 - min_left) * F.col("word_chars"), False).otherwise(~F.col("base_failed"))))
    if not clean_texts:
        return judged.drop("_x_rk").withColumnRenamed("_x_id", id_col)
    good = judged.where("kept").select(F.col("_x_id").alias("_x_gid"), F.col("_x_rk").alias("_x_grk"), "_x_gone")
    good = good.dropDuplicates(["_x_gid", "_x_grk"])
    keyed = docs.withColumns({"_x_id": F.col(f"`{id_col}`"), "_x_rk": row_key(text)})
    kept = keyed.join(good, F.col("_x_id").eqNullSafe(F.col("_x_gid")) & (F.col("_x_rk") == F.col("_x_grk")))
    return kept.select(*[kept_lines(text, F.col("_x_gone")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
