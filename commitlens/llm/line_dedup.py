"""Operator 1 - line deduplication across documents.

Lines are exploded, normalised and hashed (128 bit); distinct documents are
counted per hash; lines of keys over the limit go, except in one document; the
texts are put together again by position.

Shuffles: (hash, id) pairs for the distinct count (pre-aggregated in the map
tasks), the same pairs for the join with the repeated keys (hot keys are split by
adaptive execution), dropped positions by document, and each text once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import ascii_lower, digest, drop_lines, lines, row_key, skew_join, strip_white, text_or_empty

MIN_CHARS = 10   # shorter keys (in code points) are never dropped
MAX_DOCS = 1     # a key in more documents than this is dropped everywhere but in the smallest id


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(_x_id, _x_rk, _x_pos, _x_h): one row per line whose key is long enough."""
    text = F.col(f"`{text_col}`")
    keys = F.transform(lines(text_or_empty(text)), lambda x: ascii_lower(strip_white(x)))
    return (docs.where(F.col(f"`{id_col}`").isNotNull() & text.isNotNull())
            .select(F.col(f"`{id_col}`").alias("_x_id"), row_key(text).alias("_x_rk"),
                    F.posexplode(keys).alias("_x_pos", "_x_key"))
            .where(F.length("_x_key") >= min_chars)
            .select("_x_id", "_x_rk", "_x_pos", digest(F.col("_x_key")).alias("_x_h")))


def repeated_lines(hashes: DataFrame, max_docs: int) -> DataFrame:
    """(_x_h, _x_keep, _x_docs): keys in more than ``max_docs`` distinct documents."""
    return (hashes.select("_x_h", "_x_id").distinct().groupBy("_x_h")
            .agg(F.count(F.lit(1)).alias("_x_docs"), F.min("_x_id").alias("_x_keep"))
            .where(F.col("_x_docs") > max_docs))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, max_docs: int = MAX_DOCS) -> DataFrame:
    """The input rows with ``text`` replaced, plus ``n_lines`` (before) and ``n_dropped``.

    Defined results: a null or empty text is one empty line and stays as it is;
    rows with a null id are neither counted nor changed; rows that share an
    id are one document (all of them keep a line when the id is the smallest);
    repeated rows give repeated rows; input columns called ``n_lines`` or
    ``n_dropped`` are replaced; other extra columns are carried along.
    """
    hashes = line_hashes(docs, id_col, text_col, min_chars)
    drops = (skew_join(hashes, repeated_lines(hashes, max_docs), ["_x_h"])
             .where(F.col("_x_id") != F.col("_x_keep")).select("_x_id", "_x_rk", "_x_pos"))
    return drop_lines(docs, drops, id_col, text_col, "n_lines", "n_dropped")
