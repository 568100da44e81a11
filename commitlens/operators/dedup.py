"""Dedup, first-per-key, ordering, set operations and hash splits.

"Keep the first row of a key" is an aggregate (``min_by`` over a declared
order), not a window: Spark partially aggregates it map-side, so a key that
holds a third of all rows still never lands whole in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_dedup(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows."""
    return df.distinct()


def first_per_key(df: DataFrame, keys: list[str], order: list[str], count_name: str | None = None) -> DataFrame:
    """One row per key (NULL keys group together), the row first in ``order``.

    ``order`` should make rows of a key unique; otherwise any of the tied rows
    is kept (they agree on every ordered column).
    """
    others = [c for c in df.columns if c not in keys]
    aggs = [F.min_by(F.struct(*others), F.struct(*order)).alias("_first")]
    if count_name:
        aggs.append(F.count(F.lit(1)).alias(count_name))
    out = df.groupBy(*keys).agg(*aggs)
    cols = [*keys, "_first.*"] + ([count_name] if count_name else [])
    return out.select(*cols)


def unique_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of one column."""
    return df.select(col).distinct()


def pick_min(df: DataFrame, keys: list[str], rank: list[Column], value_cols: list[str],
             where: Column | None = None) -> DataFrame:
    """Per key, the values of the row with the smallest ``rank`` tuple.

    ``where`` restricts the candidate rows; keys without a candidate get NULL.
    Implemented as ``min(struct(rank..., values...))`` -- an ordinary partial
    aggregate.
    """
    cand = F.struct(*[r.alias(f"_r{i}") for i, r in enumerate(rank)], *[F.col(c) for c in value_cols])
    if where is not None:
        cand = F.when(where, cand)
    best = df.groupBy(*keys).agg(F.min(cand).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in value_cols])


def shortest_path(df: DataFrame, group: str, path: str = "path",
                  drop_suffixes: tuple[str, ...] = (".1", ".apk")) -> DataFrame:
    """Per group, the shortest path (ties by path) after dropping paths with
    the given suffixes; groups with no remaining path are absent."""
    keep = F.lit(True)
    for sfx in drop_suffixes:
        keep = keep & ~F.col(path).endswith(sfx)
    return pick_min(df.filter(keep), [group], [F.length(path), F.col(path)], [path])


def max_number_in(df: DataFrame, col: str, name: str = "max_batch") -> DataFrame:
    """Largest number found in a text column (e.g. the latest batch file)."""
    return df.agg(F.max(F.regexp_extract(F.col(col), r"(\d+)", 1).cast("long")).alias(name))


def hash_fraction(key: Column, seed: str = "") -> Column:
    """Deterministic value in [0, 1) from md5 (a hash both Spark and DuckDB share)."""
    h = F.md5(F.concat(key.cast("string"), F.lit(seed)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(16 ** 8))


def hash_split(df: DataFrame, key: str, fraction: float = 2 / 3, seed: str = "") -> DataFrame:
    """Deterministic split tag ('first'/'second') by hash of the key."""
    part = F.when(hash_fraction(F.col(key), seed) < fraction, F.lit("first")).otherwise(F.lit("second"))
    return df.withColumn("part", part)


def seeded_order(df: DataFrame, key: str, seed: str = "0") -> DataFrame:
    """O2: a reproducible random order of a work list."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), F.col(key))


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """Union by column name, filling missing columns with NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of ``a`` not in ``b`` (set semantics)."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def key_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``a`` or ``b``."""
    return a.select(key).union(b.select(key)).distinct()
