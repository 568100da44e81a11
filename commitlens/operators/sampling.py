"""Stratified sampling with statistically sized strata.

Sample size per stratum: n = ceil(n0 / (1 + (n0 - 1) / N)), n0 = z^2 p (1-p) / e^2.
Rows are ranked per stratum by md5(key | stratum | seed) and the n smallest
are kept.  To keep a huge stratum out of a single sorting task, only a prefix
of the hash order is ranked: rows are bucketed into hash-threshold levels and
the lowest level prefix that holds at least n rows is chosen per stratum (see
``stratified_sample``); the result equals the full ranking exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.functions import fixed
from commitlens.operators.joins import skew_safe_join


def initial_size(confidence_level: float = 0.95, margin_of_error: float = 0.05, proportion: float = 0.5) -> float:
    z = fixed.Z_SCORES[confidence_level]
    return (z ** 2 * proportion * (1 - proportion)) / margin_of_error ** 2


def sample_size(population: Column, confidence_level: float = 0.95, margin_of_error: float = 0.05,
                proportion: float = 0.5) -> Column:
    """Finite-population corrected sample size as a column expression."""
    n0 = F.lit(initial_size(confidence_level, margin_of_error, proportion))
    return F.ceil(n0 / (F.lit(1.0) + (n0 - F.lit(1.0)) / population.cast("double"))).cast("long")


def sample_sizes(strata: DataFrame, key: str, stratum: str, count_occurrences: bool = False, **kw) -> DataFrame:
    """Population and sample size per stratum.

    The population is the number of distinct keys, or with
    ``count_occurrences`` the number of (key, stratum) rows including repeats
    (a commit listing a category twice counts twice, as the source's label
    counts do)."""
    # distinct (key, stratum) first, then a plain count: Spark plans COUNT(DISTINCT)
    # grouped by the stratum with a shuffle on the stratum alone, which would put
    # a hot stratum's keys into one task; this form aggregates partially
    rows = strata.select(key, stratum) if count_occurrences else strata.select(key, stratum).distinct()
    pop = F.count(F.lit(1)) if count_occurrences else F.count(key)  # NULL keys are not counted as keys
    return (rows.groupBy(stratum).agg(pop.alias("population"))
            .withColumn("sample_size", sample_size(F.col("population"), **kw)))


def _rank_hash(key: str, stratum: str, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col(stratum).cast("string"), F.lit(seed)))


def stratified_sample(strata: DataFrame, key: str, stratum: str, seed: str = "0",
                      margin_sigmas: float = 6.0, margin_rows: float = 20.0, count_occurrences: bool = False,
                      **kw) -> DataFrame:
    """(key, stratum, rank) of the sampled rows; ``strata`` holds one row per (key, stratum).

    Every row gets the smallest level L whose threshold t_L = t_0 * 4^L exceeds
    its hash fraction u (t_0 keeps ~n + 6 sqrt(n) + 20 rows).  Rows of level <= L
    are exactly the rows with u < t_L, a prefix of the hash order.  Per stratum
    we pick the lowest level whose prefix holds >= n rows (counts per (stratum,
    level) are a tiny aggregate) and rank only that prefix, so no stratum is
    ever sorted whole: the chosen prefix has O(n) rows (at most ~4x the target
    even when a level falls short).
    """
    s = strata.select(key, stratum).distinct()
    sizes = sample_sizes(strata if count_occurrences else s, key, stratum, count_occurrences, **kw)
    h = _rank_hash(key, stratum, seed)
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(16 ** 8))
    n = F.col("sample_size").cast("double")
    t0 = (n + F.lit(margin_sigmas) * F.sqrt(n) + F.lit(margin_rows)) / F.col("population").cast("double")
    # level = smallest L >= 0 with u < t0 * 4^L  (u < 1 always, so the level is finite)
    level = F.greatest(F.lit(0), F.floor(F.log(4.0, u / t0) + F.lit(1)).cast("int"))
    level = F.when(u < t0, F.lit(0)).otherwise(level)
    # per-stratum values go back onto the rows; AQE splits hot strata
    rows = skew_safe_join(s, sizes, [stratum], "inner") \
        .withColumn("_h", h).withColumn("_lvl", level)
    per_level = rows.groupBy(stratum, "_lvl").agg(F.count(F.lit(1)).alias("_c"))
    cum = Window.partitionBy(stratum).orderBy("_lvl").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = (per_level.withColumn("_cum", F.sum("_c").over(cum))
              .join(sizes.select(stratum, "sample_size"), on=stratum)
              .filter(F.col("_cum") >= F.col("sample_size"))
              .groupBy(stratum).agg(F.min("_lvl").alias("_max_lvl")))
    pool = skew_safe_join(rows, chosen, [stratum], "inner") \
        .filter(F.col("_lvl") <= F.col("_max_lvl"))
    w = Window.partitionBy(stratum).orderBy("_h", key)
    return (pool.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= F.col("sample_size"))
            .select(key, stratum, F.col("rank").cast("long").alias("rank")))
