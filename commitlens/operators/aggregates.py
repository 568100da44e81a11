"""Aggregations (A1-A8): funnel, value counts, histograms, label counts, kappa.

All of them are groupBy aggregates, which Spark computes with a map-side
partial aggregate before the shuffle, so a hot key costs one partial row per
task, never a whole group in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def funnel(stages: list[tuple[str, DataFrame]], key: str = "commit_link", approx: bool = False) -> DataFrame:
    """A1: distinct keys and rows per named stage, plus retention vs. the previous stage.

    ``stages`` is an ordered list of (name, DataFrame).  The stages are tagged
    and unioned so that one aggregation computes every count.
    """
    tagged = reduce(DataFrame.unionByName,
                    [df.select(F.lit(i).alias("stage_order"), F.lit(name).alias("stage"), F.col(key).alias("_k"))
                     for i, (name, df) in enumerate(stages)])
    if approx:
        return tagged.groupBy("stage_order", "stage").agg(F.count(F.lit(1)).alias("n_rows"),
                                                           F.approx_count_distinct("_k").alias("n_commits"))
    # rows per (stage, key) first, then per stage: both levels aggregate partially,
    # unlike COUNT(DISTINCT) grouped by stage, which shuffles on the stage alone
    per_key = tagged.groupBy("stage_order", "stage", "_k").agg(F.count(F.lit(1)).alias("_r"))
    return per_key.groupBy("stage_order", "stage").agg(
        F.sum("_r").alias("n_rows"), F.count(F.col("_k")).alias("n_commits"))


def funnel_flags(df: DataFrame, key: str, stages: list[tuple[str, Column]], cap: tuple[str, str, int] | None = None
                 ) -> DataFrame:
    """A1 in one pass over one table whose rows carry a boolean flag per stage.

    Rows per stage = sum of the flag; distinct keys per stage = number of keys
    with at least one flagged row, taken from a per-key aggregate (no
    COUNT DISTINCT expansion, no re-scan per stage).  ``cap=(name, base, k)``
    adds a stage: rows of ``base`` whose key has at most ``k`` rows in ``base``.
    """
    per_key = df.groupBy(key).agg(*[F.sum(c.cast("long")).alias(f"_r{i}") for i, (_, c) in enumerate(stages)])
    names = [n for n, _ in stages]
    rows = [(n, F.col(f"_r{i}")) for i, n in enumerate(names)]
    if cap:
        cname, base, k = cap
        r = F.col(f"_r{names.index(base)}")
        rows.append((cname, F.when(r <= k, r).otherwise(F.lit(0))))
    tot = per_key.agg(*[x for i, (_, r) in enumerate(rows) for x in (
        F.sum(r).alias(f"n_rows_{i}"), F.sum((r > 0).cast("long")).alias(f"n_keys_{i}"))])
    stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("stage_order"), F.lit(n).alias("stage"),
                                           F.coalesce(F.col(f"n_rows_{i}"), F.lit(0)).alias("n_rows"),
                                           F.coalesce(F.col(f"n_keys_{i}"), F.lit(0)).alias("n_commits"))
                                 for i, (n, _) in enumerate(rows)]))
    return tot.select(stacked.alias("s")).select("s.*")


def value_counts(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """A2: rows per key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def count_histogram(df: DataFrame, key: str, size_name: str = "n_rows", count_name: str = "n_keys") -> DataFrame:
    """A3: how many keys have exactly n rows (count of counts)."""
    return value_counts(df, key, size_name).groupBy(size_name).agg(F.count(F.lit(1)).alias(count_name))


def share_at_most(df: DataFrame, key: str, k: int) -> DataFrame:
    """A4: number and share (double) of keys with at most ``k`` rows."""
    per_key = value_counts(df, key, "_n")
    return per_key.agg(
        F.lit(k).alias("k"),
        F.sum((F.col("_n") <= k).cast("long")).alias("n_at_most"),
        F.count(F.lit(1)).alias("n_keys"),
        F.avg((F.col("_n") <= k).cast("double")).alias("share"),
    )


def label_counts(df: DataFrame, key: str, labels: str, skip: list[str] | None = None,
                 label_name: str = "label") -> DataFrame:
    """A5: count labels over the first row of every key (multi-label explode).

    ``df`` must already hold one row per key (see ``dedup.first_per_key``);
    labels listed in ``skip`` are not counted.
    """
    x = df.select(F.explode(labels).alias(label_name))
    if skip:
        x = x.filter(~F.col(label_name).isin(skip))
    return x.groupBy(label_name).agg(F.count(F.lit(1)).alias("n"))


def cohen_kappa(df: DataFrame, rater_a: str, rater_b: str) -> DataFrame:
    """Cohen's kappa of two label columns, over any number of classes.

    From the contingency table (classes^2 rows) we form, per class, the two
    marginals and the diagonal; one more aggregate gives po, pe and kappa.
    Rows with a NULL label are ignored.  No join and no driver round trip.
    """
    cont = (df.filter(F.col(rater_a).isNotNull() & F.col(rater_b).isNotNull())
            .groupBy(F.col(rater_a).alias("a"), F.col(rater_b).alias("b"))
            .agg(F.count(F.lit(1)).alias("n")))
    per_class = cont.select(
        F.explode(F.array(
            F.struct(F.col("a").alias("c"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb"),
                     F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("nd")),
            F.struct(F.col("b").alias("c"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb"),
                     F.lit(0).cast("long").alias("nd")),
        )).alias("s")).select("s.*")
    marg = per_class.groupBy("c").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum("nd").alias("nd"))
    tot = marg.agg(F.sum("na").cast("double").alias("n"),
                   F.sum(F.col("na").cast("double") * F.col("nb")).alias("pe_num"),
                   F.sum("nd").cast("double").alias("po_num"))
    po = F.col("po_num") / F.col("n")
    pe = F.col("pe_num") / (F.col("n") * F.col("n"))
    return tot.select(F.col("n").cast("long").alias("n_items"), po.alias("po"), pe.alias("pe"),
                      F.when(pe == 1.0, F.lit(None).cast("double")).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def counts_with_total(df: DataFrame, group: str, name: str = "n") -> DataFrame:
    """Rows per group plus a grand-total row (group = NULL) via rollup."""
    return df.rollup(group).agg(F.count(F.lit(1)).alias(name))
