"""Chains of pages by list ranking (X2, X4: following next-page links to the end).

A crawler follows the link to the next page until there is none.  On tables the links are edges (page, next page), and
each page's place in its listing comes from pointer jumping: every page knows an ancestor and its distance, and in each
round the ancestor's ancestor takes its place, so a chain of n pages needs log2(n) rounds of one join.  Within a chain all
ancestors of a round differ, and pages that have reached the first page leave the loop: no key is hot.
Every round is written, so lost executors cost one round at most.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.operators.numbering import written


def rank_chains(pages: DataFrame, page: str = "page", next_page: str = "next_page") -> DataFrame:
    """(page, ``listing``, ``position``, ``n_pages``, ``state``) for every page.

    ``listing`` is the first page of the chain, ``position`` counts from 0, ``n_pages`` is the chain's length.  ``state`` holds for the whole
    chain: ``complete`` (the last page has no next), ``broken`` (its next page is not in the table), ``merged`` (its next page
    already follows a smaller page), ``cyclic`` (no first page: the listing is the smallest page, positions are null).
    Pages are distinct by ``page``; of repeated rows the smallest next page counts.  Null pages are left out.
    """
    one = written(pages.where(F.col(page).isNotNull()).groupBy(F.col(page).alias("p")).agg(F.min(next_page).alias("nx")), "chain-pages")
    # a page is the successor of the smallest page that links to it; other links to it end their chains
    inner = one.where(F.col("nx").isNotNull()).groupBy("nx").agg(F.min("p").alias("prev"))
    state = one.join(inner.withColumnRenamed("nx", "p"), "p", "left").select(
        "p", F.coalesce("prev", "p").alias("at"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.col("prev").isNull().alias("done"), F.col("p").alias("least"))
    state = written(state, "chain")
    n = one.count()
    finished = state.where("done")
    active = state.where(~F.col("done"))
    for _ in range(max(1, math.ceil(math.log2(max(2, n))) + 1)):
        if active.isEmpty():
            break
        known = finished.unionByName(active).select(F.col("p").alias("q"), F.col("at").alias("q_at"), F.col("dist").alias("q_dist"), F.col("done").alias("q_done"), F.col("least").alias("q_least"))
        step = active.join(known, F.col("at") == F.col("q")).select(
            "p", F.col("q_at").alias("at"), (F.col("dist") + F.col("q_dist")).alias("dist"), F.col("q_done").alias("done"), F.least("least", "q_least").alias("least"))
        step = written(step, "chain")
        finished = finished.unionByName(step.where("done"))
        active = step.where(~F.col("done"))
    cyclic = active.select("p", F.col("least").alias("listing"), F.lit(None).cast("long").alias("position"))
    ranked = written(finished.select("p", F.col("at").alias("listing"), F.col("dist").alias("position")).unionByName(cyclic), "ranked-pages")
    last = (ranked.where(F.col("position").isNotNull()).groupBy("listing").agg(F.max(F.struct("position", "p")).alias("m"), F.count(F.lit(1)).alias("n_pages"))
            .select("listing", "n_pages", F.col("m.p").alias("last")))
    ends = last.join(one, F.col("last") == F.col("p")).select("listing", "n_pages", "nx")
    there = one.select(F.col("p").alias("nx"), F.lit(True).alias("there"))
    whole = ends.join(there, "nx", "left").select("listing", "n_pages", F.when(F.col("nx").isNull(), "complete").when(F.col("there"), "merged").otherwise("broken").alias("state"))
    rings = ranked.where(F.col("position").isNull()).groupBy("listing").agg(F.count(F.lit(1)).alias("n_pages")).withColumn("state", F.lit("cyclic"))
    # the listing in a struct: the join gets an exchange of its own, so a listing of very many pages can be split
    chains = whole.unionByName(rings).withColumnRenamed("listing", "_l")
    return ranked.join(chains, F.struct(F.col("listing").alias("k")) == F.struct(F.col("_l").alias("k"))).select(F.col("p").alias(page), "listing", "position", "n_pages", "state")
