"""Joins (J1-J5, J9-J11, J13): semi/anti membership, null-safe propagation,
key-derived project match, enrichment updates and guarded lookups.

All are equi joins; Catalyst/AQE pick broadcast or sort-merge from runtime
sizes.  The lookup side is always reduced to one row per key first, so a join
can never multiply rows of the large side, and per-key values rejoin the rows
through ``skew_safe_join`` so that a hot key is split, never sent whole to one
task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.functions.text import project_link, short_commit_key


def skew_safe_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a one-row-per-key table back onto a big table whose keys may be hot.

    When ``small`` is an aggregate on ``keys``, Spark reuses its partitioning,
    the join gets no shuffle of its own and AQE cannot split a hot key.
    Joining on the keys packed into one struct makes both sides shuffle on
    that struct, so AQE's skew split applies (proportionally to the hot key's
    size) at no extra pass.  Rows with a NULL key never match, as in a plain
    equi join (a struct holding NULLs would).  Works for inner, left,
    left_semi and left_anti joins; the same plan at every size.
    """
    jk = F.struct(*[F.col(k) for k in keys])
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    s = small.filter(present).withColumn("_jk", jk).drop(*keys)
    return big.withColumn("_jk", jk).join(s, on="_jk", how=how).drop("_jk")


def semi(df: DataFrame, keys_df: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys_df``.

    The key side is deduplicated first (a partial aggregate collapses a hot key
    there); AQE splits a hot key of ``df``."""
    return skew_safe_join(df, keys_df.select(*on).distinct(), on, "left_semi").select(*df.columns)


def anti(df: DataFrame, *others: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in none of ``others`` (work list minus done)."""
    for o in others:
        df = skew_safe_join(df, o.select(*on).distinct(), on, "left_anti").select(*df.columns)
    return df


def flag_member(df: DataFrame, keys_df: DataFrame, on: list[str], name: str) -> DataFrame:
    """Boolean column ``name`` = key occurs in ``keys_df``.

    The keys of a partition are hashed and the rows of ``df`` stream past them, as in ``propagate``."""
    k = keys_df.select(*on).distinct().withColumn(name, F.lit(True))
    return skew_safe_join(df, k.hint("shuffle_hash"), on, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def propagate(df: DataFrame, verdicts: DataFrame, keys: list[str], cols: list[str], how: str = "inner") -> DataFrame:
    """Copy verdict columns from unique keys to every row with that key.

    Keys compare null-safe: each becomes the pair (is NULL, value or an empty
    text), and the pairs are joined through ``skew_safe_join``, so AQE splits a
    hot key.  Of several verdict rows with one key the smallest is used, so a
    commit row is never multiplied.  The verdicts of a partition are hashed and
    the rows of ``df`` stream past them: sorting the rows of a hot key that is
    too small for AQE's split (256 MB shuffled) would take many times its bytes
    of memory.
    """
    on = [f"_{p}_{k}" for k in keys for p in ("n", "v")]

    def paired(c: DataFrame) -> DataFrame:
        return c.withColumns({x: v for k in keys for x, v in (
            (f"_n_{k}", F.col(k).isNull()), (f"_v_{k}", F.coalesce(F.col(k).cast("string"), F.lit(""))))})

    v = paired(verdicts).groupBy(*on).agg(F.min(F.struct(*cols)).alias("_verdict"))
    return skew_safe_join(paired(df), v.hint("shuffle_hash"), on, how).select(*df.columns, *[F.col(f"_verdict.{c}").alias(c) for c in cols])


def match_project(commits: DataFrame, projects: DataFrame, link: str = "commit_link",
                  project: str = "git_link") -> DataFrame:
    """Commit rows of the listed projects, by the project link parsed from the commit link."""
    keyed = commits.withColumn("_p", project_link(link))
    listed = projects.select(F.col(project).alias("_p")).distinct()
    return skew_safe_join(keyed, listed, ["_p"], "left_semi").select(*commits.columns)


def fill_from(df: DataFrame, lookup: DataFrame, on: list[str], col: str, prefer_new: bool = False) -> DataFrame:
    """Fill (or, with ``prefer_new``, overwrite) ``col`` from a lookup.

    Of several lookup rows with one key the smallest value is used, so a row
    of ``df`` is never multiplied."""
    lk = lookup.groupBy(*on).agg(F.min(col).alias("_new"))
    out = skew_safe_join(df, lk, on, "left")
    value = F.coalesce("_new", col) if prefer_new else F.coalesce(col, "_new")
    return out.withColumn(col, value).drop("_new")


def lookup_status(work: DataFrame, table: DataFrame, key: str, verdict: str) -> DataFrame:
    """Per work item, the lookup status in ``table``.

    missing (0 matches) / multiple (> 1, treated as done) / done (1 match with a
    verdict) / todo (1 match without a verdict).
    """
    agg = table.groupBy(key).agg(F.count(F.lit(1)).alias("n_matches"), F.max(verdict).alias("_v"))
    out = work.select(key).distinct().join(agg, on=key, how="left")
    n = F.coalesce(F.col("n_matches"), F.lit(0))
    status = (F.when(n == 0, "missing").when(n > 1, "multiple")
              .when(F.col("_v").isNotNull(), "done").otherwise("todo"))
    return out.select(key, n.cast("long").alias("n_matches"), status.alias("status"))


def match_short_key(items: DataFrame, commits: DataFrame, item_key: str = "short_key",
                    link: str = "commit_link") -> DataFrame:
    """Resolve ``repo/commit/hash`` keys to full links; ambiguous keys are rejected."""
    resolved = (commits.select(short_commit_key(link).alias(item_key), F.col(link)).distinct()
                .groupBy(item_key)
                .agg(F.count(link).alias("n_links"), F.min(link).alias("_link")))
    out = items.join(resolved, on=item_key, how="left")
    n = F.coalesce(F.col("n_links"), F.lit(0))
    return out.select(*items.columns, F.when(n == 1, F.col("_link")).alias(link),
                      F.when(n == 0, "missing").when(n > 1, "ambiguous").otherwise("ok").alias("match_status"))
