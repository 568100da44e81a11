"""Release matching: assets per version, asset choice, as-of pairing, gap fill
(J7, W4, W5, A6, J8 and the composite C6).

Per-(project, version) facts are aggregated once and joined to the pairs on
(project, version), never recomputed per commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.functions import fixed
from commitlens.functions.text import normalized_version
from commitlens.operators.asof import asof_join
from commitlens.operators.dedup import first_per_key, pick_min
from commitlens.operators.joins import skew_safe_join
from commitlens.session import scratch_path
from commitlens.sources.sinks import write_table

GV = ["git_link", "apk_version"]


def versions_with_binary(assets: DataFrame, name: str = "download_file_name") -> DataFrame:
    """All asset rows of the (project, version)s that have at least one ``.apk`` file."""
    with_apk = assets.filter(F.col(name).endswith(".apk")).select(*GV).distinct()
    return skew_safe_join(assets, with_apk, GV, "left_semi").select(*assets.columns)


def pick_asset(assets: DataFrame, name: str = "download_file_name", link: str = "download_link") -> DataFrame:
    """One ``.apk`` per (project, version): preferred names first, then the shortest name."""
    n = F.col(name)
    pref = F.when(n == fixed.PREFERRED_APKS[0], 0).when(n == fixed.PREFERRED_APKS[1], 1).otherwise(2)
    return pick_min(assets.withColumn("apk_download_link", F.col(link)), GV,
                    [pref, F.length(n), n, F.col(link)], ["apk_download_link"], where=n.endswith(".apk"))


def pick_archive(assets: DataFrame, name: str = "download_file_name", link: str = "download_link") -> DataFrame:
    """One source archive (``.zip``, literal) per (project, version).

    A single archive is taken as is; among several, ``html.zip`` is dropped and
    the shortest name wins.  No archive -> NULL (counted by the caller).
    """
    n = F.col(name)
    is_zip = n.contains(".zip")
    cand = F.struct(F.length(n).alias("l"), n.alias("n"), F.col(link).alias("k"))
    agg = assets.groupBy(*GV).agg(
        F.count(F.when(is_zip, 1)).alias("_nz"),
        F.min(F.when(is_zip, cand)).alias("_any"),
        F.min(F.when(is_zip & (n != fixed.EXCLUDED_ARCHIVE), cand)).alias("_best"))
    pick = F.when(F.col("_nz") == 1, F.col("_any.k")).otherwise(F.col("_best.k"))
    return agg.select(*GV, pick.alias("source_code_download_link"))


def first_release_date(assets: DataFrame, date: str = "release_date") -> DataFrame:
    """First release date per (project, version)."""
    return assets.groupBy(*GV).agg(F.min(date).alias("apk_release_time"))


def commits_per_project(commits: DataFrame) -> DataFrame:
    """Distinct commits with their project and date (first row of each commit).

    A hash ``distinct`` on the three columns first collapses the changed-file
    rows (partial aggregation, fixed cost per row); the exact first-per-key
    (a sort-based ``min_by``) then only sees one row per commit.
    """
    c = commits.select("git_link", "commit_link", "commit_date").filter(F.col("commit_date").isNotNull())
    return first_per_key(c.distinct(), ["commit_link"], ["commit_date", "git_link"])


def version_facts(assets: DataFrame, name: str = "download_file_name", link: str = "download_link",
                  date: str = "release_date") -> DataFrame:
    """J7 + A6 + W4 + W5 in ONE aggregation per (project, version) with a binary:
    first release date, all release dates, chosen ``.apk`` link and chosen source archive.

    Works on the raw asset rows: repeated rows change nothing (a version has a
    single archive iff the smallest archive row equals the largest).
    """
    n, k = F.col(name), F.col(link)
    pref = F.when(n == fixed.PREFERRED_APKS[0], 0).when(n == fixed.PREFERRED_APKS[1], 1).otherwise(2)
    zcand = F.struct(F.length(n).alias("l"), n.alias("n"), k.alias("k"), F.col(date).alias("d"))
    zips = F.when(n.contains(".zip"), zcand)
    agg = assets.groupBy(*GV).agg(
        F.min(date).alias("apk_release_time"), F.collect_set(date).alias("dates"),
        F.min(F.when(n.endswith(".apk"), F.struct(pref.alias("p"), F.length(n).alias("l"), n.alias("n"),
                                                   k.alias("k")))).alias("_apk"),
        F.min(zips).alias("_any"), F.max(zips).alias("_last"),
        F.min(F.when(n.contains(".zip") & (n != fixed.EXCLUDED_ARCHIVE), zcand)).alias("_best"))
    src = F.when(F.col("_any") == F.col("_last"), F.col("_any.k")).otherwise(F.col("_best.k"))
    return agg.filter(F.col("_apk").isNotNull()).select(
        *GV, "apk_release_time", "dates", F.col("_apk.k").alias("apk_download_link"), src.alias("source_code_download_link"))


def release_pairs(commits: DataFrame, assets: DataFrame, store: DataFrame) -> DataFrame:
    """C6 before the gap fill: commit -> newest version released strictly before it,
    per source ('release', 'store').

    Both sources go through ONE as-of join (the source is part of the key).  Its
    right side is one row per (project, version, date); what else is known of
    a version joins the matches on (project, version).
    """
    facts = version_facts(assets)
    null = F.lit(None).cast("string")
    rel = (facts.select("git_link", F.lit("release").alias("source"), F.col("apk_version").alias("m_version"),
                        F.explode("dates").alias("m_date"), null.alias("m_apk"), null.alias("m_src"))
           .unionByName(store.select(
               "git_link", F.lit("store").alias("source"), F.col("apk_version").alias("m_version"),
               F.col("release_date").alias("m_date"), F.col("apk_download_link").alias("m_apk"),
               F.col("source_code_download_link").alias("m_src"))))
    offers = commits_per_project(commits).withColumn("source", F.explode(F.array(F.lit("release"), F.lit("store"))))
    m = asof_join(offers, rel, ["git_link", "source"], "commit_date", "m_date", strict=True, how="inner",
                  tie_break=["m_version", "m_apk", "m_src"])
    known = facts.select(*GV, F.lit("release").alias("source"), F.col("apk_release_time").alias("_t"),
                         F.col("apk_download_link").alias("_apk"), F.col("source_code_download_link").alias("_src"))
    x = skew_safe_join(m.withColumnRenamed("m_version", "apk_version"), known, [*GV, "source"], "left")
    own = F.col("source") == "store"
    return x.select("git_link", "commit_link", F.col("commit_date").alias("commit_release_time"),
                    F.when(own, F.col("m_date")).otherwise(F.col("_t")).alias("apk_release_time"), "apk_version",
                    F.when(own, F.col("m_apk")).otherwise(F.col("_apk")).alias("apk_download_link"),
                    F.when(own, F.col("m_src")).otherwise(F.col("_src")).alias("source_code_download_link"), "source")


def pairs_from_store(commits: DataFrame, store: DataFrame) -> DataFrame:
    """Store path of C6: commit -> newest store version released strictly before it."""
    rel = store.distinct().select(
        "git_link", F.col("apk_version").alias("s_version"), F.col("release_date").alias("s_date"),
        F.col("apk_download_link").alias("s_apk"), F.col("source_code_download_link").alias("s_src"))
    m = asof_join(commits_per_project(commits), rel, ["git_link"], "commit_date", "s_date",
                  strict=True, how="inner", tie_break=["s_version", "s_apk", "s_src"])
    return m.select("git_link", "commit_link", F.col("commit_date").alias("commit_release_time"),
                    F.col("s_date").alias("apk_release_time"), F.col("s_version").alias("apk_version"),
                    F.col("s_apk").alias("apk_download_link"), F.col("s_src").alias("source_code_download_link"))


def gap_fill(pairs: DataFrame) -> DataFrame:
    """Pairs of both sources (column ``source``: 'release', 'store') -> the release pairs, and the
    store pairs whose normalised version is missing from the release source in that project.

    Only store rows whose raw version equals its normalised form are added.  ``pairs``
    has one row per commit and source, so nothing is added twice.  One flag per
    (project, version) goes back onto the pairs; both sources stay in one plan.
    """
    x = pairs.withColumn("_nv", normalized_version("apk_version"))
    have = (x.filter(F.col("_nv").isNotNull()).groupBy("git_link", "_nv")
            .agg(F.max(F.col("source") == "release").alias("_have")))
    flagged = skew_safe_join(x, have, ["git_link", "_nv"], "left")
    release = F.col("source") == "release"
    add = ~release & (F.col("apk_version") == F.col("_nv")) & ~F.coalesce(F.col("_have"), F.lit(False))
    return flagged.filter(release | add).select(*pairs.columns)


def match_releases(commits: DataFrame, assets: DataFrame, store: DataFrame) -> DataFrame:
    """Release pairs, gap-filled from the store listing.

    The gap fill reads the pairs twice, once without their links; they are written once, or both would be matched from the tables."""
    spark = commits.sparkSession
    path = write_table(release_pairs(commits, assets, store), scratch_path(spark, "release_pairs"))
    return gap_fill(spark.read.parquet(path))
