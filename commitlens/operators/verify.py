"""Verification of commit/release matches against file text.

The snapshot table ``(commit_link, side, path, content)`` holds one row per
commit, side and path.  The changed-file rows join the sides they need on
(commit, path); no file text passes through an aggregate.  Rows are checked
with array lambdas and reduced per commit with ``bool_and``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.functions import fixed
from commitlens.functions.text import let, split_lines, strip_ws
from commitlens.operators.joins import fill_from, lookup_status, semi


def with_sides(changes: DataFrame, snapshot: DataFrame, sides: list[str]) -> DataFrame:
    """Changed-file rows with the text of each side and whether that side has the file."""
    out = changes
    for s in sides:
        side = snapshot.filter(F.col("side") == s).select(
            F.col("commit_link").alias("_c"), F.col("path").alias("_p"), F.col("content").alias(s), F.lit(True).alias(f"has_{s}"))
        out = out.join(side, (F.col("commit_link") == F.col("_c")) & (F.col("path") == F.col("_p")), "left").drop("_c", "_p")
    return out


def file_checks(changes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Per changed file: ``ok`` (the release keeps the deleted lines, or equals the
    old text when nothing was deleted), NULL when the old text is unreadable.

    Binary files (``.apk``, ``.so``) are not checked (NULL, counted as skipped).  With an ``added_lines``
    column, a pure addition (nothing deleted, every line of the new file
    added) is ok exactly when the file did not exist before.
    """
    skip = F.lit(False)
    for sfx in fixed.UNCHECKED_SUFFIXES:
        skip = skip | F.col("path").endswith(sfx)
    additions = "added_lines" in changes.columns
    j = with_sides(changes, snapshot, ["before", "release", *(["after"] if additions else [])])
    deleted = let(split_lines("before"), lambda lines: F.transform("deleted_lines", lambda i: strip_ws(F.try_element_at(lines, i))))
    # Most deleted lines that the release keeps are whole lines of it: one hash set answers them.  Only the others are looked
    # for in the text, up to the first that is missing.  A deleted line number beyond the old file makes the file unreadable (skipped).
    own = F.transform(split_lines("release"), strip_ws)
    keeps = let(deleted, lambda d: F.when(F.exists(d, lambda x: x.isNull()), F.lit(None).cast("boolean"))
                .otherwise(F.forall(F.array_except(d, own), lambda x: F.col("release").contains(x))))
    unknown = F.lit(None).cast("boolean")
    ok = F.when(skip, unknown)
    if additions:
        pure_add = ((F.size("deleted_lines") == 0) & (F.size("added_lines") > 0)
                    & (F.size(split_lines("after")) == F.size("added_lines")))
        ok = ok.when(pure_add, ~F.coalesce(F.col("has_before"), F.lit(False)))
    ok = (ok.when(F.col("before").isNull(), unknown)
          .when(F.col("release").isNull(), F.lit(False))
          .when(F.size("deleted_lines") == 0, F.col("release") == F.col("before"))
          .otherwise(keeps))
    return j.select("commit_link", "path", ok.alias("ok"))


def verify_commits(changes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Per commit 'same' if every readable changed file checks out, else
    'different'; unreadable files are counted as skipped."""
    fc = file_checks(changes, snapshot)
    agg = fc.groupBy("commit_link").agg(
        F.bool_and("ok").alias("_all"),
        F.count(F.lit(1)).alias("n_files"),
        F.count(F.when(F.col("ok").isNull(), 1)).alias("n_skipped"))
    verdict = F.when(F.col("_all") | F.col("_all").isNull(), F.lit("same")).otherwise(F.lit("different"))
    return agg.select("commit_link", verdict.alias("check"), F.col("n_files").cast("long"),
                      F.col("n_skipped").cast("long"))


def verify_pairs(pairs: DataFrame, changes: DataFrame, snapshot: DataFrame, key: str = "commit_link",
                 verdict: str = "check") -> DataFrame:
    """J11 lookup status -> verify the commits still to do -> J10 write the verdicts back.

    ``pairs`` may hold several pairs of a commit and verdicts of an earlier
    run; only commits with status 'todo' (one pair without a verdict) are checked.
    """
    work = pairs.select(key).distinct()
    todo = lookup_status(work, pairs, key, verdict).filter(F.col("status") == "todo").select(key)
    checked = verify_commits(semi(changes, todo, [key]), semi(snapshot, todo, [key]))
    return fill_from(pairs, checked.select(key, F.col("check").alias(verdict)), [key], verdict)
