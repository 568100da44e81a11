"""Operator 10 - secret scan with an incremental blob ledger (native expressions only).

Every version of every file is content-addressed (SHA-256 of its text).  The ledger has
one row per scanned (blob, rule, rule version) with the spans found there.  Only
pairs that the ledger lacks are scanned, each distinct blob once; findings
are joined back to all versions (paths) that have the blob.

Shuffles: blob hashes (pre-aggregated), the texts once (to pick one copy of each
blob), spans of the few blobs that have any, and blob hashes with ids for the way
back to all paths (hot blobs are split by adaptive execution).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commitlens.llm.common import materialise, skew_join, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``pattern``: Java regular expression whose leftmost non-overlapping matches count;
    a match is dropped if its ``group`` has fewer than ``least`` characters."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # runs are greedy, so a least length inside the pattern gives the same matches as dropping short ones
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", 1, r"\b[a-z][a-z0-9+.-]{0,63}://[^\s/:@]+:[^\s/:@]+@"),   # a bounded scheme: linear in the text
)
RULES = BASE + MORE
LEDGER_SCHEMA = "blob binary, rule string, version int, spans array<struct<start:bigint,end:bigint>>"


def blob_of(text):
    return F.unhex(F.sha2(text_or_empty(text), 256))


def unseen_blobs(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...],
                 id_col: str, text_col: str) -> DataFrame:
    """(blob, text, seen): one row per blob that lacks a (rule, version) in the ledger; ``seen`` has those it has."""
    keyed = versions.select(blob_of(F.col(f"`{text_col}`")).alias("blob"), F.col(f"`{id_col}`").alias("_x_id"),
                            text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    first = keyed.groupBy("blob").agg(F.min("_x_id").alias("_x_first"))
    if ledger is not None:
        wanted = F.array(*[F.lit(f"{r.name}@{r.version}") for r in rules])
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("seen"))
        first = first.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
        first = first.where(F.size(F.array_except(wanted, "seen")) > 0)
    else:
        first = first.withColumn("seen", F.array().cast("array<string>"))
    first = first.withColumnsRenamed({"blob": "_x_blob"})
    # the copy with the smallest id is scanned; repeated rows with that id are made one below
    one = keyed.join(first, (F.col("blob") == F.col("_x_blob")) & F.col("_x_id").eqNullSafe(F.col("_x_first")))
    return one.select("blob", "text", "seen")


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """New ledger rows: (blob, rule, version, spans) for each unseen pair; offsets in code points, end exclusive.

    Matches and the gaps between them come from the same pattern; a start is the sum of what stands before it.
    """
    def pieces(r: Rule):
        found = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        tested = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))
        size = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))
        # pairs that the ledger has are not evaluated
        cut = F.when(~F.array_contains("seen", f"{r.name}@{r.version}") & F.regexp_like("text", F.lit(r.pattern)),
                     F.arrays_zip(size(F.slice(F.split("text", r.pattern, -1), 1, F.size(found))).alias("gap"),
                                  size(found).alias("len"), size(tested).alias("test")))
        empty = F.array().cast("array<struct<gap:bigint,len:bigint,test:bigint>>")
        return F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"),
                        F.coalesce(cut.cast("array<struct<gap:bigint,len:bigint,test:bigint>>"), empty).alias("hits"))

    pairs = (blobs.select("blob", "seen", F.array(*[pieces(r) for r in rules]).alias("each"))
             .select("blob", "seen", F.inline("each"))
             .where(~F.array_contains("seen", F.concat_ws("@", "rule", "version"))))
    # offsets without a loop that copies: hits become rows, and a window inside the blob and rule sums them; a pair without a
    # hit is one row with a null hit, so that the texts are scanned once.  One exchange serves the three steps that follow.
    key = ["blob", "rule", "version"]
    rows = pairs.select(*key, "least", F.posexplode_outer("hits").alias("i", "hit")).select(*key, "least", "i", "hit.*")
    rows = rows.repartition(*[F.col(c) for c in key]).distinct()
    upto = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(upto)
    return (rows.select(*key, "least", "test", (end - F.col("len")).alias("start"), end.alias("end"))
            .groupBy(*key)
            .agg(F.sort_array(F.collect_list(F.when(F.col("test") >= F.col("least"), F.struct("start", "end")))).alias("spans")))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows to append to the ledger: every (blob, rule version) pair of ``versions`` that it lacks."""
    return scan(unseen_blobs(versions, ledger, rules, id_col, text_col), rules)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per version: id, blob and ``found``, an array of (start, ord, rule, end) by start, then rule order."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.name}@{r.version}"), F.lit(i))])
    at = order[F.concat_ws("@", "rule", "version")]
    per_blob = (ledger.where(F.size("spans") > 0).withColumn("ord", at).where(F.col("ord").isNotNull())
                .select("blob", F.explode(F.transform("spans", lambda s: F.struct(
                    s["start"].alias("start"), F.col("ord"), F.col("rule"), s["end"].alias("end")))).alias("s"))
                .groupBy("blob").agg(F.sort_array(F.collect_set("s")).alias("found")))
    paths = versions.select(F.col(f"`{id_col}`"), blob_of(F.col(f"`{text_col}`")).alias("blob"))
    none = F.array().cast("array<struct<start:bigint,ord:int,rule:string,end:bigint>>")
    return skew_join(paths, per_blob, ["blob"], "left").withColumn("found", F.coalesce("found", none))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings for every version after one increment: what the ledger has plus what is new.

    Defined results: a null text is the empty blob; versions with the same text share
    one scan; null ids and repeated rows are kept, one result row per input row; extra
    columns are ignored.  To keep the ledger, write ``update_ledger`` and use ``findings``.
    """
    new = update_ledger(versions, ledger, rules, id_col, text_col)
    return findings(versions, new if ledger is None else ledger.unionByName(new), rules, id_col, text_col)


def scan_increments(increments: list[tuple[DataFrame, tuple[Rule, ...]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings for the versions of the last increment, from a ledger kept in the shared folder over all of them.

    Each increment (versions, rules) appends the pairs that the ledger lacks and rescans nothing else: a version that came
    before costs its hash, a new rule or rule version is the only one that old blobs are scanned with.
    """
    ledger = None
    for versions, rules in increments:
        new = materialise(update_ledger(versions, ledger, rules, id_col, text_col), "blob-ledger")
        ledger = new if ledger is None else ledger.unionByName(new)
    return findings(versions, ledger, rules, id_col, text_col)


def span_list(found, names: tuple[str, ...] | None = None):
    """``rule:start:end`` joined by commas, optionally of some rules only."""
    if names is not None:
        found = F.filter(found, lambda s: s["rule"].isin(*names))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")
