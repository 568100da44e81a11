"""Composite jobs (C1-C10): each is a chain of library operators over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.functions import fixed
from commitlens.functions.answers import parse_class_answer, parse_filter_answer, taxonomy_categories
from commitlens.operators import filters, joins
from commitlens.operators.dedup import first_per_key
from commitlens.operators.prompts import chat_prompt, render_messages
from commitlens.operators.releases import match_releases  # noqa: F401  (C6, re-exported)
from commitlens.operators.sampling import stratified_sample
from commitlens.operators.scoring import lexicon_answer, lexicon_class_answer, score_with_fallback
from commitlens.operators.verify import verify_commits, verify_pairs  # noqa: F401  (C7, re-exported)

MSG = ["commit_title", "commit_description"]

# Our own short instruction for the native scorer's prompts (not a model prompt).
SYSTEM_TEXT = "Decide whether the commit optimises performance and name the issue type."
EXAMPLES = [("###Commit_Title\n\tSpeed up startup\n\n\n###Commit_Description\n\tEMPTY",
             "###Is_Perf_Optimization\n    Yes\n\n\n###Performance_Issue_Type\n    slow startup")]
CLASS_SYSTEM_TEXT = "Name the performance issue types of the commit and their root causes."
CLASS_EXAMPLES = [("###Commit_Title\n\tSpeed up startup\n\n\n###Commit_Description\n\tEMPTY",
                   f"{fixed.CLASS_TYPE_HEADER}[Responsiveness]{fixed.CLASS_CAUSE_HEADER}\n    [startup]")]


def message_text(title: str = "commit_title", description: str = "commit_description") -> F.Column:
    """Scoring input: title and description ('EMPTY' when missing)."""
    return F.concat(F.col(title), F.lit("\n"), F.coalesce(F.col(description), F.lit(fixed.EMPTY_DESCRIPTION)))


def unique_messages(commits: DataFrame, keep_first: bool = False) -> DataFrame:
    """W2 before scoring: one row per (title, description), NULL-safe, first link kept.

    The scoring text ``_msg`` is built after the dedup, so its sorts and its
    shuffle hold a long description once, not twice.  It is tied to the count
    (at least 1 in every group): because the answer then depends on an
    aggregate output, Catalyst cannot push a filter on the answer below the
    dedup (it would otherwise evaluate the scorer on every raw row).  Where the
    first link is not read, the messages are then hashed; with ``keep_first``
    it stays part of the dedup even so, which sorts them.
    """
    u = first_per_key(commits.select(*MSG, "commit_link", "commit_diff_file"),
                      MSG, ["commit_link", "commit_diff_file"], count_name="_n")
    found = F.col("_n") > 0
    if keep_first:
        found = found | F.col("commit_link").isNotNull()
    return u.withColumn("_msg", F.when(found, message_text())).drop("_n")


def score_commits(commits: DataFrame, scorer=None, second=None, keep_text: bool = False) -> DataFrame:
    """Dedup messages, build prompts, score.

    ``scorer`` (any pandas scorer) gets the rendered chat prompt of each
    message; where it raises or gives NULL, ``second`` or else the native
    lexicon answers, and ``answered_by`` says which.  Without a scorer the
    native lexicon reads the message itself.

    ``keep_text`` keeps the scoring text ``_msg`` (an aggregate output) for a
    later model call, so that call also stays above the dedup."""
    u = (unique_messages(commits, keep_first=True)
         .withColumn("_desc", F.coalesce(F.col("commit_description"), F.lit(fixed.EMPTY_DESCRIPTION)))
         .withColumn("prompt", chat_prompt("commit_title", "_desc", SYSTEM_TEXT, EXAMPLES))
         .drop("_desc"))
    if scorer is None:
        scored = u.withColumn("answer", lexicon_answer("_msg"))
    else:
        scored = score_with_fallback(u.withColumn("_prompt", render_messages("prompt")), "_prompt", scorer, second,
                                     native=lexicon_answer("_msg")).drop("_prompt")
    scored = scored if keep_text else scored.drop("_msg")
    return scored.withColumn("parsed", parse_filter_answer("answer"))


def propagate_scores(commits: DataFrame, scored: DataFrame, by: str = "message") -> DataFrame:
    """Positive verdicts back onto every commit row.

    ``by='message'`` joins on (title, description) NULL-safe (the intent);
    ``by='link'`` flags rows whose link was itself scored positive (as written
    in the source pipeline).  Returns all rows with a boolean ``is_perf``.
    """
    pos = scored.filter(F.col("parsed.positive"))
    if by == "link":
        return joins.flag_member(commits, pos, ["commit_link"], "is_perf")
    v = pos.select(*MSG).withColumn("is_perf", F.lit(True))
    out = joins.propagate(commits, v, MSG, ["is_perf"], how="left")
    return out.withColumn("is_perf", F.coalesce(F.col("is_perf"), F.lit(False)))


def classify(answers: DataFrame, key: str = "commit_link", answer: str = "answer") -> DataFrame:
    """C4/C5 core: parse classification answers; one row per commit."""
    a = first_per_key(answers.select(key, answer), [key], [answer])
    p = a.withColumn("_p", parse_class_answer(answer))
    return p.select(key, "_p.types_text", "_p.causes_text", "_p.pi_types", "_p.root_causes", "_p.is_na")


def merge_classification(answers: DataFrame) -> DataFrame:
    """Drop N/A answers and merge raw types into taxonomy categories."""
    c = filters.drop_na_marker(classify(answers))
    return c.withColumn("unique_pi_types", taxonomy_categories("pi_types"))


def label_sheet(classified: DataFrame, commits: DataFrame | None = None, seed: str = "0") -> DataFrame:
    """Stratified sample per category, then the first row of every sampled commit
    with its title and description (from the first changed-file row of ``commits``)
    and empty labelling columns."""
    strata = classified.select("commit_link", F.explode("unique_pi_types").alias("label"))
    picked = (stratified_sample(strata, "commit_link", "label", seed=seed, count_occurrences=True)
              .select("commit_link").distinct())
    rows = joins.semi(classified, picked, ["commit_link"])
    out = rows.select("commit_link", F.array_join("unique_pi_types", "|").alias("unique_pi_types"),
                      F.array_join("root_causes", "|").alias("root_causes"))
    if commits is not None:
        first = first_per_key(commits.select("commit_link", "commit_diff_file", *MSG), ["commit_link"], ["commit_diff_file"])
        out = joins.skew_safe_join(out, first.select("commit_link", *MSG), ["commit_link"], "left")
    for c in ["contain_perf", "PI_caused_class", "PI_causes_method", "PI_root_causes", "optimization_method"]:
        out = out.withColumn(c, F.lit(""))
    return out


def snapshot_index(pairs: DataFrame, root: str = "data/Saved_Projects",
                   order: list[str] | None = None) -> DataFrame:
    """Project key, commit hash and before/after folders of every unchecked pair;
    one row per (project, hash) -- the first pair in ``order`` (default: commit link)."""
    from commitlens.functions.text import last_segment

    todo = pairs.filter(F.col("check").isNull()) if "check" in pairs.columns else pairs
    parts = F.split("git_link", "/")
    x = todo.select("*", F.concat_ws("___", F.element_at(parts, -2), F.element_at(parts, -1)).alias("project_name"),
                    last_segment("commit_link").alias("commit_hash"))
    x = first_per_key(x, ["project_name", "commit_hash"], order or ["commit_link"])
    base = F.concat_ws("/", F.lit(root), F.col("project_name"), F.col("commit_hash"))
    return x.withColumn("before_change_dir", F.concat(base, F.lit("/before_change"))) \
        .withColumn("after_change_dir", F.concat(base, F.lit("/after_change")))


def benchmark_report(pairs: DataFrame) -> DataFrame:
    """Distinct commits and distinct binaries of a pair table."""
    return pairs.agg(F.count_distinct("commit_link").alias("n_commits"),
                     F.count_distinct("apk_download_link").alias("n_apks"))


def classify_messages(messages: DataFrame, scorer=None, second=None, done: DataFrame | None = None) -> DataFrame:
    """C4: classification answer of every message: F6 -> T1 -> M3 -> J10.

    ``messages`` has the message columns and ``_msg``; ``done`` answers of
    earlier runs (message columns, ``answer``), which stay as they are.  The
    others get a classification prompt; ``scorer`` reads it, with ``second``
    (or else the native class lexicon) where it raises or gives NULL.  Adds
    ``answer`` and ``answered_by`` ('done', 'first' or 'second').
    """
    x = joins.propagate(messages, done, MSG, ["answer"], how="left") if done is not None \
        else messages.withColumn("answer", F.lit(None).cast("string"))
    native = lexicon_class_answer("_msg")
    if scorer is None:
        by = F.when(F.col("answer").isNotNull(), "done").otherwise("second")
        return x.withColumn("answered_by", by).withColumn("answer", F.coalesce(F.col("answer"), native))
    desc = F.coalesce(F.col("commit_description"), F.lit(fixed.EMPTY_DESCRIPTION))
    prompt = render_messages(chat_prompt("commit_title", "_desc", CLASS_SYSTEM_TEXT, CLASS_EXAMPLES))
    x = x.withColumn("_desc", desc).withColumn("_prompt", prompt).drop("_desc")
    return score_with_fallback(x, "_prompt", scorer, second, native=native, keep=True).drop("_prompt")


def classify_commits(commits: DataFrame, scorer=None, second=None, done: DataFrame | None = None,
                     max_files: int | None = None) -> DataFrame:
    """C4 + C5 from commit rows: heuristic filter, score unique messages, keep
    positive commits, classify the positive messages once, propagate the parsed
    types by message, drop N/A and merge the taxonomy.

    ``max_files`` drops commits with more changed files first (F3; off by default)."""
    f1 = filters.heuristic_filter(commits)
    scored = score_commits(f1, keep_text=True)
    flagged = propagate_scores(f1, scored, by="message").filter("is_perf").drop("is_perf")
    if max_files is not None:
        flagged = filters.fanout_cap(flagged, max_rows=max_files)
    pos = scored.filter(F.col("parsed.positive")).select(*MSG, "_msg")
    cls = classify_messages(pos, scorer, second, done)
    verdicts = cls.select(*MSG, "answered_by", parse_class_answer("answer").alias("p")).select(
        *MSG, "answered_by", "p.pi_types", "p.root_causes", "p.is_na")
    rows = joins.propagate(flagged, verdicts, MSG, ["pi_types", "root_causes", "is_na", "answered_by"])
    return (filters.drop_na_marker(rows)
            .withColumn("unique_pi_types", taxonomy_categories("pi_types")))
