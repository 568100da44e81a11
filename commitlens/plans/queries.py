"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each reads the driver's tables (through the adapters) in full.  Array results
are rendered with ``array_join(.., '|')`` so the DuckDB oracle can compare them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens.functions import text as tx
from commitlens.functions.answers import parse_filter_answer as parse_filter
from commitlens.functions.answers import taxonomy_unmapped
from commitlens.operators import aggregates as agg
from commitlens.operators import dedup, filters, joins, prompts, releases, sampling, scoring, verify
from commitlens.operators import batches, chains
from commitlens.operators import elements as el
from commitlens.operators import extract as ex
from commitlens.operators.asof import asof_join
from commitlens.plans import adapters as ad
from commitlens.plans import jobs, pages
from commitlens.session import scratch_path
from commitlens.sources import readers, sinks
from commitlens.sources.versioned import VersionedTable
from commitlens.streaming import funnel as rf
from commitlens.streaming import incremental as inc

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def q(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _f1(spark, d):
    return filters.heuristic_filter(ad.commits(spark, d))


# --- filters ------------------------------------------------------------------

@q
def heuristic_filter(spark, d):
    return _f1(spark, d)


@q
def title_only_filter(spark, d):
    return filters.title_only_filter(ad.commits(spark, d))


@q
def rule_audit(spark, d):
    return filters.rule_audit(ad.commits(spark, d))


@q
def funnel(spark, d):
    c = ad.commits(spark, d).withColumn("_heur", filters.heuristic_keep())
    scored = jobs.score_commits(c.filter("_heur"))
    flagged = jobs.propagate_scores(c, scored, by="message")
    stages = [("crawled", F.lit(True)), ("heuristic", F.col("_heur")),
              ("positive", F.col("_heur") & F.col("is_perf"))]
    return agg.funnel_flags(flagged, "commit_link", stages, cap=("capped", "positive", 5))


@q
def ascii_documents(spark, d):
    docs = ad.table(spark, d, "documents")
    return docs.select("doc_id", "lang", tx.is_ascii("text").alias("is_ascii"))


@q
def token_budget(spark, d):
    docs = ad.table(spark, d, "documents")
    return docs.select("doc_id", tx.word_count("text").alias("n_words"))


@q
def fanout_cap(spark, d):
    return filters.fanout_cap(ad.commits(spark, d))


@q
def fanout_hist(spark, d):
    return agg.count_histogram(ad.commits(spark, d), "commit_link")


@q
def fanout_share(spark, d):
    return agg.share_at_most(ad.commits(spark, d), "commit_link", 5)


# --- dedup --------------------------------------------------------------------

@q
def dedup_messages(spark, d):
    c = ad.commits(spark, d).select(*jobs.MSG, "commit_link", "commit_diff_file")
    return dedup.first_per_key(c, jobs.MSG, ["commit_link", "commit_diff_file"], count_name="n_rows")


@q
def first_per_commit(spark, d):
    return dedup.first_per_key(ad.commits(spark, d), ["commit_link"], ["commit_diff_file"])


@q
def exact_dedup(spark, d):
    return dedup.exact_dedup(ad.table(spark, d, "documents").select("text"))


@q
def hash_split(spark, d):
    links = dedup.unique_values(ad.commits(spark, d), "commit_link")
    return dedup.hash_split(links, "commit_link", 2 / 3, seed="s")


@q
def shortest_path(spark, d):
    """W6 over the release-side file list of every commit in the snapshot table."""
    files = ad.snapshot(spark, d).filter(F.col("side") == "release")
    return dedup.shortest_path(files, "commit_link", "path")


@q
def commit_keys(spark, d):
    links = dedup.unique_values(ad.commits(spark, d), "commit_link")
    return links.select("commit_link", tx.project_link("commit_link").alias("project"),
                        tx.last_segment("commit_link").alias("commit_hash"),
                        tx.owner_repo_key("commit_link").alias("project_key"),
                        tx.safe_name(tx.project_link("commit_link")).alias("safe_name"),
                        tx.short_commit_key("commit_link").alias("short_key"),
                        tx.strip_suffix(F.concat(tx.project_link("commit_link"), F.lit("/commits")), "/commits")
                        .alias("stripped"))


# --- joins --------------------------------------------------------------------

def _projects(spark, d):
    cust = ad.table(spark, d, "customer")
    return cust.select("c_custkey", "c_name", ad._project(F.col("c_custkey")).alias("git_link"))


@q
def semi_projects(spark, d):
    return joins.semi(_projects(spark, d), _f1(spark, d), ["git_link"])


@q
def project_commits(spark, d):
    projects = ad.release_assets(spark, d).select("git_link")   # projects that have releases
    return joins.match_project(_f1(spark, d), projects).select("commit_link", "commit_diff_file")


@q
def anti_done(spark, d):
    o = ad.table(spark, d, "orders")
    link = F.concat(ad._project(F.col("o_custkey")), F.lit("/commit/"), F.col("o_orderkey").cast("string"))
    done = o.filter(F.col("o_orderstatus") == "F").select(link.alias("commit_link"))
    missing = o.filter(F.col("o_orderpriority") == "5-LOW").select(link.alias("commit_link"))
    work = dedup.unique_values(_f1(spark, d), "commit_link")
    return joins.anti(work, done, missing, on=["commit_link"])


@q
def flag_positive(spark, d):
    f1 = _f1(spark, d)
    return jobs.propagate_scores(f1, jobs.score_commits(f1), by="link")


@q
def propagate_message(spark, d):
    f1 = _f1(spark, d)
    return jobs.propagate_scores(f1, jobs.score_commits(f1), by="message")


def _orders_side(spark, d, status, key_name, date_name):
    o = ad.table(spark, d, "orders").filter(F.col("o_orderstatus") == status)
    return o.select("o_custkey", F.col("o_orderkey").alias(key_name), F.col("o_orderdate").cast("date").alias(date_name))


def _asof_orders(spark, d, strict, how):
    c = _orders_side(spark, d, "O", "commit_key", "commit_date")
    r = _orders_side(spark, d, "F", "release_key", "release_date")
    return asof_join(c, r, ["o_custkey"], "commit_date", "release_date", strict=strict, how=how,
                     tie_break=["release_key"])


@q
def asof_release(spark, d):
    return _asof_orders(spark, d, True, "inner")


@q
def asof_left(spark, d):
    return _asof_orders(spark, d, True, "left")


@q
def asof_inclusive(spark, d):
    return _asof_orders(spark, d, False, "left")


@q
def asof_events(spark, d):
    e = ad.table(spark, d, "events")
    p = e.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    s = e.filter(F.col("event_type") == "signup").select(
        "user_id", F.col("event_id").alias("signup_id"), F.col("ts").alias("signup_ts"))
    return asof_join(p, s, ["user_id"], "ts", "signup_ts", strict=True, how="left", tie_break=["signup_id"])


@q
def enrich_time(spark, d):
    c = ad.commits(spark, d)
    base = c.select("commit_link", "commit_diff_file",
                    F.when(F.col("commit_description").isNotNull(), F.col("commit_date")).alias("commit_release_time"))
    o = ad.table(spark, d, "orders").filter(F.col("o_orderstatus") == "F")
    lookup = o.select(F.concat(ad._project(F.col("o_custkey")), F.lit("/commit/"),
                               F.col("o_orderkey").cast("string")).alias("commit_link"),
                      F.col("o_orderdate").cast("date").alias("commit_release_time"))
    return joins.fill_from(base, lookup, ["commit_link"], "commit_release_time")


@q
def verdict_update(spark, d):
    pairs = _asof_orders(spark, d, True, "inner").select("commit_key", "release_key",
                                                         F.lit(None).cast("string").alias("check"))
    o = ad.table(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    verdicts = o.select(F.col("o_orderkey").alias("commit_key"),
                        F.when(F.col("o_totalprice") > 100000, "same").otherwise("different").alias("check"))
    return joins.fill_from(pairs, verdicts, ["commit_key"], "check", prefer_new=True)


def _pairs_union(spark, d):
    both = releases.release_pairs(ad.commits(spark, d), ad.release_assets(spark, d), ad.store_releases(spark, d)).drop("source")
    return both.withColumn("check", F.when(F.col("apk_version").startswith("v"), F.lit("same")))


@q
def lookup_guard(spark, d):
    work = dedup.unique_values(_f1(spark, d), "commit_link")
    return joins.lookup_status(work, _pairs_union(spark, d), "commit_link", "check")


@q
def short_key_match(spark, d):
    items = ad.answers(spark, d).select(tx.short_commit_key("commit_link").alias("short_key")).distinct()
    links = ad.commits(spark, d).select("commit_link")
    hash_ = tx.last_segment("commit_link").cast("long")
    forks = links.filter(hash_ % 13 == 0).select(F.concat(F.lit("https://github.com/fork/"), F.element_at(F.split("commit_link", "/"), -3),
                                                          F.lit("/commit/"), tx.last_segment("commit_link")).alias("commit_link"))
    return joins.match_short_key(items, links.filter(hash_ % 17 != 0).unionByName(forks))


# --- releases -----------------------------------------------------------------

@q
def versions_with_binary(spark, d):
    return releases.versions_with_binary(ad.release_assets(spark, d))


def _useful(spark, d):
    """Exact duplicates dropped first (W1), then versions with a binary."""
    return releases.versions_with_binary(dedup.exact_dedup(ad.release_assets(spark, d)))


@q
def pick_asset(spark, d):
    return releases.pick_asset(_useful(spark, d))


@q
def pick_archive(spark, d):
    return releases.pick_archive(_useful(spark, d))


@q
def first_release_date(spark, d):
    return releases.first_release_date(_useful(spark, d))


@q
def store_pairs(spark, d):
    return releases.pairs_from_store(ad.commits(spark, d), ad.store_releases(spark, d))


@q
def match_releases(spark, d):
    return releases.match_releases(ad.commits(spark, d), ad.release_assets(spark, d), ad.store_releases(spark, d))


@q
def snapshot_index(spark, d):
    # release pairs come before store pairs, as in the concatenated pair file
    order = ["commit_link", "source", "apk_version", "apk_download_link", "source_code_download_link"]
    return jobs.snapshot_index(match_releases(spark, d), order=order)


@q
def benchmark_report(spark, d):
    return jobs.benchmark_report(match_releases(spark, d))


@q
def project_sizes(spark, d):
    per = agg.value_counts(dedup.unique_values(ad.commits(spark, d), "commit_link")
                           .select(tx.project_link("commit_link").alias("git_link")), "git_link", "n_commits")
    return filters.size_threshold(per, "n_commits", 10)


@q
def gap_fill(spark, d):
    """J8 alone: the store pairs added for versions the release source lacks."""
    m = match_releases(spark, d)
    return m.filter(F.col("source") == "store").drop("source")


@q
def version_norm(spark, d):
    v = ad.release_assets(spark, d).select("apk_version").unionByName(
        ad.store_releases(spark, d).select("apk_version")).distinct()
    return v.select("apk_version", tx.normalized_version("apk_version").alias("norm_version"))


@q
def date_formats(spark, d):
    o = ad.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    s = o.select("o_orderkey", F.date_format("o_orderdate", "MMM d, yyyy").alias("store_text"),
                 F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso_text"))
    return s.select("o_orderkey", "store_text", "iso_text", tx.store_date("store_text").alias("store_date"),
                    tx.iso_date("iso_text").alias("iso_date"))


# --- answers, taxonomy, labels ------------------------------------------------

@q
def parse_answer(spark, d):
    c = jobs.classify(ad.answers(spark, d))
    return c.select("commit_link", "types_text", "causes_text", F.array_join("pi_types", "|").alias("pi_types"),
                    F.array_join("root_causes", "|").alias("root_causes"), "is_na")


@q
def parse_filter_answer(spark, d):
    s = jobs.score_commits(_f1(spark, d))
    answer = F.when(F.col("commit_title").startswith("Speed"), F.lit("I cannot tell.")).otherwise(F.col("answer"))   # no known format
    s = s.withColumn("answer", answer).withColumn("parsed", parse_filter("answer"))
    return s.select(*jobs.MSG, "parsed.is_perf", "parsed.issue_type", "parsed.bad_format", "parsed.positive")


@q
def label_counts(spark, d):
    return agg.label_counts(jobs.classify(ad.answers(spark, d)), "commit_link", "pi_types")


@q
def taxonomy_merge(spark, d):
    m = jobs.merge_classification(ad.answers(spark, d))
    return m.select("commit_link", F.array_join("unique_pi_types", "|").alias("unique_pi_types"),
                    F.array_join(taxonomy_unmapped("pi_types"), "|").alias("unmapped"))


@q
def classify_commits(spark, d):
    return _classified(jobs.classify_commits(ad.commits(spark, d)))


def _classified(c):
    return c.select("commit_link", "commit_diff_file", F.array_join("pi_types", "|").alias("pi_types"),
                    F.array_join("root_causes", "|").alias("root_causes"),
                    F.array_join("unique_pi_types", "|").alias("unique_pi_types"), "answered_by")


@q
def classify_scorer(spark, d):
    """C4 with a model of one's own: it reads the prompts, fails on some, and messages classified before are kept."""
    c = ad.commits(spark, d)
    done = jobs.unique_messages(_f1(spark, d)).filter(F.col("commit_title").startswith("Reduce"))
    done = done.select(*jobs.MSG, scoring.lexicon_class_answer("_msg").alias("answer"))
    return _classified(jobs.classify_commits(c, scorer=scoring.Refusing(scoring.ClassLexiconScorer(), "player"), done=done))


@q
def label_report(spark, d):
    """O1: label counts ordered by count desc, label asc (a range-partitioned sort, no single task)."""
    return agg.label_counts(jobs.classify(ad.answers(spark, d)), "commit_link", "pi_types").orderBy(F.desc("n"), "label")


@q
def unmapped_labels(spark, d):
    """E15 report: raw labels that the taxonomy neither maps nor ignores."""
    m = jobs.classify(ad.answers(spark, d)).filter(~F.col("is_na"))
    return agg.label_counts(m.select("commit_link", taxonomy_unmapped("pi_types").alias("u")), "commit_link", "u")


@q
def category_counts(spark, d):
    return agg.label_counts(jobs.merge_classification(ad.answers(spark, d)), "commit_link", "unique_pi_types")


@q
def kappa(spark, d):
    return agg.cohen_kappa(ad.table(spark, d, "labels"), "quality", "toxic")


@q
def segment_rollup(spark, d):
    return agg.counts_with_total(ad.table(spark, d, "customer"), "c_mktsegment")


@q
def sample_sizes(spark, d):
    e = ad.table(spark, d, "events")
    return sampling.sample_sizes(e, "event_id", "event_type")


@q
def stratified_sample(spark, d):
    e = ad.table(spark, d, "events")
    return sampling.stratified_sample(e, "event_id", "event_type", seed="0")


@q
def label_sheet(spark, d):
    # the sheet reads its classification four times; written once, the answers are parsed once
    path = sinks.write_table(jobs.merge_classification(ad.answers(spark, d)), scratch_path(spark, "label_sheet"))
    return jobs.label_sheet(spark.read.parquet(path), ad.commits(spark, d), seed="0")


# --- prompts ------------------------------------------------------------------

@q
def build_prompt(spark, d):
    s = jobs.score_commits(_f1(spark, d))
    return s.select(*jobs.MSG, prompts.render_messages("prompt").alias("prompt_text"),
                    tx.word_count(prompts.render_messages("prompt")).alias("n_words"))


def _diffs(spark, d):
    return ad.diffs(spark, d).groupBy("commit_link").agg(
        F.sort_array(F.collect_list(F.struct("file_name", "patch"))).alias("files"),
        F.first("message").alias("message"))


@q
def diff_prompt(spark, d):
    x = _diffs(spark, d)
    p = prompts.diff_prompt("message", "files")
    return x.select("commit_link", F.element_at(p, 1)["content"].alias("prompt_text"),
                    F.size("files").cast("long").alias("n_files"))


@q
def hunk_lines(spark, d):
    h = ex.hunks(ad.diffs(spark, d))
    return h.select("commit_link", "file_name", F.col("hunk").cast("long").alias("hunk"), "old_start", "new_start")


@q
def example_pairs(spark, d):
    return prompts.example_pairs(ad.table(spark, d, "conversations"))


# --- verification -------------------------------------------------------------

@q
def verify_pairs(spark, d):
    return verify.verify_commits(ad.changes(spark, d), ad.snapshot(spark, d))


@q
def verify_write_back(spark, d):
    """Pairs of the snapshot commits, some verified earlier, some matched twice; the rest is verified and written back."""
    n = F.col("doc_id") % 100
    pairs = ad.table(spark, d, "documents").select(
        F.concat(F.lit("c"), n.cast("string")).alias("commit_link"),
        F.explode(F.when(n % 7 == 0, F.array(F.lit("1.0"), F.lit("2.0"))).otherwise(F.array(F.lit("1.0")))).alias("apk_version"),
        F.when(n % 5 == 0, F.lit("same")).alias("check")).distinct()
    return verify.verify_pairs(pairs, ad.changes(spark, d), ad.snapshot(spark, d))


# --- extraction ---------------------------------------------------------------

@q
def page_links(spark, d):
    return ex.page_links(ad.table(spark, d, "pages"))


@q
def page_anchors(spark, d):
    return ex.page_anchors(ad.table(spark, d, "pages"))


@q
def page_title(spark, d):
    p = ad.table(spark, d, "pages")
    return p.select("page_id", ex.tag_text("html", "title").alias("title"), ex.tag_text("html", "h1").alias("h1"),
                    ex.link_by_anchor("html", "and").alias("and_link"))


@q
def page_sections(spark, d):
    return ex.page_blocks(ad.table(spark, d, "pages"), "p")


@q
def json_props(spark, d):
    e = ad.table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@q
def commit_json(spark, d):
    """Commit JSON -> message and one row per file."""
    j = pages.commit_json(spark, d).select("commit_link", ex.diff_json("body").alias("j"))
    return j.select("commit_link", F.col("j.message").alias("message"), F.inline("j.files"))


@q
def commit_page(spark, d):
    """Commit pages -> one row per changed file with the page's description."""
    x = ex.commit_page_files(pages.commit_pages(spark, d), key="commit_link")
    lines = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return x.select("commit_link", "commit_description", "file_pos", "commit_diff_file", "commit_diff", lines("added_lines"), lines("deleted_lines"))


@q
def commit_time(spark, d):
    """Machine-readable time of a commit page."""
    return pages.commit_pages(spark, d).select("commit_link", F.unix_seconds(ex.machine_time("html")).alias("commit_time"))


@q
def store_page(spark, d):
    """Store pages -> one row per version."""
    x = ex.store_versions(pages.store_pages(spark, d), key="git_link")
    return x.drop("version_pos", "code")


@q
def release_page(spark, d):
    """Release pages -> one row per asset of a full release."""
    return ex.release_assets_from_page(pages.release_pages(spark, d), key="git_link").drop("section_pos")


@q
def changelog_page(spark, d):
    """Changelog and metadata links of app pages."""
    return pages.app_pages(spark, d).select("c_custkey", ex.changelog_links("html", "git_link").alias("x")).select("c_custkey", "x.*")


@q
def next_pages(spark, d):
    """Next-page links of listing and commit-list pages."""
    base = F.lit("https://host.example")
    return pages.app_pages(spark, d).select("c_custkey", ex.next_listing("html", base).alias("next_listing"), ex.next_commit_page("html", base).alias("next_commits"))


@q
def commit_list(spark, d):
    """Commit links of list pages (anchors with the commit title), 'Initial commit' left out."""
    listing = pages.list_pages(spark, d)
    rows = ex.commit_list(ex.page_anchors(listing, key="page"))
    return rows.select(F.regexp_extract("page", r"/list/(\d+)/", 1).cast("long").alias("page_id"), "href", "anchor_text", "commit_hash")


@q
def page_chains(spark, d):
    """List pages put in order by their next-page links, to the end: listing, place in it, broken, merged and cyclic chains."""
    listing = pages.list_pages(spark, d)
    edges = listing.select("page", ex.next_commit_page("html", ex.base_url("page")).alias("next_page"))
    return chains.rank_chains(edges)


@q
def section_links(spark, d):
    """Links inside one section of the given pages."""
    return el.section_links(ad.table(spark, d, "pages"), [el.Step("nav"), el.Step("li")])


@q
def post_links(spark, d):
    """Links of the paragraphs in each post's content, past nested sections and left-out end tags."""
    path = [el.Step("div", cls="post-content"), el.Step("p")]
    return el.section_links(pages.post_pages(spark, d), path, url=None, key="page").drop("pos")


@q
def text_between(spark, d):
    """First text between two words, and first capture between two patterns."""
    docs = ad.table(spark, d, "documents")
    return docs.select("doc_id", tx.after_first_until("text", " the ", " of ").alias("after_the"), tx.first_between("text", r"\bth\w+ ", r"[.,]").alias("between"))


@q
def digits(spark, d):
    """Digits of a text as a number."""
    c = ad.table(spark, d, "customer").select("c_custkey", F.concat(F.format_number(F.col("c_custkey") * 37, 0), F.lit(" commits")).alias("t"))
    return c.select("c_custkey", tx.digits_number("t").alias("n"), tx.digits_number(F.lit("none")).alias("none"))


@q
def host_filter(spark, d):
    """links of one host."""
    p = ad.table(spark, d, "pages").select("page_id", "url")
    return filters.prefix_filter(p, "url", "https://www.")


@q
def max_batch(spark, d):
    """Largest number in the names of the result files, per order status."""
    o = ad.table(spark, d, "orders").select(F.concat(F.lit("result_"), F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("name"))
    return dedup.max_number_in(o, "name")


@q
def seeded_order(spark, d):
    """O2: reproducible random order of the work list (the first key has the smallest hash)."""
    return dedup.seeded_order(dedup.unique_values(_f1(spark, d), "commit_link"), "commit_link", seed="0")


@q
def key_union(spark, d):
    """Commits that pass the filter or have an answer."""
    return dedup.key_union(_f1(spark, d), ad.answers(spark, d), "commit_link")


# --- scoring ------------------------------------------------------------------

def _messages(spark, d):
    return jobs.unique_messages(_f1(spark, d)).select(*jobs.MSG, "_msg")


def _score_out(df):
    p = parse_filter("answer")
    return df.select(*jobs.MSG, "answer", p["positive"].alias("positive"))


@q
def lexicon_score(spark, d):
    return _score_out(_messages(spark, d).withColumn("answer", scoring.lexicon_answer("_msg")))


@q
def udf_score(spark, d):
    return _score_out(scoring.score_with(_messages(spark, d), "_msg", scoring.LexiconScorer(), "answer"))


@q
def score_fallback(spark, d):
    """M3: a first model that raises on some messages; the native lexicon answers those."""
    first = scoring.Refusing(scoring.LexiconScorer(), "scroll")
    s = scoring.score_with_fallback(_messages(spark, d), "_msg", first)
    return s.select(*jobs.MSG, "answer", parse_filter("answer")["positive"].alias("positive"), "answered_by")


@q
def score_incremental(spark, d):
    m = _messages(spark, d)
    prev = F.when(F.col("commit_title").startswith("Fix"), scoring.lexicon_answer("_msg"))
    return _score_out(scoring.score_missing(m.withColumn("answer", prev), "_msg", "answer"))


# --- sources ------------------------------------------------------------------

DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType())])


@q
def csv_roundtrip(spark, d):
    path = sinks.export_csv(ad.table(spark, d, "documents"), scratch_path(spark, "csv_roundtrip"))
    return readers.read_csv(spark, path, DOC_SCHEMA).select("doc_id", "text", "lang")


@q
def csv_recursive(spark, d):
    root = scratch_path(spark, "csv_recursive")
    docs = ad.table(spark, d, "documents")
    docs.write.partitionBy("lang").options(header="true", quote='"', escape='"',
                                           ignoreLeadingWhiteSpace="false",
                                           ignoreTrailingWhiteSpace="false").csv(root)
    schema = "doc_id long, text string, source string, n_chars long"
    df = readers.category_from_path(readers.read_csv(spark, root, schema, recursive=True), r"/lang=([^/]+)/")
    return df.groupBy("category").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@q
def csv_quarantine(spark, d):
    """S3: merge a folder of crawl pages where some files do not fit the schema
    (events rows read with the documents schema); bad records are quarantined,
    never dropped silently, and the inputs are never deleted."""
    root = scratch_path(spark, "csv_quarantine")
    sinks.export_csv(ad.table(spark, d, "documents"), f"{root}/pages_a")
    sinks.export_csv(ad.table(spark, d, "events"), f"{root}/pages_b")
    good, bad = readers.read_csv_quarantine(spark, root, DOC_SCHEMA)
    return (good.select(F.lit("good").alias("kind")).unionByName(bad.select(F.lit("quarantined").alias("kind")))
            .groupBy("kind").agg(F.count(F.lit(1)).alias("n")))


@q
def json_roundtrip(spark, d):
    root = scratch_path(spark, "json_roundtrip")
    ad.table(spark, d, "documents").write.json(root)
    return readers.read_json(spark, root, DOC_SCHEMA).select("doc_id", "lang", "n_chars", "text")


@q
def whole_text_sizes(spark, d):
    root = scratch_path(spark, "whole_text")
    ad.table(spark, d, "documents").select("source", "text").write.partitionBy("source").text(root)
    files = readers.read_whole_text(spark, root)
    src = F.regexp_extract("path", r"/source=([^/]+)/", 1)
    return files.groupBy(src.alias("source")).agg(F.sum(F.length("content")).cast("long").alias("n_chars"))


@q
def line_counts(spark, d):
    path = scratch_path(spark, "line_counts")
    ad.table(spark, d, "documents").select("source", "text").write.partitionBy("source").text(path)
    return readers.line_counts(spark, path, by="source")


@q
def file_inventory(spark, d):
    """Inventory of the text files written per source folder; bytes per folder
    and extension (file contents are never read: binaryFile with pruned content)."""
    root = scratch_path(spark, "file_inventory")
    ad.table(spark, d, "documents").select("source", "text").write.partitionBy("source").text(root)
    inv = readers.file_inventory(spark, root, suffixes=[".txt"])
    src = F.regexp_extract("path", r"/source=([^/]+)/", 1)
    return inv.groupBy(src.alias("source"), "ext").agg(F.sum("length").cast("long").alias("bytes"))


@q
def ext_counts(spark, d):
    """Files per extension of a folder with one file per language, and per source, and one more per source."""
    root = scratch_path(spark, "ext_counts")
    docs = ad.table(spark, d, "documents")
    for key, fmt in (("lang", "json"), ("source", "csv")):
        # one task per value writes one file into the value's folder
        docs.select("doc_id", key).repartition(1, key).write.partitionBy(key).format(fmt).save(f"{root}/{fmt}")
    inv = readers.file_inventory(spark, root, suffixes=[".json", "csv"])
    return readers.extension_counts(inv).select("ext", "n_files")


@q
def read_lines(spark, d):
    """One stripped string per line."""
    path = scratch_path(spark, "read_lines")
    ad.table(spark, d, "documents").select(F.concat(F.lit("  "), F.col("source"), F.lit("\t"))).write.text(path)
    return readers.read_lines(spark, path)


@q
def category_file(spark, d):
    """Category from the file name."""
    root = scratch_path(spark, "category_file")
    path = sinks.write_table(ad.table(spark, d, "documents").select("doc_id"), f"{root}/docs", None)
    f = readers.category_from_file(spark.read.parquet(path))
    return f.groupBy(F.col("category").startswith("part-").alias("named")).agg(F.count(F.lit(1)).alias("n"))


@q
def append_batches(spark, d):
    """Batches appended under their ids; a replayed batch replaces itself."""
    path = scratch_path(spark, "append_batches")
    o = ad.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for i, status in enumerate("FOPF"):
        sinks.append_batch(o.filter(F.col("o_orderstatus") == status), path, i % 3)
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", F.col("batch_id").cast("long").alias("batch_id"))


@q
def patch_line_numbers(spark, d):
    """Line numbers of added and deleted lines from multi-hunk patches."""
    x = ex.patch_line_numbers(pages.patches(spark, d), ["commit_link"])
    lines = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return x.select("commit_link", lines("added_lines"), lines("deleted_lines"))


def _rule_names():
    return [n for n, _ in filters.rule_hits()]


@q
def rule_order(spark, d):
    """what each rule removes first, alone and exclusively, in the given order and in the reverse one, from one count per mask."""
    names = _rule_names()
    counts = filters.mask_counts(filters.rule_masks(ad.commits(spark, d)))
    both = [filters.removed_first(counts, names, order).withColumn("rule_order", F.lit(label)) for label, order in (("given", names), ("reverse", names[::-1]))]
    return both[0].unionByName(both[1])


@q
def rule_of_rows(spark, d):
    """which rule removes which row."""
    masked = filters.rule_masks(ad.commits(spark, d))
    rule = filters.first_rule(F.col("rule_mask"), _rule_names(), _rule_names())
    return masked.select("commit_link", "commit_title", rule.alias("rule")).where("rule is not null")


@q
def csv_unreadable(spark, d):
    """S3: a folder with good, truncated, binary and wrongly encoded files: the good rows, and every bad file with its state."""
    root = scratch_path(spark, "csv_unreadable")
    docs = ad.table(spark, d, "documents").select("doc_id", "lang", "text")
    part = lambda lang: docs.filter(F.col("lang") == lang)
    for lang in ("en", "es"):
        sinks.export_csv(part(lang), f"{root}/in/{lang}")
    # a mark in every row, so that every file of the folder is a bad one
    part("fr").select("doc_id", F.concat("lang", F.lit("\u00e9")).alias("lang"), "text").write.options(header="true", encoding="ISO-8859-1").csv(f"{root}/in/fr")
    part("de").select("doc_id", F.concat(F.lit("d\x00"), "lang").alias("lang"), "text").write.options(header="true").csv(f"{root}/in/de")
    part("en").write.options(header="true", compression="gzip").csv(f"{root}/whole")
    sinks.cut_copy(spark, f"{root}/whole", f"{root}/in/cut", 0.5)
    good, bad = readers.read_csv_tolerant(spark, f"{root}/in", docs.schema)
    kind = F.regexp_extract("path", r"/in/([a-z]+)/", 1)
    return (good.select("doc_id", "lang", F.lit("ok").alias("status"))
            .unionByName(bad.select(F.lit(None).cast("long").alias("doc_id"), kind.alias("lang"), "status").distinct()))


@q
def batch_plan(spark, d):
    """Batches bounded by rows and prompt words, worked off in two runs with a stop in between."""
    path = scratch_path(spark, "batch_plan")
    docs = ad.table(spark, d, "documents").select("doc_id", "text")
    ledger = batches.BatchLedger(spark, f"{path}/ledger")
    ledger.plan(batches.plan_batches(docs, "doc_id", "text", 100, 10_000), "text")
    score = lambda df: df.select("doc_id", "batch_id", scoring.lexicon_answer("text").alias("answer"))
    ledger.run(score, f"{path}/out", limit=3)
    ledger.run(score, f"{path}/out")
    return spark.read.parquet(f"{path}/out").select("doc_id", F.col("batch_id").cast("long").alias("batch_id"), "answer")


# --- streaming ----------------------------------------------------------------

def _stage_files(df: DataFrame, path: str, copies: int = 1) -> None:
    """Write ``df`` as arriving files (each copy is a separate delivery)."""
    for i in range(copies):
        df.write.mode("append").parquet(path)


def _ingested(spark: SparkSession, d: str) -> str:
    """Two deliveries: two thirds of the events, twice; then all of them, so that it brings repeats and new rows of any age."""
    root = scratch_path(spark, "stream_ingest")
    e = ad.table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    first = e.filter(F.col("event_id") % 3 < 2)
    for delivery, copies in ((first, 2), (e, 1)):
        _stage_files(delivery, f"{root}/in", copies)
        inc.ingest_dedup(spark, f"{root}/in", e.schema, ["event_id"], f"{root}/out", f"{root}/ckpt", event_time="ts", delay="31 days")
    return f"{root}/out"


@q
def stream_ingest_dedup(spark, d):
    """Every event once, whatever comes again and however late."""
    return spark.read.parquet(_ingested(spark, d)).drop("batch_id")


@q
def stream_ingest_report(spark, d):
    """What each delivery brought: repeats, accepted rows, late rows."""
    return inc.ingest_report(spark, _ingested(spark, d)).drop("max_event")


@q
def stream_score_resume(spark, d):
    root = scratch_path(spark, "stream_score")
    docs = ad.table(spark, d, "documents").select("doc_id", "text")
    _stage_files(docs, f"{root}/in", copies=2)

    def score(df):
        return df.select("doc_id", scoring.lexicon_answer("text").alias("answer"))

    inc.score_resume(spark, f"{root}/in", docs.schema, "doc_id", f"{root}/out", f"{root}/ckpt", score)
    return spark.read.parquet(f"{root}/out").select("doc_id", "answer")


@q
def stream_page_links(spark, d):
    root = scratch_path(spark, "stream_pages")
    pages = ad.table(spark, d, "pages")
    _stage_files(pages, f"{root}/in", copies=2)  # every page delivered twice
    inc.parse_resume(spark, f"{root}/in", pages.schema, "page_id", f"{root}/out", f"{root}/ckpt", ex.page_links)
    return spark.read.parquet(f"{root}/out").drop("batch_id")


@q
def stream_label_counts(spark, d):
    """R4 for A5: label counts kept up to date while classification answers arrive
    (every answer delivered twice; a commit counts once)."""
    from commitlens.functions.answers import parse_class_answer

    root = scratch_path(spark, "stream_labels")
    answers = ad.answers(spark, d)
    _stage_files(answers, f"{root}/in", copies=2)
    inc.running_item_counts(spark, f"{root}/in", answers.schema, "commit_link",
                            lambda: parse_class_answer("answer")["pi_types"], f"{root}/out", f"{root}/ckpt")
    return inc.latest_item_counts(spark, f"{root}/out")


@q
def stream_funnel(spark, d):
    """R4 for A1: the funnel while verdicts arrive and change: three deliveries, later ones change rows that were counted before."""
    root = scratch_path(spark, "stream_funnel")
    li = ad.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")
    parts = [F.col("l_orderkey") % 3 < 2, F.col("l_orderkey") % 3 >= 1, F.col("l_orderkey") % 5 == 0]
    scored = F.col("l_returnflag") != "N"
    positive = scored & ((F.col("l_quantity") + 10 * F.col("delivery")) % 50 > 25)
    stages = [("crawled", F.lit(True)), ("heuristic", scored), ("positive", positive)]
    for i, part in enumerate(parts):
        delivery = li.filter(part).withColumn("delivery", F.lit(i))
        _stage_files(delivery, f"{root}/in")
        rf.running_funnel(spark, f"{root}/in", delivery.schema, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "delivery", stages, f"{root}/out", f"{root}/ckpt",
                          cap=("capped", "positive", 2), buckets=16)
    return rf.current_funnel(spark, f"{root}/out")


@q
def update_in_place(spark, d):
    """The table that is read is the table that is updated: verdicts overwritten, then missing comments filled."""
    table = VersionedTable(spark, scratch_path(spark, "versioned"), ["o_orderkey"], 16)
    o = ad.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(None).cast("string").alias("note"))
    table.create(o)
    li = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"), F.col("l_returnflag").alias("note"))
    table.update(li.filter(F.col("o_orderkey") % 7 == 0), ["o_orderstatus"])
    table.update(li.filter(F.col("o_orderkey") % 3 == 0), ["note"], prefer_new=False)
    return table.read()


@q
def stream_counts(spark, d):
    root = scratch_path(spark, "stream_counts")
    e = ad.table(spark, d, "events").select("ts", "event_type")
    _stage_files(e, f"{root}/in")
    inc.running_counts(spark, f"{root}/in", e.schema, "ts", "event_type", f"{root}/out", f"{root}/ckpt",
                       delay="31 days")
    out = inc.latest_counts(spark, f"{root}/out", "event_type")
    return out.select("window_start", "event_type", "n")
