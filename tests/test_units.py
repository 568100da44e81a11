"""Unit tests on small literals: quirks, golden answer rows, properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from commitlens.functions import text as tx
from commitlens.functions.answers import (parse_class_answer, parse_filter_answer, taxonomy_categories,
                                          taxonomy_unmapped)
from commitlens.operators import aggregates as agg
from commitlens.operators import dedup, filters, prompts, releases, sampling, verify
from commitlens.operators.asof import asof_join
from commitlens.session import scratch_path
from commitlens.sources import readers, sinks
from commitlens.streaming import incremental as inc


def one(spark, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}")


def ev(spark, value, expr, typ="string"):
    return one(spark, value, typ).select(expr.alias("y")).first()["y"]


# --- expressions ----------------------------------------------------------------

@pytest.mark.parametrize("s,expected", [("", False), ("abc\n", True), ("café", False), ("abc ", False),
                                        ("tab\tok", True)])
def test_is_ascii(spark, s, expected):
    assert ev(spark, s, tx.is_ascii("x")) is expected


def test_words_between_missing_delimiters(spark):
    assert ev(spark, "a###X b c", tx.after_last_until("x", "###X", "\n###Y")) == " b c"
    assert ev(spark, "plain", tx.after_last_until("x", "###X", "\n###Y")) == "plain"


@pytest.mark.parametrize("s", ["", "a", "a\n", "a\n\n", "a\r\nb", "a\rb\x0bc", "x y\n", "\n"])
def test_indent_equals_python_splitlines(spark, s):
    expected = "\n".join("\t" + line for line in s.splitlines())
    assert ev(spark, s, tx.indent_lines("x", 1)) == expected


def test_version_normalisation(spark):
    assert ev(spark, "v12", tx.normalized_version("x")) is None
    assert ev(spark, "Release 1.2.3", tx.normalized_version("x")) == "1.2.3"


def test_dates(spark):
    assert str(ev(spark, "Aug 21, 2024", tx.store_date("x"))) == "2024-08-21"
    assert str(ev(spark, "Jul 3, 2024", tx.store_date("x"))) == "2024-07-03"
    assert str(ev(spark, "2023-09-04T09:52:15Z", tx.iso_date("x"))) == "2023-09-04"


def test_suffix_strip_is_not_a_charset_strip(spark):
    # Q5: a character-set strip would eat 'simple-tools' -> 'simple-tool'
    assert ev(spark, "https://github.com/a/simple-tools/commits",
              tx.strip_suffix("x", "/commits")) == "https://github.com/a/simple-tools"


def test_url_parts(spark):
    link = "https://github.com/own/repo/commit/abc123"
    assert ev(spark, link, tx.project_link("x")) == "https://github.com/own/repo"
    assert ev(spark, link, tx.owner_repo_key("x")) == "own___repo"
    assert ev(spark, link, tx.short_commit_key("x")) == "repo/commit/abc123"


@pytest.mark.parametrize("path,ext", [("a/b.txt", ".txt"), ("a/.gitignore", ""), ("x..b", ".b"), ("a.", "."),
                                      ("noext", "")])
def test_file_extension_like_splitext(spark, path, ext):
    assert ev(spark, path, tx.file_extension("x")) == ext


# --- answers (golden rows in the documented formats) -----------------------------

FILTER_YES = "###Is_Perf_Optimization\n    Yes\n\n\n###Performance_Issue_Type\n    resource leak"
FILTER_NO = "###Is_Perf_Optimization\n    No\n\n\n###Performance_Issue_Type\n    N/A"
CLASS_1 = ("###Optimized_Performance_Issue_Type\n    [Energy Consumption, Memory Consumption]\n\n\n"
           "###Root_Causes\n    [resource leak]")


def test_filter_answer_golden(spark):
    p = ev(spark, FILTER_YES, parse_filter_answer("x"))
    assert (p.is_perf, p.issue_type, p.bad_format, p.positive) == ("Yes", "resource leak", False, True)
    p = ev(spark, FILTER_NO, parse_filter_answer("x"))
    assert (p.is_perf, p.positive) == ("No", False)


def test_bad_format_counts_as_positive(spark):  # Q4
    p = ev(spark, "I think yes", parse_filter_answer("x"))
    assert p.bad_format and p.positive and p.issue_type == "Not Match Format"


def test_class_answer_golden(spark):
    p = ev(spark, CLASS_1, parse_class_answer("x"))
    assert p.pi_types == ["Energy Consumption", "Memory Consumption"]
    assert p.root_causes == ["resource leak"] and not p.is_na


def test_class_answer_na_marker_and_padding(spark):
    na = CLASS_1.replace("Energy Consumption, Memory Consumption", "N/A")
    p = ev(spark, na, parse_class_answer("x"))
    assert p.is_na and p.pi_types == ["N/A"]
    padded = CLASS_1.replace("Energy Consumption, Memory Consumption", "Build Time, N/A")
    p = ev(spark, padded, parse_class_answer("x"))
    assert p.pi_types == ["Build Time", "N/A"]  # ' N/A' is padded, so it is kept


def test_taxonomy_keeps_duplicates_and_reports_unknown(spark):  # Q10, Q11
    df = spark.createDataFrame([(["Efficiency", "Responsiveness", "Security", "Unheard Of"],)], "x array<string>")
    r = df.select(taxonomy_categories("x").alias("c"), taxonomy_unmapped("x").alias("u")).first()
    assert r.c == ["Responsiveness", "Responsiveness"] and r.u == ["Unheard Of"]
    with pytest.raises(Exception):
        df.select(taxonomy_categories("x", strict=True)).collect()


# --- prompts -------------------------------------------------------------------

def test_prompt_slot_in_title_does_not_leak(spark):  # Q9
    df = spark.createDataFrame([("fix #{}# bug", "desc")], "t string, d string")
    m = df.select(prompts.chat_prompt("t", "d", "sys").alias("m")).first().m
    assert m[-1].content == "###Commit_Title\n\tfix #{}# bug\n\n\n###Commit_Description\n\tdesc"
    assert [x.role for x in m] == ["system", "user"]


def test_render_diffs_format(spark):
    df = spark.createDataFrame([([("a.java", "@@ -1 +1 @@\n-x\n+y")],)],
                               "f array<struct<file_name:string,patch:string>>")
    got = df.select(prompts.render_diffs("f").alias("r")).first().r
    assert got == "file 1{\n\tfile name: a.java\n\tpatch:\n\t\t@@ -1 +1 @@\n\t\t-x\n\t\t+y\n}\n"


# --- filters, dedup, aggregates -------------------------------------------------

COMMITS = [("l1", "Update README.md", None), ("l2", "update readme.md", "why"), ("l3", "version 1.2", None),
           ("l4", "Fix leak", None), ("l5", "Fix café", None), ("l6", None, "only description"),
           ("l7", "None", None), ("l8", "Merge branch 'dev'", None), ("l9", "Speed up", "résumé")]


def commits_df(spark):
    return spark.createDataFrame(COMMITS, "commit_link string, commit_title string, commit_description string")


def test_heuristic_filter_rows_and_idempotence(spark):
    df = commits_df(spark)
    once = filters.heuristic_filter(df)
    assert sorted(r.commit_link for r in once.collect()) == ["l2", "l4", "l7"]
    assert sorted(once.collect()) == sorted(filters.heuristic_filter(once).collect())


def test_first_per_key_hot_key(spark):
    rows = [("hot", i, f"v{i}") for i in range(3000)] + [("cold", 5, "c")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    out = {r.k: r.v for r in dedup.first_per_key(df, ["k"], ["o"]).collect()}
    assert out == {"hot": "v0", "cold": "c"}


def test_fanout_cap_and_histogram(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "commit_link string")
    assert {r.commit_link for r in filters.fanout_cap(df).collect()} == {"b"}
    assert sorted(tuple(r) for r in agg.count_histogram(df, "commit_link").collect()) == [(2, 1), (6, 1)]


def test_kappa_matches_formula(spark):
    a = [0, 1, 2, 1, 0, 2, 2, 1, 0, 0]
    b = [0, 1, 1, 1, 0, 2, 0, 1, 0, 2]
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    n = len(a)
    po = sum(x == y for x, y in zip(a, b)) / n
    pe = sum(a.count(c) * b.count(c) for c in set(a) | set(b)) / n ** 2
    got = agg.cohen_kappa(df, "a", "b").first().kappa
    assert math.isclose(got, (po - pe) / (1 - pe), rel_tol=1e-12)


def test_sample_sizes_published_values(spark):
    df = spark.createDataFrame([(n,) for n in [1, 10, 100, 1000, 14467]], "n long")
    got = [r.s for r in df.select(sampling.sample_size(F.col("n")).alias("s")).collect()]
    assert got == [1, 10, 80, 278, 375]


@pytest.mark.parametrize("margins", [(6.0, 20.0), (0.0, 0.0), (-3.0, 0.0)])
def test_stratified_sample_prefilter_is_exact_on_skewed_strata(spark, margins):
    # zero / negative margins make level 0 fall short, so higher levels are used
    rows = [(i, "hot") for i in range(20000)] + [(i, f"s{i % 7}") for i in range(700)]
    df = spark.createDataFrame(rows, "k long, s string")
    got = sorted(tuple(r) for r in sampling.stratified_sample(
        df, "k", "s", seed="7", margin_sigmas=margins[0], margin_rows=margins[1]).collect())
    # brute force: full ranking per stratum by the same hash
    h = F.md5(F.concat_ws("|", F.col("k").cast("string"), F.col("s"), F.lit("7")))
    sizes = {r.s: r.sample_size for r in sampling.sample_sizes(df, "k", "s").collect()}
    full = {}
    for r in df.select("k", "s", h.alias("h")).collect():
        full.setdefault(r.s, []).append((r.h, r.k))
    want = sorted((k, s, i + 1) for s, lst in full.items() for i, (_, k) in enumerate(sorted(lst)[:sizes[s]]))
    assert got == want


# --- as-of join: property vs brute force ----------------------------------------

def brute_asof(left, right, strict):
    out = {}
    for lk, lid, lt in left:
        cands = [(rt, rid) for rk, rid, rt in right if rk == lk and (rt < lt if strict else rt <= lt)]
        out[lid] = max(cands)[1] if cands else None
    return out


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_asof_equals_brute_force(spark, strict, kind):
    import datetime as dt
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)

    def t(x):
        v = base + dt.timedelta(hours=x * 7, minutes=x % 5)
        return v.date() if kind == "date" else v
    # key 0 is hot: a third of all rows; many equal times to exercise ties
    left = [(rnd.choice([0, 0, 1, 2, 3]), i, t(rnd.randint(0, 60))) for i in range(400)]
    right = [(rnd.choice([0, 0, 1, 2, 4]), 1000 + i, t(rnd.randint(0, 60))) for i in range(300)]
    L = spark.createDataFrame(left, f"k int, lid int, lt {kind}")
    R = spark.createDataFrame(right, f"k int, rid int, rt {kind}")
    got = {r.lid: r.rid for r in asof_join(L, R, ["k"], "lt", "rt", strict=strict, how="left",
                                            tie_break=["rid"]).collect()}
    assert got == brute_asof(left, right, strict)


def test_asof_inner_drops_unmatched(spark):
    L = spark.createDataFrame([(1, 1, "2024-01-02"), (1, 2, "2024-01-01")], "k int, lid int, lt string") \
        .withColumn("lt", F.to_date("lt"))
    R = spark.createDataFrame([(1, 9, "2024-01-01")], "k int, rid int, rt string").withColumn("rt", F.to_date("rt"))
    got = [(r.lid, r.rid) for r in asof_join(L, R, ["k"], "lt", "rt").collect()]
    assert got == [(1, 9)]  # strict: the same-day release does not count for lid 2


# --- releases -------------------------------------------------------------------

def test_gap_fill_no_version_from_both_sources(spark):
    a = spark.createDataFrame([("g", "c1", "Release 1.2")], "git_link string, commit_link string, apk_version string")
    b = spark.createDataFrame([("g", "c2", "1.2"), ("g", "c3", "1.3"), ("g", "c4", "v1.4")],
                              "git_link string, commit_link string, apk_version string")
    both = a.withColumn("source", F.lit("release")).unionByName(b.withColumn("source", F.lit("store")))
    out = releases.gap_fill(both).collect()
    assert sorted((r.commit_link, r.source) for r in out) == [("c1", "release"), ("c3", "store")]


def test_asset_choice(spark):
    rows = [("g", "1.0", "z.apk", "L1"), ("g", "1.0", "mobile.apk", "L2"), ("g", "1.0", "html.zip", "L3"),
            ("g", "1.0", "src-long.zip", "L4"), ("g", "2.0", "ab.apk", "L5"), ("g", "2.0", "html.zip", "L6")]
    df = spark.createDataFrame(rows, "git_link string, apk_version string, download_file_name string, "
                                     "download_link string").withColumn("release_date", F.current_date())
    f = {r.apk_version: r for r in releases.version_facts(df).collect()}
    assert f["1.0"].apk_download_link == "L2" and f["1.0"].source_code_download_link == "L4"
    assert f["2.0"].apk_download_link == "L5" and f["2.0"].source_code_download_link == "L6"


# --- verification ---------------------------------------------------------------

def test_verify(spark):
    snap = spark.createDataFrame([
        ("c1", "before", "a.java", "x\n  keep me\ny"), ("c1", "release", "a.java", "keep me here"),
        ("c1", "before", "b.java", "same"), ("c1", "release", "b.java", "same"),
        ("c2", "before", "a.java", "x\ngone"), ("c2", "release", "a.java", "x"),
        ("c3", "before", "a.java", "x")], "commit_link string, side string, path string, content string")
    ch = spark.createDataFrame([("c1", "a.java", [2]), ("c1", "b.java", []), ("c2", "a.java", [2]),
                                ("c3", "a.java", [5])], "commit_link string, path string, deleted_lines array<int>")
    got = {r.commit_link: (r.check, r.n_skipped) for r in verify.verify_commits(ch, snap).collect()}
    assert got == {"c1": ("same", 0), "c2": ("different", 0), "c3": ("different", 0)}


# --- sources and streams --------------------------------------------------------

def test_csv_multiline_roundtrip_and_pandas_nulls(spark):
    path = scratch_path(spark, "unit_csv")
    df = spark.createDataFrame([(1, 'line1\nline2 "quoted"', "  padded  "), (2, "None", "x")],
                               "id long, a string, b string")
    sinks.export_csv(df, path)
    back = readers.read_csv(spark, path, "id long, a string, b string")
    assert sorted(back.collect()) == sorted(df.collect())
    nulls = readers.read_csv(spark, path, "id long, a string, b string", pandas_nulls=True)
    assert {r.id: r.a for r in nulls.collect()}[2] is None  # Q1


def test_stream_rerun_reads_nothing_new(spark):
    root = scratch_path(spark, "unit_stream")
    df = spark.createDataFrame([(i, f"v{i % 3}") for i in range(50)], "id long, v string")
    df.write.parquet(f"{root}/in")
    df.write.mode("append").parquet(f"{root}/in")  # re-delivered copy
    args = (spark, f"{root}/in", df.schema, ["id"], f"{root}/out", f"{root}/ckpt")
    inc.ingest_dedup(*args)
    first = spark.read.parquet(f"{root}/out").count()
    inc.ingest_dedup(*args)
    assert first == 50 and spark.read.parquet(f"{root}/out").count() == 50


def test_read_lines_missing_file_is_empty(spark):
    assert readers.read_lines(spark, "/tmp/does-not-exist-commitlens/x.txt").count() == 0


# --- extraction on fixed page shapes ---------------------------------------------

def test_page_extractors(spark):
    from commitlens.operators import extract as ex
    html = ('<html><a href="/a/b">Older</a><a class="x" href="https://h.io/c">  Source Code </a>'
            '<relative-time class="t" datetime="2024-05-01T10:00:00Z">May 1</relative-time>'
            '<a href="https://github.com/o/r/releases">Changelog</a><a href="/m.yml">Build Metadata</a></html>')
    pages = spark.createDataFrame([(1, "https://f.example/en/packages/", html)], "page_id long, url string, html string")
    links = [(r.href, r.abs_url) for r in ex.page_links(pages).orderBy("pos").collect()]
    assert links[0] == ("/a/b", "https://f.example/a/b") and links[1] == ("https://h.io/c", "https://h.io/c")
    r = pages.select(ex.link_by_anchor("html", "Source Code").alias("s"), ex.machine_time("html").alias("t"),
                     ex.changelog_links("html", F.lit("https://github.com/o/r")).alias("c")).first()
    assert r.s == "https://h.io/c" and str(r.t) == "2024-05-01 10:00:00" and r.c.valid
    anchors = ex.page_anchors(spark.createDataFrame(
        [(1, '<a href="/o/r/commit/abc">Fix it</a><a href="/o/r/commit/def">Initial commit</a>')],
        "page_id long, html string"))
    assert [(c.commit_hash, c.anchor_text) for c in ex.commit_list(anchors).collect()] == [("abc", "Fix it")]


def test_version_header_and_category(spark):
    from commitlens.operators import extract as ex
    h = "Version 1.4.2 (142) suggested Added on Aug 21, 2024"
    r = one(spark, h).select(ex.version_header("x").alias("v")).first().v
    assert (r.version, r.code, r.added_on) == ("1.4.2", "142", "Aug 21, 2024")
    assert ev(spark, "https://f.example/en/categories/games/", ex.category_from_url("x")) == "games"
    assert ev(spark, "1,234 commits", tx.digits_number("x")) == 1234


def test_diff_json_and_hunks(spark):
    from commitlens.operators import extract as ex
    js = '{"commit": {"message": "m"}, "files": [{"filename": "a", "patch": "@@ -3,2 +4,5 @@ x\\n@@ -10 +12 @@"}]}'
    r = one(spark, js).select(ex.diff_json("x").alias("d")).first().d
    assert r.message == "m" and r.files[0].filename == "a"
    h = one(spark, r.files[0].patch).select(ex.hunk_starts("x").alias("h")).first().h
    assert (h.old_starts, h.new_starts) == ([3, 10], [4, 12])


def test_first_between_dotall(spark):
    assert ev(spark, "a<x>1\n2</x><x>3</x>", tx.first_between("x", "<x>", "</x>")) == "1\n2"


def test_csv_quarantine_and_inventory(spark, tmp_path_factory):
    root = scratch_path(spark, "unit_quarantine")
    good = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string")
    bad = spark.createDataFrame([("x1", "c")], "id string, v string")
    sinks.export_csv(good, f"{root}/good")
    sinks.export_csv(bad, f"{root}/nested/bad")
    ok, quarantined = readers.read_csv_quarantine(spark, root, "id long, v string")
    assert sorted(tuple(r) for r in ok.collect()) == [(1, "a"), (2, "b")]
    assert quarantined.count() == 1
    inv = readers.file_inventory(spark, root, suffixes=[".csv"])
    counts = {r.ext: r.n_files for r in readers.extension_counts(inv).collect()}
    assert counts == {".csv": inv.count()} and inv.count() >= 2


def test_time_queries_do_not_depend_on_session_zone(spark):
    """Buckets and stream windows read TIMESTAMP_NTZ wall clocks zone-free."""
    import __spark_entry__ as entry
    from tests.oracle_compare import compare, duck

    con = duck("/root/testdata/sf0.01")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        for name in ("asof_events", "stream_counts"):
            res = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], "/root/testdata/sf0.01")
            assert res["ok"], res
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_score_resume_rerun_and_new_delivery(spark):
    root = scratch_path(spark, "unit_resume")
    df = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    df.write.parquet(f"{root}/in")
    df.write.mode("append").parquet(f"{root}/in")  # duplicate delivery

    def score(x):
        return x.select("doc_id", F.upper("text").alias("answer"))

    args = (spark, f"{root}/in", df.schema, "doc_id", f"{root}/out", f"{root}/ckpt", score)
    inc.score_resume(*args)
    inc.score_resume(*args)  # rerun on the same checkpoint: nothing new
    assert spark.read.parquet(f"{root}/out").count() == 30
    more = spark.createDataFrame([(i, f"text {i}") for i in range(25, 40)], "doc_id long, text string")
    more.write.mode("append").parquet(f"{root}/in")
    inc.score_resume(*args)
    out = spark.read.parquet(f"{root}/out")
    assert out.count() == 40 and out.select("doc_id").distinct().count() == 40


COMMIT_PAGE = """<div class="commit-desc"><pre>Avoid  <b>leak</b></pre></div>
<div class="js-diff-progressive-container">
<copilot-diff-entry data-file-path="src/A.java"><table>
<tr class="show-top-border"><td data-line-number="10"></td><td data-line-number="11"></td><td class="blob-code blob-code-deletion">-old();</td></tr>
<tr class="show-top-border"><td data-line-number="11"></td><td data-line-number="12"></td><td class="blob-code blob-code-addition">+new();</td></tr>
<tr class="show-top-border"><td data-line-number="12"></td><td data-line-number="13"></td><td class="blob-code">ctx</td></tr>
</table></copilot-diff-entry>
<copilot-diff-entry data-file-path="B.md"><table>
<tr class="show-top-border"><td></td><td data-line-number="1"></td><td class="blob-code blob-code-addition">+doc</td></tr>
</table></copilot-diff-entry></div>"""

RELEASE_PAGE = """<section><h2 class="sr-only">v2.0</h2><span class="Label">Pre-release</span>
<ul><li><a href="/o/r/releases/download/v2.0/app.apk">app.apk</a><relative-time datetime="2024-02-01T00:00:00Z"></relative-time></li></ul></section>
<section><h2 class="sr-only">v1.9</h2><ul>
<li><a href="/o/r/releases/download/v1.9/app-universal-release.apk">x</a><relative-time datetime="2024-01-05T10:00:00Z"></relative-time></li>
<li><a href="/o/r/archive/v1.9.zip">zip</a><relative-time datetime="2024-01-05T10:00:00Z"></relative-time></li>
<li>no link</li></ul></section>"""


def test_commit_page_files(spark):
    from commitlens.operators import extract as ex
    pages = spark.createDataFrame([(1, COMMIT_PAGE)], "page_id long, html string")
    rows = ex.commit_page_files(pages).orderBy("file_pos").collect()
    assert [(r.commit_diff_file, r.added_lines, r.deleted_lines) for r in rows] == [
        ("src/A.java", [12], [10]), ("B.md", [1], [])]
    assert rows[0].commit_diff == "-old();+new();ctx" and rows[0].commit_description == "Avoid  leak"


def test_release_assets_from_page(spark):
    from commitlens.operators import extract as ex
    pages = spark.createDataFrame([(1, RELEASE_PAGE)], "page_id long, html string")
    rows = ex.release_assets_from_page(pages).collect()
    assert sorted((r.apk_version, r.download_file_name, r.apk_release_time) for r in rows) == [
        ("v1.9", "app-universal-release.apk", "2024-01-05T10:00:00Z"), ("v1.9", "v1.9.zip", "2024-01-05T10:00:00Z")]
    assert str(rows[0].apk_release_time[:10]) == "2024-01-05"


def test_small_helpers(spark):
    df = spark.createDataFrame([("a", "x/b.apk"), ("a", "x/zz"), ("a", "x/y"), ("b", "q.1")], "g string, path string")
    assert {r.g: r.path for r in dedup.shortest_path(df, "g").collect()} == {"a": "x/y"}
    files = spark.createDataFrame([("r/is_perf_detect_result_500.csv",), ("r/is_perf_detect_result_1500.csv",)], "p string")
    assert dedup.max_number_in(files, "p").first().max_batch == 1500  # W7
    keys = spark.createDataFrame([(i,) for i in range(20)], "k long")
    a = [r.k for r in dedup.seeded_order(keys, "k", "1").collect()]
    assert a == [r.k for r in dedup.seeded_order(keys, "k", "1").collect()] and sorted(a) == list(range(20))  # O2
    u = dedup.union_all([keys.limit(3), keys.limit(2).withColumn("extra", F.lit(1))])
    assert u.columns == ["k", "extra"] and u.count() == 5  # U1
    assert dedup.key_difference(keys, keys.filter("k < 15"), "k").count() == 5  # U2
    assert dedup.key_union(keys.filter("k < 5"), keys.filter("k < 8"), "k").count() == 8


def test_append_batch_replaces_a_replayed_batch(spark):
    root = scratch_path(spark, "unit_append")
    df = spark.createDataFrame([(1,)], "x long")
    sinks.append_batch(df, root, 0)
    sinks.append_batch(df, root, 1)
    sinks.append_batch(df, root, 1)
    assert sorted(r.batch_id for r in spark.read.parquet(root).collect()) == [0, 1]


def test_no_machine_local_scratch_on_a_cluster():
    from types import SimpleNamespace as Fake
    from commitlens.session import checkpoint_root
    sc = Fake(getConf=lambda: {}, getCheckpointDir=lambda: None, master="local-cluster[2,1,1024]")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(Fake(sparkContext=sc))


def test_lookup_sides_are_made_unique(spark):
    from commitlens.operators import joins
    df = spark.createDataFrame([("a", None, 1), (None, "x", 2), ("b", "y", 3)], "t string, d string, n int")
    v = spark.createDataFrame([("a", None, 5), ("a", None, 4), (None, "x", 6)], "t string, d string, v int")
    got = sorted(map(tuple, joins.propagate(df, v, ["t", "d"], ["v"], how="left").collect()), key=str)
    assert got == sorted([("a", None, 1, 4), (None, "x", 2, 6), ("b", "y", 3, None)], key=str)
    lk = spark.createDataFrame([(1, 7), (1, 8)], "n int, v int")
    out = joins.fill_from(df.withColumn("v", F.lit(None).cast("int")), lk, ["n"], "v").collect()
    assert sorted((r.n, r.v) for r in out if r.v) == [(1, 7)] and len(out) == 3


def _raises_on(word):
    from commitlens.operators import scoring
    return scoring.Refusing(scoring.LexiconScorer(), word)


def test_fallback_catches_errors_per_row(spark):
    from commitlens.operators import scoring
    texts = ["slow boom", "fine", "memory leak", "boom", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    native = {r.t: r.a for r in df.select("t", scoring.lexicon_answer("t").alias("a")).collect()}
    out = {r.t: r for r in scoring.score_with_fallback(df, "t", _raises_on("boom")).collect()}
    assert {t: r.answer for t, r in out.items()} == native
    assert {t: r.answered_by for t, r in out.items()} == {t: "second" if "boom" in (t or "") else "first" for t in texts}
    both = {r.t: (r.answer is None, r.answered_by) for r in scoring.score_with_fallback(df, "t", _raises_on("boom"), _raises_on("slow")).collect()}
    assert both["slow boom"] == (True, None) and both["boom"] == (False, "second") and both["fine"] == (False, "first")


def test_prompt_reaches_the_scorer(spark):
    import pandas as pd
    from commitlens.plans import jobs

    def echo(texts):
        return pd.Series(["###Is_Perf_Optimization\n    Yes\n\n\n###Performance_Issue_Type\n    " + str("system: " in t and "user: " in t and "Speed up list" in t)
                          for t in texts], index=texts.index)
    c = spark.createDataFrame([("l", "Speed up list", "why", "f")], "commit_link string, commit_title string, commit_description string, commit_diff_file string")
    r = jobs.score_commits(c, scorer=echo).first()
    assert r.parsed.issue_type == "True" and r.answered_by == "first"


def test_score_missing_in_one_pass(spark):
    from commitlens.operators import scoring
    df = spark.createDataFrame([("slow", None), ("x", "kept")], "t string, a string")
    for scorer in (None, scoring.LexiconScorer()):
        out = scoring.score_missing(df, "t", "a", scorer)
        got = {r.t: r.a for r in out.collect()}
        assert got["x"] == "kept" and "slow" in got["slow"]
        assert out._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1


def test_late_rows_are_reported(spark):
    import datetime as dt
    from commitlens.streaming import incremental as inc
    root = scratch_path(spark, "late")
    schema = "ts timestamp, g string"
    rows = [[(dt.datetime(2024, 1, d), "a")] for d in (1, 20, 2)]
    for i, r in enumerate(rows):     # one file per batch, in this order
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        inc.running_counts(spark, f"{root}/in", spark.createDataFrame([], schema).schema, "ts", "g", f"{root}/out", f"{root}/ckpt")
    late = spark.read.parquet(f"{root}/out_late")
    assert late.agg(F.sum("n_late")).first()[0] == 1
    assert sum(r.n for r in inc.latest_counts(spark, f"{root}/out", "g").collect()) == 2


def test_fallback_chain_calls_each_scorer_once_per_row(spark):
    import pandas as pd
    from commitlens.operators import scoring

    def first(texts):
        return pd.Series([None if len(t) > 3 else "A:" + t for t in texts], index=texts.index, dtype=object)

    def second(texts):
        return pd.Series(["B:" + t for t in texts], index=texts.index, dtype=object)

    df = spark.createDataFrame([("ab",), ("abcdef",)], "t string")
    out = {r.t: r.answer for r in scoring.score_with_fallback(df, "t", first, second).collect()}
    assert out == {"ab": "A:ab", "abcdef": "B:abcdef"}
    plan = scoring.score_with_fallback(df, "t", first, second)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1


# --- edge inputs ---------------------------------------------------------------

def test_edge_inputs(spark):
    import datetime as dt
    empty_r = spark.createDataFrame([], "k int, rid int, rt date")
    L = spark.createDataFrame([(1, 1, dt.date(2024, 1, 2)), (None, 2, dt.date(2024, 1, 2))], "k int, lid int, lt date")
    got = asof_join(L, empty_r, ["k"], "lt", "rt", how="left").collect()
    assert sorted((r.lid, r.rid) for r in got) == [(1, None), (2, None)]
    assert asof_join(L, empty_r, ["k"], "lt", "rt").count() == 0
    # NULL keys never match, even against NULL keys on the right
    R = spark.createDataFrame([(None, 9, dt.date(2024, 1, 1))], "k int, rid int, rt date")
    assert asof_join(L, R, ["k"], "lt", "rt").count() == 0
    # one class only: pe = 1, kappa undefined -> NULL (no division by zero)
    one_class = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert agg.cohen_kappa(one_class, "a", "b").first().kappa is None
    # a stratum smaller than its sample size is taken whole
    tiny = spark.createDataFrame([(1, "x"), (2, "x")], "k long, s string")
    assert sampling.stratified_sample(tiny, "k", "s").count() == 2
    assert sampling.stratified_sample(tiny.limit(0), "k", "s").count() == 0
    # funnel over empty stages
    e = spark.createDataFrame([], "commit_link string, f boolean")
    rows = agg.funnel_flags(e, "commit_link", [("all", F.lit(True)), ("f", F.col("f"))]).collect()
    assert [(r.stage, r.n_rows, r.n_commits) for r in sorted(rows, key=lambda r: r.stage_order)] == [
        ("all", 0, 0), ("f", 0, 0)]


def test_verify_binary_skip_and_pure_addition(spark):
    snap = spark.createDataFrame([
        ("c1", "after", "New.java", "a\nb"), ("c1", "release", "New.java", "a\nb"),
        ("c2", "before", "Old.java", "x"), ("c2", "after", "Old.java", "a\nb"), ("c2", "release", "Old.java", "a\nb"),
        ("c3", "before", "lib.so", "bin")], "commit_link string, side string, path string, content string")
    ch = spark.createDataFrame([("c1", "New.java", [], [1, 2]), ("c2", "Old.java", [], [1, 2]),
                                ("c3", "lib.so", [1], [])],
                               "commit_link string, path string, deleted_lines array<int>, added_lines array<int>")
    got = {r.commit_link: (r.check, r.n_skipped) for r in verify.verify_commits(ch, snap).collect()}
    # new file absent before -> same; "pure addition" of a file that existed -> different; binaries skipped
    assert got == {"c1": ("same", 0), "c2": ("different", 0), "c3": ("same", 1)}


# --- randomized equivalence with Python string semantics -------------------------

def _random_texts(n=400, seed=11):
    rnd = random.Random(seed)
    alphabet = list("ab c1.,-_/#") + ["\n", "\r", "\r\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", "\xa0",
                                      " ", "　", "é", "ß", "中", "😀", "Version ", "[N/A]", "###X"]
    return [''.join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def test_text_helpers_match_python_on_random_strings(spark):
    import re
    texts = _random_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    rows = df.select("i", tx.is_ascii("x").alias("a"), tx.strip_ws("x").alias("s"),
                     tx.indent_lines("x", 2).alias("ind"), tx.after_last_until("x", "###X", "c").alias("w"),
                     tx.normalized_version("x").alias("v")).collect()
    for r in rows:
        t = texts[r.i]
        assert r.a == bool(re.match(r"^[\x00-\x7F]+$", t)), repr(t)
        assert r.s == t.strip(), repr(t)
        assert r.ind == "\n".join("\t\t" + line for line in t.splitlines()), repr(t)
        assert r.w == t.split("###X")[-1].split("c")[0], repr(t)
        m = re.search(r"\d+(\.\d+)+", t)
        assert r.v == (m.group() if m else None), repr(t)


def test_recommended_conf_sizes_partitions():
    from commitlens.session import recommended_conf
    c = recommended_conf(100 * 10 ** 12, 1000, 8)
    assert int(c["spark.sql.shuffle.partitions"]) == -(-100 * 10 ** 12 // (256 << 20))
    assert int(recommended_conf(10 ** 6, 10, 4)["spark.sql.shuffle.partitions"]) == 120  # 3 waves minimum


@pytest.mark.parametrize("aqe", ["true", "false"])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_safe_join_equals_plain_join(spark, how, aqe):
    from commitlens.operators.joins import skew_safe_join
    big = spark.createDataFrame([("hot", 1, i) for i in range(40)] + [("a", 1, 1), (None, 1, 2), ("a", None, 3)],
                                "k string, j int, v int")
    small = spark.createDataFrame([("hot", 1, "H"), ("a", 1, "A"), (None, 1, "N"), ("a", None, "X")],
                                  "k string, j int, w string")
    old = spark.conf.get("spark.sql.adaptive.skewJoin.enabled")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", aqe)
    try:
        want = sorted(map(tuple, big.join(small, ["k", "j"], how).collect()), key=str)
        got = sorted(map(tuple, skew_safe_join(big, small, ["k", "j"], how).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", old)
    assert got == want


# --- property: as-of join against brute force with NULLs and ties ----------------

from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_rows = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.integers(0, 30))),
                 max_size=40)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=_rows, right=_rows, strict=st.booleans(), kind=st.sampled_from(["date", "timestamp"]))
def test_asof_property_with_nulls(spark, left, right, strict, kind):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)

    def t(x):
        if x is None:
            return None
        v = base + dt.timedelta(hours=x * 5)
        return v.date() if kind == "date" else v
    L = [(k, i, t(x)) for i, (k, x) in enumerate(left)]
    R = [(k, 1000 + i, t(x)) for i, (k, x) in enumerate(right)]
    want = {}
    for k, lid, lt in L:
        c = [(rt, rid) for rk, rid, rt in R if k is not None and rk == k and lt is not None and rt is not None
             and (rt < lt if strict else rt <= lt)]
        want[lid] = max(c)[1] if c else None
    ldf = spark.createDataFrame(L, f"k int, lid int, lt {kind}")
    rdf = spark.createDataFrame(R, f"k int, rid int, rt {kind}")
    got = {r.lid: r.rid for r in asof_join(ldf, rdf, ["k"], "lt", "rt", strict=strict, how="left",
                                            tie_break=["rid"]).collect()}
    assert got == want


_keys = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.integers(0, 5)), max_size=30)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(big=_keys, small_keys=st.lists(st.one_of(st.none(), st.integers(0, 4)), unique=True, max_size=5),
       how=st.sampled_from(["inner", "left", "left_semi", "left_anti"]), aqe=st.booleans())
def test_skew_safe_join_property(spark, big, small_keys, how, aqe):
    from commitlens.operators.joins import skew_safe_join
    b = spark.createDataFrame(big, "k int, v int")
    s = spark.createDataFrame([(k, f"w{k}") for k in small_keys], "k int, w string")
    old = spark.conf.get("spark.sql.adaptive.skewJoin.enabled")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true" if aqe else "false")
    try:
        want = sorted(map(tuple, b.join(s, "k", how).select(*b.join(s, "k", how).columns).collect()), key=str)
        got_df = skew_safe_join(b, s, ["k"], how)
        got = sorted(map(tuple, got_df.select(*b.join(s, "k", how).columns).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", old)
    assert got == want
