"""Unreadable files, patch line numbers, the line index of verification, the rule lattice, planned batches."""

import gzip
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from commitlens.operators import batches, filters, verify
from commitlens.operators import extract as ex
from commitlens.operators.numbering import row_numbers
from commitlens.session import scratch_path
from commitlens.sources import readers


def test_unreadable_files_are_listed_and_stay(spark, tmp_path):
    text = "k,v\n" + "".join(f'{i},"a ""b""\nline {i}"\n' for i in range(3000))
    whole = gzip.compress(text.encode())
    (tmp_path / "sub").mkdir()
    files = {"good.csv": text.encode(), "sub/good.csv.gz": whole, "cut.csv.gz": whole[: len(whole) // 2], "not.csv.gz": b"plain text", "latin.csv": "k,v\n1,é\n".encode("latin-1"),
             "bin.csv": b"k,v\n1,\x00\x01\n", "empty.csv": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    good, bad = readers.read_csv_tolerant(spark, str(tmp_path), "k int, v string")
    assert good.count() == 6000 and good.distinct().count() == 3000
    got = {os.path.basename(r.path): (r.length, r.status) for r in bad.collect()}
    assert {k: v[1] for k, v in got.items()} == {"cut.csv.gz": "unreadable", "not.csv.gz": "unreadable", "latin.csv": "encoding", "bin.csv": "binary"}
    assert all(n == len(files[k]) for k, (n, _) in got.items())
    assert {os.path.basename(r.path) for r in readers.file_status(spark, str(tmp_path)).where("status = 'ok'").collect()} == {"good.csv", "good.csv.gz"}
    assert all((tmp_path / name).read_bytes() == data for name, data in files.items())


def walk(patch):
    added, deleted, old, new = [], [], None, None
    for line in re.split(r"\r?\n", patch or ""):
        m = re.match(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", line)
        if m:
            old, new = int(m[1]), int(m[2])
        elif old is not None and line[:1] in (" ", "+", "-"):
            if line[0] == "+":
                added.append(new)
            if line[0] == "-":
                deleted.append(old)
            old += line[0] != "+"
            new += line[0] != "-"
    return sorted(added), sorted(deleted)


def test_patch_line_numbers(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(40):
        hunks, old, new = [], 1, 1
        for _ in range(rnd.randint(1, 5)):
            old, new = old + rnd.randint(0, 50), new + rnd.randint(0, 50)
            body = [rnd.choice([" a", "+@@ -1 +1 @@", "-b", "+", "-", " ", "+c", "\\ No newline at end of file"]) for _ in range(rnd.randint(1, 30))]
            hunks.append(f"@@ -{old},9 +{new}{rnd.choice(['', ',7'])} @@ f()\n" + "\n".join(body))
        rows.append((i, "diff --git\n--- a\n+++ b\n" * (i % 2) + "\n".join(hunks)))
    rows += [(100, None), (101, ""), (102, "+no header"), (103, "@@ -5 +9 @@"), (104, "@@ -1,2 +1,2 @@\r\n-a\r\n+b")]
    df = spark.createDataFrame(rows, "k int, patch string")
    got = {r.k: (r.added_lines, r.deleted_lines) for r in ex.patch_line_numbers(df, ["k"]).collect()}
    assert all(got.get(k, ([], [])) == walk(p) for k, p in rows)
    lines = ex.patch_lines(df.where("k = 104"), ["k"]).orderBy("pos").collect()
    assert [(r.kind, r.old_line, r.new_line, r.text) for r in lines] == [("-", 1, None, "a"), ("+", None, 1, "b")]


def test_patches_are_read_within_their_row(spark):
    """No sort of lines; context lines have both numbers; rows that share a key give one row with all numbers."""
    df = spark.createDataFrame([(1, "@@ -3 +7 @@\n a\n-b\n c\n+d\n-\n@@ -20,2 +30 @@ f\n x\n+y"), (None, "@@ -1 +1 @@\n+n"), (None, "@@ -5 +5 @@\n-o"), (2, "@@ -1 +1 @@\n\\ mark")], "k int, patch string")
    lines = ex.patch_lines(df, ["k"])
    assert "Window" not in lines._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[1:] for r in lines.where("k = 1").orderBy("pos").collect()] == [
        (0, 1, " ", 3, 7, "a"), (0, 2, "-", 4, None, "b"), (0, 3, " ", 5, 8, "c"), (0, 4, "+", None, 9, "d"), (0, 5, "-", 6, None, ""), (1, 7, " ", 20, 30, "x"), (1, 8, "+", None, 31, "y")]
    numbers = ex.patch_line_numbers(df, ["k"])
    plan = numbers._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    assert {r.k: (r.added_lines, r.deleted_lines) for r in numbers.collect()} == {1: ([9, 31], [4, 6]), None: ([1], [5])}


def test_damaged_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from commitlens.plans import queries

    rows = [(i, ("en", "es", "fr", "de")[i % 4], "plain text", "s", 10) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string, source string, n_chars long").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    try:
        got = sorted(map(tuple, queries.csv_unreadable(spark, str(tmp_path)).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted([(i, lang, "ok") for i, lang, *_ in rows if lang in ("en", "es")] + [(None, "fr", "encoding"), (None, "de", "binary"), (None, "cut", "unreadable")], key=str)
    for kind in ("in/fr", "in/de", "in/cut"):
        assert sum(f.startswith("part-") for f in os.listdir(f"{tmp_path}/csv_unreadable/{kind}")) > 1


def test_commits_stay_dealt_to_all_partitions(spark, tmp_path):
    """An order without a text matches no document, whatever its key; the wide rows are not joined up into a few tasks."""
    from commitlens.plans import adapters as ad

    spark.createDataFrame([(4, 1, "2020-01-02"), (29, 1, "2020-01-02"), (7, 2, "2020-01-02"), (None, 2, "2020-01-02")], "o_orderkey long, o_custkey long, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, n) for k in (4, 29, 7, None) for n in (1, 2)], "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0, "zero"), (1, "one"), (7, "seven"), (None, "none")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = ad.commits(spark, str(tmp_path))
    big = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for c in big:
        spark.conf.set(c, "-1")
    try:
        assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        for c in big:
            spark.conf.unset(c)
    got = sorted((r.commit_link.rsplit("/", 1)[1], r.commit_description) for r in rows.collect())
    assert got == [("29", "one")] * 2 + [("4", "zero")] * 2 + [("7", None)] * 2


def test_propagate_does_not_sort_the_rows_of_a_hot_key(spark):
    """The verdicts are hashed and the rows stream past them, whatever the sizes: a hot message needs no memory of its own."""
    from commitlens.operators import joins

    df = spark.createDataFrame([("hot", None, i) for i in range(300)] + [("hot", "", 300), (None, None, 301), ("cold", "x", 302)], "t string, d string, i int")
    v = spark.createDataFrame([("hot", None, True), ("hot", None, False), (None, None, True), ("lost", "x", True)], "t string, d string, v boolean")
    for how in ("left", "inner"):
        out = joins.propagate(df, v, ["t", "d"], ["v"], how=how)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Sort [_jk" not in plan
        want = [("hot", None, i, False) for i in range(300)] + [(None, None, 301, True)]
        want += [("hot", "", 300, None), ("cold", "x", 302, None)] if how == "left" else []
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_unique_messages_are_hashed_without_their_scoring_text(spark):
    """The scoring text is built above the dedup, whose rows are hashed, not sorted; a filter on the answer stays above it."""
    from commitlens.operators import scoring
    from commitlens.plans import jobs

    rows = [("Speed up", None, "l2", "b"), ("Speed up", None, "l1", "c"), ("Speed up", None, "l1", "a"), ("Speed up", "", "l3", "a"), ("Speed up", "", None, "b"),
            (None, "memory", "l4", "a"), ("Add", "cpu", "l5", None)]
    u = jobs.unique_messages(spark.createDataFrame(rows, "commit_title string, commit_description string, commit_link string, commit_diff_file string"))
    want = [("Speed up", None, "l1", "a", "Speed up\nEMPTY"), ("Speed up", "", None, "b", "Speed up\n"), (None, "memory", "l4", "a", None), ("Add", "cpu", "l5", None, "Add\ncpu")]
    assert u.columns == [*jobs.MSG, "commit_link", "commit_diff_file", "_msg"]
    assert sorted(map(tuple, u.collect()), key=str) == sorted(want, key=str)
    scored = u.select(*jobs.MSG, scoring.lexicon_answer("_msg").alias("answer"))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Sort [" not in plan
    yes = u.withColumn("answer", scoring.lexicon_answer("_msg")).filter(F.col("answer").contains("Yes"))
    plan = yes._jdf.queryExecution().optimizedPlan().toString()
    assert "EMPTY" in plan and "regexp_extract" in plan
    assert "EMPTY" not in plan[plan.index("Aggregate ["):] and "regexp_extract" not in plan[plan.index("Aggregate ["):]
    assert sorted(map(tuple, yes.select("commit_link").collect()), key=str) == [("l1",), ("l5",), (None,)]


def test_flag_member_hashes_the_keys(spark):
    """The keys are hashed and the rows stream past them: a partition of wide rows is not sorted."""
    from commitlens.operators import joins

    df = spark.createDataFrame([("hot", i) for i in range(300)] + [("cold", 300), (None, 301)], "k string, i int")
    keys = spark.createDataFrame([("hot",), ("hot",), (None,), ("lost",)], "k string")
    out = joins.flag_member(df, keys, ["k"], "found")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Sort [" not in plan
    want = [("hot", i, True) for i in range(300)] + [("cold", 300, False), (None, 301, False)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_line_index_is_linear(spark):
    """A file of 100,000 lines, all deleted and all kept, some only as parts of lines."""
    n = 100_000
    before = "\n".join(f"  int value{i} = {i};" for i in range(n))
    release = "\n".join(f"\tint value{i} = {i};" if i % 50_000 else f"x int value{i} = {i}; // y" for i in range(n))
    snap = spark.createDataFrame([("c", "before", "A.java", before), ("c", "release", "A.java", release), ("d", "before", "A.java", before), ("d", "release", "A.java", release[:-9])],
                                 "commit_link string, side string, path string, content string")
    changes = spark.createDataFrame([("c", "A.java"), ("d", "A.java")], "commit_link string, path string").withColumn("deleted_lines", F.sequence(F.lit(1), F.lit(n)))
    t = time.time()
    got = {r.commit_link: r.ok for r in verify.file_checks(changes, snap).collect()}
    assert got == {"c": True, "d": False} and time.time() - t < 30


def test_rule_lattice(spark):
    rules = [("a", F.col("t").contains("a")), ("b", F.col("t").contains("b")), ("c", F.col("t").contains("c"))]
    texts = ["a", "ab", "abc", "bc", "c", "x", "b", "b", None, "é a"]
    df = spark.createDataFrame([(t, None) for t in texts], "t string, d string")
    masked = filters.rule_masks(df, rules, "t", "d")
    names = ["a", "b", "c"]
    assert {r.t: r.rule_mask for r in masked.collect()} == {"a": 1, "ab": 3, "abc": 7, "bc": 6, "c": 4, "x": 0, "b": 2}
    counts = filters.mask_counts(masked)
    for order in (names, names[::-1], ["b", "a", "c"]):
        got = {r.rule: (r.step, r.n_first, r.n_alone, r.n_only) for r in filters.removed_first(counts, names, order).collect()}
        left = [t for t in texts if t and t.isascii()]
        for i, rule in enumerate(order):
            gone = [t for t in left if rule in t]
            alone = [t for t in texts if t and t.isascii() and rule in t]
            assert got[rule] == (i, len(gone), len(alone), sum(not set("abc") - {rule} & set(t) and set(t) & set("abc") == {rule} for t in alone))
            left = [t for t in left if rule not in t]
        first = {r.t: r.f for r in masked.select("t", filters.first_rule(F.col("rule_mask"), names, order).alias("f")).collect()}
        assert first["abc"] == order[0] and first["x"] is None


def test_row_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(5000).selectExpr("id * 7919 % 5000 as k", "id % 3 = 0 as f")
    for parts in (1, 7):
        out, n = row_numbers(df.repartition(parts), [F.col("k").asc()], "n", "f")
        rows = out.collect()
        assert n == 1667 and all(r.n == r.k + 1 for r in rows) and len(rows) == 5000
    out, n = row_numbers(df.limit(0), [F.col("k").asc()])
    assert out.count() == 0 and n == 0


def test_batches_survive_stops_and_failures(spark):
    root = scratch_path(spark, "unit_batches")
    words = [3, 50, 1, 0, 7, 200, 2]
    work = spark.createDataFrame([(i, " ".join(["w"] * words[i % 7]) if i % 11 else None) for i in range(300)], "k int, t string")
    plans = [{r.k: r.batch_id for r in batches.plan_batches(work.repartition(p), "k", "t", 20, 100).collect()} for p in (1, 6)]
    assert plans[0] == plans[1] and len(plans[0]) == 300
    groups = {}
    for k in range(300):
        groups.setdefault(plans[0][k], []).append(words[k % 7] if k % 11 else 0)
    assert all(len(g) <= 20 and sum(g[:-1]) < 100 for g in groups.values()) and sorted(groups) == list(dict.fromkeys(plans[0][k] for k in range(300)))

    ledger = batches.BatchLedger(spark, f"{root}/ledger")
    ledger.plan(batches.plan_batches(work, "k", "t", 20, 100), "t")
    score = lambda df: df.select("k", "batch_id", F.lit("ok").alias("a"))
    ledger.run(score, f"{root}/out", wave=2, limit=3)                       # stopped after three batches
    assert ledger.status().where("state = 'done'").count() == 3
    bad = sorted(groups)[5]
    fails = lambda df: df.select("k", "batch_id", F.when(F.col("batch_id") == bad, F.raise_error(F.lit("model")).cast("string")).otherwise("ok").alias("a"))
    again = batches.BatchLedger(spark, f"{root}/ledger")                    # a new process
    again.plan(batches.plan_batches(work, "k", "t", 1, 1), "t")            # an existing plan is kept
    again.run(fails, f"{root}/out", wave=4)
    assert [(r.batch_id, r.state) for r in again.status().where("state <> 'done'").collect()] == [(bad, "failed")]
    again.run(score, f"{root}/out")
    out = spark.read.parquet(f"{root}/out")
    assert again.status().where("state <> 'done'").count() == 0 and sorted(r.k for r in out.collect()) == list(range(300))


@pytest.mark.parametrize("n", [500, 20_000])
def test_link_by_anchor_with_many_tags(spark, n):
    html = "<a href='x'></a><a href='y'>" + "<i>" * n + " Changelog " + "</i>" * n + "</a>"
    df = spark.createDataFrame([(html,), (None,), ("<a href='z'>" + "<b>" * n,)], "html string")
    assert [r.x for r in df.select(ex.link_by_anchor("html", "Changelog").alias("x")).collect()] == ["y", None, None]


def test_jobs_do_not_grow_with_the_batches(spark):
    root = scratch_path(spark, "unit_waves")
    work = spark.range(3000).select("id", F.lit("w w").alias("t"))
    ledger = batches.BatchLedger(spark, f"{root}/ledger")
    ledger.plan(batches.plan_batches(work, "id", "t", 3, 100), "t")
    asked = []

    def score(df):
        asked.append(df)
        return df.select("id", "batch_id", F.lit("ok").alias("a"))

    ledger.run(score, f"{root}/out", wave=4)
    assert len(asked) <= batches.WAVES and ledger.status().where("state = 'done'").count() == 1000
    assert sorted(r.id for r in spark.read.parquet(f"{root}/out").select("id").collect()) == list(range(3000))
    files = spark.read.parquet(f"{root}/ledger/work").groupBy(F.input_file_name()).agg(F.min("batch_id").alias("a"), F.max("batch_id").alias("b")).orderBy("a").collect()
    assert all(x.b < y.a for x, y in zip(files, files[1:]))


def test_commit_page_is_cut_once_not_for_every_file(spark):
    cell = '<tr class="show-top-border"><td data-line-number="{0}"></td><td data-line-number="{0}"></td><td class="{1}">{2}</td></tr>'
    lines = [cell.format(7, "blob-code-addition", "a &lt;<b>x</b>&amp;lt; \u00e9"), cell.format(8, "blob-code-deletion", "1 < 2 > 0"),
             '<tr class="show-top-border"><td data-line-number="3"></td><td class="blob-code-deletion">d</td><td class="cut" </tr>',      # the last cell is not closed
             '<tr class="show-top-border"><td data-line-number="4"></td><td class="blob-code-deletion">e</td><td class="x">no end</tr>', '<tr class="show-top-border">no cell</tr>']
    page = "<div class='n'></div><div class=\"commit-desc\"><pre> d &amp; e </pre></div><!-- <copilot-diff-entry -->" + "".join(
        f'<copilot-diff-entry data-file-path="f{i}"><table>{line}</table></copilot-diff-entry>' for i, line in enumerate(lines))
    pages = spark.createDataFrame([(1, page), (2, "<html>no file</html>"), (3, None)], "page_id long, html string")
    got = ex.commit_page_files(pages)
    rows = [(r.page_id, r.commit_description, r.file_pos, r.commit_diff_file, r.commit_diff, r.added_lines, r.deleted_lines) for r in got.orderBy("file_pos").collect()]
    want = [("a <x&lt; \u00e9", [7], []), ("1  0", [], [8]), ("d", [], [3]), ("e", [], []), ("", [], [])]
    assert rows == [(1, "d & e", i, f"f{i}", *w) for i, w in enumerate(want)]
    # one pattern pass a page: neither the description nor the page's visible part is made above the rows of its files
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Generate")]
    assert "commit-desc" not in above and "<!--" not in above and plan.count("commit-desc") == 1 and plan.count("show-top-border") == 1


def test_text_is_cut_into_lines_once(spark):
    from commitlens.functions.text import indent_lines, split_lines
    from commitlens.operators import prompts

    texts = ["", "a", "a\n", "\n", "a\r\n\nb\r", "\u2028x", "a\n\n", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [(r.s, r.x) for r in df.select("i", split_lines("t").alias("s"), indent_lines("t", 2).alias("x")).orderBy("i").collect()]
    assert got == [(None, None) if t is None else (t.splitlines(), "\n".join("\t\t" + v for v in t.splitlines())) for t in texts]
    files = df.select(F.col("t").alias("m"), F.array(F.struct(F.lit("f").alias("file_name"), F.col("t").alias("patch"))).alias("files"))
    plan = files.select(prompts.diff_prompt("m", "files").alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 3      # the message, the patch and the rendered files


def test_shared_steps_run_once(spark):
    from commitlens.plans.queries import REGISTRY

    d = "/root/testdata/sf0.001"
    plan = {n: REGISTRY[n](spark, d)._jdf.queryExecution().optimizedPlan().toString() for n in ("label_sheet", "match_releases", "snapshot_index")}
    assert "Root_Causes" not in plan["label_sheet"]       # the parsed answers are read
    assert all("lineitem" not in p and "l_orderkey" not in p for n, p in plan.items() if n != "label_sheet")      # the pairs are read
