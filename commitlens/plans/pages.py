"""Pages built from given rows, for the page parsers.

Each adapter wraps the rows of a domain table in HTML or JSON of the crawled
shape, one page per commit or project, so the parsers' work grows with the
tables.  The oracle derives the expected rows from the tables directly, not
through the page text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.plans import adapters as ad


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def joined(structs: Column, body) -> Column:
    """Concatenation of ``body(row)`` over the sorted collected rows."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(structs)), body), "")


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit_link, o_orderkey, ln, old, new, qty, flag): numbers behind one changed file of a commit."""
    o = ad.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    li = ad.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    j = o.join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(text(ad._project(F.col("o_custkey")), "/commit/", F.col("o_orderkey").cast("string")).alias("commit_link"), "o_orderkey",
                    F.col("o_orderdate"), F.col("o_orderpriority"), F.col("l_linenumber").cast("int").alias("ln"),
                    F.col("l_quantity").cast("long").alias("qty"), F.col("l_returnflag").alias("flag"))


def commit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit_link, html): a commit page with description, time and every changed file."""
    s = lambda c: c.cast("string")

    def entry(f: Column) -> Column:
        old, new = s(f["ln"] * 10), s(f["ln"] * 10 + 1)
        row = lambda a, b, kind, code: text(
            '<tr class="diff-line-row show-top-border"><td data-line-number="', a, '" class="n"></td><td data-line-number="', b,
            '" class="n"></td><td class="blob-code ', kind, '">', code, "</td></tr>")
        return text('<copilot-diff-entry data-file-path="src/F', s(f["ln"]), '.java"><table><tr class="hunk"><td>@@</td></tr>',
                    row(old, old, "blob-code-context", text("<span>int q</span>;\n")),
                    row(old, "", "blob-code-deletion", text("-List&lt;Q&gt; q = ", s(f["qty"]), ";\n")),
                    row("", new, "blob-code-addition", text("+<span class='k'>if</span> (a &amp;&amp; b) q = ", s(f["qty"] + 1), ";\n")),
                    "</table></copilot-diff-entry>")

    rows = code_lines(spark, sf_dir).groupBy("commit_link", "o_orderkey", "o_orderdate", "o_orderpriority").agg(
        joined(F.struct("ln", "qty"), entry).alias("files"))
    desc = text("Fixes &lt;#", s(F.col("o_orderkey") % 100), "&gt; &amp; ", escape(F.col("o_orderpriority")))
    return rows.select("commit_link", text(
        "<html><!-- <pre>no</pre> --><script>var x='<copilot-diff-entry';</script><relative-time class=\"t\" datetime='",
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "'>x</relative-time><div class=\"a commit-desc b\"><pre>", desc, "</pre></div>",
        F.col("files"), "</html>").alias("html"))


def store_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(git_link, html): a store page per project with every listed version."""
    def item(v: Column) -> Column:
        return text('<li class="package-version" id="v"><div class="package-version-header"><a name="x"></a><b>Version ', v["apk_version"], "</b> (",
                    v["code"].cast("string"), ") - <i>Added on ", F.date_format(v["release_date"], "MMM d, yyyy"),
                    '</i></div><p class="package-version-source"><a href="', v["src"], '">source &amp; build</a></p><p class=\'package-version-download\'><b><a class="x" href=\'',
                    v["apk"], "'>Download <u>APK</u></a></b></p></li>")

    st = ad.store_releases(spark, sf_dir)
    code = F.crc32(F.col("apk_download_link").cast("binary")) % 1000
    row = F.struct("apk_download_link", "apk_version", code.alias("code"), "release_date", F.col("source_code_download_link").alias("src"), F.col("apk_download_link").alias("apk"))
    return st.groupBy("git_link").agg(text('<html><ul class="package-versions-list">', joined(row, item), "</ul></html>").alias("html"))


def release_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(git_link, html): a release page per project; versions starting with 'v' are marked as pre-releases on projects ending in 0."""
    def section(r: Column) -> Column:
        mark = F.when(r["pre"], F.lit("<span> Pre-release </span>")).otherwise(F.lit("<span>Latest</span>"))
        return text('<section aria-label="r"><h2 class="sr-only">', r["apk_version"], "</h2>", mark, '<ul><li class="a"><a href="', r["download_link"], "/", r["download_file_name"],
                    '"><b>', r["download_file_name"], '</b></a><relative-time datetime="', r["t"], '"></relative-time></li><li>no link</li></ul></section>')

    a = ad.release_assets(spark, sf_dir).distinct()
    pre = F.col("apk_version").startswith("v") & F.col("git_link").endswith("0")
    row = F.struct("download_link", "apk_version", "download_file_name", F.date_format("release_date", "yyyy-MM-dd").alias("t"), pre.alias("pre"))
    return a.groupBy("git_link").agg(text("<html>", joined(row, section), "</html>").alias("html"))


def app_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(git_link, html): an app page per customer with changelog and metadata links, next-page links included."""
    c = ad.table(spark, sf_dir, "customer").select("c_custkey", ad._project(F.col("c_custkey")).alias("git_link"))
    k = F.col("c_custkey")
    change = F.when(k % 4 == 0, "").otherwise(text("<a href='", F.col("git_link"), F.when(k % 4 == 1, "/tags").otherwise("/releases"), "'><b>Changelog</b></a>"))
    meta = F.when(k % 5 == 0, "").otherwise(text('<A HREF="/meta/', k.cast("string"), '?a=1&amp;b=2">Build Metadata</A>'))
    older = F.when(k % 3 == 0, "").otherwise(text('<a class="n" href="/page/', (k + 1).cast("string"), '/">Older Posts &raquo;</a>'))
    style = F.when(k % 6 == 1, " style='color: disabled'").otherwise("")
    button = F.when(k % 3 == 1, text("<a", style, ' data-testid="pagination-next-button" href="/list/', (k + 1).cast("string"), '">Next</a>')).otherwise("")
    return c.select("c_custkey", "git_link", text("<html><!-- <a href='x'>Changelog</a> -->", change, meta, older, button, "</html>").alias("html"))


def commit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit_link, body): commit JSON with message and files."""
    d = ad.diffs(spark, sf_dir)
    files = F.sort_array(F.collect_list(F.struct(F.col("file_name").alias("filename"), "patch")))
    g = d.groupBy("commit_link").agg(files.alias("files"), F.min("message").alias("message"))
    return g.select("commit_link", F.to_json(F.struct(F.struct("message").alias("commit"), "files", F.lit("x").alias("sha"))).alias("body"))


PER_PAGE = 10   # rows on a list page


def list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, o_orderkey, n_pages, no): the commits of a project dealt to list pages of about PER_PAGE rows, numbered from 0."""
    o = ad.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    n = o.groupBy("o_custkey").agg(F.ceil(F.count(F.lit(1)) / PER_PAGE).alias("n_pages")).withColumnRenamed("o_custkey", "_c")
    j = o.join(n, F.struct(F.col("o_custkey").alias("k")) == F.struct(F.col("_c").alias("k"))).drop("_c")
    return j.withColumn("no", (F.col("o_orderkey") * 7919) % F.col("n_pages"))


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, o_custkey, html): commit list pages with a button to the next one.

    The last page's button is missing, but on every seventh project leads to the first page and on the projects after those to the second.
    """
    s = lambda c: c.cast("string")
    k = F.col("o_orderkey")
    anchor = text('<p><a class="t" href="/o/r/commit/', s(k), '">', F.when(k % 6 == 0, "Initial commit").otherwise(text("<i>Fix</i> &lt;", s(k), "&gt;")),
                  '</a><a href="/o/r/tree">tree</a></p>')
    g = list_rows(spark, sf_dir).groupBy("o_custkey", "no", "n_pages").agg(F.array_join(F.sort_array(F.collect_list(anchor)), "").alias("rows"))
    url = lambda no: text("https://host.example/list/", s(F.col("o_custkey")), "/", s(no))
    after = (F.when(F.col("no") + 1 < F.col("n_pages"), F.col("no") + 1).when(F.col("o_custkey") % 7 == 0, 0).when(F.col("o_custkey") % 7 == 1, 1))
    button = F.when(after.isNotNull(), text('<a data-testid="pagination-next-button" href="/list/', s(F.col("o_custkey")), "/", s(after), '">Next</a>')).otherwise("")
    return g.select(url(F.col("no")).alias("page"), "o_custkey", text("<html>", F.col("rows"), button, "</html>").alias("html"))


def post_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, html): pages of posts, each with nested sections and list items whose end tags are left out, inside and outside the post's content."""
    s = lambda c: c.cast("string")
    k = s(F.col("o_orderkey"))
    post = text('<div class="post"><div id="h"><h3><a href="/post/', k, '">T ', k, '</a></h3></div><div class="big post-content"><div class=\'x\'><p>see <a href="/in/', k,
                '">in <b>', k, '</b></a><br/></div><ul><li>a<li><p><a href="/item/', k, '?a=1&amp;b=2">&lt;item&gt;</a></ul><!-- <div class="post-content"> --></div>',
                '<div><p title="a > b </div>"><a href="/out/', k, '">out</a></p></div></div>')
    g = list_rows(spark, sf_dir).groupBy("o_custkey", "no").agg(F.array_join(F.sort_array(F.collect_list(F.struct("o_orderkey", post.alias("t"))))["t"], "").alias("posts"))
    return g.select(text(s(F.col("o_custkey")), "/", s(F.col("no"))).alias("page"), text("<html><body>", F.col("posts"), "</body></html>").alias("html"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit_link, patch): a patch per commit with one hunk for each of its files: context, deleted and added lines, a mark at the end."""
    def hunk(f: Column) -> Column:
        s = lambda c: c.cast("string")
        lines = lambda mark, n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: text(mark, "q", s(i))), "\n")
        return text("@@ -", s(f["ln"] * 100), ",9 +", s(f["ln"] * 100 + 5), " @@ f(@@ -1 +1 @@)\n a\n", lines("-", f["n_del"]), "\n \n", lines("+", f["n_add"]), "\n b\n\\ No newline")

    rows = code_lines(spark, sf_dir).select("commit_link", F.struct("ln", (F.col("qty") % 3 + 1).cast("int").alias("n_del"), (F.col("qty") % 4 + 1).cast("int").alias("n_add")).alias("f"))
    return rows.groupBy("commit_link").agg(F.array_join(F.transform(F.sort_array(F.collect_set("f")), hunk), "\n").alias("patch"))
