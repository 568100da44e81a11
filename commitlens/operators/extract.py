"""Extraction jobs: fetched pages / JSON text -> rows.

Pages are parsed with regex built-ins; one page becomes many rows via
``explode``/``posexplode`` (a generator, not a UDTF).  Comments, scripts and
styles are left out first (``visible``); element text is what stands between
its tags without inner tags and with character references decoded
(``inner_text``), as an HTML parser would give it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.functions import fixed
from commitlens.functions.text import ColumnOrName, _c, after_first_until, last_segment, store_date, strip_ws

QUOTED = r"""("[^"]*"|'[^']*')"""
OPEN_A = r"(?is)<a(?:\s[^>]*?)?\shref\s*=\s*" + QUOTED
ANCHOR = OPEN_A + r"[^>]*>(.*?)</a\s*>"
HIDDEN = [r"(?s)<!--.*?-->", r"(?is)<script(?:\s[^>]*)?>.*?</script\s*>", r"(?is)<style(?:\s[^>]*)?>.*?</style\s*>"]


def visible(html: ColumnOrName) -> Column:
    """The page without comments, scripts and styles."""
    c = _c(html)
    for p in HIDDEN:
        c = F.regexp_replace(c, p, "")
    return c


def decode_entities(c: Column) -> Column:
    """Character references to characters, the ampersand last."""
    for name, ch in fixed.HTML_ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(ch))
    return c


def inner_text(fragment: Column) -> Column:
    """Text of an HTML fragment."""
    return decode_entities(F.regexp_replace(fragment, r"<[^>]+>", ""))


def unquoted(value: Column) -> Column:
    """Value of a quoted attribute."""
    return decode_entities(F.substring(value, F.lit(2), F.length(value) - 2))


def first_or_null(found: Column) -> Column:
    return F.nullif(found, F.lit(""))


def attribute(tag_text: Column, name: str) -> Column:
    """Value of the first ``name`` attribute in a piece of HTML; NULL if absent."""
    return unquoted(first_or_null(F.regexp_extract(tag_text, rf"(?is)\s{name}\s*=\s*" + QUOTED, 1)))


def base_url(url: ColumnOrName) -> Column:
    """scheme://host of a URL."""
    return F.regexp_extract(_c(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)


def absolute(href: ColumnOrName, base: ColumnOrName) -> Column:
    h = _c(href)
    return F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), h).otherwise(F.concat(_c(base), h))


def page_links(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """Every link of a page, made absolute with the page's base URL."""
    hrefs = F.transform(F.regexp_extract_all(visible(html), F.lit(OPEN_A), 1), unquoted)
    x = pages.select(key, base_url(url).alias("_base"), F.posexplode(hrefs).alias("pos", "href"))
    return x.select(key, F.col("pos").cast("long").alias("pos"), "href",
                    absolute("href", "_base").alias("abs_url"))


def page_anchors(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(link, anchor text) rows of a listing page, in page order."""
    hrefs = F.transform(F.regexp_extract_all(visible(html), F.lit(ANCHOR), 1), unquoted)
    texts = F.transform(F.regexp_extract_all(visible(html), F.lit(ANCHOR), 2), inner_text)
    x = pages.select(key, F.posexplode(F.arrays_zip(hrefs.alias("href"), texts.alias("text"))).alias("pos", "a"))
    return x.select(key, F.col("pos").cast("long").alias("pos"), F.col("a.href").alias("href"),
                    F.col("a.text").alias("anchor_text"))


def blocks(html: Column, tag: str) -> Column:
    """Inner HTML of every ``<tag>`` element, in order: up to its end tag or the next start tag."""
    after = F.filter(F.split(html, rf"(?i)<{tag}(?:\s[^>]*)?>", -1), lambda x, i: i > 0)
    return F.transform(after, lambda x: F.get(F.split(x, rf"(?i)</{tag}\s*>", -1), F.lit(0)))


def page_blocks(pages: DataFrame, tag: str = "p", html: str = "html", key: str = "page_id") -> DataFrame:
    """X2/X8/X10 pattern: split a page into its ``<tag>`` blocks, one row per block in order."""
    texts = F.transform(blocks(visible(html), tag), inner_text)
    x = pages.select(key, F.posexplode(texts).alias("pos", "block"))
    return x.select(key, F.col("pos").cast("long").alias("pos"), strip_ws("block").alias("text"))


def link_by_anchor(html: ColumnOrName, anchor_text: str) -> Column:
    """Href of the first link whose text is ``anchor_text`` (tags around it allowed); NULL if absent."""
    text = "".join(c if c.isalnum() or ord(c) > 127 else f"[{c}]" if c not in "^\\" else "\\" + c for c in anchor_text)
    tags = r"\s*+(?:(?!</a[\s>])<[^>]*+>\s*+)*+"      # possessive: a loop in the regex engine, whatever the number of tags
    pat = OPEN_A + r"[^>]*+>" + tags + text + tags + r"</a\s*>"
    return unquoted(first_or_null(F.regexp_extract(visible(html), pat, 1)))


def tag_text(html: ColumnOrName, tag: str) -> Column:
    """Text of the first ``<tag>`` element, inner tags left out; NULL if absent or empty."""
    inner = F.regexp_extract(visible(html), rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)
    return F.nullif(strip_ws(inner_text(inner)), F.lit(""))


def next_listing(html: ColumnOrName, base: ColumnOrName) -> Column:
    """URL of the next listing page; NULL on the last one."""
    pat = OPEN_A + r"[^>]*>\s*" + fixed.NEXT_LISTING_TEXT
    return absolute(unquoted(first_or_null(F.regexp_extract(visible(html), pat, 1))), base)


def next_commit_page(html: ColumnOrName, base: ColumnOrName) -> Column:
    """URL behind the next-page button of a commit list; NULL if there is none or it is disabled."""
    button = F.regexp_extract(visible(html), rf"""(?is)(<a\s[^>]*data-testid\s*=\s*["']{fixed.NEXT_BUTTON_ID}["'][^>]*>)""", 1)
    off = F.coalesce(attribute(button, "style"), F.lit("")).contains("disabled")
    return F.when(~off, absolute(attribute(button, "href"), base))


def category_from_url(url: ColumnOrName) -> Column:
    """Category name from a listing URL (``.../categories/<name>/``)."""
    return F.nullif(F.regexp_extract(_c(url), r"categories/([^/]+)/", 1), F.lit(""))


def commit_list(anchors: DataFrame, href: str = "href", text: str = "anchor_text") -> DataFrame:
    """Commit links of a commit-list page (from :func:`page_anchors`), skipping
    the 'Initial commit' title; the hash is the last path segment."""
    c = anchors.filter(F.col(href).contains("/commit/") & (F.col(text) != "Initial commit"))
    return c.withColumn("commit_hash", last_segment(href))


def machine_time(html: ColumnOrName) -> Column:
    """``datetime`` attribute of the first ``<relative-time>`` element."""
    tag = F.regexp_extract(visible(html), r"(?is)(<relative-time\s[^>]*>)", 1)
    return F.to_timestamp(attribute(tag, "datetime"))


def store_versions(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Store page -> one row per listed version: version, code, date, binary and source links."""
    item = r"(?is)<li\s[^>]*class\s*=\s*[\"'][^\"']*package-version(?:\s[^\"']*)?[\"'][^>]*>"
    parts = F.filter(F.split(visible(html), item, -1), lambda x, i: i > 0)
    x = pages.select(key, F.posexplode(parts).alias("version_pos", "li"))

    def part(tag: str, name: str) -> Column:
        return F.regexp_extract("li", rf"""(?is)<{tag}\s[^>]*class\s*=\s*["'][^"']*{name}[^"']*["'][^>]*>(.*?)</{tag}\s*>""", 1)

    header = version_header(inner_text(part("div", "package-version-header")))
    return (x.withColumn("_h", header)
            .select(key, F.col("version_pos").cast("long").alias("version_pos"), "_h.version", "_h.code",
                    store_date("_h.added_on").alias("added_on"),
                    attribute(part("p", "package-version-download"), "href").alias("apk_download_link"),
                    attribute(part("p", "package-version-source"), "href").alias("source_code_download_link")))


def version_header(header: ColumnOrName) -> Column:
    """X8: 'Version <v> (<code>) ... Added on <date>' -> struct(version, code, added_on)."""
    h = _c(header)
    v = after_first_until(h, "Version ", " (")
    code = F.split_part(F.split_part(h, F.concat(v, F.lit(" (")), F.lit(2)), F.lit(")"), F.lit(1))
    added = strip_ws(F.substring_index(h, "Added on ", -1))
    return F.struct(v.alias("version"), F.nullif(code, F.lit("")).alias("code"),
                    F.when(h.contains("Added on "), added).alias("added_on"))


def diff_json(text: ColumnOrName) -> Column:
    """Commit JSON -> struct(message, files array<struct<filename, patch>>)."""
    schema = "commit struct<message:string>, files array<struct<filename:string,patch:string>>"
    j = F.from_json(_c(text), schema)
    return F.struct(j["commit"]["message"].alias("message"), j["files"].alias("files"))


def hunk_starts(patch: ColumnOrName) -> Column:
    """struct(old_starts, new_starts) of the ``@@ -a,b +c,d @@`` hunk headers."""
    pat = r"@@ -(\d+)(?:,\d+)? \+(\d+)"
    old = F.transform(F.regexp_extract_all(_c(patch), F.lit(pat), 1), lambda x: x.cast("int"))
    new = F.transform(F.regexp_extract_all(_c(patch), F.lit(pat), 2), lambda x: x.cast("int"))
    return F.struct(old.alias("old_starts"), new.alias("new_starts"))


def hunks(diffs: DataFrame, patch: str = "patch") -> DataFrame:
    """One row per hunk of every patch: ``hunk`` from 0, old and new start line."""
    h = hunk_starts(patch)
    x = diffs.select(*[c for c in diffs.columns if c != patch], F.posexplode(F.arrays_zip(h["old_starts"], h["new_starts"])).alias("hunk", "_s"))
    return x.withColumn("old_start", F.col("_s.old_starts")).withColumn("new_start", F.col("_s.new_starts")).drop("_s")


HUNK_HEADER = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def _hunk_bodies(diffs: DataFrame, key: list[str], patch: str) -> DataFrame:
    """(key, ``_hunks``): the hunks of every patch as array<struct<hunk, at, old, new, body>>: place of the header line, start lines and the lines up to the next header."""
    x = diffs.select(*key, F.split(F.col(patch), "\r?\n", -1).alias("_lines")).where(F.col("_lines").isNotNull())
    x = x.withColumn("_at", F.filter(F.transform("_lines", lambda line, i: F.when(line.startswith("@@ -") & line.rlike(HUNK_HEADER), i)), lambda i: i.isNotNull()))

    def hunk(at: Column, h: Column) -> Column:
        start = lambda side: F.regexp_extract(F.get("_lines", at), HUNK_HEADER, side).cast("long")
        end = F.coalesce(F.get("_at", h + 1), F.size("_lines"))
        return F.struct(h.cast("long").alias("hunk"), at.alias("at"), start(1).alias("old"), start(2).alias("new"), F.slice("_lines", at + 2, end - at - 1).alias("body"))

    return x.select(*key, F.transform("_at", hunk).alias("_hunks"))


def _kind(line: Column) -> Column:
    return F.substring(line, 1, 1)


def _begins(line: Column, *marks: str) -> Column:
    return reduce(lambda a, b: a | b, [line.startswith(m) for m in marks])


def _side(h: Column, first: str, mark: str) -> Column:
    """Lines of one side of a hunk, those that begin with a space or ``mark``, as array<struct<pos, line, number>>: its numbers count them from ``first``."""
    lines = F.transform(h["body"], lambda line, i: F.struct((h["at"] + 1 + i).cast("long").alias("pos"), line.alias("line")))
    on = F.filter(lines, lambda x: _begins(x["line"], " ", mark))
    return F.transform(on, lambda x, i: F.struct(x["pos"].alias("pos"), x["line"].alias("line"), (h[first] + i).alias("number")))


def patch_lines(diffs: DataFrame, key: list[str], patch: str = "patch") -> DataFrame:
    """One row per line of every patch: ``hunk`` (from 0), ``pos``, ``kind`` (' ', '+', '-'), ``old_line``, ``new_line``, ``text``.

    A line's number is its place among the lines of its side of the hunk, so every patch is read within its row, without a window or a sort.  A line
    that is only on one side has a NULL number on the other; marks ("\\ No newline ...") and what stands before the first header are
    left out.  ``key`` tells the patches apart.
    """
    x = _hunk_bodies(diffs, key, patch).select(*key, F.explode("_hunks").alias("_h"))
    x = x.select(*key, F.col("_h.hunk").alias("hunk"), _side(F.col("_h"), "old", "-").alias("_old"), _side(F.col("_h"), "new", "+").alias("_new"))
    none = F.lit(None).cast("long")

    def row(x: Column, old: Column, new: Column) -> Column:
        return F.struct(x["pos"].alias("pos"), x["line"].alias("line"), old.alias("old_line"), new.alias("new_line"))

    def of(side: str, mark: str) -> Column:
        return F.filter(F.col(side), lambda x: _begins(x["line"], mark))

    both = F.zip_with(of("_old", " "), of("_new", " "), lambda a, b: row(a, a["number"], b["number"]))      # the context is the same on both sides
    rows = F.concat(both, F.transform(of("_old", "-"), lambda x: row(x, x["number"], none)), F.transform(of("_new", "+"), lambda x: row(x, none, x["number"])))
    x = x.select(*key, "hunk", F.explode(rows).alias("_r"))
    line = F.col("_r.line")
    return x.select(*key, "hunk", "_r.pos", _kind(line).alias("kind"), "_r.old_line", "_r.new_line", F.substring(line, F.lit(2), F.length(line)).alias("text"))


def patch_line_numbers(diffs: DataFrame, key: list[str], patch: str = "patch") -> DataFrame:
    """X9 for J12: per patch the numbers of its added lines (new file) and deleted lines (old file), rising; empty arrays if there are none."""
    def numbers(first: str, mark: str) -> Column:
        def of(h: Column) -> Column:
            side = F.filter(h["body"], lambda line: _begins(line, " ", mark))
            return F.filter(F.transform(side, lambda line, i: F.when(_begins(line, mark), h[first] + i)), lambda n: n.isNotNull())

        return F.flatten(F.transform("_hunks", of))

    x = _hunk_bodies(diffs, key, patch).where(F.exists("_hunks", lambda h: F.exists(h["body"], lambda line: _begins(line, " ", "+", "-"))))
    x = x.select(*key, numbers("new", "+").alias("_added"), numbers("old", "-").alias("_deleted"))
    return x.groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list("_added"))).alias("added_lines"), F.array_sort(F.flatten(F.collect_list("_deleted"))).alias("deleted_lines"))


def changelog_links(html: ColumnOrName, git_link: ColumnOrName) -> Column:
    """X11: struct(changelog, metadata, valid) of an app page; valid only when both
    links exist and the changelog is the project's ``/releases`` page."""
    ch = link_by_anchor(html, "Changelog")
    meta = link_by_anchor(html, "Build Metadata")
    valid = ch.isNotNull() & meta.isNotNull() & (ch == F.concat(_c(git_link), F.lit("/releases")))
    return F.struct(ch.alias("changelog_link"), meta.alias("build_metadata"), valid.alias("valid"))


def commit_page_files(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Commit page -> one row per changed file: description, path, the diff text
    (concatenated code cells) and the line numbers of added / deleted lines.

    A file is a ``copilot-diff-entry`` block; a diff line is a ``show-top-border``
    table row whose last cell says whether it is an addition (new line number in
    the second cell) or a deletion (old line number in the first cell).  The
    page-level description is kept on every file row (X12).
    """
    desc = F.regexp_extract("_page", r'(?s)<div[^>]*class="[^"]*commit-desc[^"]*"[^>]*>\s*<pre>(.*?)</pre>', 1)
    blocks = F.filter(F.split("_page", "<copilot-diff-entry", -1), lambda x, i: i > 0)
    # what belongs to the page is made before its files are rows: beside posexplode it would be made again for every file;
    # the outer form adds no test for empty pages, which would cut every page twice more
    x = (pages.select(key, visible(html).alias("_page"))
         .select(key, strip_ws(inner_text(desc)).alias("commit_description"), blocks.alias("_blocks"))
         .select(key, "commit_description", F.posexplode_outer("_blocks").alias("file_pos", "block")).where("file_pos is not null"))
    # the possessive repetition stops at the first end tag, as a lazy one does, but takes the text between tags at once
    rows = F.regexp_extract_all(F.col("block"), F.lit(r'(?s)<tr[^>]*show-top-border[^>]*>((?:[^<]++|<(?!/tr>))*+)</tr>'), 1)

    def last_cell(r):
        tail = F.substring_index(r, "<td", -1)      # behind the row's last cell mark
        return F.struct(tail.alias("tail"), F.instr(tail, ">").alias("at"), F.contains(r, F.lit("<td")).alias("any"), r.alias("row"))

    def last_cell_class(c):
        # a mark that nothing closes is no cell: then the pattern looks for the one before
        return (F.when(c["any"] & (c["at"] > 0), F.substring(c["tail"], F.lit(1), c["at"] - 1))
                .otherwise(F.regexp_extract(c["row"], r'(?s).*<td([^>]*)>', 1)))

    def last_cell_html(c):
        inner = F.substring(c["tail"], c["at"] + 1, F.length(c["tail"]))
        return (F.when(c["any"] & (c["at"] > 0) & inner.contains("</td>"), F.substring_index(inner, "</td>", 1))
                .otherwise(F.regexp_extract(c["row"], r'(?s).*<td[^>]*>(.*?)</td>', 1)))

    def inner_texts(fragments):
        plain = F.transform(fragments, lambda t: F.when(t.contains("<"), F.regexp_replace(t, r"<[^>]+>", "")).otherwise(t))
        return F.transform(plain, lambda t: F.when(t.contains("&"), decode_entities(t)).otherwise(t))

    def first_num(r):
        return F.nullif(F.regexp_extract(r, r'<td[^>]*data-line-number="(\d+)"', 1), F.lit("")).cast("int")

    def second_num(r):
        return F.nullif(F.regexp_extract(r, r'(?s)<td[^>]*>.*?</td>\s*<td[^>]*data-line-number="(\d+)"', 1),
                        F.lit("")).cast("int")

    def numbers(kind, number):
        of_kind = F.filter("_lines", lambda c: c["cls"].contains(kind))
        return F.filter(F.transform(of_kind, lambda c: number(c["row"])), lambda v: v.isNotNull())

    cells = F.transform(F.transform(rows, last_cell), lambda c: F.struct(last_cell_class(c).alias("cls"), last_cell_html(c).alias("html"), c["row"].alias("row")))
    x = x.withColumn("_lines", cells)
    return x.select(key, "commit_description", F.col("file_pos").cast("long").alias("file_pos"),
                    F.regexp_extract("block", r'data-file-path="([^"]*)"', 1).alias("commit_diff_file"),
                    F.array_join(inner_texts(F.transform("_lines", lambda c: c["html"])), "").alias("commit_diff"),
                    numbers("blob-code-addition", second_num).alias("added_lines"),
                    numbers("blob-code-deletion", first_num).alias("deleted_lines"))


def release_assets_from_page(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Release page -> one row per downloadable asset of every non-pre-release
    section: version label, asset link, file name and release time."""
    sections = F.regexp_extract_all(visible(html), F.lit(r"(?s)<section[^>]*>(.*?)</section>"), 1)
    x = pages.select(key, F.posexplode(sections).alias("section_pos", "sec"))
    x = x.filter(~F.col("sec").rlike(r">\s*Pre-release\s*<"))
    x = x.select(key, "section_pos",
                 strip_ws(decode_entities(F.regexp_extract("sec", r'class="[^"]*sr-only[^"]*"[^>]*>([^<]*)<', 1))).alias("apk_version"),
                 F.explode(F.regexp_extract_all("sec", F.lit(r"(?s)<li[^>]*>(.*?)</li>"), 1)).alias("li"))
    link = first_or_null(decode_entities(F.regexp_extract("li", r'href="([^"]*)"', 1)))
    return (x.withColumn("download_link", link).filter(F.col("download_link").isNotNull())
            .select(key, F.col("section_pos").cast("long").alias("section_pos"), "apk_version", "download_link",
                    last_segment("download_link").alias("download_file_name"),
                    F.nullif(F.regexp_extract("li", r'datetime="([^"]+)"', 1), F.lit("")).alias("apk_release_time")))
