"""Element tree of pages, natively: tags as rows with matched ends.

One pattern pass cuts a page into tags and the text between them; comments, scripts and styles are taken in the same
pass.  Start and end tags are matched per tag name by their running depth: a start at a depth belongs to the next end that
leaves this depth, so nested equal tags (``div`` in ``div``) find their own ends.  A start without an end (``p`` or ``li`` whose end
tag is left out) ends before the next tag of its name, or with the page.  Elements inside a section are found by the
farthest end of the sections begun before, step by step along a selector; no element is joined with its ancestors.

All windows are over one page (rows of one key); they share one exchange, that of the pages before they are cut, and three sorts whatever the number
of steps: by tag, by tag and depth, by position.  The exchange has a part for every
``PART_CHARS`` of text, so a task sorts a bounded number of tags, whatever the size of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.operators.extract import absolute, attribute, base_url, decode_entities

# Possessive repetitions are loops in the regex engine, so texts of any length need no stack.  What is not closed runs to the page's
# end (\z), so every start matches once and the pass stays linear.
ATTRIBUTES = r"""(?:[^'">]++|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))*+(?:>|\z)"""
TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<(script|style)(?=[\s>]){ATTRIBUTES}.*?(?:</\2\s*+>|\z)|</?[a-z][a-z0-9:-]*+{ATTRIBUTES}"
PART_CHARS = 1 << 22     # pages full of tags take some 200 bytes a character in the sorts of a task
PAGE_END = 1 << 62       # behind every position
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]


@dataclass(frozen=True)
class Step:
    """One step of a selector: a tag name with, if given, one of its classes, its id, or a substring of its class attribute."""
    tag: str
    cls: str | None = None
    id: str | None = None
    cls_part: str | None = None

    def matches(self, tag: Column, raw: Column) -> Column:
        hit = tag == self.tag
        classes = F.coalesce(attribute(raw, "class"), F.lit(""))
        if self.cls:
            hit = hit & F.array_contains(F.split(classes, r"[ \t\n\r\f]+", -1), self.cls)
        if self.cls_part:
            hit = hit & classes.contains(self.cls_part)
        if self.id:
            hit = hit & (F.coalesce(attribute(raw, "id"), F.lit("")) == self.id)
        return hit


def dealt(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """``pages`` (key, ``html``) dealt by key to parts of about ``PART_CHARS``, at least one per core."""
    chars = pages.agg(F.sum(F.length(html).cast("long"))).first()[0] or 0
    return pages.select(key, html).repartition(max(pages.sparkSession.sparkContext.defaultParallelism, -(-chars // PART_CHARS)), key)


def tokens(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, ``pos``, ``raw``, ``text``, ``tag``, ``is_end``): every tag of a page in order with the text behind it.

    ``pos`` 0 is the text before the first tag (no tag); comments, scripts and styles have no tag either, nor has a tag that the page's
    end cuts off.
    """
    # one pass: a mark that no text holds stands before and after each tag
    marked = F.regexp_replace(F.translate(F.col(html), "\x01\x02", ""), f"({TOKEN})", "\x01$1\x02")
    x = pages.select(key, F.posexplode(F.split(marked, "\x01", -1)).alias("pos", "_piece"))
    x = x.withColumn("raw", F.substring_index("_piece", "\x02", 1)).withColumn("_cut", F.col("pos") > 0)
    raw = F.when(F.col("_cut"), F.col("raw"))
    text = F.when(F.col("_cut"), F.substring_index("_piece", "\x02", -1)).otherwise(F.col("_piece"))
    name = F.lower(F.regexp_extract(raw, r"^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1))
    tag = F.when(raw.startswith("<!") | ~raw.endswith(">") | name.isin("script", "style"), F.lit(None)).otherwise(F.nullif(name, F.lit("")))
    return x.select(key, F.col("pos").cast("long").alias("pos"), raw.alias("raw"), text.alias("text"), tag.alias("tag"), raw.startswith("</").alias("is_end"))


def matched(tags: DataFrame, key: str = "page_id") -> DataFrame:
    """``tokens`` with ``end`` on start tags (position of the token that ends the element; null: the page's end) and
    ``start`` on end tags (position of the matching start tag; null on stray ones), ``depth`` among tags of its name, and ``closed``."""
    counts = F.col("tag").isNotNull() & ~F.col("tag").isin(VOID) & ~F.coalesce(F.rtrim("raw").endswith("/>"), F.lit(False))
    same = Window.partitionBy(key, "tag").orderBy("pos")
    move = F.when(~counts, 0).when(F.col("is_end"), -1).otherwise(1)
    x = tags.withColumn("_move", move).withColumn("_sum", F.sum("_move").over(same)).withColumn("_after", F.lead("pos").over(same))
    x = x.withColumn("depth", F.when(F.col("_move") == 0, F.lit(None)).otherwise(F.col("_sum") + F.when(F.col("_move") < 0, 1).otherwise(0)))
    level = Window.partitionBy(key, "tag", "depth").orderBy("pos")
    x = x.withColumn("_next_move", F.lead("_move").over(level)).withColumn("_next", F.lead("pos").over(level))
    x = x.withColumn("_prev_move", F.lag("_move").over(level)).withColumn("_prev", F.lag("pos").over(level))
    start, closed = F.col("_move") == 1, F.coalesce(F.col("_next_move") == -1, F.lit(False))
    own = F.col("_move") == 0          # void tags and tags without content end where they begin
    x = x.withColumn("closed", (start & closed) | (own & F.col("tag").isNotNull()))
    x = x.withColumn("end", F.when(start & closed, F.col("_next")).when(start, F.col("_after")).when(own & F.col("tag").isNotNull(), F.col("pos")))
    x = x.withColumn("start", F.when((F.col("_move") == -1) & (F.col("_prev_move") == 1), F.col("_prev")))
    return x.drop("_move", "_sum", "_after", "_next_move", "_next", "_prev_move", "_prev")


def _inside(x: DataFrame, chosen: Column, key: str, name: str) -> DataFrame:
    """``name``: whether a chosen element that began before is open at each token; ``name_n``: how many have begun up to it."""
    order = Window.partitionBy(key).orderBy("pos")
    content = ~F.col("tag").isin(VOID) & ~F.coalesce(F.rtrim("raw").endswith("/>"), F.lit(False))
    x = x.withColumn("_hit", F.coalesce(~F.col("is_end") & chosen, F.lit(False)) & content)
    # a chosen element is open up to its end; of all that began before, the one that ends last tells
    last = F.max(F.when(F.col("_hit"), F.coalesce("end", F.lit(PAGE_END)))).over(order.rangeBetween(Window.unboundedPreceding, -1))
    x = x.withColumn(f"{name}_n", F.sum(F.col("_hit").cast("int")).over(order)).withColumn("_last", last)
    return x.withColumn(name, F.coalesce(F.col("_last") > F.col("pos"), F.lit(False))).drop("_hit", "_last")


def select_elements(pages: DataFrame, path: list[Step], html: str = "html", key: str = "page_id") -> DataFrame:
    """Start tags of the elements that a selector finds (each step a descendant of the one before), with ``pos``, ``end``, ``raw``, ``depth``."""
    x = matched(tokens(dealt(pages, html, key), html, key), key)
    inside = F.lit(True)
    for i, step in enumerate(path[:-1]):
        x = _inside(x, step.matches(F.col("tag"), F.col("raw")) & inside, key, f"_in{i}")
        inside = F.col(f"_in{i}")
    last = path[-1]
    hit = last.matches(F.col("tag"), F.col("raw")) & ~F.col("is_end") & inside
    return x.where(hit).select(key, "pos", "end", "tag", "raw", "depth")


def section_links(pages: DataFrame, section: list[Step], html: str = "html", url: str | None = "url", key: str = "page_id") -> DataFrame:
    """The links inside the sections that a selector finds, in page order: ``pos`` (from 0 within the page), ``href``,
    ``abs_url`` (with a ``url`` column) and ``anchor_text``.  An empty selector gives all links of the page."""
    base = [base_url(url).alias("_base")] if url else []
    x = matched(tokens(dealt(pages, html, key), html, key), key)
    inside = F.lit(True)
    for i, step in enumerate(section):
        x = _inside(x, step.matches(F.col("tag"), F.col("raw")) & inside, key, f"_in{i}")
        inside = F.col(f"_in{i}")
    x = x.withColumn("_href", F.when((F.col("tag") == "a") & ~F.col("is_end") & inside, attribute(F.col("raw"), "href")))
    x = x.withColumn("_link", F.col("_href").isNotNull())
    x = _inside(x, F.col("_link"), key, "_in_link")
    within = F.col("_in_link") | F.col("_link")
    closes = (F.col("tag") == "a") & F.col("is_end")       # the text behind an end tag is outside
    parts = x.where(within).groupBy(key, "_in_link_n").agg(
        F.max("_href").alias("href"),
        F.array_sort(F.collect_list(F.when(~F.coalesce(closes, F.lit(False)), F.struct("pos", "text")))).alias("_text"))
    links = parts.where(F.col("href").isNotNull()).select(key, (F.col("_in_link_n") - 1).alias("pos"), "href",
                                                          decode_entities(F.array_join(F.transform("_text", lambda t: t["text"]), "")).alias("anchor_text"))
    if not url:
        return links
    urls = pages.select(key, *base)
    return links.join(urls, key).select(key, "pos", "href", absolute("href", "_base").alias("abs_url"), "anchor_text")
