"""Page parsers against Python's own HTML parser, on every given page."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from commitlens.functions.text import PY_WHITESPACE  # noqa: F401  (same white space as str.strip)
from commitlens.operators import extract as ex

SF = "/root/testdata/sf0.01"


class Reader(HTMLParser):
    """Links, anchors, paragraph blocks and first title and h1 texts of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self.anchors, self.blocks, self.first = [], [], [], {}
        self.a = self.p = self.skip = None
        self.open = {}

    def handle_starttag(self, tag, attrs):
        d = dict(attrs)
        if tag in ("script", "style"):
            self.skip = tag
        if tag == "a" and d.get("href") is not None:
            self.links.append(d["href"])
            self.a = [d["href"], ""]
        if tag == "p":
            self.blocks.append("")
            self.p = True
        if tag in ("title", "h1") and tag not in self.first:
            self.open[tag] = ""

    def handle_endtag(self, tag):
        if tag == self.skip:
            self.skip = None
        if tag == "a" and self.a:
            self.anchors.append(tuple(self.a))
            self.a = None
        if tag == "p":
            self.p = None
        if tag in self.open:
            self.first.setdefault(tag, self.open.pop(tag))

    def handle_data(self, data):
        if self.skip:
            return
        if self.a:
            self.a[1] += data
        if self.p:
            self.blocks[-1] += data
        for t in self.open:
            self.open[t] += data


def read(html):
    r = Reader()
    r.feed(html)
    r.close()
    return r


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def parsed(pages):
    return {r.page_id: read(r.html) for r in pages.select("page_id", "html").collect()}


def by_page(rows, value):
    out = {}
    for r in sorted(rows, key=lambda r: (r.page_id, r.pos)):
        out.setdefault(r.page_id, []).append(value(r))
    return out


def test_links(pages, parsed):
    got = by_page(ex.page_links(pages).collect(), lambda r: r.href)
    assert got == {k: p.links for k, p in parsed.items() if p.links}


def test_anchors(pages, parsed):
    got = by_page(ex.page_anchors(pages).collect(), lambda r: (r.href, r.anchor_text))
    assert got == {k: p.anchors for k, p in parsed.items() if p.anchors}


def test_paragraphs(pages, parsed):
    got = by_page(ex.page_blocks(pages, "p").collect(), lambda r: r.text)
    assert got == {k: [b.strip() for b in p.blocks] for k, p in parsed.items() if p.blocks}


def test_title_and_heading(pages, parsed):
    rows = pages.select("page_id", ex.tag_text("html", "title").alias("t"), ex.tag_text("html", "h1").alias("h")).collect()
    assert {r.page_id: (r.t, r.h) for r in rows} == {
        k: tuple((p.first.get(t, "").strip() or None) for t in ("title", "h1")) for k, p in parsed.items()}


def test_odd_markup(spark):
    html = ("<article href='no'>x</article><A class=x HREF='/a?x=1&amp;y=2'>one <b>two</b></A><a data-href='n' href=\"/b\">&lt;T&gt;</a>"
            "<!-- <a href='/c'>c</a> --><pre>not a paragraph</pre><P>first <i>in</i> &amp;lt;<p>second</p><path d='x'/>after")
    df = spark.createDataFrame([(1, html, "http://h/x")], "page_id long, html string, url string")
    assert [(r.href, r.abs_url) for r in ex.page_links(df).orderBy("pos").collect()] == [("/a?x=1&y=2", "http://h/a?x=1&y=2"), ("/b", "http://h/b")]
    assert [r.anchor_text for r in ex.page_anchors(df).orderBy("pos").collect()] == ["one two", "<T>"]
    assert [r.text for r in ex.page_blocks(df, "p").orderBy("pos").collect()] == ["first in &lt;", "second"]
    assert df.select(ex.link_by_anchor("html", "one").alias("x")).first().x is None
    assert df.select(F.array(ex.decode_entities(F.lit("&amp;lt; &copy;"))).alias("x")).first().x == ["&lt; ©"]
