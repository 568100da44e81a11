"""Element tree against Python's html.parser, on given pages and nested cases; texts of any length."""

from html.parser import HTMLParser

import pytest

from commitlens.operators import elements as el

SF = "/root/testdata/sf0.01"
VOID = set(el.VOID)


class Tree(HTMLParser):
    """Links with their open ancestors (tag, classes, id); an end tag closes the innermost open element of its name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.links, self.elements = [], [], []
        self.a = None

    def handle_starttag(self, tag, attrs):
        d = dict(attrs)
        node = (tag, (d.get("class") or "").split(), d.get("id"))
        self.elements.append((node, list(self.open)))
        if tag == "a" and d.get("href") is not None:
            self.a = [d["href"], "", list(self.open)]
            self.links.append(self.a)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.elements.append(((tag, (dict(attrs).get("class") or "").split(), dict(attrs).get("id")), list(self.open)))

    def handle_endtag(self, tag):
        if tag == "a":
            self.a = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i]
                break

    def handle_data(self, data):
        if self.a and not (self.open and self.open[-1][0] in ("script", "style")):
            self.a[1] += data


def fits(node, step):
    return node[0] == step.tag and (not step.cls or step.cls in node[1]) and (not step.id or step.id == node[2])


def below(ancestors, path):
    for step in path:
        at = next((i for i, n in enumerate(ancestors) if fits(n, step)), None)
        if at is None:
            return False
        ancestors = ancestors[at + 1:]
    return True


def links(html, path):
    t = Tree()
    t.feed(html)
    t.close()
    return [(h, x) for h, x, up in t.links if below(up, path)]


def by_page(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.page_id, []).append((r.pos, r.href, r.anchor_text))
    assert all([p for p, *_ in sorted(v)] == list(range(len(v))) for v in out.values())
    return {k: [x[1:] for x in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("path", [[], [el.Step("nav")], [el.Step("body"), el.Step("ul"), el.Step("li")], [el.Step("article")], [el.Step("div", cls="ad")]])
def test_links_of_a_section_on_given_pages(spark, path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: links(r.html, path) for r in pages.collect()}
    assert by_page(el.section_links(pages, path)) == {k: v for k, v in want.items() if v}


NESTED = [
    '<div class="c"><div><a href="1">x</a></div><a href="2">y <b>z</b></a></div><a href="3">out</a>',
    '<div><div class="c"><div><div class="c"><a href="1">in</a></div></div><a href="2">in</a></div><a href="3">out</a></div>',
    "<div class='a c b'><ul><li><ul><li><a href='1'>deep</a></li></ul></li><li><a href='2'>x</a></li></ul></div><ul><li><a href='3'>out</a></li></ul>",
    '<div class="cc"><a href="1">no</a></div><div class="c" title="a > b </div>"><a href="2">yes</a><!-- </div> --><script>"</div>"</script><a href="3">yes</a></div>',
    '</div></div><div class="c"><br><img src="x"><a href="1">a</a></div></div><a href="2">out</a><div class="c"></div><a href="3">out</a>',
    '<DIV CLASS="c"><A HREF="1">A&amp;B &lt;c&gt;</A></DIV>',
    "", "no tags", "<", "a < b <a href=\"1\">x</a>",
]


def test_nested_equal_tags(spark):
    path = [el.Step("div", cls="c")]
    df = spark.createDataFrame(list(enumerate(NESTED)), "page_id int, html string").selectExpr("page_id", "html", "'https://h/x' as url")
    want = {i: links(h, path) for i, h in enumerate(NESTED)}
    assert by_page(el.section_links(df, path)) == {k: v for k, v in want.items() if v}
    lists = [el.Step("ul"), el.Step("li"), el.Step("li")]
    assert by_page(el.section_links(df, lists)) == {2: [("1", "deep")]}


def test_left_out_end_tags_and_matched_ends(spark):
    """``p`` and ``li`` without end tags end before the next of their name; matched elements know their end."""
    html = "<ul><li>a<p><a href='1'>x</a><li>b<p>c<p><a href='2'>y</a></ul><div><div></div></div><br/>"
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    got = [(r.href, r.anchor_text) for r in el.section_links(df, [el.Step("li"), el.Step("p")], url=None).orderBy("pos").collect()]
    assert got == [("1", "x"), ("2", "y")]
    tags = el.matched(el.tokens(df)).orderBy("pos").collect()
    outer, inner = [r for r in tags if r.tag == "div" and not r.is_end]
    assert outer.depth == 1 and inner.depth == 2 and outer.closed and outer.end == inner.end + 1
    assert [(r.pos, r.closed, r.end) for r in tags if r.tag == "li" and not r.is_end] == [(2, False, 6), (6, False, None)]
    assert [r.tag for r in el.select_elements(df, [el.Step("div"), el.Step("div")]).collect()] == ["div"]


def test_long_and_odd_pages(spark):
    long = "<div class='c'>" + "<b>" * 5000 + "<a href='1'>" + "<i></i>" * 5000 + "x" * 1_000_000 + "</a></div>"
    attr = "<a " + " ".join(f"k{i}='v'" for i in range(20_000)) + " href='2'>y</a>"
    hostile = ["<" * 200_000, "<a '" * 20_000, "<!--" * 50_000, "<script>" * 20_000, '<a href="' + "x" * 500_000]
    df = spark.createDataFrame(list(enumerate([long, attr, None, *hostile])), "page_id int, html string")
    got = by_page(el.section_links(df, [], url=None))
    assert got == {0: [("1", "x" * 1_000_000)], 1: [("2", "y")]}
    assert el.section_links(df.limit(0), [el.Step("div")], url=None).count() == 0
    plan = el.section_links(df, [el.Step("div"), el.Step("p")], url=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("regexp_replace") <= 2 and "Python" not in plan


def test_pages_get_parts_by_their_size(spark, monkeypatch):
    """The sorts of a task do not grow with the table: more pages, more parts."""
    monkeypatch.setattr(el, "PART_CHARS", 1000)
    df = spark.createDataFrame([(i, "<nav><a href='x'>" + "y" * 983 + "</a></nav>") for i in range(60)], "page_id int, html string")
    links = el.section_links(df, [el.Step("nav")], url=None)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and int(plan.split("Exchange hashpartitioning(page_id")[1].split(", ")[1].split(")")[0]) >= 60
    assert links.count() == 60


def test_three_sorts_whatever_the_number_of_steps(spark):
    """Tokens are sorted by tag, by tag and depth, and by position; a further step adds no sort."""
    df = spark.createDataFrame(list(enumerate(NESTED)), "page_id int, html string")
    for path in ([el.Step("div")], [el.Step("div"), el.Step("ul"), el.Step("li"), el.Step("b")]):
        plan = el.section_links(df, path, url=None)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Sort [") == 3


def test_sections_that_overlap(spark):
    """A section without its end tag ends before the next tag of its name, one that is closed late covers what comes after; nested ones reach to the farthest end."""
    pages = ['<p class="c"><a href="1">in</a><p><a href="2">out</a></p>', '<div class="c"><p class="c"></div><a href="1">in p</a><p><a href="2">out</a>',
             '<div class="c"><div class="c"><a href="1">in</a></div><a href="2">in</a></div><a href="3">out</a>', '<p class="c"/><a href="1">out</a><b class="c"><a href="2">in</a>']
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    got = by_page(el.section_links(df, [el.Step("p", cls="c")], url=None))
    assert got == {0: [("1", "in")], 1: [("1", "in p")]}
    assert by_page(el.section_links(df, [el.Step("div", cls="c")], url=None)) == {2: [("1", "in"), ("2", "in")]}
    assert by_page(el.section_links(df, [el.Step("b", cls="c")], url=None)) == {3: [("2", "in")]}
