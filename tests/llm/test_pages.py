"""Main texts of pages with planted boilerplate, of consensus over hosts, and of broken html."""

import random
from html.parser import HTMLParser

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clipmine.llm import pages

BOILERPLATE = [
    '<nav class="top"><ul><li><a href="/a">Home page</a></li><li>About us and all of our many friends</li></ul></nav>',
    "<header><h2>The site's own name</h2></header>",
    "<footer>&copy; 2024 A company, all rights reserved, in every country.</footer>",
    '<div class="sidebar"><p>Most read this week, and what the editors liked best.</p></div>',
    '<div id="cookieNotice">We use cookies to make this page better for everyone who reads it.</div>',
    '<div class="ad ad-top"><p>Buy now, only today, two for the price of one!</p></div>',
    '<form action="/s"><p>Search this site for something else</p><input name="q"><button>Go</button></form>',
    '<script>var t = "</p><p>not a text</p>"; if (a < b) { f("<div>") }</script>',
    "<style>p > b { color: red }</style><!-- <p>hidden remark</p> -->",
    '<section class="comments"><article class="comment"><p>A long remark of a reader who is of another opinion altogether.</p></article></section>',
    '<p style="display: none">An invisible paragraph that nobody reads.</p><div hidden>Not shown either.</div>',
    '<aside role="complementary"><p>Beside the point.</p></aside><iframe><p>Framed</p></iframe>',
]
TEXT = ["First & foremost, a title", "It began with a walk. Then it rained, and all went home.", "A list entry", "Second  entry,\n longer than the first, with café.", "The end."]
WANTED = "First & foremost, a title\nIt began with a walk. Then it rained, and all went home.\nA list entry\nSecond entry, longer than the first, with café.\nThe end."


def article(rng, wrap):
    def extra():
        return "".join(rng.sample(BOILERPLATE, rng.randint(0, 3)))

    e = ["First &amp; foremost,<br>a title", "It began with a <a href='/w'>walk</a>. Then <b>it</b> rained,<script>x</script> and all went home.", "A list entry", "Second &nbsp;entry,\n longer than the first, with caf&eacute;.", "The end."]
    body = f"<h1>{e[0]}</h1>{extra()}<p>{e[1]}<ul><li>{e[2]}<li><p>{e[3]}</p></ul>{extra()}<p>{e[4]}"
    return f"<!DOCTYPE html><html><head><title>Not this</title></head><body class='with-sidebar'>{extra()}{wrap[0]}{body}{wrap[1]}{extra()}</body></html>"


WRAPS = [
    ("<article>", "</article>"),
    ("<main><div class='post-content'>", "</div></main>"),
    ("<div id='page'><div class='entry entry-4711'>", "</div></div>"),
    ("<main><article id='x'><section>", "</section></article></main>"),
    ("<form id='aspnet'><div class='content with-comments'>", "</div></form>"),
    ("<div class='container'><table><tr><td>", "</td></tr></table></div>"),
]


@pytest.mark.parametrize("wrap", WRAPS)
def test_boilerplate_goes_and_text_stays(wrap):
    rng = random.Random(wrap[0])
    for _ in range(60):
        assert pages.extracted(article(rng, wrap), []) == WANTED


class Blocks(HTMLParser):
    """The blocks of simple pages, by the standard library."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [""], 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("nav", "footer", "aside")
        if tag in ("p", "div", "h2", "nav", "footer", "aside", "article", "body"):
            self.parts.append("")
        elif tag == "br":
            self.parts[-1] += " "

    def handle_endtag(self, tag):
        self.skip -= tag in ("nav", "footer", "aside")
        if tag in ("p", "div", "h2", "nav", "footer", "aside", "article", "body"):
            self.parts.append("")

    def handle_data(self, data):
        if not self.skip:
            self.parts[-1] += data

    def text(self):
        return "\n".join(t for t in (" ".join(p.split()) for p in self.parts) if t)


def element(children):
    tags = st.sampled_from(["p", "div", "h2", "b", "i", "nav", "footer", "aside", "span"])
    return st.tuples(tags, st.lists(children, max_size=4)).map(lambda t: f"<{t[0]}>{''.join(t[1])}</{t[0]}>")


LEAF = st.sampled_from(["word", " ", "two words", "&lt;tag&gt;", "a &amp; b", "<br>", "<!-- c -->", "é\n", "&notin;", "1 < 2 "])
INLINE = st.recursive(LEAF, lambda c: st.tuples(st.sampled_from(["b", "i", "span"]), st.lists(c, max_size=3)).map(lambda t: f"<{t[0]}>{''.join(t[1])}</{t[0]}>"), max_leaves=6)
FLOW = st.recursive(
    st.lists(INLINE, max_size=4).map(lambda x: f"<p>{''.join(x)}</p>") | INLINE,
    lambda c: st.tuples(st.sampled_from(["div", "nav", "footer", "aside"]), st.lists(c, max_size=4)).map(lambda t: f"<{t[0]}>{''.join(t[1])}</{t[0]}>"),
    max_leaves=20,
)


@given(st.lists(FLOW, max_size=6).map("".join))
def test_blocks_as_by_the_standard_parser(body):
    html = f"<body><article>A heading. {body} and an end.</article></body>"
    assert pages.extracted(html, []) == Blocks(html).text()


@given(st.text(alphabet="<>/abp='\"! -&;\n", max_size=60))
def test_anything_can_be_read(html):
    page = pages.Page(html)
    k = page.container()
    assert isinstance(page.text([k]), str) and k in page.at_path(page.path(k)) or not page.nodes[k].score
    for cut in range(0, len(html), 7):
        pages.extracted(html[:cut], [("html/body", 0.5)])


def test_paths_are_generalised():
    assert pages.generalised("div", "post-123 body a0f39c77e") == "div.#.body.post-#"
    assert pages.generalised("div", "b a b") == "div.a.b" and pages.generalised("p", "") == "p"


@pytest.fixture(scope="module")
def hosts(spark):
    """A host whose longest container is sometimes an unmarked talk of readers; its other pages outvote it."""
    rows = []
    for i in range(30):
        story = "".join(f"<p>Story {i}, part {k}: enough words to be a paragraph of some length.</p>" for k in range(6))
        talk = "".join(f"<p>Reader {k} says something, at length and with much feeling about it.</p>" for k in range(60 if i % 10 == 0 else 1))
        rows.append((i, f"https://News.example.org:80/{i}?q#f", f"<body><div class='c'><div class='story s{i}'>{story}</div></div><div class='talk'>{talk}</div></body>"))
    return rows


def test_a_page_follows_its_host(spark, hosts):
    odd = [(100, None, "<p>alone</p>"), (101, "nonsense", "no tag at all &amp; a  space"), (102, "http://e.org", None), (103, "http://e.org", ""), (None, "http://e.org", "<body><p>x"), (101, "nonsense", "no tag at all &amp; a  space")]
    odd.append((104, "http://long.org", "<article>" + "<p>long text</p>" * 100_000))
    table = spark.createDataFrame(hosts + odd, "page_id long, url string, html string").repartition(4)
    table = table.withColumns({n: F.lit("extra") for n in ("host", "path", "text", "winners", "score", "votes")})
    got = {}
    for r in pages.main_texts(table).collect():
        assert r["n_chars"] == len(r["text"])
        got.setdefault(r["page_id"], []).append((r["url"], r["text"]))
    for i, url, _ in hosts:
        assert got[i] == [(url, "\n".join(f"Story {i}, part {k}: enough words to be a paragraph of some length." for k in range(6)))]
    assert got[101] == [("nonsense", "no tag at all & a space")] * 2
    assert [got[i][0][1] for i in (100, 102, 103, None)] == ["alone", "", "", "x"]
    assert got[104][0][1] == "\n".join(["long text"] * 100_000)
    won = {(r["host"], r["path"]): r["votes"] for r in pages.votes(table).collect()}
    assert won["news.example.org", "body/div.c/div.s#.story"] == 27 and won["news.example.org", "body/div.talk"] == 3
    # without its host, a page with a long talk is misled
    assert pages.extracted(hosts[0][2], []).startswith("Reader 0")


def test_empty_table(spark):
    assert pages.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
