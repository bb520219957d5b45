"""Main text of web pages by consensus host paths.

1. A page's elements are read once from left to right. Elements that aren't content by name, role or class (menus, headers,
   footers, sidebars, notices, adverts, forms, comments, scripts) are marked with all they hold. Each other container is
   scored by the text of its blocks, without links. The page's container is an `article` or `main`, else the smallest one that holds
   most of the page's score.
2. The container's path of tags and classes, generalised (numbers and hashes in class names taken out), is the page's vote.
   Votes are counted per host in Spark, each path once a page, so a host with a third of all pages is a partial aggregate.
3. Every page is read again with the winning paths of its host: all its containers at the most voted one that it has give the text. A
   page without any keeps its own container; so does one whose own path has won votes enough itself.

The text is the container's blocks less the marked elements: character references decoded, white space inside a block
made one space, ends trimmed, empty blocks left out, one line feed between blocks. `br` is white space.

Defined cases: a null or empty html gives an empty text; html without a tag is one block; unclosed and crossing tags are
closed where an enclosing one ends, a page cut off anywhere is read to its end; a null url or one without a host
belongs to the host ''; rows may repeat, and vote again; equal votes are decided by score, then by path; an empty
table gives an empty table; extra columns are ignored, whatever their names; a very long page is read in one task, in time
and memory proportional to it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmine.llm.tables import BROADCAST_BYTES, stored

#: Of a host's votes that a path needs to be used on other pages, and to be kept by its own pages.
WINS, STAYS = 0.05, 0.2
#: The part of a container's score that a smaller one inside it must hold to take its place.
BULK = 0.7
#: Paths of one host that can win: each needs `WINS` of the votes.
MOST = int(1 / WINS)

# The elements of HTML by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
#: A start tag that ends an open element of these names, if no element of the second set lies between.
CLOSES = {
    "p": (frozenset({"p"}), frozenset("article aside blockquote body div fieldset form li main section table td th".split())),
    "li": (frozenset({"li"}), frozenset("ul ol menu dir".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
PARAGRAPH_ENDS = BLOCK - {"body", "html", "head", "option", "optgroup", "tbody", "thead", "tfoot", "tr", "caption", "legend"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTSIDE = frozenset("head nav header footer aside button select input label menu dialog object embed svg math canvas audio video map fieldset".split()) | RAW
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsors sponsored promo promos promotion "
    "banner banners cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager sidebar sidebars aside widget widgets related recommended "
    "recommendations share sharing social comment comments commentlist disqus respond reply replies footer header masthead toolbar copyright disclaimer "
    "skip form search searchbox topbar".split()
)
#: A word before one of these that says the element only goes with it.
NEGATED = frozenset("no non not has have with without hide hidden".split())
CONTAINERS = frozenset("article main section div body html td center blockquote".split())
MAIN = frozenset({"article", "main"})
# End of the fixed values.

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>\x00]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)(?:>|\Z)",
    re.S,
)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.S)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_NUMBER = re.compile(r"(?=[A-Za-z]*\d)[0-9A-Fa-f]{6,}|\d+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    classes: str
    outside: bool
    mains: bool = False  # holds an article or main
    closed: bool = False
    score: int = 0
    heading: bool = False
    children: list[int] = field(default_factory=list)


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), unescape(next((v for v in values if v), "")))
    return out


def is_outside(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element is no content by its name, role, visibility or classes."""
    if tag in OUTSIDE:
        return True
    if tag in ("html", "body", "main") or not attrs:
        return False
    if attrs.get("role", "").lower() in OUTSIDE_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in _WORDS.findall(name)]
        for k, word in enumerate(words):
            if word in OUTSIDE_WORDS and not (k and words[k - 1] in NEGATED):
                return True
    return False


def generalised(tag: str, classes: str) -> str:
    """One step of a path: the tag with its classes, numbers and hashes in them taken out."""
    names = sorted({_NUMBER.sub("#", c) for c in classes.split()})
    return ".".join([tag, *names])


class Page:
    """The elements of a page and its blocks of text, each with the element it lies in."""

    def __init__(self, html: str):
        self.nodes = [Node("", -1, "", False)]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._read(html)
        self._weigh()

    def _read(self, html: str) -> None:
        open_: list[int] = [0]
        names: dict[str, int] = {}  # how many elements of a name are open
        text: list[str] = []
        links = linked = muted = at = 0
        nodes, blocks = self.nodes, self.blocks
        owner = 0  # the innermost block element; a block of text belongs to it

        def end_block() -> None:
            nonlocal linked
            if text:
                clean = " ".join("".join(text).split())
                if clean:
                    blocks.append((owner, clean, min(linked, len(clean))))
                text.clear()
            linked = 0

        def left(k: int) -> None:
            """An element is no longer open."""
            nonlocal links, muted
            node = nodes[k]
            names[node.tag] -= 1
            links -= node.tag == "a"
            if muted and node.outside and node.tag not in BLOCK:
                muted -= 1

        def close(depth: int) -> None:
            nonlocal owner
            breaks = any(nodes[k].tag in BLOCK for k in open_[depth:])
            if breaks:
                end_block()
            for k in open_[depth:]:
                left(k)
            del open_[depth:]
            if breaks:
                owner = next((k for k in reversed(open_) if nodes[k].tag in BLOCK), 0)

        def put(raw: str) -> None:
            nonlocal linked
            if muted:
                return
            piece = unescape(raw) if "&" in raw else raw
            text.append(piece)
            if links:
                linked += len(piece.strip())

        for begin, end, slash, tag, source in _tokens(html):
            if begin > at:
                put(html[at:begin])
            at = end
            if tag is None:
                if html.startswith("<![CDATA[", begin):
                    put(html[begin + 9 : end].removesuffix("]]>"))
                continue
            if slash:
                if names.get(tag):
                    depth = next(d for d in range(len(open_) - 1, 0, -1) if nodes[open_[d]].tag == tag)
                    nodes[open_[depth]].closed = True
                    if tag not in BLOCK and any(nodes[k].tag in BLOCK for k in open_[depth:]):
                        left(open_.pop(depth))  # an inline element crosses blocks; they stay open
                    else:
                        close(depth)
                elif tag == "p":
                    end_block()
                elif tag == "br":
                    text.append(" ")
                continue
            if tag in ("br", "td", "th"):
                text.append(" ")
            self._imply(open_, names, tag, close)
            if tag in VOID:
                if tag in BLOCK:
                    end_block()
                continue
            attrs = attributes(source) if len(source) > 1 else {}
            outside = is_outside(tag, attrs)
            if tag in BLOCK:
                end_block()
            k = len(nodes)
            nodes.append(Node(tag, open_[-1], attrs.get("class", ""), outside))
            nodes[open_[-1]].children.append(k)
            if tag in RAW:
                nodes[k].closed = True
                continue
            open_.append(k)
            names[tag] = names.get(tag, 0) + 1
            links += tag == "a"
            if tag in BLOCK:
                owner = k
            elif outside:
                muted += 1
            if tag in MAIN and not outside:
                muted = 0
                for up in open_:
                    nodes[up].mains = True
        if at < len(html):
            put(html[at:])
        end_block()

    def _imply(self, open_: list[int], names: dict[str, int], tag: str, close) -> None:
        """End the open elements that a start tag ends without saying so."""
        rules = [CLOSES[tag]] if tag in CLOSES else []
        if tag in PARAGRAPH_ENDS and tag != "p":
            rules.append(CLOSES["p"])
        for ended, barriers in rules:
            if not any(names.get(n) for n in ended):
                continue
            for d in range(len(open_) - 1, 0, -1):
                here = self.nodes[open_[d]].tag
                if here in ended:
                    close(d)
                    break
                if here in barriers:
                    break

    def _weigh(self) -> None:
        nodes = self.nodes
        for k, node in enumerate(nodes):
            # An unclosed notice before the article doesn't take the article away.
            spared = node.mains and node.tag not in MAIN and not node.closed and node.tag not in ("nav", "header", "footer", "aside")
            node.outside = (node.outside and not spared) or (k > 0 and nodes[node.parent].outside)
        forms = [k for k, n in enumerate(nodes) if n.tag == "form" and not n.outside]
        self._score()
        # A form around a whole page is no form of the page; others go, with what they hold.
        gone = {k for k in forms if not nodes[k].mains and 2 * nodes[k].score < nodes[0].score}
        if gone:
            for k, node in enumerate(nodes):
                node.outside = node.outside or k in gone or (k > 0 and nodes[node.parent].outside)
            self._score()

    def _score(self) -> None:
        """The text of an element's own blocks, and of those in it: blocks that are links for the most part count nothing."""
        nodes = self.nodes
        for node in nodes:
            node.score = 0
        for k, text, linked in self.blocks:
            node = nodes[k]
            if not node.outside and 2 * linked <= len(text):
                node.score += len(text) - linked
                if node.tag in HEADINGS:
                    nodes[node.parent].heading = True
        for k in range(len(nodes) - 1, 0, -1):
            nodes[nodes[k].parent].score += nodes[k].score

    def path(self, k: int) -> str:
        steps = []
        while k:
            steps.append(generalised(self.nodes[k].tag, self.nodes[k].classes))
            k = self.nodes[k].parent
        return "/".join(reversed(steps))

    def container(self) -> int:
        """The element that holds the main text, by this page alone; 0 is the page itself.

        The largest article, if all articles at its path hold a quarter of the page's score; else the largest `main`;
        else one goes down from the page as long as one element inside holds the bulk of the score and no heading is lost.
        """
        nodes = self.nodes
        mains = sorted((n.tag == "main", -n.score, k) for k, n in enumerate(nodes) if n.tag in MAIN and not n.outside and n.score)
        k = mains[0][2] if mains else 0
        if k and nodes[k].tag == "article":
            if 4 * sum(nodes[c].score for c in self.at_path(self.path(k))) >= nodes[0].score:
                return k
            k = next((m for is_main, _, m in mains if is_main), 0)
        while True:
            node = nodes[k]
            inner = [c for c in node.children if not nodes[c].outside and nodes[c].tag in CONTAINERS]
            best = max(inner, key=lambda c: (nodes[c].score, -c), default=None)
            if best is None or not nodes[best].score or nodes[best].score < BULK * node.score:
                return k
            if node.heading and node.tag not in ("", "html", "body"):
                return k
            k = best

    def at_path(self, path: str) -> list[int]:
        """The outermost elements at a path that aren't outside."""
        steps = path.split("/") if path else []
        level = [0]
        for step in steps:
            level = [c for k in level for c in self.nodes[k].children if not self.nodes[c].outside and generalised(self.nodes[c].tag, self.nodes[c].classes) == step]
            if not level:
                return []
        return level

    def text(self, containers: list[int]) -> str:
        """The blocks inside the containers, in page order, less what is outside."""
        inside = [False] * len(self.nodes)
        chosen = set(containers)
        for k, node in enumerate(self.nodes):
            inside[k] = not node.outside and (k in chosen or (k > 0 and inside[node.parent]))
        return "\n".join(text for k, text, _ in self.blocks if inside[k])


def _tokens(html: str):
    """Tags and declarations as (start, end, slash, name or None, attributes); what scripts and the like hold is skipped."""
    at = 0
    while True:
        found = _TOKEN.search(html, at)
        if not found:
            return
        at = found.end()
        name = found[2].lower() if found[2] else None
        if name in RAW and not found[1] and not found[3].endswith("/"):
            stop = _RAW_END[name].search(html, at)
            at = stop.end() if stop else len(html)
        yield found.start(), at, found[1], name, found[3] or ""


def vote(html: str) -> tuple[str, int]:
    """The path of a page's container and its score."""
    page = Page(html)
    k = page.container()
    return page.path(k), page.nodes[k].score


def extracted(html: str, winners: list[tuple[str, float]]) -> str:
    """The main text by the winning paths (path, share of votes) of the page's host, most voted first."""
    page = Page(html)
    own = page.container()
    path = page.path(own)
    shares = dict(winners)
    if shares.get(path, 0) < STAYS:
        for path_, _ in winners:
            text = page.text(page.at_path(path_))
            if text:
                return text
    return page.text(page.at_path(path)) or page.text([own])


def host(url: Column) -> Column:
    """The host of a url in lower case, without port and user; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1))


def _scan(df: DataFrame, make, ddl: str, schema: pa.Schema) -> DataFrame:
    def scan(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = [make(row) for row in batch.slice(i, 64).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return df.mapInArrow(scan, ddl)


def votes(pages: DataFrame) -> DataFrame:
    """(`host`, `path`, `votes`, `share`, `place`) of the paths that win on their host."""
    cast = pages.select(host(F.col("url").cast("string")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def make(row: dict) -> dict:
        path, score = vote(row["html"])
        return {"host": row["host"], "path": path, "score": score}

    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("score", pa.int64())])
    cast_votes = _scan(cast, make, "host string, path string, score long", schema).where(F.col("score") > 0)
    counted = stored(cast_votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score")))
    totals = counted.groupBy("host").agg(F.sum("votes").alias("total"))
    shares = counted.join(totals, "host").withColumn("share", F.col("votes") / F.col("total")).where(F.col("share") >= WINS)
    best = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path")
    return shares.withColumn("place", F.row_number().over(best)).where(F.col("place") <= MOST).select("host", "path", "votes", "share", "place")


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row of `pages`: page_id, url, text, n_chars."""
    listed = votes(pages).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "path", "share"))).alias("winners"))
    winners = stored(listed)
    size = winners.agg(F.sum(F.length(F.col("host")) + F.aggregate("winners", F.lit(0), lambda n, w: n + F.length(w["path"]) + 32))).first()[0] or 0
    side = F.broadcast(winners) if size <= BROADCAST_BYTES // 4 else winners
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        host(F.col("url").cast("string")).alias("host"),
    )

    def make(row: dict) -> dict:
        text = extracted(row["html"], [(w["path"], w["share"]) for w in row["winners"] or []])
        return {"page_id": row["page_id"], "url": row["url"], "text": text, "n_chars": len(text)}

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    return _scan(rows.join(side, "host", "left").drop("host"), make, "page_id long, url string, text string, n_chars long", schema)
