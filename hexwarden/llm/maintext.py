"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of running text at block-level tags. A linear classifier over a block's markup and words
gives the cost of calling it content and that of calling it boilerplate; these are the capacities to the two terminals
of a graph. Neighbours in page order and blocks that follow each other under one parent are joined by edges, the
stronger the closer they stand in the document tree. The minimum cut (by maximum flow) labels all blocks at once: weak
evidence about a block gives way to its surroundings, strong evidence does not.

Defined results: null or empty html and pages without content blocks give the empty text; unclosed, unknown and
mismatched tags are tolerated, and pages of any length and nesting are parsed in time linear in their tags;
a comment's opening that never closes is text, and the tags behind it count; what stands in scripts, styles, forms' controls and comments of the markup is no text;
pages are independent, so repeated rows and ids all appear; an empty table gives an empty table; extra columns are not
read.
"""

from __future__ import annotations

import math
import re
from collections import deque
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hexwarden.llm.common import table

#: Tags by their meaning.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
SILENT = frozenset(
    "head title script style noscript template svg math canvas iframe object select option textarea button audio video "
    "datalist meter progress map".split()
)
AWAY = frozenset("nav footer aside form menu dialog".split())
TOWARDS = frozenset("article main".split())
#: Words in class, id and role that name a part of a page.
AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial banner banners breadcrumb breadcrumbs byline comment "
    "comments commentlist consent cookie cookies copyright disclaimer disqus dialog discussion donate feedback footer "
    "form gdpr header login masthead menu menubar meta modal nav navbar navigation newsletter notice notices notification "
    "outbrain overlay pager pagination paywall popup promo promotion promoted recommended related replies reply respond "
    "responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola tags "
    "toolbar topbar warning widget widgets alert alerts contentinfo complementary alertdialog".split()
)
TOWARDS_WORDS = frozenset("article content entry main post story text body prose".split())

#: The classifier: log odds of content.
BIAS, ZONE_TOWARDS, ZONE_AWAY = -0.6, 3.5, -7.0
TAG_ODDS = {"p": 1.0, "h1": 0.8, "h2": 0.5, "h3": 0.4, "blockquote": 0.8, "pre": 0.8, "li": -0.4, "td": -0.2, "th": -0.4}
PER_LOG_WORD, LINKS, SENTENCE, COPYRIGHT = 0.35, -4.0, 0.5, -2.0
#: Weight of an edge between neighbours, before it is divided by 1 + their distance in the tree.
SMOOTH = 2.0

_NAME_WORDS = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?…。！？][\"'»”’)\]]*$")
_COMMENT_END = re.compile(r"--!?\s*>")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    __slots__ = ("link_chars", "node", "tag", "text", "zone")

    def __init__(self, text, link_chars, node, tag, zone):
        self.text, self.link_chars, self.node, self.tag, self.zone = text, link_chars, node, tag, zone


class _Node:
    """A block-level element; inline ones have no node, as they are no part of a block's place in the tree."""

    __slots__ = ("depth", "parent", "tag", "zone")

    def __init__(self, tag, zone, parent):
        self.tag, self.zone, self.parent = tag, zone, parent
        self.depth = parent.depth + 1 if parent else 0


class _Open:
    """An open element, with what has to be known of those it stands in, so that nothing walks the stack."""

    __slots__ = ("inline_zone", "node", "node_at", "solid_at", "tag", "zone")

    def __init__(self, tag, zone, node, inline_zone, node_at, solid_at):
        self.tag, self.zone, self.node = tag, zone, node
        self.inline_zone = inline_zone  # The lowest zone of the open inline elements; 1, the highest, without any.
        self.node_at, self.solid_at = node_at, solid_at  # Places of the last block-level element, and of the last but <p>.


def _zone(tag: str, attrs, outer: int) -> int:
    """1: inside a part that names itself the article, -1: inside one that names itself something else, 0: neither."""
    if tag in ("html", "body"):
        return 0
    if tag in AWAY:
        return -1
    if tag in TOWARDS:
        return 1
    names = " ".join(value for key, value in attrs if key in ("class", "id", "role") and value)
    words = set(_NAME_WORDS.findall(_CAMEL.sub(" ", names).lower())) if names else set()
    away, towards = not words.isdisjoint(AWAY_WORDS), not words.isdisjoint(TOWARDS_WORDS)
    if tag == "header":
        return outer if outer == 1 else -1
    if away != towards and tag not in ("p", *INLINE):
        return -1 if away else max(outer, 1) if outer >= 0 else outer
    return -1 if away and not towards else outer


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.root = _Node("body", 0, None)
        self.stack: list[_Open] = [_Open("", 0, self.root, 1, 0, 0)]
        self.places: dict[str, list[int]] = {}  # Where in the stack the open elements of a tag are.
        self.silent = self.links = 0
        self.parts: list[str] = []
        self.link_chars = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1]
            self.blocks.append(Block(text, self.link_chars, top.node, top.node.tag, min(top.node.zone, top.inline_zone)))
        self.parts, self.link_chars = [], 0

    def _push(self, tag: str, attrs) -> None:
        top, at = self.stack[-1], len(self.stack)
        zone = _zone(tag, attrs, top.zone)
        if tag in INLINE:
            opened = _Open(tag, zone, top.node, min(zone, top.inline_zone), top.node_at, top.solid_at)
        else:
            node = _Node(tag, zone, top.node)
            opened = _Open(tag, zone, node, top.inline_zone, at, top.solid_at if tag == "p" else at)
        self.stack.append(opened)
        self.places.setdefault(tag, []).append(at)
        self.silent += tag in SILENT
        self.links += tag == "a"

    def _pop_to(self, size: int) -> None:
        while len(self.stack) > size:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            self.silent -= tag in SILENT
            self.links -= tag == "a"

    def _close(self, tag: str, since: int = 0) -> None:
        """Close the last open ``tag`` and all it holds, unless it stands before the place ``since``."""
        places = self.places.get(tag)
        if places and places[-1] >= since:
            self._pop_to(places[-1])

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "hr", "wbr"):
            self.parts.append("" if tag == "wbr" else " ")
        if tag not in INLINE and tag not in SILENT:
            self.flush()
            if tag == "body":
                self._pop_to(1)
            elif tag == "p" or tag in ("div", "ul", "ol", "table", "section", "article", "footer", "nav", "aside"):
                self._close("p", self.stack[-1].solid_at)
            elif tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
                self._close(tag, self.stack[-1].solid_at)
        if tag not in VOID:
            self._push(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "iframe", "script"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE and tag not in SILENT:
            self.flush()
        self._close(tag, self.stack[-1].node_at if tag in INLINE else 0)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.link_chars += len(data.strip())


def _settled(html: str) -> str:
    """The page with comments and tags that never close written as the text they count as; the parser would search the
    rest of the page for the end of each."""
    ends = 0
    for match in _COMMENT_END.finditer(html):
        ends = match.end()
    html = html[:ends] + html[ends:].replace("<!--", "&lt;!--")
    ends = html.rfind(">") + 1
    return html[:ends] + html[ends:].replace("<", "&lt;")


def blocks_of(html: str) -> list[Block]:
    parser = _Blocks()
    parser.feed(_settled(html))
    parser.close()
    parser.flush()
    return parser.blocks


def odds(block: Block) -> float:
    """Log odds that the block is content."""
    total = BIAS + (ZONE_TOWARDS if block.zone > 0 else ZONE_AWAY if block.zone < 0 else 0.0)
    total += TAG_ODDS.get(block.tag, 0.0) + PER_LOG_WORD * math.log1p(len(block.text.split()))
    total += LINKS * min(1.0, block.link_chars / len(block.text))
    if _SENTENCE.search(block.text):
        total += SENTENCE
    if block.zone <= 0 and ("©" in block.text or "(c)" in block.text):
        total += COPYRIGHT
    return total


def _distance(one: _Node, other: _Node) -> int:
    """Steps from one node of the tree to another; between blocks in page order no more than tags between them."""
    steps = 0
    while one is not other:
        if one.depth < other.depth:
            one, other = other, one
        one, steps = one.parent, steps + 1
    return steps


def _edges(blocks: list[Block]):
    last_under: dict[_Node, int] = {}
    for i, block in enumerate(blocks):
        near, parent = {i - 1} if i else set(), block.node.parent or block.node
        if parent in last_under:
            near.add(last_under[parent])
        last_under[parent] = i
        for j in near:
            yield j, i, SMOOTH / (1 + _distance(blocks[j].node, block.node))


def minimum_cut(gain: list[float], edges) -> list[bool]:
    """Labels that minimise the costs: a node called False pays ``gain`` if positive, one called True pays ``-gain`` if
    negative, and an edge (i, j, weight) pays its weight if its ends differ. Maximum flow by blocking flows."""
    n = len(gain)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def add(i: int, j: int, forth: float, back: float) -> None:
        head[i].append(len(to))
        head[j].append(len(to) + 1)
        to.extend((j, i))
        room.extend((forth, back))

    for i, g in enumerate(gain):
        if g >= 0:
            add(source, i, g, 0.0)
        else:
            add(i, sink, -g, 0.0)
    for i, j, weight in edges:
        add(i, j, weight, weight)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for e in head[i]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        following, path = [0] * (n + 2), []
        at = source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= 1e-12)
                at = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while following[at] < len(head[at]):
                e = head[at][following[at]]
                if room[e] > 1e-12 and level[to[e]] == level[at] + 1:
                    path.append(e)
                    at = to[e]
                    break
                following[at] += 1
            else:
                if not path:
                    break
                at = to[path.pop() ^ 1]
                following[at] += 1


def main_text(html: str | None) -> str:
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    content = minimum_cut([odds(b) for b in blocks], _edges(blocks))
    return "\n\n".join(b.text for b, keep in zip(blocks, content, strict=True) if keep)


@F.pandas_udf(StringType())
def _main_texts(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract(html: Column) -> Column:
    return _main_texts(html)


def extract_pages(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    out = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extract(F.coalesce(html_col, F.lit(""))).alias("text")
    )
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
