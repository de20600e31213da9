"""Main text of web pages by composite text density.

For every node of the page's tree: characters per tag, adjusted for characters and tags inside links. The node
with the largest sum of its children's densities is the core; the smallest density on the way from the body to
it is the threshold for what may be joined to it. Elements that are never article text (menus, forms, scripts,
notices, adverts, comments) are cut out of the tree before densities are taken. Names and class words of elements
that hold the page's content (most of its text outside links, or its only article) are passed over.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, map_rows

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr img".split())
NEVER = frozenset("head title script style noscript template iframe object embed svg canvas audio video button select option textarea input".split())
# Not the article, unless they are around all of it.
APART = frozenset("nav aside form dialog menu footer".split())
ARTICLE = frozenset(("article", "main"))
# Words in class, id or role that mark what is not the article.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay"
    " comment comments respond reply replies disqus sidebar widget widgets menu navbar nav navigation breadcrumb breadcrumbs footer masthead share sharing"
    " social related recommended newsletter subscribe signup login search pagination pager skip toolbar complementary contentinfo".split()
)
# Marks of what is cut out: by a name or word that may stand on a wrapper of the content too, or for good.
PART, GONE = 1, 2
# A marked word after one of these says what an element has or lacks, not what it is.
NOT_ITSELF = frozenset(("no", "has", "with", "without"))
# Start tags that end an open element of the given names.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
BARRIER = frozenset("table ul ol dl td th article section div body main".split())
SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "up", "kids", "marked", "chars", "tags", "link_chars", "link_tags", "density", "total", "plain", "holds", "inside")

    def __init__(self, tag: str, up: Node | None, marked: int) -> None:
        self.tag, self.up, self.marked, self.kids = tag, up, marked, []
        self.inside = tag in ARTICLE or up is not None and up.inside


class Tree(HTMLParser):
    """The elements and texts of a page. Open elements end where HTML lets their end tags be left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None, 0)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body" or tag == "html":
            while self.at.up is not None and self.at.tag not in ("html", "body"):
                self.at = self.at.up
        if tag in ENDS_P:
            self._end(("p",))
        if tag in ENDS:
            self._end(ENDS[tag])
        node = Node(tag, self.at, _marked(tag, attrs, self.at))
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        node = self.at
        while node is not None and node.tag != tag:
            if tag in INLINE and node.tag not in INLINE:
                return
            node = node.up
        if node is not None and node.up is not None:
            self.at = node.up

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)

    def _end(self, names: tuple[str, ...]) -> None:
        node = self.at
        while node is not None and node.up is not None:
            if node.tag in names:
                self.at = node.up
                return
            if node.tag in BARRIER:
                return
            node = node.up


def _marked(tag: str, attrs: list, up: Node) -> int:
    if tag in NEVER:
        return GONE
    fixed = tag in ("html", "body") or tag in ARTICLE
    mark = PART if tag in APART or tag == "header" and not up.inside else 0
    for name, value in () if fixed else attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return GONE
        if name in ("class", "id", "role") and value:
            before = ""
            for word in SPLIT.split(value.lower()):
                if before not in NOT_ITSELF and (word in MARKED or word == "header" and not up.inside):
                    mark = PART
                before = word
    return mark


def _unmark_wrappers(root: Node) -> None:
    """Takes the mark from elements with more than half of the page's text outside links; and, as long as no text
    of an article is left in the tree, from those around one."""
    nodes = [root]
    for n in nodes:
        nodes += [k for k in n.kids if isinstance(k, Node) and k.marked != GONE]
    for n in reversed(nodes):
        n.plain, n.holds = 0, n.tag in ARTICLE
        for k in n.kids:
            if isinstance(k, str):
                n.plain += len("".join(k.split()))
            elif k.marked != GONE:
                n.plain += 0 if k.tag == "a" else k.plain
                n.holds = n.holds or k.holds
    for n in nodes:
        if n.marked and 2 * n.plain > root.plain:
            n.marked = 0
    todo = [root]
    while todo:
        around, found = [], False
        for n in todo:
            for k in n.kids:
                if isinstance(k, str):
                    found = found or n.inside and bool(k.strip())
                elif not k.marked:
                    todo.append(k)
                elif k.marked == PART and k.holds:
                    around.append(k)
        if found:
            return
        for n in around:
            n.marked = 0
        todo = around


def _sorted_nodes(root: Node) -> list[Node]:
    """Nodes that are not marked, parents before children; no recursion, so depth has no limit."""
    out = [root]
    for node in out:
        out += [k for k in node.kids if isinstance(k, Node) and not k.marked]
    return out


def _measure(nodes: list[Node]) -> None:
    for n in reversed(nodes):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for k in n.kids:
            if isinstance(k, str):
                n.chars += len("".join(k.split()))
            elif not k.marked:
                n.chars += k.chars
                n.tags += k.tags + 1
                n.link_chars += k.chars if k.tag == "a" else k.link_chars
                n.link_tags += k.tags + 1 if k.tag == "a" else k.link_tags
    all_chars, all_links = max(1, nodes[0].chars), nodes[0].link_chars
    for n in nodes:
        c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        base = math.log(c / max(1, c - n.link_chars) * n.link_chars + all_links / all_chars * c + math.e)
        n.density = c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(max(base, 1.0 + 1e-9)) if c else 0.0
    for n in nodes:
        n.total = sum(k.density for k in n.kids if isinstance(k, Node) and not k.marked)


def _core(nodes: list[Node]) -> tuple[Node, float]:
    """The node whose text is taken, and the threshold."""
    best = max(nodes, key=lambda n: n.total)
    threshold, node, top = best.density, best, best
    while node is not None:
        threshold = min(threshold, node.density)
        if node.tag in ARTICLE:
            top = node
        node = node.up
    if top.tag not in ARTICLE:
        # Without an article element the core grows while what is added is no sparser than the way to it.
        while top.up is not None and top.tag != "body":
            others = [k for k in top.up.kids if isinstance(k, Node) and not k.marked and k is not top and k.chars]
            if any(k.density < threshold and 2 * k.link_chars > k.chars for k in others):
                break
            top = top.up
    return top, threshold


def _text(top: Node, threshold: float) -> str:
    parts: list[str] = []
    loose = top.tag not in ARTICLE
    stack: list[object] = [top]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif not x.marked:
            if loose and x is not top and x.tag not in INLINE and x.density < threshold and 2 * x.link_chars > x.chars:
                continue
            edge = [] if x.tag in INLINE else [" "]
            stack += edge + x.kids[::-1] + edge
    return " ".join("".join(parts).split())


def main_text(html: str | None) -> str:
    """The article's text; empty for null, empty or textless pages."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    _unmark_wrappers(tree.root)
    nodes = _sorted_nodes(tree.root)
    _measure(nodes)
    if not nodes[0].chars:
        return ""
    return _text(*_core(nodes))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``. Repeated rows give repeated results; an empty
    table gives none. Other columns are not read."""

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return map_rows(rows, run, {"page_id": arrow_type(pages, "page_id"), "url": arrow_type(pages, "url"), "text": pa.string(), "n_chars": pa.int64()})
