"""The readable text of a page (T-15, S-08): by the source's selector, else by scores of a tree, else none.

Paragraphs score by length and commas and pass their scores to the blocks around them,
half of it with each step; what links make up of a block's text is taken off. The best
block and its well-scored neighbours are the article. What is left of it is cleaned:
clusters of offers, banners and blocks of links go, then lines of page furniture. Lines
are innermost blocks, so no text stands twice. Less than `ENOUGH` characters are none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .workers import bounded, on_path

# Where known sources keep their articles.
SELECTORS = (
    ("bleepingcomputer.com", "div.articleBody"), ("krebsonsecurity.com", "div.entry-content"), ("thehackernews.com", "div#articlebody"),
    ("securityweek.com", "div.zox-post-body"), ("cisa.gov", "div.l-page-section__content, div.usa-prose, main article"),
)
# What is never an article: tags, parts of class names, parts of ids, roles.
TAGS = ("script", "style", "noscript", "template", "aside", "nav", "footer", "header", "form", "iframe", "figcaption")
CLASSES = ("related", "newsletter", "share", "social", "promo", "sidebar", "comment", "cookie", "ad-", "advert")
IDS = ("cookie", "advert")
ROLES = ("complementary", "banner", "contentinfo", "navigation")
# How a link speaks that offers something.
OFFER = re.compile(r"^(get|download|read|learn|register|sign ?up|request|try|start|claim|watch|book|schedule|join)\b.{0,60}$|whitepaper|webinar|free trial|demo\b", re.I)
#: Characters of an article at least, share of links in a block at most, and blocks and characters of a cluster of offers.
ENOUGH, LINKS, CLUSTER_BLOCKS, CLUSTER_CHARS = 200, 0.5, 8, 800

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_LINE = {"p", "li", "h1", "h2", "h3", "h4", "pre", "blockquote", "td"}
_BLOCK = _LINE | {"div", "section", "article", "main", "ul", "ol", "table", "tr", "body", "h5", "h6", "dl", "dt", "dd", "figure"}
_ENDS = {"li": {"li"}, "td": {"td", "th"}, "tr": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


class Node:
    __slots__ = ("tag", "attrs", "inner", "parent", "score")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.inner, self.score = tag, attrs, parent, [], 0.0

    def walk(self) -> Iterator[Node]:
        """Itself and all nodes in it, in the page's order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [x for x in reversed(node.inner) if isinstance(x, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                out += [" "] * (x.tag in _BLOCK or x.tag == "br")
                todo += reversed(x.inner)
        return _plain("".join(out))

    def drop(self) -> None:
        if self.parent is not None and self in self.parent.inner:
            self.parent.inner.remove(self)


def _plain(x: str) -> str:
    return " ".join(x.split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("body", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        ends = _ENDS.get(tag, set()) | ({"p"} if tag in _BLOCK else set())
        if self.at.tag in ends:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.inner.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.inner.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.inner.append(data)


def parsed(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _fits(node: Node, simple: str) -> bool:
    tag, mark, name = re.match(r"(\w+)([.#]?)([\w-]*)", simple).groups()
    return node.tag == tag and (not mark or (name in node.attrs.get("class", "").split() if mark == "." else node.attrs.get("id") == name))


def selected(root: Node, selector: str) -> Node | None:
    """The first node of `a, b c`: tags with a class or an id, alternatives, and nodes inside others."""
    paths = [s.split() for s in selector.split(",")]
    for node in root.walk():
        for *outer, last in paths:
            if _fits(node, last):
                up = node.parent
                while outer and up is not None:
                    if _fits(up, outer[-1]):
                        outer.pop()
                    up = up.parent
                if not outer:
                    return node
    return None


def host(url: str | None) -> str | None:
    try:
        name = urlsplit(url or "").hostname
    except ValueError:
        return None
    return name.removeprefix("www.") if name else None


def selector_for(url: str | None) -> str | None:
    name = host(url)
    return next((s for domain, s in SELECTORS if name and (name == domain or name.endswith(f".{domain}"))), None)


def pruned(root: Node) -> Node:
    noise = lambda n: n.tag in TAGS or any(c in n.attrs.get("class", "") for c in CLASSES) or any(i in n.attrs.get("id", "") for i in IDS) or n.attrs.get("role") in ROLES
    for node in [n for n in root.walk() if n.parent is not None and noise(n)]:
        node.drop()
    return root


def links(node: Node) -> float:
    own = sum(len(a.text()) for a in node.walk() if a.tag == "a")
    return own / len(node.text()) if own else 0.0


def article(root: Node) -> Node | None:
    """The best block by the scores of its paragraphs, with its neighbours that score a fifth of it or are paragraphs of prose."""
    for node in root.walk():
        node.score = 0.0
    scored: dict[Node, None] = {}
    for node in root.walk():
        prose = node.text() if node.tag in ("p", "td", "pre", "blockquote") or (node.tag in ("div", "section") and not any(isinstance(x, Node) and x.tag in _BLOCK for x in node.inner)) else ""
        if len(prose) < 25:
            continue
        points, up = 1 + prose.count(",") + min(len(prose) // 100, 3), node.parent
        for _ in range(4):
            if up is None:
                break
            up.score += points
            scored[up] = None
            points, up = points / 2, up.parent
    best = max(scored, key=lambda n: n.score * (1 - links(n)), default=None)
    if best is None or best.parent is None:
        return best
    found, top = Node("div", {}, best.parent), best.score * (1 - links(best))
    for near in best.parent.inner:
        if isinstance(near, Node):
            prose = near.tag == "p" and len(near.text()) > 80 and links(near) < 0.25
            if near is best or prose or (near in scored and near.score * (1 - links(near)) >= max(10, 0.2 * top)):
                found.inner.append(near)
    for near in found.inner:
        near.parent = found
    return found


def _outside(href: str, own: str | None) -> str | None:
    """Where a link to another site leads, without its query; null for links within the site."""
    if not re.match(r"https?://", href, re.I):
        return None
    there = host(href)
    same = own is not None and there is not None and (there == own or there.endswith(f".{own}") or own.endswith(f".{there}"))
    return None if there is None or same else href.split("?")[0].split("#")[0]


def _picture(a: Node) -> bool:
    return not a.text() and any(n.tag == "img" for n in a.walk())


def without_offers(root: Node, url: str | None) -> None:
    """Takes out small runs of neighbours around repeated links to one place elsewhere that offer something, and banners that are pictures with a link elsewhere."""
    to: dict[str, list[Node]] = {}
    for a in root.walk():
        if a.tag == "a" and (there := _outside(a.attrs.get("href", ""), host(url))):
            to.setdefault(there, []).append(a)
    for same in to.values():
        headed = lambda a: bool(re.fullmatch("h[1-6]", a.parent.tag)) and links(a.parent) >= 0.9
        if len(same) > 1 and any(OFFER.search(a.text()) or headed(a) or _picture(a) for a in same):
            paths = []
            for a in same:
                path = [a]
                while path[-1] is not root and path[-1].parent is not None:
                    path.append(path[-1].parent)
                paths.append(path[::-1])
            depth = next((k for k in range(min(map(len, paths))) if len({id(p[k]) for p in paths}) > 1), None)
            if depth:
                above = paths[0][depth - 1]
                nodes = [x for x in above.inner if isinstance(x, Node)]
                at = [nodes.index(p[depth]) for p in paths]
                run = nodes[min(at) : max(at) + 1]
                if len(run) <= CLUSTER_BLOCKS and len(" ".join(n.text() for n in run)) <= CLUSTER_CHARS:
                    for n in run:
                        n.drop()
        for a in same:
            if _picture(a):
                while a.parent is not None and a.parent is not root and not a.parent.text():
                    a = a.parent
                a.drop()


def cleaned(root: Node, url: str | None) -> str:
    without_offers(pruned(root), url)
    for node in [n for n in root.walk() if n is not root and n.tag in ("p", "ul", "ol", "div", "table")]:
        if links(node) > LINKS:
            node.drop()
    inner = {id(n) for n in root.walk() if n.tag in _LINE}
    lines, loose = [], []
    for n in root.walk():
        if id(n) in inner:
            part = Node(n.tag, {}, None)
            part.inner = [x for x in n.inner if isinstance(x, str) or not any(id(y) in inner for y in x.walk())]
            lines.append(part.text())
    if not any(lines):
        loose = [root.text()]
    return "\n".join(x for x in (lines if any(lines) else loose) if T.is_content(x))


def readable(html: str | None, url: str | None = None) -> tuple[str | None, str]:
    """(text, method): source_selector, scored or none."""
    if not html:
        return None, "none"
    root = parsed(html)
    selector = selector_for(url)
    if selector and (node := selected(root, selector)) is not None and len(found := cleaned(node, url)) >= ENOUGH:
        return found, "source_selector"
    node = article(pruned(parsed(html) if selector else root))
    found = cleaned(node, url) if node is not None else ""
    return (found, "scored") if len(found) >= ENOUGH else (None, "none")


def extracted(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """`pages` with `text` and `method`: where no article is found, all text of the page, and null where there is none."""
    on_path(pages.sparkSession)
    bounded(pages.sparkSession)

    @F.pandas_udf("text string, method string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for h, u in batches:
            yield pd.DataFrame([readable(a, b) for a, b in zip(h, u, strict=True)], columns=["text", "method"])

    found = pages.withColumn("__r", run(F.col(html), F.col(url)))
    whole = F.nullif(T.html_text(F.col(html)), F.lit(""))
    method = F.when(F.col("__r.text").isNotNull(), F.col("__r.method")).when(whole.isNotNull(), "fallback").otherwise("none")
    return found.withColumns({"text": F.coalesce("__r.text", whole), "method": method}).drop("__r")


def compared(words_found: Column, words_wanted: Column) -> tuple[Column, Column]:
    """(recall, precision) of lists of words, as shares of distinct words; nothing wanted is found in whole."""
    both = F.size(F.array_intersect(words_found, words_wanted))
    share = lambda n: F.when(n == 0, 1.0).otherwise(both / n)
    return share(F.size(F.array_distinct(words_wanted))), share(F.size(F.array_distinct(words_found)))
