"""Main text of an HTML page, in batches (T-15): blocks outside furniture, with few links, as lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .workers import on_path

_SKIP = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "svg", "iframe", "template"}
_BLOCK = {"p", "div", "article", "section", "main", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "table", "tr", "td", "br", "body"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"}
_AD = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|promo\w*|sponsor\w*|cookie\w*|newsletter|share|social|related|comments?)(?:$|[\s_-])", re.I)


class _Blocks(HTMLParser):
    """Collects (text, characters in links, inside the article) of each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []
        self.blocks: list[tuple[str, int, bool]] = []
        self.parts: list[str] = []
        self.linked = self.links = 0

    def _flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.parts)).strip()
        if text:
            self.blocks.append((text, self.linked, any(a for _, _, a in self.stack)))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._flush()
        if tag in _VOID:
            return
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        skip = tag in _SKIP or bool(_AD.search(names)) or (self.stack[-1][1] if self.stack else False)
        self.stack.append((tag, skip, tag in ("article", "main")))
        self.links += tag == "a"

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self._flush()
        at = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag), None)
        if at is not None:
            self.links -= sum(t == "a" for t, _, _ in self.stack[at:])
            del self.stack[at:]

    def handle_data(self, data):
        if self.stack and self.stack[-1][1]:
            return
        self.parts.append(data)
        if self.links > 0:
            self.linked += len(data.strip())


def readable(html: str | None, density: float = 0.5) -> str:
    """Blocks of the article if the page marks one, else of the page; without blocks of links and short scraps."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    blocks = [b for b in parser.blocks if b[1] <= density * len(b[0])]
    if any(inside for _, _, inside in blocks):
        blocks = [b for b in blocks if b[2]]
    return "\n".join(t for t, _, _ in blocks if len(t) >= 25 or len(t.split()) >= 4 or re.search(r"[.!?:]$", t))


def main_text(html: Column) -> Column:
    on_path()

    @F.pandas_udf("string")
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in pages:
            yield s.map(readable)

    return run(html)
