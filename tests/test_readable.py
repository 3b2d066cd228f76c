"""Readable text of hand-made pages, a page for each way through."""

import re

import pytest
from pyspark.sql import functions as F

from newswarden.functions import readable, text

PROSE = ["Attackers exploited the flaw, which was fixed in May, to run code on gateways that were left unpatched.", "The vendor asks all customers to update at once, to rotate keys, and to look for the signs listed below.", "Researchers saw the first attacks in April, long before the advisory, and told the agency about them."]
BODY = "".join(f"<p>{p}</p>" for p in PROSE)


def words(x):
    return set(re.findall(r"\w+", x or ""))


def page(inner, head=""):
    return f"<!doctype html><html><head><title>T</title>{head}</head><body><nav><ul><li><a href='/'>Home page of all things</a></li></ul></nav>{inner}<footer>All rights reserved by someone here.</footer></body></html>"


PAGES = {
    "selector": (page(f"<div class='wide entry-content'>{BODY}</div><div><p>{'Another story, of no matter here, goes on and on. ' * 20}</p></div>"), "https://www.krebsonsecurity.com/2024/x", PROSE, "source_selector"),
    "inner selector": (page(f"<main><div><article>{BODY}</article></div></main>"), "https://us.cisa.gov/a", PROSE, "source_selector"),
    "short selector": (page(f"<div class='entry-content'><p>Too short.</p></div><div><section>{BODY}</section></div>"), "https://krebsonsecurity.com/", PROSE, "scored"),
    "scored": (page(f"<div><div class='teaser'><p>One line of a teaser, no more.</p></div><div id='x'>{BODY}</div></div>"), None, PROSE, "scored"),
    "noise": (page(f"<div>{BODY}<div class='related-posts'><p>{PROSE[0].upper()}</p></div><aside><p>An aside of many words that is no part of this.</p></aside><div role='banner'><p>A banner of many words, no part of this.</p></div></div>"), None, PROSE, "scored"),
    "links": (page(f"<div>{BODY}<ul><li><a href='/1'>A first headline of some other story</a></li><li><a href='/2'>A second headline of some other story</a></li></ul></div>"), None, PROSE, "scored"),
    "offers": (page(f"<div>{BODY[:110]}</p><p><a href='https://sponsor.example/x?utm=1'><img src='b.png'></a></p><h2><a href='https://sponsor.example/x'>Ten ways to spend money</a></h2><p>A pitch of the sponsor, which goes on.</p><p><a href='https://sponsor.example/x?y'>Get the whitepaper</a></p>{BODY}</div>"), "https://news.example/a", PROSE, "scored"),
    "banner": (page(f"<div>{BODY}<p><a href='https://elsewhere.example/'><img src='b.png'></a></p></div>"), "https://news.example/a", PROSE, "scored"),
    "junk lines": (page(f"<div>{BODY}<p>Share this with all of your friends now.</p><p>Comments (12)</p><p>Tags: gateway, flaw, update, key, and more.</p><p>Two words</p><h2>What to do:</h2></div>"), None, [*PROSE, "What to do:"], "scored"),
    "unclosed": ("<div><p>" + "<p>".join(PROSE) + "<li>", None, PROSE, "scored"),
    "fallback": ("<html><body><b>Brief.</b> <i>Nothing more.</i></body></html>", None, ["Brief. Nothing more."], "fallback"),
    "nothing": ("", None, [], "none"),
    "null": (None, None, [], "none"),
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(k, h, u) for k, (h, u, _, _) in PAGES.items()], "name string, html string, url string")
    return {r.name: r for r in readable.extracted(df).collect()}


@pytest.mark.parametrize("name", list(PAGES))
def test_every_way(found, name):
    _, _, lines, method = PAGES[name]
    assert found[name].method == method
    got, want = words(found[name].text), words(" ".join(lines))
    assert len(got & want) >= 0.8 * len(want) and len(got & want) >= 0.6 * len(got)
    if name not in ("offers", "fallback"):
        assert (found[name].text or "").split("\n") == (lines or [""])


def test_offers_are_gone(found):
    assert not words(found["offers"].text) & {"whitepaper", "money", "pitch"}


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + BODY
    assert readable.readable(deep)[0].split("\n") == PROSE
    assert len(readable.readable(page(f"<div>{BODY * 300}</div>"))[0].split("\n")) == 900


def test_lines_alike_in_python_and_in_columns(spark):
    lines = ["Subscribe to our newsletter of the week", "subscribed users are many in this town", "Comments", "Comments on this case are many", "comments (3)", "Two words", "Two words.", "one two three four", "", "   ", "© 2024 Someone and someone else", "A line that is long enough to stay", "Read next: a story of another town", "tags : a b c d e f g"]
    got = spark.createDataFrame([("\n".join(lines),)], "t string").select(text.content_lines(F.col("t")).alias("k")).first().k
    assert got == [x for x in lines if text.is_content(x.strip())] and "Comments on this case are many" in got and "Comments" not in got and len(got) == 4


def test_a_page_is_parsed_once_where_no_selector_took_parts_of_it(monkeypatch):
    seen = []
    plain = readable.parsed
    monkeypatch.setattr(readable, "parsed", lambda html: (seen.append(html), plain(html))[1])
    html, url, _, method = PAGES["scored"]
    assert readable.readable(html, url)[1] == method
    assert len(seen) == 1
    html, url, _, method = PAGES["short selector"]
    assert readable.readable(html, url)[1] == method
    assert len(seen) == 3


def test_white_space_of_any_kind_is_one_space():
    spaces = "".join(c for c in map(chr, range(0x110000)) if re.match(r"\s", c))
    assert readable._plain(f"{spaces}a{spaces}b\n") == "a b"
    assert all(readable._plain(f"a{c}b") == "a b" for c in spaces)
    assert readable._plain("a\u200bb") == "a\u200bb"
