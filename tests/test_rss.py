"""Feeds as they come: RSS with namespaces, Atom, odd dates, broken ones."""

import datetime as dt

import pytest

from newswarden.sources import rss

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Feed</title><link>https://feed.example</link>
<item><title>One &amp; only</title><link>https://Example.org/a?utm_source=x#top</link><guid isPermaLink="false">g-1</guid><category>Security</category><category domain="d"> Patch  day </category><category>Security</category>
<pubDate>Mon, 15 Jan 2024 10:00:00 EST</pubDate><description>&lt;p&gt;First &lt;b&gt;bold&lt;/b&gt; line&lt;/p&gt;&lt;p&gt;second &amp;amp; &amp;#8217;last&amp;#x2019;&lt;/p&gt;</description></item>
<item><title><![CDATA[Two <i>]]></title><guid>https://example.org/b</guid><dc:date>2024-01-16T08:30:00+02:00</dc:date><content:encoded><![CDATA[<div>Encoded<br/>text</div>]]></content:encoded></item>
<item><title>No address</title></item>
<item><link>https://example.org/c</link><pubDate>yesterday</pubDate></item>
</channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Atom</title>
<entry><title type="html">Three</title><id>urn:3</id><link rel="self" href="https://example.org/self"/><link rel="alternate" href="https://example.org/3/"/><updated>2024-01-17T00:00:00Z</updated><summary>short</summary><category term="x"/></entry>
<entry><title>Four</title><link href="https://example.org/4"/><published>2024-01-18T01:02:03Z</published><updated>2024-01-19T00:00:00Z</updated><content type="html">&lt;p&gt;long&lt;/p&gt;</content></entry></feed>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("feeds")
    files = {"a.xml": RSS, "b.xml": ATOM, "c.xml": "<rss><channel><item><title>whole</title><link>https://example.org/w</link></item><item><title>cut</titel></item><item><title>after</title></item></channel></rss>", "d.xml": "<html>no feed</html>", "e.xml": ""}
    for name, body in files.items():
        (path / name).write_text(body, encoding="utf-8")
    return str(path)


def test_items(spark, folder):
    rows = {r.title: r for r in rss.items(spark, folder).collect()}
    assert set(rows) == {"One & only", "Two <i>", "No address", None, "Three", "Four", "whole"}
    one, two, three, four = (rows[k] for k in ("One & only", "Two <i>", "Three", "Four"))
    utc = lambda *a: dt.datetime(*a)
    assert (one.guid, one.categories, one.snippet, one.iso_date) == ("g-1", ["Security", "Patch  day", "Security"], "First bold line\nsecond & ’last’", utc(2024, 1, 15, 15))
    assert (two.link, two.guid, two.snippet, two.iso_date) == (None, "https://example.org/b", "Encoded\ntext", utc(2024, 1, 16, 6, 30))
    assert (three.kind, three.link, three.guid, three.content, three.categories, three.iso_date) == ("atom", "https://example.org/3/", None, "short", [], utc(2024, 1, 17))
    assert (four.link, four.snippet, four.iso_date) == ("https://example.org/4", "long", utc(2024, 1, 18, 1, 2, 3)) and rows[None].iso_date is None


def test_broken_and_silent(spark, folder):
    assert [(r.file.rsplit("/", 1)[1], "titel" in r.record) for r in rss.broken(spark, folder).collect()] == [("c.xml", True)]
    assert {r.file.rsplit("/", 1)[1] for r in rss.silent(spark, folder).collect()} == {"d.xml"}


def test_normalised(spark, folder):
    rows = {r.title: r for r in rss.normalised(rss.items(spark, folder)).collect()}
    assert set(rows) == {"One & only", "Two <i>", "https://example.org/c", "Three", "Four", "whole"}
    one = rows["One & only"]
    assert (one.canonical_url, one.rss_summary, one.rss_categories) == ("https://example.org/a", "First bold line second & ’last’", ["Security", "Patch day"])
    assert rows["Two <i>"].canonical_url == "https://example.org/b" and rows["https://example.org/c"].rss_summary is None and len(one.url_hash) == len(one.title_hash) == 64


@pytest.mark.parametrize(("written", "hour"), [("Tue, 02 Jan 2024 10:00:00 GMT", 10), ("2 Jan 2024 10:00 +0100", 9), ("Tue, 2 Jan 2024 10:00:00 -05:00", 15), ("2024-01-02T10:00:00.500Z", 10), ("2024-01-02 10:00:00", 10), ("Tuesday, 02 Jan 2024 10:00:00 PDT", 17), ("soon", None), ("", None), (None, None), ("31 Feb 2024 10:00:00 GMT", None)])
def test_dates(spark, written, hour):
    (r,) = spark.createDataFrame([(written,)], "d string").select(rss.moment(rss.F.col("d")).alias("at")).collect()
    assert (r.at and (r.at.day, r.at.hour)) == (hour and (2, hour))
