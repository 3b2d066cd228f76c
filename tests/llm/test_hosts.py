"""Host reputation and rules against a plain Python version."""

import math
import re
from collections import defaultdict

import pytest

from newswarden.llm import hosts
from newswarden.llm.queries import URL_RULES


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def strength(children):
    c = [(g, n) for g, n in children if n]
    total, good = sum(n for _, n in c), sum(g for g, _ in c)
    if len(c) < 2 or total <= len(c):
        return 10.0
    gp = sum(g * g / n for g, n in c)
    between, within = (gp - good * good / total) / (len(c) - 1), (good - gp) / (total - len(c))
    size = (total - sum(n * n for _, n in c) / total) / (len(c) - 1)
    low = between + (size - 1) * within
    rho = (between - within) / low if low > 0 else 0
    return min(max((1 - rho) / rho, 1.0), 1e4) if rho > 0 else 1e4


def brute(rows, outcomes, least):
    label = {}
    for i, good in outcomes:
        label[i] = good
    count = defaultdict(lambda: [0, 0])
    for i, url in rows:
        c = count[parts(url)[0]]
        if label.get(i) is not None:
            c[0] += label[i]
            c[1] += 1
    up = lambda h, n: ".".join(h.split(".")[-n:])
    level = lambda n, of: {k: [sum(v[j] for h, v in of.items() if up(h, n) == k) for j in (0, 1)] for k in {up(h, n) for h in of}}
    domains = level(2, count)
    tops = level(1, domains)
    good, n = (sum(v[j] for v in tops.values()) for j in (0, 1))
    mean = (good + 1) / (n + 2)
    a, b, c = (strength([tuple(v) for v in x.values()]) for x in (tops, domains, count))
    bound = {}
    for h, (g, m) in count.items():
        tm = (tops[up(h, 1)][0] + a * mean) / (tops[up(h, 1)][1] + a)
        dm = (domains[up(h, 2)][0] + b * tm) / (domains[up(h, 2)][1] + b)
        y, z = g + c * dm, m - g + c * (1 - dm)
        bound[h] = y / (y + z) - 1.645 * math.sqrt(y * z / ((y + z) ** 2 * (y + z + 1)))
    out = []
    for i, url in rows:
        h, p = parts(url)
        fit = [r for r in URL_RULES if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        r = max(fit, key=lambda r: len(r.text), default=None)
        out.append((i, h, p, r.text if r else None, r.action if r else "allow" if bound[h] >= least else "block"))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [hosts.HOT, 3])
def test_against_python(spark, hot, monkeypatch):
    monkeypatch.setattr(hosts, "HOT", hot)
    urls = [f"https://h{k % 7}.d{k % 3}.{'org' if k % 2 else 'io'}/p/{k}?q#f" for k in range(300)]
    urls += ["http://WWW.Example.com/en/1", "http://a.example.com/en/", "http://example.com/fr", "http://com/", "http://x.net/es/y", "http://net/fr/", "http://b.example.com", None, "no scheme", "a://b://c/d", "://", "http://Éx.org:80/é"] * 2
    rows = list(enumerate(urls))
    outcomes = [(i, (i * 7919) % 10 >= i % 7) for i in range(0, 300, 2)] + [(305, None)]
    pages = spark.createDataFrame([(i, u, "c", "v") for i, u in rows], "page_id long, url string, host string, verdict string")
    known = spark.createDataFrame(outcomes, "page_id long, good boolean")
    got = hosts.judged(pages, known, URL_RULES, least=0.55)
    want = brute(rows, outcomes, 0.55)
    assert sorted((tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()), key=str) == want
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good boolean")
    assert hosts.judged(pages, none, URL_RULES).collect() == []
    one = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None)], "page_id long, url string")
    assert hosts.judged(one, none, []).count() == 3


def test_levels_of_ports_addresses_and_country_suffixes(spark):
    names = {"a.b.co.uk": ("b.co.uk", "co.uk"), "a.b.com": ("b.com", "com"), "x.gov.br:8080": ("x.gov.br", "gov.br"), "a.b.com:80": ("b.com", "com"), "10.0.0.1:99": ("10.0.0.1", "10.0.0.1"), "localhost": ("localhost", "localhost"), "": ("", ""), "a.nic.io": ("nic.io", "io")}
    df = spark.createDataFrame([(h,) for h in names], "host string")
    domain, suffix = hosts._levels("host", hosts.SUFFIXES)
    assert {r.host: (r.d, r.s) for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect()} == names


def test_very_long_hosts(spark):
    """A host of 100,000 labels costs no more than its length."""
    import time

    long = "a." * 100_000
    pages = spark.createDataFrame([(1, f"http://{long}example.com/en/x"), (2, f"http://{long}org/"), (3, "http://www.example.com/en/")], "page_id long, url string")
    rules = [hosts.rule("allow", "com/"), hosts.rule("block", "example.com/en/"), hosts.rule("allow", "www.example.com/en/")]
    began = time.time()
    got = {r.page_id: r.rule for r in hosts.judged(pages, spark.createDataFrame([], "page_id long, good boolean"), rules).collect()}
    assert got == {1: "example.com/en/", 2: None, 3: "www.example.com/en/"} and time.time() - began < 60
