"""Faults of a dataset by line, in files of several splits."""

import json

import pytest

from newswarden.sources import datasets

GOOD = {"sourceName": "s", "sourceTier": "unknown", "url": "https://example.org/0", "title": "t", "rssSummary": None, "rssCategories": [], "publishedAt": None, "humanLabel": "RELEVANT", "humanReason": "why"}


def line(k, **changes):
    return json.dumps({**GOOD, "url": f"https://example.org/{k}", **changes})


FAULTS = [
    ("{broken", "no JSON object"), ("[1, 2]", "no JSON object"), ('"text"', "no JSON object"), (line(1, id=""), "bad id"), (line(2, id=None), "bad id"), (line(3, sourceName=5), "bad sourceName"), (line(4, sourceTier="friend"), "bad sourceTier"),
    (line(5, url="no address"), "bad url"), (line(6, title=""), "bad title"), (json.dumps({k: v for k, v in GOOD.items() if k != "rssSummary"}), "bad rssSummary"), (line(7, rssCategories="x"), "bad rssCategories"), (line(8, rssCategories=["x", 1]), "bad rssCategories"),
    (line(9, rssCategories=["x", None]), "bad rssCategories"), (line(10, publishedAt="2024-01-01"), "bad publishedAt"), (line(11, humanLabel="relevant"), "bad humanLabel"), (line(12, humanReason=None), "bad humanReason"), (line(13, expectedMinimumDecision="LATER"), "bad expectedMinimumDecision"),
    (line(14, expectedSignals={"cvePresent": True}), "bad expectedSignals"), (line(15, expectedMinimumDecision="DROP"), "humanLabel contradicts expectedMinimumDecision"), (line(16, humanLabel="IRRELEVANT", expectedMinimumDecision="KEEP"), "humanLabel contradicts expectedMinimumDecision"),
    (line(17, humanLabel="CRITICAL_RELEVANT", expectedMinimumDecision="MAYBE_KEEP"), "humanLabel contradicts expectedMinimumDecision"),
]
SOUND = [line(20, rssCategories=["a"], publishedAt="2024-01-01T00:00:00.5Z"), line(21, humanLabel="IRRELEVANT"), line(22, expectedMinimumDecision="KEEP", expectedSignals=dict.fromkeys(datasets.SIGNALS, True), extra=1), line(23, id="own")]


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_line_numbers_over_splits(spark, tmp_path, small_splits):
    bodies = {"a.jsonl": "".join(f"line {k}{' x' * (k % 50)}\r\n" for k in range(1, 900)) + "last", "b.jsonl": "\n\none\n\n", "c.jsonl": ""}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body.encode())
    rows = datasets.numbered(spark, str(tmp_path)).collect()
    got = {(r.file.rsplit("/", 1)[1], r.line): r.value for r in rows}
    want = [(name, k + 1, x.rstrip("\r")) for name, body in bodies.items() for k, x in enumerate(body.removesuffix("\n").split("\n") if body else [])]
    assert got == {(n, k): x for n, k, x in want} and len(rows) == len(want)
    assert [r.value for r in sorted(rows, key=lambda r: r.place)] == [x for _, _, x in want] and sorted(r.place for r in rows) == list(range(1, len(want) + 1))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8


def test_reasons(spark, tmp_path, small_splits):
    filler = [line(1000 + k, title="filler " * 20) for k in range(60)]
    body = [*filler[:30], "", *[f for f, _ in FAULTS], "   ", *SOUND, *filler[30:], line(20), line(5000, id="own"), filler[0]]
    (tmp_path / "set.jsonl").write_text("\n".join(body) + "\n")
    got = {r.line: r.reason for r in datasets.errors(spark, str(tmp_path)).collect()}
    want = {body.index(f) + 1: reason for f, reason in FAULTS}
    n = len(body)
    want |= {n - 2: f"repeated id, first on line {body.index(SOUND[0]) + 1}", n - 1: f"repeated id, first on line {body.index(SOUND[3]) + 1}", n: "repeated id, first on line 1"}
    assert got == want
    kept = {r.url: r for r in datasets.samples(spark, str(tmp_path)).collect()}
    assert len(kept) == 64 and kept["https://example.org/21"].expectedMinimumDecision == "DROP" and kept["https://example.org/22"].expectedMinimumDecision == "KEEP"
    assert kept["https://example.org/23"].id == "own" and kept["https://example.org/20"].id == "cf-" + __import__("hashlib").sha1(b"https://example.org/20").hexdigest()[:8]


def test_a_repeated_address_with_an_id_of_its_own(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join([line(1, id="a"), line(1, id="b"), line(1, id="c")]))
    assert [(r.line, r.reason) for r in datasets.errors(spark, str(tmp_path)).orderBy("line").collect()] == [(2, "repeated url, first on line 1"), (3, "repeated url, first on line 1")]
    (tmp_path / "x.jsonl").write_text("\n \n")
    assert datasets.errors(spark, str(tmp_path)).collect() == [] and datasets.samples(spark, str(tmp_path)).collect() == []
