"""Decontamination against brute force over words."""

import re

import pytest

from newswarden.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, width=10):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        x = words(item)
        size = min(width, len(x))
        for i in range(len(x) - size + 1 if size else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == x[i : i + size]:
                    hit.update(range(j, j + size))
                    names.add(name)
    return len(w), len(hit), sorted(str(n) for n in names if n is not None)


LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, LONG), (2, "Short Item é!"), (3, None), (4, ""), (5, "a b c d e f g h i j k"), (5, "a b c d e f g h i j k"), (None, "solo"), (12, "short item é")]
TEXTS = ["", None, "x " * 50, f"before {LONG} after", "w3 w4 w5 w6 w7 w8 w9 w10 w11", "A-B-C-D-E-F-G-H-I-J then SHORT ITEM É short item é", "solo,solo", "w0 " + LONG.upper() + " " + LONG, "a b c d e f g h i j" * 3, "é" * 20000, "word\n" * 30000 + LONG]


@pytest.mark.parametrize("max_bytes", [decontam.MAX_BYTES, 20])
def test_against_brute_force(spark, max_bytes):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, items string, n_hit int")
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(docs, bench, max_bytes=max_bytes).collect()}
    assert got == {i: brute(t, ITEMS) for i, t in enumerate(TEXTS)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id int, text string")
    full = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontam.contamination(docs, bench).collect() == []
    assert [r.n_hit for r in decontam.contamination(full, bench).collect()] == [0]


def test_removal_keeps_columns_and_clean_rows(spark):
    docs = spark.createDataFrame([(1, f"keep this text here {'and more ' * 40} {LONG} tail", "z"), (2, LONG, "z"), (3, "clean", "z"), (4, None, "z")], "doc_id long, text string, __nw_x string")
    bench = spark.createDataFrame([(1, LONG)], "item_id int, text string")
    out = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench).collect()}
    assert set(out) == {1, 3, 4} and "w5" not in out[1] and out[1].endswith("more tail") and out[3] == "clean"
    assert {r.doc_id for r in decontam.decontaminate(docs, bench, remove="documents").collect()} == {3, 4}


def test_many_sets_clashing_columns_and_shared_windows(spark, monkeypatch):
    """Sets are let go after each two scans; a window that many items share names them all."""
    monkeypatch.setattr(decontam, "TOGETHER", 2)
    docs = spark.createDataFrame([(1, f"x {LONG} y", "own"), (2, "nothing", None)], "doc_id long, text string, __nw_hits string")
    bench = spark.createDataFrame([(i, LONG) for i in range(30)], "item_id int, text string")
    for max_bytes in (decontam.MAX_BYTES, 400):
        got = {r.doc_id: (r.n_hit, len(r["items"])) for r in decontam.contamination(docs, bench, max_bytes=max_bytes).collect()}
        assert got == {1: (40, 30), 2: (0, 0)}
        clean = {r.doc_id: (r.text, r["__nw_hits"]) for r in decontam.decontaminate(docs, bench, max_bytes=max_bytes, drop_share=1.0).collect()}
        assert clean == {1: ("x y", "own"), 2: ("nothing", None)}


def test_white_space_at_the_ends_stays(spark):
    docs = spark.createDataFrame([(1, f"\n  a {LONG} b \n")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, LONG)], "item_id int, text string")
    assert decontam.decontaminate(docs, bench, drop_share=1.0).first().text == "\n  a b \n"
