"""Counts of phrases without pairs of text and item, against the pairs."""

import re

import numpy as np
import pytest

from newswarden.fixtures import Tables
from newswarden.functions import substrings
from newswarden.operators import phrases
from newswarden.plans import QUERIES, dictionary

from .test_phrases import ITEMS, TEXTS

ITEM = "vendor string, product string, aliases array<string>, place long, noisy boolean"
ODD_ITEMS = [("Straße", "ΟΔΟΣ", ["ſet", "Kelvin", "İx"], 20, False), ("x" * 90, "ACME", ["été", "é", "é à"], 21, True), ("acme", "Été", [" acme", "hub\n", "c"], 22, False)]
ODD_TEXTS = ["STRASSE straße", "οδος ΟΔΟΣ", "set ſet sets", "kelvin Kelvin", "İx i̇x ix", "été-éé à ÉTÉ", "l'é à", "x" * 90 + " acme", " acme", "acme hub\nhub\n", "acmeſ acme", "Xé", "日本 acme 😀"]


def counted(df):
    return {tuple(r.item): r.n for r in df.collect()}


def test_counts_are_the_lengths_of_groups_of_found(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 100)
    index = phrases.phrase_index(spark.createDataFrame(ITEMS + ODD_ITEMS, ITEM))
    texts = spark.createDataFrame(list(enumerate(TEXTS + ODD_TEXTS)), "key long, text string")
    want = counted(phrases.found(texts, index).groupBy("item").count().withColumnRenamed("count", "n"))
    assert len(want) > 20 and counted(phrases.counts(texts, index)) == want
    assert counted(phrases.counts(texts.limit(0), index)) == {} == counted(phrases.counts(texts, index.limit(0)))


def most_rows(plan):
    """The most rows that a step of a plan that has run put out."""
    name = plan.getClass().getSimpleName()
    children = plan.children()
    below = [children.apply(k) for k in range(children.size())]
    if name == "AdaptiveSparkPlanExec":
        below = [plan.executedPlan()]
    elif "QueryStage" in name:
        below = [plan.plan()]
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(most_rows, below)])


def test_a_frequent_phrase_makes_no_row_for_each_item_and_text(spark, tmp_path):
    spark.range(1500).selectExpr("id AS doc_id", "concat('Word', id, ' one two the end ok') AS text").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["j_13_phrase_hits"](spark, str(tmp_path))
    rows = df.collect()
    assert {(r.kind, r.n) for r in rows} == {(1, 1), (2, 1500), (3, 1500)} and len(rows) == 4500
    assert most_rows(df._jdf.queryExecution().executedPlan()) <= 10 * 1500


def test_the_dictionary_is_the_view(spark, tmp_path):
    texts = ["", None, "a", "a b", "a b c", "a b c d", " a b c", "a b c ", "a  b c", "a b  c", "x1y z w", "x1 z w", "é-ab z w\n", "1 2 3", "a\nb c\nd e", "   ", "ab, cd ef."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    t = Tables(spark, str(tmp_path))
    want = t.dictionary.selectExpr("place", "vendor", "product", "array(alias_a, alias_b) AS aliases", "noisy")
    assert sorted(map(repr, dictionary._dictionary(t).collect())) == sorted(map(repr, want.collect()))


def test_different_strings_of_one_hash_are_told_apart(monkeypatch):
    texts = [b"ab ab cd", b"ab", b"cd"]
    marks = substrings.Marks(substrings.PART_BITS, [(0, b"\xff" * (substrings.PART_BITS // 8))])
    met = substrings.met
    monkeypatch.setattr(substrings, "met", lambda *a: ((rows, text, np.zeros_like(h)) for rows, text, h in met(*a)))
    got = {}
    for strings, n in substrings.counted(texts, [2], marks):
        for s, k in zip(strings.to_pylist(), n.tolist(), strict=True):
            got[s] = got.get(s, 0) + k
    assert got == {"ab": 2, "cd": 2}


@pytest.mark.parametrize("n", [0, 1, 3000, 1 << 40])
def test_bits(n):
    bits = substrings.bits_for(n)
    assert bits & (bits - 1) == 0 and substrings.PART_BITS <= bits <= substrings.MOST_BITS
    h = substrings.hashes([f"phrase {k}".encode() for k in range(500)])
    assert len(set(h.tolist())) == 500 and (substrings.places(h, bits) < bits).all()


def test_what_is_not_odd_has_one_small_letter_and_folds_alone():
    odd = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: "\\U" + m[1].zfill(8), phrases.ODD))
    for c in (chr(k) for k in range(0x20000) if not 0xD800 <= k < 0xE000):
        if not odd.match(c):
            upper = c.upper() if len(c.upper()) == 1 else c
            assert len(c.lower()) == 1 and upper.lower() == c.lower(), c
            assert c.isascii() or not (upper.lower().isascii() or c.lower().isascii()), c
