"""Lists put together where the texts are, against those from hits as rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newswarden.functions import listing, substrings
from newswarden.operators import phrases
from newswarden.plans import QUERIES

from .test_phrase_counts import ITEM, ODD_ITEMS, ODD_TEXTS, most_rows
from .test_phrases import ITEMS, TEXTS

MORE = [("Acme", "Vault", ["gw", "cloud"], 8, True), (None, None, ["acme", "vault"], 4, None), ("Zed", None, ["vault"], 3, True), ("Acme", "Acme Gateway", ["acme"], 6, False)]


@pytest.mark.parametrize("more", [[], MORE, MORE + ODD_ITEMS])
def test_as_detected(spark, monkeypatch, more):
    monkeypatch.setattr(substrings, "CHUNK", 60)
    monkeypatch.setattr(listing, "OUT_BYTES", 20)
    inventory = spark.createDataFrame(ITEMS + ITEMS[:1] + more, ITEM)
    texts = spark.createDataFrame(list(enumerate(TEXTS + ODD_TEXTS)), "key long, text string")
    d = phrases.detected(texts, inventory).select("key", F.array_join("vendors", ",").alias("vendors"), F.when(F.size("products") > 0, F.array_join("products", "|")).alias("products"), F.size("aliases").cast("long").alias("n_aliases"), "noisy")
    want = sorted(map(tuple, d.collect()))
    for most in (phrases.MOST_BROADCAST, 0):
        assert sorted(map(tuple, phrases.listed(texts, inventory, most_broadcast=most).collect())) == want
    assert len(want) > 10


def test_nothing(spark):
    inventory = spark.createDataFrame([], ITEM)
    texts = spark.createDataFrame([("k", "x")], "key string, text string")
    assert phrases.listed(texts, inventory).collect() == []
    got = phrases.listed(texts, spark.createDataFrame([("X", "y", [], 1, True)], ITEM)).collect()
    assert [tuple(r) for r in got] == [("k", "X", None, 1, True)]


def test_items_of_a_text_are_no_rows(spark, tmp_path):
    spark.range(1500).selectExpr("id AS doc_id", "concat('Word', id, ' one two the end ok') AS text").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["j_13_phrase_table"](spark, str(tmp_path))
    rows = df.collect()
    every = ",".join(f"vendor-{k}" for k in range(1500))
    assert len(rows) == 1500 and all(r.vendors == every and r.products.count("|") == 1499 for r in rows)
    # Names: "the" and "two" of all, the text's own product, and all vendors.
    assert {r.n_aliases for r in rows} == {1503}
    assert most_rows(df._jdf.queryExecution().executedPlan()) <= 10 * 1500


def test_an_index_whose_hashes_clash_is_told(spark, monkeypatch):
    inventory = spark.createDataFrame(ITEMS, ITEM)
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "key long, text string")
    want = sorted(map(tuple, phrases.listed(texts, inventory).collect()))
    monkeypatch.setattr(substrings, "hashes", lambda strings: np.zeros(len(strings), np.uint64))
    rows = phrases.phrase_index(inventory).select("low", "item.*").toArrow()
    assert not listing.Index(rows, (",", "|")).single
    assert sorted(map(tuple, phrases.listed(texts, inventory).collect())) == want
