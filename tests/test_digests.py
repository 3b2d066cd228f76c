"""Kept runs, their metrics by hand, the gate, and deltas to the baseline."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newswarden.operators import digests

GOLD = "article_id long, related boolean, vendors array<string>, products array<string>, cves array<string>"
PRED = GOLD + ", error string"


def gold(spark):
    return spark.createDataFrame([(1, True, ["Acme"], ["GW"], ["CVE-1"]), (2, True, ["Acme", "Globex"], [], None), (3, False, [], [], []), (4, False, None, None, ["CVE-2"]), (5, True, ["X"], ["Y"], [])], GOLD)


def predictions(spark):
    return spark.createDataFrame([(1, True, [" acme "], ["gw", "GW"], ["cve-1"], None), (2, True, ["Acme"], [], [], None), (3, True, [], [], [], None), (4, False, [], [], ["CVE-2", "CVE-3"], None), (5, True, ["X"], ["Y"], [], "timed out"), (9, True, [], [], [], None)], PRED)


def test_scores_and_metrics(spark):
    s = {r.article_id: r for r in digests.scored(gold(spark), predictions(spark)).collect()}
    assert set(s) == {1, 2, 3, 4, 5} and s[1].failures == [] and s[1].vendor_f1 == 1.0
    assert s[2].failures == ["vendors: gold [Acme, Globex], pred [Acme]"] and s[2].vendor_f1 == pytest.approx(2 / 3)
    assert s[3].vendor_exact is None and s[3].failures == ["related: gold no, pred yes"] and s[4].cve_f1 == pytest.approx(2 / 3)
    assert s[5].failures == ["related: gold yes, pred no", "vendors: gold [X], pred []", "products: gold [Y], pred []"]
    m = digests.metrics(digests.scored(gold(spark), predictions(spark))).first()
    assert (m.gold_count, m.related_count) == (5, 3) and m.relatedness_precision == m.relatedness_recall == pytest.approx(2 / 3)
    assert (m.vendor_exact_rate, m.product_exact_rate, m.cve_exact_rate) == pytest.approx((1 / 3, 2 / 3, 0.8)) and m.vendor_set_f1 == pytest.approx((1 + 2 / 3 + 0) / 3)
    nothing = digests.gate(digests.metrics(digests.scored(gold(spark).limit(0), predictions(spark)))).first()
    assert nothing.vendor_exact_rate is None and nothing.cve_exact_rate == 0.0 and nothing.relatedness_f1 == 1.0 and nothing.warnings == ["too_few_gold_labels"]


def test_gate_counts_from_forty(spark):
    for n, active in ((39, False), (40, True)):
        g = spark.range(n).selectExpr("id AS article_id", "false AS related", "array() AS vendors", "array() AS products", "array('a') AS cves")
        row = digests.gate(digests.metrics(digests.scored(g, predictions(spark).limit(0)))).first()
        assert (row.active, row.warnings) == (active, ["cve_exact_rate"] if active else ["too_few_gold_labels"])


def test_store(spark, tmp_path):
    store = str(tmp_path)
    p = predictions(spark)
    at, later = F.lit(dt.datetime(2024, 1, 1)), lambda d: F.lit(dt.datetime(2024, 1, 1 + d))
    digests.save(p, store, "b1", "baseline", at, later(1))
    digests.save(p.where("article_id < 3"), store, "b2", "baseline", at, later(2))
    digests.save(p, store, "b3", "baseline", at, F.lit(None))
    digests.save(p.limit(0), store, "r1", "regen", at, later(3))
    assert {r["mode"]: r.run for r in digests.latest(digests.runs(spark, store)).collect()} == {"baseline": "b2", "regen": "r1"}
    # Saved again: only that run changes.
    digests.save(p.where("article_id > 1"), store, "r1", "regen", at, later(4))
    kept = {r.run: (r.saved, r.failed) for r in digests.runs(spark, store).collect()}
    assert kept == {"b1": (5, 1), "b2": (2, 0), "b3": (5, 1), "r1": (4, 1)} and {r.article_id for r in digests.load(spark, store, "r1").collect()} == {2, 3, 4, 5, 9}
    assert "PartitionFilters: [isnotnull(run" in digests.load(spark, store, "r1")._jdf.queryExecution().executedPlan().toString()
    row = digests.evaluated(spark, store, gold(spark), "r1").first()
    # The baseline has articles 1 and 2: related F1 1, vendors right in one of two.
    assert row.delta_relatedness_f1 == pytest.approx(row.relatedness_f1 - 1.0) and row.delta_vendor_exact_rate == pytest.approx(0 - 0.5) and row.active is False
    assert digests.evaluated(spark, store, gold(spark), "b2").first().delta_relatedness_f1 is None
