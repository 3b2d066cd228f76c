"""Filters on what is computed from texts don't bring the computation along."""

from newswarden.fixtures import Tables
from newswarden.operators import filtering


def test_a_filter_on_decisions_does_not_repeat_the_signals(spark):
    decided = filtering.decide(Tables(spark, "/root/testdata/sf0.001").articles)
    searched = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    dropped = decided.where("decision = 'DROP' and score < 15 and size(s.negative) = 0")
    assert searched(dropped) == searched(decided) == 1
    assert dropped.count() == sum(r.decision == "DROP" and r.score < 15 and not r.negative for r in decided.select("decision", "score", "s.negative").collect())
