"""A scope keeps an active row; measures of a labelled set at their edges."""

from newswarden.operators import evaluation, merges


def test_keep_one_active(spark):
    state = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, False), ("b", 1, True), ("c", 1, False), ("d", 1, True), ("d", 2, False), ("e", 1, True), ("e", 2, True)], "scope string, id long, is_active boolean")
    changes = [("a", 1, False, 5), ("a", 2, False, 4), ("a", 9, False, 9), ("b", 1, False, 1), ("c", 1, False, 1), ("d", 1, False, 1), ("d", 2, True, 2), ("e", 1, False, 3), ("e", 1, True, 4), ("e", 2, False, 1), ("z", 1, True, 1)]
    got = {(r.scope, r.id): (r.is_active, r.applied, r.error) for r in merges.keep_one_active(state, spark.createDataFrame(changes, "scope string, id long, is_active boolean, at long")).collect()}
    assert got == {
        ("a", 1): (False, False, "last_active"), ("a", 2): (False, True, None), ("a", 9): (False, False, "unknown_id"), ("b", 1): (False, False, "last_active"), ("c", 1): (False, True, None),
        ("d", 1): (False, True, None), ("d", 2): (True, True, None), ("e", 1): (True, True, None), ("e", 2): (False, True, None), ("z", 1): (True, False, "unknown_id"),
    }
    assert merges.keep_one_active(state, spark.createDataFrame([], "scope string, id long, is_active boolean, at long")).collect() == []


ITEM = "is_duplicate boolean, predicted_duplicate boolean, is_relevant boolean, predicted_relevant boolean, llm_called boolean, extraction_success boolean, expected_event_group string, predicted_event_group string, source_to_notification_latency_seconds double"


def test_labelled_metrics(spark):
    nothing = evaluation.labelled_metrics(spark.createDataFrame([], ITEM)).first()
    assert tuple(nothing) == (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None)
    rows = [(True, True, True, True, True, True, "a", "a", 10.0), (True, False, False, True, False, True, "a", "b", 30.0), (False, None, None, False, False, False, "a", "none", None), (False, True, True, True, False, True, None, None, 50.0)]
    got = tuple(evaluation.labelled_metrics(spark.createDataFrame(rows, ITEM)).first())
    assert got == (0.5, 0.5, 2 / 3, 0.5, 0.75, 0.75, 30.0)


def test_pair_report(spark):
    rows = [("same_event", 0.1), ("same_event", 0.2), ("same_event", 0.4), ("different_event", 0.12), ("different_event", 0.5), ("uncertain", 0.3), ("uncertain", None), ("same_event", float("nan")), ("different_event", float("inf")), ("different_event", None)]
    pairs = spark.createDataFrame(rows, "label string, distance double")
    r = evaluation.pair_report(pairs, 0.15, 0.35).first()
    assert (r.labelled, r.scorable, r.unscorable, r.fit_same, r.fit_different, r.uncertain_labels) == (10, 6, 4, 3, 2, 1)
    assert (r.false_attaches, r.missed, r.in_band, r.suggested_attach, r.suggested_uncertain) == (1, 2, 1, 0.25, 0.27)
    apart = evaluation.pair_report(pairs.where("distance <> 0.12"), 0.15, 0.35).first()
    assert (apart.suggested_attach, apart.suggested_uncertain) == (0.4, 0.5)
    nothing = evaluation.pair_report(pairs.limit(0), 0.15, 0.35).first()
    assert (nothing.labelled, nothing.suggested_attach, nothing.suggested_uncertain) == (0, 0.15, 0.35)
    assert {(r.label, r.bin): r.pairs for r in evaluation.pair_histogram(pairs, 0.2).collect()} == {("same_event", 0): 1, ("same_event", 1): 1, ("same_event", 2): 1, ("different_event", 0): 1, ("different_event", 2): 1, ("uncertain", 1): 1}
