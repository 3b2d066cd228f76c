"""The duplicate ladder, skew-safe joins, event vectors and review rules on hand-made cases."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newswarden.context import DEFAULT
from newswarden.operators import events, review, skew
from newswarden.sources import landing

T0 = datetime(2024, 1, 1)


def articles(spark, rows):
    data = [(i, title, body, None if day is None else T0 + timedelta(days=day), T0 + timedelta(days=day or 0)) for i, title, body, day in rows]
    return spark.createDataFrame(data, "id long, title string, clean_text string, published_at timestamp, fetched_at timestamp")


def rungs(df, **options):
    return {r.id: (r.rung, r.duplicate_of) for r in events.survivors(df, **options).collect()}


def test_title_window_slides_from_survivor_to_survivor(spark):
    got = rungs(articles(spark, [(1, "Same", "a", 0), (2, "same ", "b", 8), (3, "SAME", "c", 10), (4, "Same", "d", None), (5, "Same", "a", 9)]))
    assert got == {1: ("unique", None), 2: ("unique", None), 3: ("title_hash", 2), 4: ("unique", None), 5: ("content_hash", 1)}


def test_no_text_or_title_is_no_duplicate(spark):
    got = rungs(articles(spark, [(1, "A", None, 0), (2, "B", "", 0), (3, "C", " \n", 0), (4, None, "x", 0), (5, "", "y", 0), (6, " ", "z", 0)]))
    assert set(got.values()) == {("unique", None)}


def test_frequent_keys_take_another_way_to_the_same_rows(spark):
    rng = random.Random(3)
    df = articles(spark, [(i, rng.choice("ABC"), str(rng.randrange(60)), rng.choice([None, *range(60)])) for i in range(300)])
    assert rungs(df) == rungs(df, array_rows=10, hot=5)
    assert rungs(df.limit(0)) == {}


def test_attach(spark):
    rows = spark.createDataFrame([(k, k % 3 if k % 7 else None) for k in range(100)], "id long, key long")
    facts = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    want = sorted((r.id, r.key, r.top) for r in rows.join(facts, "key", "left").collect())
    for hot in (0, 30, 1000):
        assert sorted((r.id, r.key, r.top) for r in skew.attach(rows, facts, "key", "n", "id", hot).collect()) == want


def test_semantic_rung_needs_recent_articles_and_the_default_distance(spark):
    assert (DEFAULT.attach_distance, DEFAULT.uncertain_distance, DEFAULT.duplicate_distance) == (0.15, 0.35, 0.18)
    df = articles(spark, [(1, "A", "a", 29), (2, "B", "b", 28), (3, "C", "c", 2), (4, "D", "d", 27)])
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 0.0]), (4, [0.0, 1.0])], "id long, embedding array<float>")
    got = {r.id: (r.rung, r.candidates) for r in events.dedup_ladder(df, v, F.col("id") < 5).collect()}
    assert got == {1: ("semantic_candidate", [2]), 2: ("semantic_candidate", [1]), 3: ("semantic_candidate", [1, 2]), 4: ("unique", [])}


def test_vector_of_an_event_is_its_first_ready_article(spark):
    links = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "event_id long, article_id long, created_at long")
    a = spark.createDataFrame([(10, "NEW", [1.0]), (11, "GROUPED", [2.0]), (12, "NEW", [3.0])], "id long, status string, embedding array<double>")
    assert sorted(events.event_vectors(links, a).collect()) == [(1, 11, [2.0]), (2, 12, [3.0])]


def test_open_event_seen_last_matches(spark):
    drafts = spark.createDataFrame([(1, "cve:a"), (2, "unknown"), (3, "b")], "article_id long, grouping_key string")
    e = spark.createDataFrame([(7, "cve:a", "open", 1), (8, "cve:a", "open", 2), (9, "cve:a", "closed", 3), (6, "unknown", "open", 9)], "id long, grouping_key string, event_status string, last_seen_at long")
    assert {r.article_id: r.key_event for r in events.open_match(drafts, e).collect()} == {1: 8, 2: None, 3: None}


def test_review_needs_and_triage(spark):
    a = spark.createDataFrame([(1, "failed", None, None, None), (2, "success", 0.5, None, "x"), (3, "success", 0.9, 0.9, None), (4, "failed", None, None, None)], "id long, extraction_status string, rss_recall double, content_quality double, llm_classification string")
    links = spark.createDataFrame([(3, 1, "x", True)], "article_id long, event_id long, relationship string, is_material_update boolean")
    e = spark.createDataFrame([(1, 0.9)], "id long, confidence double")
    alerts = spark.createDataFrame([(1, "early_warning", False), (1, "confirmed", True)], "event_id long, alert_tier string, suppressed boolean")
    verdicts = spark.createDataFrame([(4, "relevant"), (1, "not_reviewed")], "article_id long, verdict string")
    cases = review.cases(a, links, e, alerts, verdicts)
    assert {r.id: r.a for r in cases.select("id", review.needs_attention().alias("a")).collect()} == {1: True, 2: True, 3: True, 4: False}
    assert tuple(review.summary(cases).first()) == (4, 3, 1, 0, 1, 1, 2, 1, 1)


def test_consolidation_takes_the_first_task_of_a_pair(spark):
    tasks = spark.createDataFrame([(1, 10, 1, ["c", "c", "d"]), (2, 10, 2, ["c"]), (3, 11, 3, ["c"]), (4, 12, 4, ["z"])], "id long, target_id long, completed_at long, results array<string>")
    assert sorted(review.consolidated(tasks, 3).collect()) == [("c", 10, 1, 10), ("c", 11, 3, 10), ("d", 10, 1, 10)]


def test_markdown_report(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n long")
    path = landing.report(df, str(tmp_path / "r"), "Title")
    assert spark.read.json(path).count() == 2
    assert [r.value for r in spark.read.text(f"{path}.md").collect()] == ["# Title", "", "| name | n |", "| --- | --- |", "| a\\|b | 1 |", "|  | 2 |"]


def test_exact_quantiles_by_narrowing(spark):
    import random

    from newswarden.operators import quantiles

    rng = random.Random(1)
    for values in ([rng.random() for _ in range(3000)], [rng.choice([1.0, 2.0]) for _ in range(2001)], [5.0], [1.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
        for q in (0.1, 1.0):
            s, place = sorted(values), q * (len(values) - 1)
            low, high = s[int(place)], s[min(int(place) + (place > int(place)), len(s) - 1)]
            want = low + (high - low) * (place - int(place))
            assert all(abs(quantiles.interpolated(df, "x", q, few) - want) < 1e-12 for few in (50, 10_000))
    assert quantiles.interpolated(spark.createDataFrame([], "x double"), "x", 0.5) is None
