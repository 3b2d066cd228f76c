"""Decisions case by case, with nulls, empty texts, ties and empty tables."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newswarden.context import AS_OF, DEFAULT, Context, Product
from newswarden.functions import dates, numbers, text
from newswarden.operators import entities, evaluation, events, filtering, latest, merges, monitoring, readmodels, vectors

NOW = datetime.fromisoformat(AS_OF)
ARTICLE = "id long, source_name string, title string, rss_summary string, clean_text string, published_at timestamp, fetched_at timestamp"


def articles(spark, *rows):
    return spark.createDataFrame([(k, s, t, r, r, NOW - timedelta(hours=h) if h is not None else None, NOW) for k, (s, t, r, h) in enumerate(rows)], ARTICLE)


def test_filter_cascade(spark):
    rows = [
        ("x", "Acme Gateway zero-day CVE-2024-1234 actively exploited", "", 2),
        ("x", "Acme quarterly results and webinar", "", 2),
        ("x", "Acme opens an office", "", 2),
        ("x", "Globex vulnerability fixed", "", 2),
        ("Dark Reading", "Globex vulnerability fixed", "", 2),
        ("x", "Some cve-2023-99999 bug", None, None),
        ("CISA", "Weekly digest", "", 500),
        ("Business Daily", "Gardening tips", "", 500),
        (None, None, None, None),
        (None, "", "", None),
        ("x", "acmegateway ACME-GATEWAY patch", "", 2),
    ]
    got = [(r.decision, r.score) for r in filtering.decide(articles(spark, *rows)).orderBy("id").collect()]
    assert got == [("KEEP", 100), ("DROP", 5), ("DROP", 25), ("DROP", 55), ("KEEP", 65), ("MAYBE_KEEP", 35), ("MAYBE_KEEP", 5), ("DROP", 0), ("DROP", 0), ("DROP", 0), ("MAYBE_KEEP", 45)]
    assert filtering.decide(articles(spark, *rows).limit(0)).collect() == []
    many = Context(inventory=(Product("V", "P.x+1", ("al-ias",)),))
    hits = filtering.signals(articles(spark, ("x", "the P.x+1, and AL-IAS", "", 1), ("x", "Pax+1", "", 1)), many).orderBy("id").select("s.products", "s.vendors").collect()
    assert [tuple(h) for h in hits] == [(["P.x+1"], ["V"]), ([], [])]


@pytest.mark.parametrize("zones,n,kind,backed,want", [(["title"], 1, "vendor", True, 1.0), (["title"], 1, "vendor", False, 0.45), (["tail"], 1, "vendor", True, 0.3), (["body"], 2, "product", True, 0.7), (["tail"], 1, "cve", True, 0.6), (["lead"], 1, "ioc_ip", False, 0.95), ([], 0, "attack_type", True, 0.0), (["summary", "tail"], 2, "attack_type", False, 1.0)])
def test_confidence(spark, zones, n, kind, backed, want):
    t = F.struct(*(F.lit((n if len(zones) == 1 else 1) if z in zones else 0).alias(z) for z, _ in entities.ZONES))
    df = spark.range(1).select(F.lit(kind).alias("entity_type"), F.lit(backed).alias("corroborated"), t.alias("t"))
    assert df.select(entities.confidence()).first()[0] == want


def test_entities_and_drafts(spark):
    a = articles(spark, ("x", "Acme GW hit by ransomware", "Acme Gateway users on 10.1.2.3 saw evil.example.com", 1), (None, None, None, None))
    e = {(r.entity_type, r.entity_value): r.confidence for r in entities.extract(a).collect()}
    assert e["product", "Acme Gateway"] == 1.0 and e["ioc_ip", "10.1.2.3"] == 0.95 and ("ioc_domain", "evil.example.com") in e and e["attack_type", "ransomware"] == 1.0
    d = entities.drafts(entities.extract(a)).first()
    assert (d.severity, d.urgency, d.grouping_key) == ("high", "P1", "acme|acme gateway::ransomware")
    assert entities.extract(a.limit(0)).collect() == []


def alert(**kw):
    return {"vendor": "Acme", "severity": "high", "urgency": "P1", "confidence": 0.9, "first_seen_at": NOW - timedelta(hours=30), "recent_tier": None, "material": False} | kw


@pytest.mark.parametrize("event,reason,tier", [
    (alert(vendor=None), "no_affected_vendor", None),
    (alert(), "confirmed_vendor_impact_event", "confirmed"),
    (alert(confidence=0.5, first_seen_at=NOW - timedelta(hours=3)), "early_warning_unconfirmed_signal", "early_warning"),
    (alert(confidence=None, first_seen_at=None), "early_warning_unconfirmed_signal", "early_warning"),
    (alert(severity="low"), "stale_event_below_confirmed_gate", None),
    (alert(urgency="P3"), "stale_event_below_confirmed_gate", None),
    (alert(recent_tier="confirmed"), "recent_alert_suppression", None),
    (alert(recent_tier="early_warning"), "upgraded_to_confirmed", "confirmed"),
    (alert(recent_tier="confirmed", material=True), "material_update_bypasses_suppression", "confirmed"),
    (alert(recent_tier="confirmed", material=True, confidence=0.1), "material_update_bypasses_suppression", "early_warning"),
])
def test_alerts(spark, event, reason, tier):
    schema = "vendor string, severity string, urgency string, confidence double, first_seen_at timestamp, recent_tier string, material boolean"
    r = events.decide_alerts(spark.createDataFrame([tuple(event.values())], schema)).first()
    assert (r.reason, r.tier, r.should_alert) == (reason, tier, tier is not None)


def test_grouping_ladder_and_assessment(spark):
    rows = [("k", 7, 8, 0.1), ("unknown", 7, 8, 0.1), ("k", None, 8, 0.3), ("k", None, 8, 0.9), ("k", None, None, None)]
    got = [(r.kind, r.event, r.method) for r in events.decide_grouping(spark.createDataFrame(rows, "grouping_key string, key_event long, near_event long, distance double")).collect()]
    assert got == [("attach", 7, "grouping_key"), ("attach", 8, "embedding"), ("uncertain", 8, None), ("create", None, "no_match"), ("create", None, "no_match")]
    rows = [("low", "P4", None, "high", "P2", 0.8, True, 3), ("critical", "P1", 0.9, "odd", "P2", 0.1, True, 1), ("high", None, 0.5, "high", "P3", 0.9, False, 9), (None, None, None, "low", "P4", 1.0, True, 99)]
    schema = "severity string, urgency string, confidence double, new_severity string, new_urgency string, new_confidence double, relevant boolean, sources long"
    got = [(r.next_severity, r.next_urgency, round(r.next_confidence, 6)) for r in events.assessed(spark.createDataFrame(rows, schema)).collect()]
    assert got == [("high", "P2", 0.87), ("critical", "P1", 0.9), ("high", "P3", 0.2), ("low", "P4", 0.95)]


def test_deduplication_modes(spark):
    at = lambda d: NOW - timedelta(days=d)
    rows = [(1, "s", "T one", "r", "same", at(3), NOW), (2, "s", "T two", "r", " same ", at(5), NOW), (3, "s", "T three", "r", "same", None, NOW), (4, "s", "Title", "r", "a", at(9), NOW), (5, "s", " TITLE ", "r", "b", at(4), NOW), (6, "s", "title", "r", "c", at(1), NOW)]
    df = spark.createDataFrame(rows, ARTICLE)
    spec = {r.id: (r.rung, r.duplicate_of) for r in events.survivors(df).collect()}
    assert spec == {1: ("content_hash", 2), 2: ("unique", None), 3: ("content_hash", 2), 4: ("unique", None), 5: ("title_hash", 4), 6: ("unique", None)}
    assert {r.id for r in events.survivors(df, "compat").where("duplicate_of is null").collect()} == {3, 4, 6}


def test_latest_rows_and_changes(spark):
    rows = [(1, 1, "nvd", "ok", 95.0, NOW), (2, 1, "nvd", "ok", 95.0, NOW), (3, 1, "nvd", "failed", None, NOW + timedelta(1)), (4, 1, "nvd", "ok", 96.0, NOW + timedelta(2)), (5, 1, "nvd", "transient_failure", None, NOW + timedelta(3))]
    obs = spark.createDataFrame(rows, "id long, case_id long, source string, status string, value double, retrieved_at timestamp")
    assert [r.id for r in latest.latest(obs, ["case_id", "source"], ["retrieved_at", "id"]).collect()] == [5]
    assert [r.id for r in latest.latest(latest.terminal(obs), ["case_id", "source"], ["retrieved_at", "id"]).collect()] == [4]
    assert sorted(r.id for r in latest.changes(obs).collect()) == [1, 4]
    cases = spark.createDataFrame([(1, "c", "draft"), (2, "d", "approved")], "id long, cve_id string, status string")
    got = {r.id: (r.action, r.cvss) for r in latest.publication(latest.scores(latest.skim(cases, obs))).collect()}
    assert got == {1: ("publish", 9.6), 2: ("unpublish", None)}


def test_grades_and_rounding(spark):
    df = spark.createDataFrame([(9.0, 0.1, None), (7.0, 0.05, 0.96), (1.0, 0.01, 0.91), (None, None, None)], "c double, s double, p double")
    assert [tuple(r) for r in df.select(numbers.cvss_grade(F.col("c")), numbers.epss_grade(F.col("s"), F.col("p"))).collect()] == [("critical", "critical"), ("high", "critical"), ("medium", "high"), (None, None)]
    assert [r[0] for r in spark.createDataFrame([(1.005,), (2.5,), (-1.235,)], "x double").select(numbers.rounded(F.col("x"))).collect()] == [1.0, 2.5, -1.24]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, n int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "id long, v string, n int")
    rows = lambda df: sorted((r.id, r.v) for r in df.collect())
    assert rows(merges.insert_absent(old, new, ["id"], ["n"])) == [(1, "a"), (2, "b"), (3, "e")]
    assert rows(merges.upsert(old, new, ["id"], ["n"])) == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(merges.upsert_where(old, new.where("n <> 3"), ["id"], F.col("v") == "z")) == [(1, "a"), (2, "b"), (3, "e")]
    assert rows(merges.replace_group(old, new, ["id"])) == [(1, "a"), (2, "c"), (2, "d"), (3, "e")]
    assert rows(merges.upsert(old, new.limit(0), ["id"], ["n"])) == rows(old)


def test_drift_and_times(spark):
    rows = [("s", k, NOW - timedelta(hours=k), 0.1 * (k < 3), None, "HTTP_FAILED" if k < 4 else "ok") for k in range(6)] + [("quiet", 9, NOW, 0.0, 0.0, "ok"), (None, 9, NOW, 0.0, 0.0, "ok")]
    df = spark.createDataFrame(rows, "source_name string, id long, extracted_at timestamp, rss_recall double, content_quality double, extraction_status string")
    got = {r.source_name: (r.drifted, r.reasons) for r in monitoring.drift(df).collect()}
    assert got == {"s": (True, ["median_recall_0.05_below_0.6", "failure_rate_0.67_above_0.5"]), "quiet": (False, [])}
    t = spark.createDataFrame([(NOW + timedelta(1),), (NOW - timedelta(15),), (None,)], "t timestamp").select(dates.recent(F.col("t"), AS_OF), dates.old(F.col("t"), AS_OF), dates.day_in(F.col("t")))
    assert [tuple(r) for r in t.collect()] == [(True, False, "2024-02-01"), (False, True, "2024-01-16"), (False, False, "")]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, embedding array<float>")
    got = [(r.query_id, r.id, r["rank"]) for r in vectors.top_k(v.where("id = 1"), v, 2, blocks=3).orderBy("rank").collect()]
    assert got == [(1, 2, 1), (1, 3, 2)]
    odd = spark.createDataFrame([([1.0], [1.0, 2.0]), ([0.0], [1.0]), ([], [])], "a array<float>, b array<float>").select(numbers.cosine_distance(F.col("a"), F.col("b")))
    assert [r[0] for r in odd.collect()] == [1.0, 1.0, 1.0]


def test_text_functions(spark):
    df = spark.createDataFrame([("  HTTPS://Ex.Com/a//?utm_source=x&b=2&a=1&REF=q#f ",), ("http://x.org",), ("http://x.org/?",)], "u string")
    assert [r[0] for r in df.select(text.normal_url(F.col("u"))).collect()] == ["https://ex.com/a?a=1&b=2", "http://x.org/", "http://x.org/"]
    html = spark.createDataFrame([("<p>a&lt;b</p><SCRIPT>x\ny</SCRIPT>&nbsp;c",), (None,)], "h string").select(text.html_text(F.col("h"))).collect()
    assert [r[0] for r in html] == ["a<b c", None]
    n = spark.createDataFrame([("a-a a",), ("",), (None,)], "t string").select(text.count_phrase(F.col("t"), F.lit("a"))).collect()
    assert [r[0] for r in n] == [2, 0, None]
    assert DEFAULT.lexicon.flat[0] == "0-day" and text._phrase("Out-of-band  patch") == "out of band patch"


def test_pairs_of_whole_tables(spark):
    from itertools import combinations

    rows = [(i % 90, i % 7) for i in range(200)] + [(None, 1), (5, None)]
    df = spark.createDataFrame(rows, "item long, basket int")
    known = [r for r in rows if None not in r]
    pairs = [(a, b) for a, b in combinations(known, 2) if a[0] != b[0]]
    want = {k: (sum(a[1] == b[1] == k for a, b in pairs), sum(a[1] != b[1] and k in (a[1], b[1]) for a, b in pairs)) for k in range(7)}
    assert {r.basket: (r.within, r.across) for r in readmodels.pair_counts(df, "basket", "item").collect()} == want


def test_limits_and_places_of_whole_tables(spark):
    import numpy as np

    v = np.random.default_rng(5).normal(size=(150, 6))
    v[149] = 0
    rows = [(k, k % 4 if k % 50 else None, x.tolist()) for k, x in enumerate(v)] + [(150, 1, None), (151, 2, [1.0])]
    df = spark.createDataFrame(rows, "id long, label int, embedding array<double>")
    pairs = df.alias("a").join(df.alias("b"), F.col("a.id") < F.col("b.id")).select(F.when(F.col("a.label") == F.col("b.label"), "same_event").otherwise("different_event").alias("label"), numbers.cosine_distance(F.col("a.embedding"), F.col("b.embedding")).alias("distance"))
    want = evaluation.threshold_suggestion(pairs).first()
    for size in (20, 2048):
        got = evaluation.distance_limits(df, rows=size).first()
        assert got.same_max == pytest.approx(want.same_max) and got.different_min == pytest.approx(want.different_min)
    ids = spark.range(0, 5000, 7).repartition(5).withColumn("id", F.col("id") * 3 - 400)
    assert [r.place for r in readmodels.numbered(ids, "id").orderBy("id").collect()] == list(range(715))
    assert readmodels.numbered(ids.limit(0), "id").collect() == []


def test_legacy_overrides(spark):
    at = lambda degrees: [float(math.cos(math.radians(degrees))), float(math.sin(math.radians(degrees)))]
    # 0: the nearest decides nothing, the next shares an identifier; 100: vendor, product and type; 200: near ones differ in type; 300: too far.
    where = {0: 0, 1: 2, 2: 5, 3: 6, 100: 90, 101: 93, 200: 180, 201: 184, 300: 270, 301: 306}
    vectors = spark.createDataFrame([(k, at(v)) for k, v in where.items()], "id long, embedding array<double>")
    acme = ["Acme"], ["Acme Gateway"]
    rows = [(0, ["CVE-1"], *acme, "rce"), (1, [], [], [], "rce"), (2, ["CVE-9", "CVE-1"], [], [], "breach"), (3, [], *acme, "rce"), (100, [], *acme, "rce"), (101, ["CVE-1"], *acme, "rce"), (200, [], *acme, "rce"), (201, [], *acme, "breach"), (300, ["CVE-2"], *acme, "rce"), (301, ["CVE-2"], *acme, "rce")]
    facts = spark.createDataFrame(rows, "id long, cves array<string>, vendors array<string>, products array<string>, event_type string")
    got = {r.query_id: (r.id, r.relationship) for r in events.legacy_overrides(events.similar(vectors.where("id % 100 = 0"), vectors), facts).collect()}
    assert got == {0: (2, "same_event_material_update"), 100: (101, "same_event_new_source")}
    # The limit itself is similar enough; a sixth nearest is not looked at.
    edge = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.82, math.sqrt(1 - 0.82**2)])], "id long, embedding array<double>")
    named = spark.createDataFrame([(k, ["CVE-1"], [], [], "x") for k in (0, 1)], facts.schema)
    assert [r.id for r in events.legacy_overrides(events.similar(edge.where("id = 0"), edge), named).collect()] == [1]
    many = spark.createDataFrame([(k, at(k)) for k in range(7)], "id long, embedding array<double>")
    last = spark.createDataFrame([(k, ["CVE-1"] if k in (0, 6) else [], [], [], str(k)) for k in range(7)], facts.schema)
    assert events.legacy_overrides(events.similar(many.where("id = 0"), many), last).collect() == []
