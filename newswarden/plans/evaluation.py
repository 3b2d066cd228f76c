"""Evaluation queries (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..context import DEFAULT
from ..operators import evaluation, filtering
from ..functions import text
from .domain import _ITEMS, _SIGNALS
from .registry import query
from .text import CVES

_C = F.col
_LABEL = "CASE id % 4 WHEN 0 THEN 'CRITICAL_RELEVANT' WHEN 1 THEN 'RELEVANT' WHEN 2 THEN 'WEAK_RELEVANT' ELSE 'IRRELEVANT' END"


def _results(t):
    label = F.when(_C("id") % 4 == 0, "CRITICAL_RELEVANT").when(_C("id") % 4 == 1, "RELEVANT").when(_C("id") % 4 == 2, "WEAK_RELEVANT").otherwise("IRRELEVANT")
    return filtering.decide(t.articles).withColumn("human_label", label)


_RES = f"WITH {_SIGNALS}, res AS (SELECT *, {_LABEL} AS human_label FROM dec)"


@query("e_01_label_metrics", "SELECT count(*) AS n, count(*) FILTER (quality = 1) / count(*) AS good_rate, count(*) FILTER (toxic = 1) / count(*) AS toxic_rate, count(*) FILTER (quality = 1 AND toxic = 0) / count(*) AS usable_rate FROM labels")
def _(t):
    share = lambda c: F.count_if(c) / F.count("*")
    return t.labels.agg(F.count("*").alias("n"), share(_C("quality") == 1).alias("good_rate"), share(_C("toxic") == 1).alias("toxic_rate"), share((_C("quality") == 1) & (_C("toxic") == 0)).alias("usable_rate"))


_RATE = "CASE WHEN count(*) FILTER ({1}) = 0 THEN 0.0 ELSE count(*) FILTER ({0}) / count(*) FILTER ({1}) END"
_CRIT, _IMP, _IRR = "human_label = 'CRITICAL_RELEVANT'", "human_label IN ('CRITICAL_RELEVANT', 'RELEVANT')", "human_label = 'IRRELEVANT'"


_METRICS = f"""SELECT count(*) AS dataset_size, {_RATE.format(_CRIT + " AND decision = 'KEEP'", _CRIT)} AS critical_recall, {_RATE.format(_IMP + " AND decision <> 'DROP'", _IMP)} AS relevant_recall,
  {_RATE.format(_IMP + " AND decision = 'DROP'", _IMP)} AS false_negative_rate, {_RATE.format(_CRIT + " AND decision <> 'KEEP'", _CRIT)} AS critical_miss_rate, {_RATE.format("decision <> 'DROP'", "true")} AS pass_through_rate,
  {_RATE.format("decision = 'KEEP'", "true")} AS keep_rate, {_RATE.format("decision = 'MAYBE_KEEP'", "true")} AS maybe_keep_rate, {_RATE.format(_IRR + " AND decision <> 'DROP'", _IRR)} AS irrelevant_pass_rate FROM res"""


@query("e_02_filter_metrics", f"{_RES} {_METRICS}")
def _(t):
    return evaluation.filter_metrics(_results(t))


@query("e_02_gate", f"""{_RES}, m AS ({_METRICS}) SELECT failures = '' AS passed, failures, warnings FROM (SELECT concat_ws(',', CASE WHEN critical_recall < 1 THEN 'critical_recall' END, CASE WHEN relevant_recall < 0.9 THEN 'relevant_recall' END, CASE WHEN critical_miss_rate > 0 THEN 'critical_miss_rate' END) AS failures,
  concat_ws(',', CASE WHEN dataset_size < 50 THEN 'small_dataset' END, CASE WHEN pass_through_rate > 0.6 THEN 'high_pass_through' END, CASE WHEN irrelevant_pass_rate > 0.5 THEN 'high_irrelevant_pass' END) AS warnings FROM m)""")
def _(t):
    return evaluation.gate(evaluation.filter_metrics(_results(t))).select("passed", F.array_join("failures", ",").alias("failures"), F.array_join("warnings", ",").alias("warnings"))


@query("e_02_failures", f"""{_RES} SELECT failure, count(*) AS n FROM (SELECT CASE WHEN {_CRIT} AND decision = 'DROP' THEN 'critical_dropped' WHEN {_CRIT} AND decision = 'MAYBE_KEEP' THEN 'critical_deprioritized' WHEN human_label = 'RELEVANT' AND decision = 'DROP' THEN 'relevant_dropped'
  WHEN human_label = 'WEAK_RELEVANT' AND decision = 'DROP' THEN 'weak_relevant_dropped' WHEN {_IRR} AND decision = 'KEEP' THEN 'irrelevant_kept' WHEN {_IRR} AND decision = 'MAYBE_KEEP' THEN 'irrelevant_maybe_kept' END AS failure FROM res) WHERE failure IS NOT NULL GROUP BY 1""")
def _(t):
    return _results(t).select(evaluation.failure_type(_C("human_label"), _C("decision")).alias("failure")).where("failure is not null").groupBy("failure").agg(F.count("*").alias("n"))


@query("e_03_confusion", f"{_RES} SELECT human_label, count(*) FILTER (decision = 'KEEP') AS keep, count(*) FILTER (decision = 'MAYBE_KEEP') AS maybe, count(*) FILTER (decision = 'DROP') AS dropped FROM res GROUP BY 1")
def _(t):
    wide = _results(t).groupBy("human_label").pivot("decision", ["KEEP", "MAYBE_KEEP", "DROP"]).count().na.fill(0)
    return wide.withColumnsRenamed({"KEEP": "keep", "MAYBE_KEEP": "maybe", "DROP": "dropped"})


@query("e_05_expected_decision", f"SELECT id, CASE {_LABEL} WHEN 'CRITICAL_RELEVANT' THEN 'KEEP' WHEN 'IRRELEVANT' THEN 'DROP' ELSE 'MAYBE_KEEP' END AS least FROM v_articles")
def _(t):
    return _results(t).select("id", evaluation.least_decision(_C("human_label")).alias("least"))


@query("e_06_judge_distribution", f"{_RES} SELECT tier, decision, count(*) AS n, count(*) FILTER ({_IMP} AND decision = 'DROP') AS risks FROM res GROUP BY ALL")
def _(t):
    risk = _C("human_label").isin("CRITICAL_RELEVANT", "RELEVANT") & (_C("decision") == "DROP")
    return _results(t).groupBy(_C("s.tier").alias("tier"), "decision").agg(F.count("*").alias("n"), F.count_if(risk).alias("risks"))


@query("e_07_dashboard", f"{_RES} SELECT id, row_number() OVER (ORDER BY CASE WHEN {_IMP} AND decision = 'DROP' THEN 0 WHEN {_IRR} AND decision <> 'DROP' THEN 1 ELSE 2 END, id) AS place FROM res QUALIFY place <= 200")
def _(t):
    from ..operators.readmodels import ranked

    r = _results(t)
    rank = F.when(_C("human_label").isin("CRITICAL_RELEVANT", "RELEVANT") & (_C("decision") == "DROP"), 0).when((_C("human_label") == "IRRELEVANT") & (_C("decision") != "DROP"), 1).otherwise(2)
    return ranked(r.orderBy(rank, "id").limit(200), rank, _C("id")).select("id", "place")


@query("e_08_digest_metrics", """SELECT count(*) AS n, (count(*) - count(*) FILTER (g <> p)) / count(*) AS accuracy, CASE WHEN count(*) FILTER (p) = 0 THEN 1.0 ELSE count(*) FILTER (g AND p) / count(*) FILTER (p) END AS precision, CASE WHEN count(*) FILTER (g) = 0 THEN 0.0 ELSE count(*) FILTER (g AND p) / count(*) FILTER (g) END AS recall
  FROM (SELECT quality = 1 AS g, doc_id % 5 <> 0 AS p FROM labels)""")
def _(t):
    return evaluation.binary_metrics(t.labels.select((_C("quality") == 1).alias("g"), (_C("doc_id") % 5 != 0).alias("p")), "g", "p").drop("f1")


def _vendors(column: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {v} THEN '{p.vendor}' END" for p, _, v in _ITEMS).replace("txt", column) + "], lambda x: x IS NOT NULL)"


_AGREE = f"""ag AS (SELECT id, len(gv) > 0 AS gold_related, len(pv) > 0 AS pred_related, list_sort(gv) = list_sort(pv) AS v, list_sort(list_distinct(gc)) = list_sort(list_distinct(pc)) AS c
    FROM (SELECT id, {_vendors("title")} AS gv, {_vendors("body")} AS pv, {CVES.format("title")} AS gc, {CVES.format("body")} AS pc FROM (SELECT id, title, concat(title, ' ', clean_text) AS body FROM v_articles)))"""


@query("e_09_agreement", f"WITH {_AGREE} SELECT id, gold_related = pred_related AS related, CASE WHEN gold_related THEN v END AS vendors, c AS cves FROM ag")
def _(t):
    return evaluation.exact_agreement(_gold_and_predicted(t)).select("id", "related", "vendors", "cves")


@query("e_09_agreement_rates", f"WITH {_AGREE} SELECT count(*) AS samples, count(*) FILTER (gold_related = pred_related) / count(*) AS related_rate, count(*) FILTER (gold_related AND v) / nullif(count(*) FILTER (gold_related), 0) AS vendor_rate, count(*) FILTER (c) / count(*) AS cve_rate FROM ag")
def _(t):
    return evaluation.agreement_rates(evaluation.exact_agreement(_gold_and_predicted(t))).select("samples", "related_rate", "vendor_rate", "cve_rate")


def _gold_and_predicted(t):
    """What a title says as gold, what title and body say as predicted."""
    body = F.concat("title", F.lit(" "), "clean_text")
    gold, predicted = (filtering.inventory_hits(c, DEFAULT.inventory) for c in (_C("title"), body))
    a = t.articles.select("id", gold[0].alias("gold_vendors"), gold[1].alias("gold_products"), text.cves(_C("title")).alias("gold_cves"), predicted[0].alias("vendors"), predicted[1].alias("products"), text.cves(body).alias("cves"))
    return a.withColumns({"gold_related": F.size("gold_vendors") > 0, "related": F.size("vendors") > 0})


_KIND = """CASE WHEN human_label = 'CRITICAL_RELEVANT' AND decision = 'DROP' THEN 'false_negative_risk' WHEN human_label = 'CRITICAL_RELEVANT' AND score < 40 THEN 'under_scored_critical' WHEN human_label = 'IRRELEVANT' AND decision = 'KEEP' THEN 'false_positive_risk'
  WHEN human_label = 'IRRELEVANT' AND score >= 40 THEN 'over_scored_irrelevant' WHEN id % 3 = 0 THEN 'reasonable' ELSE 'minor_difference' END"""


@query("e_06_disagreements", f"{_RES} SELECT kind, count(*) AS n FROM (SELECT {_KIND} AS kind FROM res) GROUP BY 1")
def _(t):
    assessed = F.when(_C("id") % 3 == 0, "REASONABLE").otherwise("TOO_LOW")
    return _results(t).select(evaluation.disagreement(_C("human_label"), _C("decision"), _C("score"), assessed).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("e_10_pairs", "SELECT CASE WHEN a.label = b.label THEN 'same_event' ELSE 'different_event' END AS label, count(*) AS pairs FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id GROUP BY 1")
def _(t):
    from ..operators.readmodels import pair_counts

    # A pair across baskets counts for both of them.
    c = pair_counts(t.embeddings, "label", "vec_id").agg(F.sum("within").alias("same_event"), (F.sum("across") / 2).cast("long").alias("different_event"))
    rows = F.array(*(F.struct(F.lit(k).alias("label"), _C(k).alias("pairs")) for k in ("same_event", "different_event")))
    return c.select(F.inline(rows)).where("pairs > 0")


@query("e_11_threshold", "SELECT round(max(CASE WHEN l = 'same_event' THEN d END), 4) AS same_max, round(min(CASE WHEN l <> 'same_event' THEN d END), 4) AS different_min FROM (SELECT CASE WHEN a.label = b.label THEN 'same_event' ELSE 'different_event' END AS l, list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)")
def _(t):
    limits = evaluation.distance_limits(t.embeddings.select(_C("vec_id").alias("id"), "label", "embedding"))
    return limits.select(F.round("same_max", 4).alias("same_max"), F.round("different_min", 4).alias("different_min"))


@query("e_12_extraction_sets", r"""SELECT count(*) AS n, round(CAST(sum(shared) AS DOUBLE) / sum(p), 9) AS precision, round(CAST(sum(shared) AS DOUBLE) / sum(g), 9) AS recall FROM (SELECT len(g) AS g, len(p) AS p, len(list_intersect(g, p)) AS shared FROM
  (SELECT list_distinct(list_transform(regexp_extract_all(title, '(?i)\bCVE-[0-9]{4}-[0-9]{4,}\b'), lambda x: lower(x))) AS g, list_distinct(list_transform(regexp_extract_all(lower(substring(title, 1, 40)), 'cve-[0-9]{4}-[0-9]{4,}'), lambda x: x)) AS p FROM v_articles))""")
def _(t):
    rows = t.articles.select(text.cves(_C("title")).alias("g"), text.cves(F.substring("title", 1, 40)).alias("p"))
    return evaluation.set_metrics(rows, "g", "p").select("n", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("e_13_harvest", "SELECT bucket, id FROM (SELECT id, doc % 4 AS bucket, row_number() OVER (PARTITION BY doc % 4 ORDER BY sha256(CAST(id AS VARCHAR)), id) AS rn FROM (SELECT id, id % 4 AS doc FROM v_articles WHERE id NOT IN (SELECT doc_id FROM labels))) WHERE rn <= 10")
def _(t):
    from ..operators.latest import first_n

    free = t.articles.join(t.labels.select(_C("doc_id").alias("id")), "id", "left_anti").select((_C("id") % 4).alias("bucket"), "id")
    return first_n(free, ["bucket"], [F.sha2(_C("id").cast("string"), 256), _C("id")], 10)


@query("e_14_queue_counts", "SELECT count(*) AS unlabelled, count(*) FILTER (status = 'DIGESTED') AS ready FROM v_articles WHERE id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t.articles.join(t.labels.select(_C("doc_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("unlabelled"), F.count_if(_C("status") == "DIGESTED").alias("ready"))


@query("e_15_basket_overlap", "SELECT article_id FROM (SELECT article_id, count(DISTINCT event_id) AS n FROM (SELECT article_id, event_id FROM v_event_articles UNION ALL SELECT article_id, event_id + 1 FROM v_event_articles WHERE article_id % 20 = 0) GROUP BY 1) WHERE n > 1")
def _(t):
    links = t.event_articles.select("article_id", "event_id")
    both = links.union(links.where("article_id % 20 = 0").select("article_id", _C("event_id") + 1))
    return both.groupBy("article_id").agg(F.countDistinct("event_id").alias("n")).where("n > 1").select("article_id")


@query("e_16_assist_valid", "SELECT event_id, count(*) BETWEEN 2 AND 5 AS valid FROM v_event_articles GROUP BY 1")
def _(t):
    return t.event_articles.groupBy("event_id").agg(F.count("*").between(2, 5).alias("valid"))


@query("e_17_run_join", "SELECT d.doc_id, l.quality IS NOT NULL AS predicted FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", _C("quality").isNotNull().alias("predicted"))


_FAILED = f"SELECT id, tier, score, decision, negative, n_product, n_vendor, exploitation + incident AS critical, medium, (SELECT length(trim(rss_summary)) FROM v_articles a WHERE a.id = res.id) AS n FROM res WHERE {_IMP} AND decision = 'DROP'"


@query("e_04_failure_buckets", f"""{_RES} SELECT bucket, CASE bucket WHEN 'missing_product_alias' THEN 'add_missing_product_alias' WHEN 'negative_keyword_overpowered' THEN 'reduce_negative_keyword_penalty'
    ELSE CASE WHEN bucket = 'threshold_too_high' OR (tier = 'security_media' AND score < 15) THEN 'increase_security_media_boost_or_lower_maybe_threshold' WHEN bucket = 'rss_summary_too_short' THEN 'consider_source_tier_boost_or_shadow_sampling' ELSE 'manual_review_required' END END AS fix, count(*) AS n
  FROM (SELECT *, CASE WHEN negative > 0 THEN 'negative_keyword_overpowered' WHEN id % 8 < 4 AND n_product = 0 THEN 'missing_product_alias' WHEN n < 40 THEN 'rss_summary_too_short' WHEN score > 0 AND score < 15 THEN 'threshold_too_high' ELSE 'unknown' END AS bucket FROM ({_FAILED})) GROUP BY ALL""")
def _(t):
    r = _results(t).where(_C("human_label").isin("CRITICAL_RELEVANT", "RELEVANT") & (_C("decision") == "DROP"))
    no = F.lit(False)
    expected = F.struct((_C("id") % 8 < 4).alias("product"), no.alias("vendor"), no.alias("critical"), no.alias("medium"))
    n = lambda c: F.size(f"s.{c}")
    bucket = evaluation.failure_bucket(expected, n("negative"), n("products"), n("vendors"), n("exploitation") + n("incident"), n("medium"), _C("rss_summary"), F.lit(True), _C("score"), _C("decision"), F.lit(""))
    r = r.withColumn("bucket", bucket).withColumn("fix", evaluation.suggested_fix(_C("bucket"), _C("s.tier"), _C("score")))
    return r.groupBy("bucket", "fix").agg(F.count("*").alias("n"))


_LOT = "CAST(concat('0x', substring(sha256(concat('{0}', {1})), 1, 15)) AS BIGINT)"
_QUOTA = f"""q AS (SELECT lang, doc_id, fit, row_number() OVER (PARTITION BY lang ORDER BY {_LOT.format("w10", "doc_id")}, doc_id) AS rn FROM (SELECT lang, doc_id, n_chars >= 600 AS fit FROM documents)),
  k AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY rn) - 1 AS place FROM q WHERE rn <= 48 AND fit)"""
_LANGS = ["en", "de", "fr", "es", "nowhere"]


def _quota(t):
    from ..operators import sampling

    rows = t.documents.select("lang", "doc_id", (_C("n_chars") >= 600).alias("fit"))
    return sampling.by_quota(rows, "lang", "doc_id", _LANGS, 200, _C("fit"), seed="w10")


@query("w_10_quota", f"WITH {_QUOTA} SELECT lang, doc_id, place FROM k WHERE place < 40 AND lang IN ('en', 'de', 'fr', 'es')")
def _(t):
    """40 documents of each language, of 48 drawn those that are long enough."""
    return _quota(t)[0]


@query("w_10_quota_report", f"WITH {_QUOTA} SELECT b.lang, CAST(40 AS BIGINT) AS requested, count(k.doc_id) AS found FROM (SELECT unnest({_LANGS}) AS lang) b LEFT JOIN k ON k.lang = b.lang AND place < 40 GROUP BY 1")
def _(t):
    return _quota(t)[1]


_HARVEST = f"""{_RES}, d AS (SELECT id, decision, {_LOT.format("", "id")} AS lot, score FROM res),
  o AS (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY CASE WHEN decision = 'DROP' THEN score END DESC NULLS LAST, lot, id) AS rn, id IN (SELECT doc_id FROM labels) AS labelled, id % 5 = 0 AS candidate FROM d),
  p AS (SELECT *, count(*) FILTER (NOT labelled AND NOT candidate) OVER (PARTITION BY decision ORDER BY rn) AS n, m FROM o JOIN (VALUES ('KEEP', 12), ('MAYBE_KEEP', 9), ('DROP', 15)) AS l(dec2, m) ON dec2 = decision WHERE rn <= 3 * m),
  t AS (SELECT * FROM p WHERE n <= m AND NOT (n = m AND (labelled OR candidate)))"""


def _harvest(t):
    from ..operators import sampling

    rows = filtering.decide(t.articles).select("decision", "id", "score")
    return sampling.harvested(rows, "decision", "id", {"KEEP": 12, "MAYBE_KEEP": 9, "DROP": 15}, t.labels.select(_C("doc_id").alias("id")), t.articles.where("id % 5 = 0").select("id"), {"DROP": "score"})


@query("e_13_harvest_strata", f"{_HARVEST} SELECT decision, id FROM t WHERE NOT labelled AND NOT candidate")
def _(t):
    """New candidates of each decision: three times as many drawn, known ones skipped, drops by score."""
    return _harvest(t)[0]


@query("e_13_harvest_report", f"{_HARVEST} SELECT decision, count(*) FILTER (NOT labelled AND NOT candidate) AS added, count(*) FILTER (labelled) AS skipped_labelled, count(*) FILTER (NOT labelled AND candidate) AS skipped_candidate FROM t GROUP BY 1")
def _(t):
    return _harvest(t)[1]


_DIGESTS = f"""g AS (SELECT id, id % 3 <> 0 AS rel, CASE WHEN id % 2 = 0 THEN source_name ELSE '' END AS v, CASE WHEN id % 4 < 3 THEN lang ELSE '' END AS p, list_sort(list_distinct({CVES.format('title')})) AS c, title, source_name, lang FROM v_articles),
  r AS (SELECT g.*, m.mode, id % 11 = 0 AND mode = 'regen' AS failed, id % m.a <> 0 AS p_rel, CASE WHEN id % m.b = 0 THEN source_name ELSE '' END AS p_v, CASE WHEN id % 4 < m.a - 2 THEN lang ELSE '' END AS p_p, CASE WHEN id % m.b = 1 THEN [] ELSE c END AS p_c FROM g, (VALUES ('baseline', 4, 6), ('regen', 5, 4)) AS m(mode, a, b)),
  s AS (SELECT mode, rel, NOT failed AND p_rel AS p_rel, v = CASE WHEN failed THEN '' ELSE p_v END AS v_ok, p = CASE WHEN failed THEN '' ELSE p_p END AS p_ok, c = CASE WHEN failed THEN [] ELSE p_c END AS c_ok FROM r),
  t AS (SELECT mode, count(*) AS gold_count, count(*) FILTER (rel) AS related_count, count(*) FILTER (rel AND p_rel) AS tp, count(*) FILTER (NOT rel AND p_rel) AS fp, count(*) FILTER (rel AND NOT p_rel) AS fn,
    count(*) FILTER (rel AND v_ok) / count(*) FILTER (rel) AS vendor_exact_rate, count(*) FILTER (rel AND p_ok) / count(*) FILTER (rel) AS product_exact_rate, count(*) FILTER (c_ok) / count(*) AS cve_exact_rate FROM s GROUP BY 1),
  m AS (SELECT *, 2.0 * tp / (2 * tp + fp + fn) AS relatedness_f1 FROM t),
  w AS (SELECT *, concat_ws(',', CASE WHEN relatedness_f1 < 0.8 THEN 'relatedness_f1' END, CASE WHEN vendor_exact_rate < 0.7 THEN 'vendor_exact_rate' END, CASE WHEN product_exact_rate < 0.7 THEN 'product_exact_rate' END, CASE WHEN cve_exact_rate < 0.75 THEN 'cve_exact_rate' END) AS warnings FROM m)"""


def _digest_gold(t):
    one = lambda c, v: F.when(c, F.array(v)).otherwise(F.array().cast("array<string>"))
    return t.articles.select(_C("id").alias("article_id"), (_C("id") % 3 != 0).alias("related"), one(_C("id") % 2 == 0, _C("source_name")).alias("vendors"), one(_C("id") % 4 < 3, _C("lang")).alias("products"), text.cves(_C("title")).alias("cves"))


def _digest_predictions(t, a: int, b: int, failing: bool):
    none, i = F.array().cast("array<string>"), _C("id")
    one = lambda c, v: F.when(c, F.array(F.concat(F.lit(" "), F.upper(v)))).otherwise(none)
    return t.articles.select(i.alias("article_id"), (i % a != 0).alias("related"), one(i % b == 0, _C("source_name")).alias("vendors"), one(i % 4 < a - 2, _C("lang")).alias("products"), F.when(i % b == 1, none).otherwise(text.cves(_C("title"))).alias("cves"), F.when((i % 11 == 0) & F.lit(failing), F.lit("no reply")).alias("error"))


def _digest_store(t):
    """A baseline, another that doesn't finish, and a regenerated run that is kept twice."""
    from ..operators import digests
    from ..sources import landing

    store, at = landing.scratch(t.spark, "digests"), lambda d: F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp")
    digests.save(_digest_predictions(t, 4, 6, False), store, "base-1", "baseline", at(1), at(2))
    digests.save(_digest_predictions(t, 5, 4, True), store, "base-2", "baseline", at(3), F.lit(None))
    digests.save(_digest_predictions(t, 4, 6, True), store, "regen-1", "regen", at(4), F.lit(None))
    digests.save(_digest_predictions(t, 5, 4, True), store, "regen-1", "regen", at(4), at(5))
    return store


@query("e_08_digest_gate", f"WITH {_DIGESTS} SELECT gold_count, related_count, round(tp / (tp + fp), 9) AS relatedness_precision, round(tp / (tp + fn), 9) AS relatedness_recall, round(relatedness_f1, 9) AS relatedness_f1, round(vendor_exact_rate, 9) AS vendor_exact_rate, round(product_exact_rate, 9) AS product_exact_rate, round(cve_exact_rate, 9) AS cve_exact_rate, true AS active, warnings FROM w WHERE mode = 'regen'")
def _(t):
    from ..operators import digests

    m = digests.gate(digests.metrics(digests.scored(_digest_gold(t), _digest_predictions(t, 5, 4, True))))
    return m.select("gold_count", "related_count", *(F.round(c, 9).alias(c) for c in ("relatedness_precision", "relatedness_recall", "relatedness_f1", "vendor_exact_rate", "product_exact_rate", "cve_exact_rate")), "active", F.array_join("warnings", ",").alias("warnings"))


@query("e_17_run_store", f"""WITH {_DIGESTS} SELECT a.gold_count, a.warnings, round(a.relatedness_f1 - b.relatedness_f1, 9) AS d_related, round(a.vendor_exact_rate - b.vendor_exact_rate, 9) AS d_vendor, round(a.product_exact_rate - b.product_exact_rate, 9) AS d_product,
  round(a.cve_exact_rate - b.cve_exact_rate, 9) AS d_cve FROM w a, w b WHERE a.mode = 'regen' AND b.mode = 'baseline'""")
def _(t):
    """A regenerated run against the last finished baseline, both loaded from the store."""
    from ..operators import digests

    r = digests.evaluated(t.spark, _digest_store(t), _digest_gold(t), "regen-1")
    return r.select("gold_count", F.array_join("warnings", ",").alias("warnings"), F.round("delta_relatedness_f1", 9).alias("d_related"), F.round("delta_vendor_exact_rate", 9).alias("d_vendor"), F.round("delta_product_exact_rate", 9).alias("d_product"), F.round("delta_cve_exact_rate", 9).alias("d_cve"))


@query("w_12_last_run_by_mode", "SELECT 'baseline' AS mode, 'base-1' AS run, count(*) AS saved, CAST(0 AS BIGINT) AS failed FROM v_articles UNION ALL SELECT 'regen', 'regen-1', count(*) FILTER (id % 11 <> 0), count(*) FILTER (id % 11 = 0) FROM v_articles")
def _(t):
    """Of each mode the last run that finished; a later one that goes on doesn't count."""
    from ..operators import digests

    found = digests.runs(t.spark, _digest_store(t))
    return digests.latest(found).join(found.select("run", "saved", "failed"), "run").select("mode", "run", "saved", "failed")


_ITEMS_SQL = """i AS (SELECT id, id % 3 = 0 AS dup, id % 6 = 0 OR id % 7 = 0 AS p_dup, id % 4 < 2 AS rel, id % 5 < 3 AS p_rel, id % 2 = 0 AS llm, status <> 'EXTRACTION_FAILED' AS ok, source_name AS grp, CASE WHEN id % 9 = 0 THEN 'none' WHEN id % 8 = 0 THEN 'other' ELSE source_name END AS p_grp,
  epoch(fetched_at) - epoch(published_at) AS wait FROM v_articles)"""


@query("e_01_seven_metrics", f"""WITH {_ITEMS_SQL} SELECT count(*) FILTER (dup AND p_dup) / count(*) FILTER (dup) AS duplicate_reduction_rate, count(*) FILTER (p_grp <> 'none' AND p_grp = grp) / count(*) FILTER (p_grp <> 'none') AS event_grouping_precision,
  count(*) FILTER (rel AND p_rel) / count(*) FILTER (p_rel) AS classification_precision, count(*) FILTER (NOT rel AND p_rel) / count(*) FILTER (NOT rel) AS false_positive_rate, 1 - count(*) FILTER (llm) / count(*) AS llm_call_reduction_rate,
  count(*) FILTER (ok) / count(*) AS extraction_success_rate, median(wait) AS median_source_to_notification_latency_seconds FROM i""")
def _(t):
    """All seven measures of a labelled set."""
    i = _C("id")
    items = t.articles.select(
        (i % 3 == 0).alias("is_duplicate"), ((i % 6 == 0) | (i % 7 == 0)).alias("predicted_duplicate"), (i % 4 < 2).alias("is_relevant"), (i % 5 < 3).alias("predicted_relevant"), (i % 2 == 0).alias("llm_called"), (_C("status") != "EXTRACTION_FAILED").alias("extraction_success"),
        _C("source_name").alias("expected_event_group"), F.when(i % 9 == 0, "none").when(i % 8 == 0, "other").otherwise(_C("source_name")).alias("predicted_event_group"), (F.unix_seconds(_C("fetched_at").cast("timestamp")) - F.unix_seconds(_C("published_at").cast("timestamp"))).alias("source_to_notification_latency_seconds"),
    )
    return evaluation.labelled_metrics(items)


_NEXT = """n AS (SELECT vec_id, label, embedding, lead(label) OVER w AS label_b, lead(embedding) OVER w AS b FROM embeddings WINDOW w AS (PARTITION BY vec_id % 16 ORDER BY vec_id)),
  d AS (SELECT vec_id, CASE WHEN vec_id % 17 = 0 THEN 'uncertain' WHEN label = label_b THEN 'same_event' ELSE 'different_event' END AS label, CASE WHEN vec_id % 13 <> 0 THEN list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST(b AS DOUBLE[])) END AS distance FROM n WHERE b IS NOT NULL)"""


def _pairs(t):
    """Each vector with the next of its sixteenth of the ids; some labels uncertain, some distances missing."""
    from pyspark.sql import Window

    from ..functions import numbers

    w = Window.partitionBy(_C("vec_id") % 16).orderBy("vec_id")
    n = t.embeddings.select("vec_id", "label", "embedding", F.lead("label").over(w).alias("label_b"), F.lead("embedding").over(w).alias("b")).where("b is not null")
    label = F.when(_C("vec_id") % 17 == 0, "uncertain").when(_C("label") == _C("label_b"), "same_event").otherwise("different_event")
    return n.select(label.alias("label"), F.when(_C("vec_id") % 13 != 0, numbers.cosine_distance(_C("embedding"), _C("b"))).alias("distance"))


@query("e_11_pair_report", f"""WITH {_NEXT}, c AS (SELECT count(*) AS labelled, count(distance) AS scorable, count(*) - count(distance) AS unscorable, count(*) FILTER (label = 'same_event' AND distance IS NOT NULL) AS fit_same, count(*) FILTER (label = 'different_event' AND distance IS NOT NULL) AS fit_different,
    count(*) FILTER (label = 'uncertain' AND distance IS NOT NULL) AS uncertain_labels, count(*) FILTER (label = 'different_event' AND distance <= 0.9) AS false_attaches, count(*) FILTER (label = 'same_event' AND distance > 0.9) AS missed,
    count(*) FILTER (label <> 'uncertain' AND distance > 0.9 AND distance <= 1.0) AS in_band, max(distance) FILTER (label = 'same_event') AS a, min(distance) FILTER (label = 'different_event') AS u FROM d)
  SELECT * EXCLUDE (a, u), floor(CASE WHEN a >= u THEN greatest((a + u) / 2 - 0.01, 0) ELSE a END * 1000 + 0.5) / 1000 AS suggested_attach, floor(CASE WHEN a >= u THEN (a + u) / 2 + 0.01 ELSE u END * 1000 + 0.5) / 1000 AS suggested_uncertain FROM c""")
def _(t):
    return evaluation.pair_report(_pairs(t), 0.9, 1.0)


@query("e_11_histogram", f"WITH {_NEXT} SELECT label, CAST(floor(distance / 0.02) AS BIGINT) AS bin, count(*) AS pairs FROM d WHERE distance IS NOT NULL GROUP BY 1, 2")
def _(t):
    return evaluation.pair_histogram(_pairs(t))
