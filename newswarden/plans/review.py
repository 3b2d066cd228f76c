"""Review cases, triage, consolidation, catalogue details, and readers over files that the queries write (K-19 to K-26, S, A, Q, V-01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import entities, evaluation, filtering, latest, merges, monitoring, review
from ..sources import landing, readers
from .domain import _ENT, _LATEST, _SIGNALS
from .registry import query
from .text import CVES

_C = F.col
_CASE = """ar AS (SELECT id, CASE WHEN status = 'EXTRACTION_FAILED' THEN 'failed' ELSE 'success' END AS extraction_status, rss_recall, (id * 7 % 100) / 100.0 AS content_quality, CASE WHEN id % 4 = 0 THEN 'x' END AS llm FROM v_articles),
  al AS (SELECT event_id, count(*) FILTER (NOT suppressed AND alert_tier = 'early_warning') AS early, count(*) FILTER (NOT suppressed AND alert_tier = 'confirmed') AS confirmed, count(*) FILTER (suppressed) AS held FROM v_alerts GROUP BY 1),
  li AS (SELECT ea.article_id AS id, bool_or(ea.article_id % 23 = 0) AS uncertain, bool_or(e.confidence < 0.65) AS weak, bool_or(is_material_update) AS material, coalesce(sum(early), 0) AS early, coalesce(sum(confirmed), 0) AS confirmed, coalesce(sum(held), 0) AS held
    FROM v_event_articles ea LEFT JOIN v_cyber_events e ON e.id = ea.event_id LEFT JOIN al ON al.event_id = ea.event_id GROUP BY 1),
  ca AS (SELECT ar.id, ar.llm, extraction_status = 'failed' AS failed, coalesce(rss_recall < 0.6, false) OR content_quality < 0.3 AS low, coalesce(uncertain, false) AS uncertain, coalesce(weak, false) AS weak, coalesce(material, false) AS material,
    coalesce(early, 0) AS early, coalesce(confirmed, 0) AS confirmed, coalesce(held, 0) AS held, ar.id IN (SELECT article_id FROM v_verdicts WHERE verdict <> 'uncertain') AS reviewed FROM ar LEFT JOIN li ON li.id = ar.id),
  att AS (SELECT *, NOT reviewed AND (failed OR low OR uncertain OR weak OR early > 0) AS attention FROM ca)"""


def _cases(t):
    a = t.articles.select("id", F.when(_C("status") == "EXTRACTION_FAILED", "failed").otherwise("success").alias("extraction_status"), "rss_recall", (_C("id") * 7 % 100 / 100.0).alias("content_quality"), F.when(_C("id") % 4 == 0, "x").alias("llm_classification"))
    links = t.event_articles.withColumn("relationship", F.when(_C("article_id") % 23 == 0, "uncertain_need_human_review").otherwise("same_event_new_source"))
    verdicts = t.verdicts.select("article_id", F.when(_C("verdict") == "uncertain", "not_reviewed").otherwise(_C("verdict")).alias("verdict"))
    return review.cases(a, links, t.cyber_events, t.alerts, verdicts)


@query("k_19_attention", f"WITH {_CASE} SELECT id, attention FROM att")
def _(t):
    return _cases(t).select("id", review.needs_attention().alias("attention"))


@query("k_20_review_counters", f"""WITH {_CASE} SELECT count(*) AS total_articles, count(*) FILTER (attention) AS needs_attention, CAST(sum(early) AS BIGINT) AS early_warnings, CAST(sum(confirmed) AS BIGINT) AS confirmed_alerts, CAST(sum(held) AS BIGINT) AS suppressed_alerts,
  count(llm) AS llm_outputs, count(*) FILTER (failed) AS extraction_failures, count(*) FILTER (low) AS low_extraction_quality, count(*) FILTER (material) AS material_updates FROM att""")
def _(t):
    return review.summary(_cases(t))


@query("k_21_triage_signals", f"""WITH {_SIGNALS}, {_ENT}, en AS (SELECT article_id, bool_or(entity_type IN ('vendor', 'product')) AS v, bool_or(entity_type = 'cve') AS c FROM ent GROUP BY 1)
  SELECT sig.id, n_vendor + n_product > 0 OR coalesce(v, false) AS has_vendor_or_product, cves > 0 OR coalesce(c, false) AS has_cve, exploitation + incident > 0 AS has_critical_keyword FROM sig LEFT JOIN en ON en.article_id = sig.id""")
def _(t):
    return review.triage(filtering.signals(t.articles), entities.extract(t.articles)).select("id", "has_vendor_or_product", "has_cve", "has_critical_keyword")


@query("k_23_consolidation", f"""WITH t AS (SELECT id AS task_id, id AS article_id, fetched_at, {CVES.format("concat(title, ' ', rss_summary)")} AS results FROM v_articles WHERE status <> 'EXTRACTION_FAILED' ORDER BY fetched_at, id LIMIT 200),
  x AS (SELECT task_id, article_id, fetched_at, unnest(results) AS cve_id FROM t), o AS (SELECT cve_id, article_id, arg_min(task_id, (fetched_at, task_id)) AS task_id, min(fetched_at) AS seen FROM x GROUP BY 1, 2)
  SELECT cve_id, article_id, task_id, first_value(article_id) OVER (PARTITION BY cve_id ORDER BY seen, task_id) AS first_article FROM o""")
def _(t):
    done = t.articles.where("status <> 'EXTRACTION_FAILED'").select("id", _C("id").alias("target_id"), _C("fetched_at").alias("completed_at"), text.cves(F.concat("title", F.lit(" "), "rss_summary")).alias("results"))
    return review.consolidated(done)


@query("k_25_public_articles", "SELECT c.cve_id, a.id AS article_id, a.title, a.source_name FROM v_cases c JOIN v_case_articles ca ON ca.case_id = c.id AND ca.state <> 'human_rejected' JOIN v_articles a ON a.id = ca.article_id WHERE c.status = 'approved'")
def _(t):
    """Articles of the public details: of approved cases, without rejected links."""
    shown = t.cases.where("status = 'approved'").select(_C("id").alias("case_id"), "cve_id").join(t.case_articles.where("state <> 'human_rejected'"), "case_id")
    return shown.join(t.articles.select(_C("id").alias("article_id"), "title", "source_name"), "article_id").select("cve_id", "article_id", "title", "source_name")


_ANY = "w AS (SELECT case_id" + "".join(f", max(CASE WHEN source = '{s}' THEN status END) AS {s}_status, max(CASE WHEN source = '{s}' THEN value END) AS {s}_value" for s in ("nvd", "kev", "epss")) + f" FROM ({_LATEST.format('')}) GROUP BY 1)"


@query("k_26_article_scores", f"""WITH {_ANY} SELECT ca.article_id, c.cve_id, ca.state, round(CASE WHEN nvd_status = 'ok' THEN least(nvd_value / 10, 10.0) END, 6) AS cvss, coalesce(kev_status = 'ok' AND kev_value > 20, false) AS kev, round(CASE WHEN epss_status = 'ok' THEN least(epss_value / 100, 1.0) END, 6) AS epss
  FROM v_case_articles ca JOIN v_cases c ON c.id = ca.case_id LEFT JOIN w ON w.case_id = c.id""")
def _(t):
    """Scores of an article's cases from the latest fetch of any status: one that failed later blanks them."""
    s = latest.scores(latest.skim(t.cases, t.observations, None)).select(_C("id").alias("case_id"), "cve_id", F.round("cvss", 6).alias("cvss"), "kev", F.round("epss", 6).alias("epss"))
    return t.case_articles.join(s, "case_id").select("article_id", "cve_id", "state", "cvss", "kev", "epss")


@query("q_03_stage_counters", "SELECT count(*) AS rows, count(*) FILTER (status = 'EXTRACTION_FAILED') AS failed, count(*) FILTER (status = 'DIGESTED') AS digested FROM v_articles")
def _(t):
    """Counters that fill while a stage is written, without a pass of their own."""
    counted, seen = monitoring.counted(t.articles.select("id", "status"), "stage", failed=_C("status") == "EXTRACTION_FAILED", digested=_C("status") == "DIGESTED")
    counted.write.format("noop").mode("overwrite").save()
    return t.spark.createDataFrame([tuple(seen.get[k] for k in ("rows", "failed", "digested"))], "rows long, failed long, digested long")


_SETS = rf"""g AS (SELECT id, list_distinct({CVES.format('title')}) AS g, list_distinct({CVES.format("concat(title, ' ', clean_text)")}) AS p FROM v_articles),
  n AS (SELECT len(g) AS g, len(p) AS p, len(list_intersect(g, p)) AS b FROM g)"""


@query("a_20_micro_sets", f"WITH {_SETS} SELECT count(*) AS n, round(sum(b) / sum(p), 9) AS precision, round(sum(b) / sum(g), 9) AS recall FROM n")
def _(t):
    rows = t.articles.select(text.cves(_C("title")).alias("g"), text.cves(F.concat("title", F.lit(" "), "clean_text")).alias("p"))
    return evaluation.set_metrics(rows, "g", "p").select("n", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("a_21_macro_sets", f"WITH {_SETS} SELECT round(avg(CASE WHEN g + p = 0 THEN 1.0 ELSE 2.0 * b / (g + p) END), 6) AS macro_f1, round(count(*) FILTER (b = g AND b = p) / count(*), 9) AS exact_rate FROM n")
def _(t):
    rows = t.articles.select(text.cves(_C("title")).alias("g"), text.cves(F.concat("title", F.lit(" "), "clean_text")).alias("p"))
    return evaluation.set_metrics(rows, "g", "p").select(F.round("macro_f1", 6).alias("macro_f1"), F.round("exact_rate", 9).alias("exact_rate"))


@query("s_05_feed", "SELECT id, source_name, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, CAST(floor(epoch(published_at)) AS BIGINT) AS published_at, CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS n_categories FROM v_articles")
def _(t):
    """Landed feed items, written as JSON and read again."""
    both = F.array(F.lit(" security "), F.lit(""), F.lit("security"), F.when(_C("id") % 2 == 1, F.lit("patch")))
    items = t.articles.select("source_name", _C("id").cast("string").alias("url"), F.concat(F.lit("  "), F.col("title"), F.lit("\n")).alias("title"), "rss_summary", F.array_compact(both).alias("rss_categories"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"))
    feed = readers.feed(t.spark, landing.report(items, landing.scratch(t.spark, "feed")))
    return feed.select(_C("url").cast("long").alias("id"), "source_name", "title", F.unix_seconds("published_at").alias("published_at"), F.size("rss_categories").alias("n_categories"))


@query("s_06_dataset", "SELECT source_name AS source, count(*) AS n, count(*) FILTER (id % 4 = 0) AS critical FROM v_articles GROUP BY 1")
def _(t):
    lines = t.articles.select(_C("source_name").alias("sourceName"), F.concat(F.lit("https://example.org/"), "id").alias("url"), "title", F.when(_C("id") % 4 == 0, "CRITICAL_RELEVANT").otherwise("IRRELEVANT").alias("humanLabel"))
    found = readers.dataset(t.spark, landing.report(lines, landing.scratch(t.spark, "dataset")))
    return found.groupBy(_C("sourceName").alias("source")).agg(F.count("url").alias("n"), F.count_if(_C("humanLabel") == "CRITICAL_RELEVANT").alias("critical"))


@query("s_10_catalogue", """SELECT cve_id, concat('about ', cve_id) AS description, CASE id % 3 WHEN 0 THEN 9.5 WHEN 1 THEN 5.0 END AS cvss, CASE WHEN id % 5 = 0 THEN NULL ELSE (id % 100) / 100.0 END AS epss, CASE WHEN id % 5 = 0 THEN 'no_score' ELSE 'ok' END AS status, id % 2 = 0 AS listed FROM v_cases""")
def _(t):
    """Three catalogues as their services write them, read and joined: CVSS 3.1 before 2.0, base and vector both there, English text first."""
    c, spark = t.cases, t.spark
    metric = lambda base, vector: F.array(F.struct(F.struct(F.lit(base).alias("baseScore"), F.lit(vector).alias("vectorString")).alias("cvssData")))
    third = F.when(_C("id") % 3 == 0, metric(9.5, "CVSS:3.1/AV:N")).when(_C("id") % 3 == 1, metric(9.9, None))
    words = F.array(F.struct(F.lit("fr").alias("lang"), F.lit("non").alias("value")), F.struct(F.lit("en").alias("lang"), F.concat(F.lit("about "), "cve_id").alias("value")))
    entry = F.struct(F.struct(F.lower("cve_id").alias("id"), words.alias("descriptions"), F.struct(third.alias("cvssMetricV31"), F.when(_C("id") % 3 == 1, metric(5.0, "AV:N")).alias("cvssMetricV2")).alias("metrics")).alias("cve"))
    nvd = readers.vulnerabilities(spark, landing.report(c.select(F.array(entry).alias("vulnerabilities")), landing.scratch(spark, "nvd")), lines=True)
    kev = readers.exploited(spark, landing.report(c.where("id % 2 = 0").select(F.array(F.struct(_C("cve_id").alias("cveID"), F.lit("2024-01-05").alias("dateAdded"))).alias("vulnerabilities")), landing.scratch(spark, "kev")), lines=True)
    score = F.when(_C("id") % 5 == 0, "n/a").otherwise((_C("id") % 100 / 100.0).cast("string"))
    epss = readers.probabilities(spark, landing.report(c.select(F.array(F.struct(_C("cve_id").alias("cve"), score.alias("epss"), F.lit("0.5").alias("percentile"))).alias("data")), landing.scratch(spark, "epss")), lines=True)
    out = nvd.join(epss, "cve_id", "left").join(kev.withColumn("listed", F.lit(True)), "cve_id", "left")
    return out.select("cve_id", "description", "cvss", "epss", "status", F.coalesce("listed", F.lit(False)).alias("listed"))


@query("s_19_report", "SELECT source_name, count(*) AS articles FROM v_articles GROUP BY 1")
def _(t):
    path = landing.report(t.articles.groupBy("source_name").agg(F.count("*").alias("articles")), landing.scratch(t.spark, "report"), "Articles by source")
    return t.spark.read.schema("source_name string, articles long").json(path)


@query("v_01_vector_text", "SELECT vec_id, len(embedding) AS dims, true AS same FROM embeddings")
def _(t):
    back = numbers.vector(numbers.vector_text(_C("embedding")))
    return t.embeddings.select("vec_id", F.size(back).cast("long").alias("dims"), (back == _C("embedding").cast("array<float>")).alias("same"))


@query("m_08_attach_detach", """WITH l AS (SELECT event_id, article_id FROM v_event_articles WHERE article_id % 9 <> 0 UNION SELECT 3, article_id FROM v_event_articles WHERE article_id % 10 = 1)
  SELECT e.id, count(l.article_id) AS source_count FROM v_cyber_events e LEFT JOIN l ON l.event_id = e.id GROUP BY 1""")
def _(t):
    links = t.event_articles.select("event_id", "article_id")
    gone, new = links.where("article_id % 9 = 0"), links.where("article_id % 10 = 1").select(F.lit(3).cast("long").alias("event_id"), "article_id")
    return merges.recounted(t.cyber_events.select("id"), merges.attached(merges.detached(links, gone), new)).select("id", "source_count")
