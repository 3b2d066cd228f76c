"""Human review of articles: attention, counters, triage signals and case consolidation (K-19 to K-21, K-23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of recall, quality and confidence under which a human looks.
RECALL, QUALITY, CONFIDENCE = 0.6, 0.3, 0.65


def cases(articles: DataFrame, links: DataFrame, events: DataFrame, alerts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per article what its review case shows.

    `articles`: id, extraction_status, rss_recall, content_quality, llm_classification; `links`: article_id, event_id,
    relationship, is_material_update; `events`: id, confidence; `alerts`: event_id, alert_tier, suppressed, repeated
    for each linked event; `verdicts`: article_id, verdict, of which any but not_reviewed counts.
    """
    tier = lambda name: ~F.col("suppressed") & (F.col("alert_tier") == name)
    by_event = alerts.groupBy("event_id").agg(F.count_if(tier("early_warning")).alias("early"), F.count_if(tier("confirmed")).alias("confirmed"), F.count_if("suppressed").alias("held"))
    known = links.join(events.select(F.col("id").alias("event_id"), "confidence"), "event_id", "left").join(by_event, "event_id", "left")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    own = known.groupBy(F.col("article_id").alias("id")).agg(
        some(F.col("relationship") == "uncertain_need_human_review").alias("uncertain"), some(F.col("confidence") < CONFIDENCE).alias("weak"), some("is_material_update").alias("material"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("early", "confirmed", "held")),
    )
    seen = verdicts.where("verdict <> 'not_reviewed'").select(F.col("article_id").alias("id")).distinct().withColumn("reviewed", F.lit(True))
    low = F.coalesce(F.col("rss_recall") < RECALL, F.lit(False)) | F.coalesce(F.col("content_quality") < QUALITY, F.lit(False))
    out = articles.join(own, "id", "left").join(seen, "id", "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("uncertain", "weak", "material", "reviewed")}
    return out.withColumns({**flags, **{c: F.coalesce(c, F.lit(0)) for c in ("early", "confirmed", "held")}, "failed": F.coalesce(F.col("extraction_status") == "failed", F.lit(False)), "low_quality": low})


def needs_attention() -> Column:
    """Of a row of `cases`: not reviewed, and something to look at."""
    return ~F.col("reviewed") & (F.col("failed") | F.col("low_quality") | F.col("uncertain") | F.col("weak") | (F.col("early") > 0))


def summary(rows: DataFrame) -> DataFrame:
    """One row of counters over `cases`."""
    n = lambda c: F.count_if(c)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(
        F.count("*").alias("total_articles"), n(needs_attention()).alias("needs_attention"), total("early").alias("early_warnings"), total("confirmed").alias("confirmed_alerts"), total("held").alias("suppressed_alerts"),
        n(F.col("llm_classification").isNotNull()).alias("llm_outputs"), n(F.col("failed")).alias("extraction_failures"), n(F.col("low_quality")).alias("low_extraction_quality"), n(F.col("material")).alias("material_updates"),
    )


def triage(signals: DataFrame, entities: DataFrame) -> DataFrame:
    """Per article the filter's signals (struct s) and its entities together: three flags, and names, identifiers and critical phrases without repeats, the filter's first."""
    of = lambda *kinds: F.sort_array(F.collect_set(F.when(F.col("entity_type").isin(*kinds), F.col("entity_value"))))
    found = entities.groupBy(F.col("article_id").alias("id")).agg(of("vendor").alias("v"), of("product").alias("p"), of("cve").alias("c"))
    none = F.array().cast("array<string>")
    own = lambda name: F.coalesce(name, none)
    out = signals.join(found, "id", "left").withColumns({
        "names": F.array_distinct(F.concat("s.vendors", "s.products", own("v"), own("p"))),
        "cve_ids": F.array_distinct(F.concat("s.cves", own("c"))),
        "critical": F.array_distinct(F.concat("s.exploitation", "s.incident")),
    })
    return out.select("id", (F.size("names") > 0).alias("has_vendor_or_product"), (F.size("cve_ids") > 0).alias("has_cve"), (F.size("critical") > 0).alias("has_critical_keyword"), "names", "cve_ids", "critical")


def consolidated(tasks: DataFrame, limit: int = 200) -> DataFrame:
    """(cve_id, article_id, task_id, first_article) of the first `limit` completed tasks (id, target_id, completed_at, results of cve_id).

    An identifier counts once for an article, for its first task; the case's first article is that of the first task which names it.
    """
    order = F.struct("completed_at", "task_id", "pos")
    some = tasks.orderBy("completed_at", "id").limit(limit).select(F.col("id").alias("task_id"), F.col("target_id").alias("article_id"), "completed_at", F.posexplode("results").alias("pos", "cve_id"))
    once = some.groupBy("cve_id", "article_id").agg(F.min(order).alias("o"))
    first = once.groupBy("cve_id").agg(F.min_by("article_id", "o").alias("first_article"))
    return once.join(first, "cve_id").select("cve_id", "article_id", F.col("o.task_id").alias("task_id"), "first_article")
