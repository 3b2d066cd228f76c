"""Watchdogs: extraction drift, alert latency and stage counters (Q-01 to Q-03, A-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..context import DEFAULT, Context
from ..functions import dates
from .latest import first_n


def drift(samples: DataFrame, *, window: int = 20, least: int = 5, recall: float = 0.6, quality: float = 0.3, failures: float = 0.5) -> DataFrame:
    """Per source: its last `window` samples, medians, failure rate and reasons. Needs source_name, extracted_at, id, rss_recall, content_quality, extraction_status."""
    recent = first_n(samples.where(F.col("extracted_at").isNotNull() & F.col("source_name").isNotNull()), ["source_name"], [F.col("extracted_at").desc(), F.col("id").desc()], window)
    s = recent.groupBy("source_name").agg(F.count("*").alias("sampled"), F.count("rss_recall").alias("recall_samples"), F.median("rss_recall").alias("median_recall"), F.median("content_quality").alias("median_quality"), (F.count_if(F.col("extraction_status").rlike("(?i)failed")) / F.count("*")).alias("failure_rate"))
    show = lambda name, c, word, limit: F.format_string(f"{name}_%.2f_{word}_{limit:g}", c)
    reasons = F.array_compact(F.array(
        F.when(F.col("median_recall") < recall, show("median_recall", F.col("median_recall"), "below", recall)),
        F.when(F.col("median_quality") < quality, show("median_quality", F.col("median_quality"), "below", quality)),
        F.when(F.col("failure_rate") > failures, show("failure_rate", F.col("failure_rate"), "above", failures)),
    ))
    return s.withColumn("reasons", F.when(F.col("sampled") >= least, reasons).otherwise(F.array().cast("array<string>"))).withColumn("drifted", F.size("reasons") > 0)


def latency(alerts: DataFrame, links: DataFrame, articles: DataFrame, context: Context = DEFAULT, *, slo_hours: float = 2, days: int = 7, least: int = 3) -> DataFrame:
    """One row: latencies from first publication to alert, in hours, and whether they break the objective."""
    age = dates.hours(dates.moment(context.as_of), F.col("created_at"))
    a = alerts.where(~F.col("suppressed") & (age < 24 * days)).select("id", "event_id", F.col("created_at").alias("alerted_at"))
    first = links.select("event_id", F.col("article_id")).join(articles.where(F.col("published_at").isNotNull()).select(F.col("id").alias("article_id"), "published_at"), "article_id").groupBy("event_id").agg(F.min("published_at").alias("first_at"))
    late = a.join(first, "event_id").select(dates.hours(F.col("alerted_at"), F.col("first_at")).alias("h")).where("h >= 0")
    out = late.agg(F.count("*").alias("sampled"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY h)").alias("p50_hours"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY h)").alias("p90_hours"), F.max("h").alias("max_hours"), F.count_if(F.col("h") > slo_hours).alias("breaches"))
    return out.withColumn("slo_violated", F.coalesce((F.col("sampled") >= least) & (F.col("p90_hours") > slo_hours), F.lit(False)))


def counted(df: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    """`df` with counters that fill as it is written, without a pass of their own: rows, and rows of each condition."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows"), *(F.count_if(c).alias(k) for k, c in conditions.items())), seen
