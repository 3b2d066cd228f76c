"""Entities with confidence, the roles' cross-check, and event drafts (K-07 to K-09, T-19, T-20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import DEFAULT, Context
from ..functions import numbers, text
from .filtering import inventory_hits, with_inventory

# What each zone is worth.
ZONES = (("title", 1.0), ("summary", 0.9), ("lead", 0.8), ("body", 0.6), ("tail", 0.3))


def extract(articles: DataFrame, context: Context = DEFAULT, inventory: DataFrame | None = None) -> DataFrame:
    """(article_id, entity_type, entity_value, role, confidence) of title, rss_summary and clean_text; `inventory` as in `filtering.signals`.

    Every step is a column of its own, and the entities are taken out by an outer
    explode with a filter after it: from an inner one the optimizer would infer
    that there are entities, push that to the scan and compute everything again there.
    """
    zone = [n for n, _ in ZONES]
    z = articles.select(F.col("id").alias("article_id"), "title", "rss_summary", text.trimmed(F.coalesce("clean_text", F.lit(""))).alias("__body"))
    parts = text.zones_of(F.col("title"), F.col("rss_summary"), F.col("__body"))
    z = z.select("article_id", *(parts[n].alias(f"z_{n}") for n in zone))
    z = z.withColumn("whole", F.concat_ws("\n", *(f"z_{n}" for n in zone))).withColumn("low", F.lower("whole"))
    if inventory is not None:
        z = with_inventory(z.withColumn("id", F.col("article_id")), "whole", inventory, "").drop("id", "noisy")
    else:
        vendors, products = inventory_hits(F.col("whole"), context.inventory, F.col("low"))
        z = z.withColumns({"vendors": vendors, "products": products})
    z = z.withColumns({"cve": text.cves(F.col("whole")), "attack": F.filter(F.array(*map(F.lit, context.lexicon.flat)), lambda w: F.contains(F.col("low"), w))})
    z = z.withColumns({"ip": text.matches(F.col("whole"), text.IP), "domain": text.matches(F.col("whole"), text.DOMAIN, "lower"), "digest": text.matches(F.col("whole"), text.DIGEST, "lower")})
    kinds = {"vendor": "vendors", "product": "products", "cve": "cve", "ioc_ip": "ip", "ioc_domain": "domain", "ioc_hash": "digest", "attack_type": "attack"}

    def typed(kind: str, values: str) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("entity_type"), v.alias("entity_value")))

    pairs = F.concat(*(typed(kind, values) for kind, values in kinds.items()))
    z = z.withColumns({"corroborated": (F.size("cve") > 0) | (F.size("attack") > 0), "pairs": pairs})
    rows = z.select("article_id", *(f"z_{n}" for n in zone), "corroborated", F.explode_outer("pairs").alias("e")).where(F.col("e").isNotNull())
    rows = rows.select("*", "e.entity_type", "e.entity_value", F.lower("e.entity_value").alias("__low"))
    for n in zone:
        rows = rows.withColumn(f"t_{n}", F.when(F.contains(F.lower(f"z_{n}"), F.col("__low")), text.count_phrase(F.col(f"z_{n}"), F.col("entity_value"))).otherwise(0))
    rows = rows.withColumn("t", F.struct(*(F.col(f"t_{n}").alias(n) for n in zone)))
    # An article's entities are distinct already; only a repeated article row brings the same ones again.
    return rows.select("article_id", "entity_type", "entity_value", F.when(F.col("entity_type").isin("vendor", "product"), "unknown").alias("role"), confidence().alias("confidence")).distinct()


def confidence() -> Column:
    """From entity_type, corroborated and the occurrences by zone in `t`."""
    hit = {n: F.col(f"t.{n}") > 0 for n, _ in ZONES}
    best = F.greatest(*(F.when(hit[n], w).otherwise(0.0) for n, w in ZONES))
    total = sum((F.col(f"t.{n}") for n, _ in ZONES), F.lit(0))
    only_tail = hit["tail"] & ~(hit["title"] | hit["summary"] | hit["lead"] | hit["body"])
    loose = best + F.when(total >= 2, 0.1).otherwise(0.0)
    loose = F.when(F.col("entity_type").isin("vendor", "product") & ~F.col("corroborated"), F.least(loose, F.lit(0.45))).otherwise(loose)
    exact = F.when(only_tail, 0.6).otherwise(0.95)
    structural = (F.col("entity_type") == "cve") | F.startswith("entity_type", F.lit("ioc_"))
    return numbers.rounded(F.when(structural, exact).otherwise(F.least(F.greatest(loose, F.lit(0.0)), F.lit(1.0))))


def cross_checked(confidence: Column, role: Column) -> Column:
    """A judged role moves a confidence; no role (null) leaves it."""
    moved = F.when(role.isin("unrelated", "unknown"), confidence * 0.4).when(role.isNotNull(), F.least(F.lit(1.0), confidence + 0.2)).otherwise(confidence)
    return numbers.rounded(moved)


def grouping_key(vendors: Column, products: Column, cves: Column, attacks: Column) -> Column:
    part = lambda a: F.array_join(F.array_sort(F.transform(a, lambda x: text.collapsed(F.lower(x)))), "|")
    rest = F.concat_ws("::", F.nullif(part(F.concat(vendors, products)), F.lit("")), F.nullif(part(attacks), F.lit("")))
    return F.when(F.size(cves) > 0, F.concat(F.lit("cve:"), part(cves))).otherwise(F.when(rest == "", "unknown").otherwise(rest))


def drafts(entities: DataFrame, least: float = 0.5) -> DataFrame:
    """Per article: lists by type of the entities of enough confidence, severity, urgency and grouping key."""
    named = lambda kind: F.sort_array(F.collect_set(F.when(F.col("entity_type") == kind, F.col("entity_value"))))
    out = entities.where(F.col("confidence") >= least).groupBy("article_id").agg(*(named(k).alias(n) for k, n in (("vendor", "vendors"), ("product", "products"), ("cve", "cves"), ("attack_type", "attacks"))))
    # What makes a draft severe.
    severe = F.arrays_overlap("attacks", F.array(*map(F.lit, ("active exploitation", "zero-day", "ransomware", "breach"))))
    subject = F.array_join(F.slice(F.concat("vendors", "products", "cves"), 1, 3), " / ")
    subject = F.when(subject == "", "Unknown cyber event").otherwise(subject)
    some = F.size("cves") > 0
    return out.select("*", F.concat(subject, F.when(some, " vulnerability report").otherwise(" cyber report")).alias("title"), F.when(severe | some, "high").otherwise("medium").alias("severity"), F.when(severe, "P1").when(some, "P2").otherwise("P3").alias("urgency"), grouping_key(F.col("vendors"), F.col("products"), F.col("cves"), F.col("attacks")).alias("grouping_key"))


def mentions(articles: DataFrame, around: int = 60) -> DataFrame:
    """First mention of each identifier in each zone of an article: (article_id, zone, cve_id, start, snippet)."""
    zoned = articles.select(F.col("id").alias("article_id"), F.explode(F.array(F.struct(F.lit("title").alias("zone"), F.col("title").alias("text")), F.struct(F.lit("summary").alias("zone"), F.col("rss_summary").alias("text")), F.struct(F.lit("body").alias("zone"), F.col("clean_text").alias("text")))).alias("z")).select("article_id", "z.*")
    found = zoned.select("article_id", "zone", "text", F.explode(text.cves(F.col("text"))).alias("cve_id"))
    start = F.instr(F.upper("text"), F.col("cve_id")) - 1
    begin = F.greatest(start - around, F.lit(0))
    raw = F.substring(F.col("text"), begin + 1, start - begin + F.length("cve_id") + around)
    whole = begin + F.length(raw) >= F.length("text")
    snippet = F.when(begin > 0, F.regexp_replace(raw, r"^\S*\s", "")).otherwise(raw)
    snippet = F.when(whole, snippet).otherwise(F.regexp_replace(snippet, r"\s\S*$", ""))
    return found.select("article_id", "zone", "cve_id", start.cast("long").alias("start"), text.trimmed(snippet).alias("snippet"))
