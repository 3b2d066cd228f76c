"""Readers of feeds, datasets, inventories and vulnerability catalogues (S-05 to S-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

FEED = "source_name string, url string, title string, rss_summary string, rss_categories array<string>, published_at string"
SAMPLE = "sourceName string, sourceTier string, url string, title string, rssSummary string, rssCategories array<string>, publishedAt string, humanLabel string, humanReason string"
INVENTORY = "id string, vendor string, product string, aliases array<string>, criticality string, inProduction boolean, newsVolume string"
_METRIC = "array<struct<cvssData: struct<baseScore: double, vectorString: string>>>"
ENTRY = f"id string, lastModified string, descriptions array<struct<lang: string, value: string>>, metrics struct<cvssMetricV31: {_METRIC}, cvssMetricV30: {_METRIC}, cvssMetricV2: {_METRIC}>"
NVD = f"vulnerabilities array<struct<cve: struct<{ENTRY}>>>"


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed items: fields trimmed, categories distinct, unreadable dates null."""
    raw = spark.read.schema(FEED).json(path)
    categories = F.array_distinct(F.filter(F.transform("rss_categories", lambda c: F.trim(c)), lambda c: c != ""))
    return raw.withColumns({"title": text.collapsed(F.col("title")), "rss_summary": text.collapsed(F.col("rss_summary")), "rss_categories": F.coalesce(categories, F.array().cast("array<string>")), "published_at": F.try_to_timestamp("published_at")})


def dataset(spark: SparkSession, path: str, schema: str = SAMPLE, key: str = "url") -> DataFrame:
    """JSON lines; a broken line or a repeated key fails the job, and blank lines are skipped."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    bad = rows.groupBy(key).agg(F.count("*").alias("__n"))
    counted = rows.join(bad, key)
    return counted.withColumn(key, F.when(F.col("__n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("repeated key "), F.col(key))))).drop("__n")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of products; a repeated id fails the job."""
    rows = spark.read.schema(INVENTORY).option("multiLine", True).json(path)
    n = rows.groupBy("id").agg(F.count("*").alias("__n"))
    return rows.join(n, "id").withColumn("id", F.when(F.col("__n") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("repeated id "), F.col("id"))))).drop("__n")


def vulnerabilities(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Pages of a vulnerability catalogue, each a file or, with `lines`, a line, one row per entry: English description or else the first; CVSS 3.1, 3.0 or 2.0, with base and vector."""
    return entry_columns(spark.read.schema(NVD).option("multiLine", not lines).json(path).select(F.explode("vulnerabilities.cve").alias("c")))


def entry_columns(rows: DataFrame) -> DataFrame:
    """The columns of a catalogue's entries in struct `c`."""
    english = F.get(F.filter("c.descriptions", lambda d: d["lang"] == "en"), 0)
    whole = lambda name: F.get(F.filter(F.col(f"c.metrics.{name}.cvssData"), lambda m: m["baseScore"].isNotNull() & m["vectorString"].isNotNull()), 0)
    score = F.coalesce(whole("cvssMetricV31"), whole("cvssMetricV30"), whole("cvssMetricV2"))
    return rows.select(F.upper("c.id").alias("cve_id"), F.try_to_timestamp("c.lastModified").alias("modified_at"), F.coalesce(english["value"], F.get("c.descriptions", 0)["value"]).alias("description"), score["baseScore"].alias("cvss"), score["vectorString"].alias("vector"))


def exploited(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The catalogue of exploited vulnerabilities, one row per entry."""
    return spark.read.schema("vulnerabilities array<struct<cveID: string, dateAdded: string>>").option("multiLine", not lines).json(path).select(F.explode("vulnerabilities").alias("v")).select(F.upper("v.cveID").alias("cve_id"), F.try_to_date("v.dateAdded").alias("added_on"))


def probabilities(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Daily exploitation probabilities; numbers come as text, and what isn't finite is null with status no_score."""
    rows = spark.read.schema("data array<struct<cve: string, epss: string, percentile: string>>").option("multiLine", not lines).json(path).select(F.explode("data").alias("d"))
    number = lambda c: F.when(F.expr(f"try_cast({c} as double)") < float("inf"), F.expr(f"try_cast({c} as double)"))
    return rows.select(F.upper("d.cve").alias("cve_id"), number("d.epss").alias("epss"), number("d.percentile").alias("percentile")).withColumn("status", F.when(F.col("epss").isNull(), "no_score").otherwise("ok"))


def route(summary: Column, refused: Column, enough: int = 500) -> Column:
    """Long summaries need no fetch; a refused fetch goes to the browser."""
    return F.when(F.length(summary) >= enough, "rss_only").when(refused, "browser").otherwise("http")
