"""JSON-line datasets whose faults are told by file and line (S-06).

Files are read in splits. A line's number is its place in its split and the lines of the
splits before it: lines are counted by split, the counts summed in the order of splits, and
each line takes its sum along. No file goes through one task, and what is summed is one row
a split.

The first fault of a line is its reason. Blank lines count as lines and are skipped. Of
lines with the same id or address, the first whole one stays and the others name its line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import skew
from . import readers

# What labels, tiers, decisions and signals may be.
LABELS = ("CRITICAL_RELEVANT", "RELEVANT", "WEAK_RELEVANT", "IRRELEVANT")
TIERS = ("official_vendor", "government_cert", "security_media", "researcher_blog", "general_news", "unknown")
DECISIONS = ("KEEP", "MAYBE_KEEP", "DROP")
SIGNALS = ("monitoredVendorPresent", "monitoredProductPresent", "cvePresent", "criticalSignalPresent", "mediumSignalPresent")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, place, value): every line with its number in its file and over all files in the order of their names, from 1."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("value"))
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = blocks.withColumns({"in_file": earlier(Window.partitionBy("file").orderBy("block")), "in_all": earlier(Window.orderBy("file", "block"))}).drop("n")
    here = F.col("at") - F.col("first") + 1
    return lines.join(known, ["file", "block"]).select("file", (F.col("in_file") + here).alias("line"), (F.col("in_all") + here).alias("place"), "value")


def _kind(name: str) -> Column:
    """The type of a field; null where it is missing."""
    return F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))


def _text(name: str) -> Column:
    return F.try_variant_get("v", f"$.{name}", "string")


def faults() -> list[tuple[str, Column]]:
    """(reason, whether the record in `v` has the fault) in the order of fields."""
    written = lambda n: F.coalesce((_kind(n) == "STRING") & (_text(n) != ""), F.lit(False))
    listed = lambda n, of: F.coalesce((_kind(n) == "STRING") & _text(n).isin(*of), F.lit(False))
    void = lambda n: F.coalesce(_kind(n) == "VOID", F.lit(False))
    absent = lambda n: _kind(n).isNull()
    address = written("url") & F.rlike(_text("url"), F.lit(r"^([a-zA-Z][a-zA-Z0-9+.-]*:(?!//)\S|[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\s]+)"))
    moment = written("publishedAt") & F.rlike(_text("publishedAt"), F.lit(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$")) & F.try_to_timestamp(_text("publishedAt")).isNotNull()
    flags = [F.coalesce(_kind(f"expectedSignals.{s}") == "BOOLEAN", F.lit(False)) for s in SIGNALS]
    signals = flags[0]
    for f in flags[1:]:
        signals = signals & f
    label, decision = _text("humanLabel"), _text("expectedMinimumDecision")
    wrong = ((label == "IRRELEVANT") != (decision == "DROP")) | ((label == "CRITICAL_RELEVANT") & (decision != "KEEP"))
    return [
        ("no JSON object", ~F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))),
        ("bad id", ~(absent("id") | written("id"))),
        ("bad sourceName", ~written("sourceName")),
        ("bad sourceTier", ~listed("sourceTier", TIERS)),
        ("bad url", ~address),
        ("bad title", ~written("title")),
        ("bad rssSummary", ~(void("rssSummary") | F.coalesce(_kind("rssSummary") == "STRING", F.lit(False)))),
        ("bad rssCategories", ~F.coalesce(_kind("rssCategories").isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(F.try_variant_get("v", "$.rssCategories", "array<string>"), lambda c: c.isNull()), F.lit(False))),
        ("bad publishedAt", ~(void("publishedAt") | moment)),
        ("bad humanLabel", ~listed("humanLabel", LABELS)),
        ("bad humanReason", ~written("humanReason")),
        ("bad expectedMinimumDecision", ~(absent("expectedMinimumDecision") | listed("expectedMinimumDecision", DECISIONS))),
        ("bad expectedSignals", ~(absent("expectedSignals") | signals)),
        ("humanLabel contradicts expectedMinimumDecision", F.coalesce(wrong, F.lit(False))),
    ]


def checked(spark: SparkSession, path: str) -> DataFrame:
    """Every line that isn't blank: file, line, place, reason (null for a sample), id, and the sample's fields in struct `s`.

    An id that is missing is made from the address: eight digits of its digest, or all of them where an earlier line
    of another address has these eight. Made ids are repeated only if their addresses are.
    """
    rows = numbered(spark, path).where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").withColumn("v", F.try_parse_json("value"))
    reason = F.coalesce(*(F.when(bad, reason) for reason, bad in faults()))
    rows = rows.withColumn("own", reason).select("file", "line", "place", "own", F.when(F.col("own").isNull(), F.from_json("value", f"id string, {readers.SAMPLE}, expectedMinimumDecision string")).alias("s"))
    rows = rows.withColumns({"id": F.coalesce("s.id", F.concat(F.lit("cf-"), F.substring(F.sha1("s.url"), 1, 8))), "url": F.col("s.url")})
    made = F.col("s").isNotNull() & F.col("s.id").isNull()
    rows = rows.withColumn("made", F.when(made, F.col("url")))
    for key in ("id", "url"):
        first = F.min(F.struct("place", "file", "line", "made"))
        facts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), first.alias(f"first_{key}"))
        rows = skew.attach(rows, facts, key, "n", "place")
    later = lambda key: F.col(f"first_{key}.place") < F.col("place")
    again = lambda key, by: F.concat(F.lit(f"repeated {key}, first on line "), F.col(f"first_{by}.line").cast("string"))
    alike = F.coalesce(later("id") & (F.col("made") != F.col("first_id.made")), F.lit(False))
    reason = F.when(later("id") & ~alike, again("id", "id")).when(later("url"), F.when(F.col("made") == F.col("first_url.made"), again("id", "url")).otherwise(again("url", "url")))
    own_id = F.when(alike, F.concat(F.lit("cf-"), F.sha1("made"))).otherwise(F.col("id"))
    return rows.select("file", "line", "place", F.coalesce("own", reason).alias("reason"), own_id.alias("id"), "s")


def errors(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, reason) of every line that is no sample."""
    return checked(spark, path).where("reason is not null").select("file", "line", "reason")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """The whole samples, with the decision that a label asks for where none is given."""
    from ..operators.evaluation import least_decision

    rows = checked(spark, path).where("reason is null").select("id", *(F.col(f"s.{f}").alias(f) for f in ("sourceName", "sourceTier", "url", "title", "rssSummary", "rssCategories", "publishedAt", "humanLabel", "humanReason")), F.col("s.expectedMinimumDecision").alias("given"))
    return rows.withColumn("expectedMinimumDecision", F.coalesce("given", least_decision(F.col("humanLabel")))).drop("given")
