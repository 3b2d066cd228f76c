"""The cheap filter: signals, score, cascade and routing (K-01 to K-06, J-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import DEFAULT, Context, Product
from ..functions import dates, text
from . import phrases


def _any(flags: list[Column]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def inventory_hits(words: Column, inventory: tuple[Product, ...], low: Column | None = None) -> tuple[Column, Column]:
    """Vendors and products named in a text, in inventory order. A product or an alias names its vendor too; an alias names its product."""
    vendors, products = [], []
    for p in inventory:
        alias = _any([text.has_phrase(words, a, low) for a in p.aliases])
        product = text.has_phrase(words, p.product, low) | alias
        vendors.append(F.when(text.has_phrase(words, p.vendor, low) | product, F.lit(p.vendor)))
        products.append(F.when(product, F.lit(p.product)))
    clean = lambda x: F.array_distinct(F.array_compact(F.array(*x))) if x else F.array().cast("array<string>")
    return clean(vendors), clean(products)


def with_inventory(rows: DataFrame, words: str, inventory: DataFrame, prefix: str) -> DataFrame:
    """`rows` (with an `id`) and the vendors, products and noise that the inventory table finds in column `words`; rows of one id are told apart by their text."""
    keyed = rows.withColumn("__key", F.struct("id", F.xxhash64(words).alias("h"), F.length(words).alias("n")))
    hits = phrases.detected(keyed, inventory, "__key", words)
    named = hits.select(F.col("key").alias("__key"), *(F.col(c).alias(f"{prefix}{c}") for c in ("vendors", "products", "noisy")))
    none = F.array().cast("array<string>")
    return keyed.join(named, "__key", "left").drop("__key").withColumns({f"{prefix}vendors": F.coalesce(f"{prefix}vendors", none), f"{prefix}products": F.coalesce(f"{prefix}products", none), f"{prefix}noisy": F.coalesce(f"{prefix}noisy", F.lit(False))})


def signals(articles: DataFrame, context: Context = DEFAULT, inventory: DataFrame | None = None) -> DataFrame:
    """Adds struct `s` with everything the filter looks at. Needs title, rss_summary, source_name, published_at; uses rss_categories and source_tier if there.

    With `inventory`, a table as in `phrases.phrase_index`, that takes the place of the context's list; then an `id` is needed.
    """
    lex = context.lexicon
    categories = F.coalesce(F.col("rss_categories"), F.array().cast("array<string>")) if "rss_categories" in articles.columns else F.array().cast("array<string>")
    tier = text.tier(F.col("source_name"), lex.tiers)
    if "source_tier" in articles.columns:
        tier = F.coalesce("source_tier", tier)
    whole = text.joined(F.col("title"), F.col("rss_summary"), F.array_join(F.filter(categories, lambda c: c != ""), "\n"))
    # Each signal is a column of its own before the struct: a struct of expressions would be
    # taken apart by the optimizer and computed once for every use of a field.
    out = articles.withColumn("__text", whole).withColumns({"__low": F.lower("__text"), "__form": text.keyword_form(F.col("__text"))})
    if inventory is not None:
        out = with_inventory(out, "__text", inventory, "__s_")
    else:
        vendors, products = inventory_hits(F.col("__text"), context.inventory, F.col("__low"))
        out = out.withColumns({"__s_vendors": vendors, "__s_products": products})
    noisy = {p.product for p in context.inventory if p.noisy}, {p.vendor for p in context.inventory if p.noisy}
    with_product = F.arrays_overlap("__s_products", F.array(*map(F.lit, sorted(noisy[0])))) if noisy[0] else F.lit(False)
    with_vendor = F.arrays_overlap("__s_vendors", F.array(*map(F.lit, sorted(noisy[1])))) if noisy[1] else F.lit(False)
    security = F.filter(categories, lambda c: F.exists(F.array(*map(F.lit, lex.categories)), lambda k: F.contains(F.lower(c), k)))
    found = {
        "cves": text.cves(F.col("__text")),
        "exploitation": text.keywords(F.col("__form"), lex.exploitation),
        "incident": text.keywords(F.col("__form"), lex.incident),
        "medium": text.keywords(F.col("__form"), lex.medium),
        "low": text.keywords(F.col("__form"), lex.low),
        "negative": text.keywords(F.col("__form"), lex.negative),
        "tier": tier,
        "categories": security,
        "noisy": F.col("__s_noisy") if inventory is not None else F.when(F.size("__s_products") > 0, with_product).otherwise(with_vendor),
        "recent": dates.recent(F.col("published_at"), context.as_of),
        "old": dates.old(F.col("published_at"), context.as_of),
    }
    out = out.withColumns({f"__s_{k}": c for k, c in found.items()})
    names = ("vendors", "products", *found)
    # Taken out by an outer explode, so that the optimizer can't push filters on signals and
    # decisions below it, where every use of a signal would become all of its expression again.
    out = out.withColumn("s", F.explode_outer(F.array(F.struct(*(F.col(f"__s_{k}").alias(k) for k in names)))))
    return out.drop("__text", "__low", "__form", *(f"__s_{k}" for k in names))


def _some(name: str) -> Column:
    return F.size(f"s.{name}") > 0


def _trusted() -> Column:
    return F.col("s.tier").isin("official_vendor", "government_cert")


def _press() -> Column:
    return F.col("s.tier").isin("security_media", "researcher_blog")


def score(context: Context = DEFAULT) -> Column:
    """Points of the signals, from 0 to 100."""
    pair = _any([F.array_contains("s.low", a) & F.array_contains("s.low", b) for a, b in context.lexicon.pairs])
    named = F.when(_some("products"), 25).when(_some("vendors"), 15).otherwise(0)
    words = F.when(_some("exploitation"), 35).when(_some("incident"), 25).when(_some("medium"), 20).when(pair, 10).when(_some("low"), 5).otherwise(0)
    plus = lambda c, n: F.when(c, n).otherwise(0)
    total = plus(_some("cves"), 35) + named + words + plus(_trusted(), 25) + plus(_press(), 10) + plus(_some("categories"), 10)
    total = total + plus(F.col("s.recent"), 10) - plus(_some("negative"), 20) - plus(F.col("s.old"), 20)
    return F.least(F.greatest(total, F.lit(0)), F.lit(100))


def decide(articles: DataFrame, context: Context = DEFAULT, mode: str = "gating", inventory: DataFrame | None = None) -> DataFrame:
    """Adds s, score, decision, reasons, blocking_reasons and processing_status.

    Columns named s, score, decision, reasons, blocking_reasons or
    processing_status are replaced.
    """
    critical = _some("exploitation") | _some("incident")
    vendor = _some("vendors") | _some("products")
    hatch = _some("cves") | _some("exploitation") | _trusted()
    corroborated = _some("categories") | _press()
    cyber = _some("cves") | critical | _trusted() | (_some("medium") & (~F.col("s.noisy") | corroborated))
    dominated = _some("negative") & ~(_some("cves") | critical)
    points = F.col("__points")
    drop = F.when(~vendor, ~hatch).otherwise(dominated | ~cyber)
    decision = F.when(drop, "DROP").when(~vendor, "MAYBE_KEEP").when(points >= context.keep_score, "KEEP").otherwise("MAYBE_KEEP")
    passed = vendor & ~dominated & cyber
    code = lambda c, name: F.when(c, F.lit(name))
    tier = F.col("s.tier")
    reasons = [
        code(_some("cves"), "cve_found"), code(_some("products"), "monitored_product_found"), code(_some("vendors"), "monitored_vendor_found"),
        code(critical, "critical_cyber_keyword_found"), code(_some("medium"), "medium_cyber_keyword_found"), code(_some("low"), "low_cyber_keyword_found"),
        *(code(tier == t, f"{t}_source") for t in ("official_vendor", "government_cert", "security_media", "researcher_blog")),
        code(_some("categories"), "security_rss_category_found"), code(F.col("s.recent"), "recent_article"),
        code(~vendor & hatch, "cheap_filter_l1_severe_signal_escape_hatch"),
        code(passed & _some("products"), "product_with_cyber_context"), code(passed & _some("vendors"), "vendor_with_cyber_context"),
        code(passed & (_trusted() | _press()), "trusted_source_with_security_context"),
    ]
    lost = ~vendor & ~hatch
    blocking = [
        code(_some("negative"), "cheap_filter_negative_business_context"), code(~_some("cves"), "cheap_filter_no_cve_in_rss_metadata"),
        code(~vendor, "cheap_filter_no_vendor_product_in_rss_metadata"),
        code(~critical & ~_some("medium") & ~_some("low"), "cheap_filter_no_cyber_keyword_in_rss_metadata"),
        code(tier == "general_news", "cheap_filter_general_news_source"), code(F.col("s.old"), "cheap_filter_old_or_stale_article"),
        code(lost, "cheap_filter_l1_no_vendor_no_severe_signal"), code(vendor & dominated, "cheap_filter_l2_negative_dominance"),
        code(vendor & ~dominated & ~cyber, "cheap_filter_vendor_only_without_security_context"),
        code(vendor & ~dominated & ~cyber, "cheap_filter_l2_no_cyber_context"),
        code(drop, "cheap_filter_insufficient_rss_signal"), code(lost & (points < 15), "cheap_filter_low_score"),
    ]
    out = signals(articles, context, inventory).withColumn("__points", score(context))
    routed = F.when(F.col("decision") == "KEEP", "EXTRACTION_PENDING").when(F.col("decision") == "MAYBE_KEEP", "EXTRACTION_PENDING_LOW_PRIORITY")
    routed = routed.otherwise("EXTRACTION_PENDING_LOW_PRIORITY" if mode == "advisory" else "IGNORED")
    out = out.withColumns({"score": F.when(~vendor & hatch, F.least(points, F.lit(49))).otherwise(points), "decision": decision, "reasons": F.array_compact(F.array(*reasons)), "blocking_reasons": F.array_compact(F.array(*blocking))})
    return out.withColumn("processing_status", routed).drop("__points")
