"""Evaluation: set scores, filter metrics, failure buckets, digests and pairs (E, U-03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from . import quantiles


def canonical(values: Column, keep_empty: bool = False) -> Column:
    low = F.transform(values, lambda x: F.lower(F.trim(x)))
    return F.array_distinct(low if keep_empty else F.filter(low, lambda x: x != ""))


def set_f1(gold: Column, predicted: Column, keep_empty: bool = False) -> Column:
    """2 x common / (both sizes); two empty sets agree."""
    g, p = canonical(gold, keep_empty), canonical(predicted, keep_empty)
    return F.when((F.size(g) == 0) & (F.size(p) == 0), 1.0).otherwise(2.0 * F.size(F.array_intersect(g, p)) / (F.size(g) + F.size(p)))


def failure_type(label: Column, decision: Column) -> Column:
    return (
        F.when((label == "CRITICAL_RELEVANT") & (decision == "DROP"), "critical_dropped")
        .when((label == "CRITICAL_RELEVANT") & (decision == "MAYBE_KEEP"), "critical_deprioritized")
        .when((label == "RELEVANT") & (decision == "DROP"), "relevant_dropped")
        .when((label == "WEAK_RELEVANT") & (decision == "DROP"), "weak_relevant_dropped")
        .when((label == "IRRELEVANT") & (decision == "KEEP"), "irrelevant_kept")
        .when((label == "IRRELEVANT") & (decision == "MAYBE_KEEP"), "irrelevant_maybe_kept")
    )


def failure_severity(kind: Column) -> Column:
    return F.when(kind == "critical_dropped", "severe").when(kind.isin("critical_deprioritized", "relevant_dropped"), "high").when(kind == "weak_relevant_dropped", "medium").when(kind.isNotNull(), "low")


def least_decision(label: Column) -> Column:
    return F.when(label == "CRITICAL_RELEVANT", "KEEP").when(label == "IRRELEVANT", "DROP").otherwise("MAYBE_KEEP")


def filter_metrics(results: DataFrame) -> DataFrame:
    """One row of rates from human_label and decision; an empty class gives 0."""
    label, decision = F.col("human_label"), F.col("decision")
    important = label.isin("CRITICAL_RELEVANT", "RELEVANT")
    n = lambda c: F.count_if(c)
    counts = results.agg(
        F.count("*").alias("dataset_size"), n(label == "CRITICAL_RELEVANT").alias("c"), n((label == "CRITICAL_RELEVANT") & (decision == "KEEP")).alias("ck"),
        n(important).alias("i"), n(important & (decision != "DROP")).alias("ip"), n(decision != "DROP").alias("p"), n(decision == "KEEP").alias("k"),
        n(decision == "MAYBE_KEEP").alias("m"), n(label == "IRRELEVANT").alias("x"), n((label == "IRRELEVANT") & (decision != "DROP")).alias("xp"),
    )
    r = lambda a, b: ratio(F.col(a), F.col(b))
    return counts.select(
        "dataset_size", r("ck", "c").alias("critical_recall"), r("ip", "i").alias("relevant_recall"), ratio(F.col("i") - F.col("ip"), F.col("i")).alias("false_negative_rate"),
        ratio(F.col("c") - F.col("ck"), F.col("c")).alias("critical_miss_rate"), r("p", "dataset_size").alias("pass_through_rate"), r("k", "dataset_size").alias("keep_rate"),
        r("m", "dataset_size").alias("maybe_keep_rate"), r("xp", "x").alias("irrelevant_pass_rate"),
    )


def gate(metrics: DataFrame, *, critical: float = 1.0, relevant: float = 0.9, miss: float = 0.0) -> DataFrame:
    """Failures and warnings of a row of metrics, and whether it passes."""
    failures = F.array_compact(F.array(F.when(F.col("critical_recall") < critical, "critical_recall"), F.when(F.col("relevant_recall") < relevant, "relevant_recall"), F.when(F.col("critical_miss_rate") > miss, "critical_miss_rate")))
    warnings = F.array_compact(F.array(F.when(F.col("dataset_size") < 50, "small_dataset"), F.when(F.col("pass_through_rate") > 0.6, "high_pass_through"), F.when(F.col("irrelevant_pass_rate") > 0.5, "high_irrelevant_pass")))
    return metrics.withColumns({"failures": failures, "warnings": warnings}).withColumn("passed", F.size("failures") == 0)


def binary_metrics(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: accuracy, precision (1 if nothing was predicted positive), recall and F1 of two boolean columns."""
    g, p = F.col(gold), F.col(predicted)
    c = rows.agg(F.count("*").alias("n"), F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    precision = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = c.select("n", ((F.col("n") - F.col("fp") - F.col("fn")) / F.col("n")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def set_metrics(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: micro precision and recall over sets, macro F1, exact matches."""
    g, p = canonical(F.col(gold)), canonical(F.col(predicted))
    sizes = rows.select(F.size(g).alias("g"), F.size(p).alias("p"), F.size(F.array_intersect(g, p)).alias("both"), set_f1(F.col(gold), F.col(predicted)).alias("f1"))
    out = sizes.agg(F.count("*").alias("n"), F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum("both").alias("both"), F.avg("f1").alias("macro_f1"), F.count_if((F.col("both") == F.col("g")) & (F.col("both") == F.col("p"))).alias("exact"))
    return out.select("n", ratio(F.col("both"), F.col("p")).alias("precision"), ratio(F.col("both"), F.col("g")).alias("recall"), "macro_f1", ratio(F.col("exact"), F.col("n")).alias("exact_rate"))


def threshold_suggestion(pairs: DataFrame) -> DataFrame:
    """From label (same_event or different_event) and distance: cloud limits, and thresholds between them where they don't overlap."""
    s = pairs.agg(F.max(F.when(F.col("label") == "same_event", F.col("distance"))).alias("same_max"), F.min(F.when(F.col("label") == "different_event", F.col("distance"))).alias("different_min"))
    return s.withColumns({"overlap": F.col("same_max") >= F.col("different_min"), "middle": (F.col("same_max") + F.col("different_min")) / 2})


def distance_limits(vectors: DataFrame, *, rows: int = 2048) -> DataFrame:
    """One row, `same_max` and `different_min`: cosine distances of all pairs of vectors (id, label, embedding), as `numbers.cosine_distance` defines them.

    Vectors are dealt into blocks of about `rows`; each pair of blocks is a tile of matrix products that returns two numbers. Work grows with the square of the table, as all pairs do.
    """
    import numpy as np
    import pandas as pd

    whole = vectors.where(F.col("id").isNotNull())
    blocks = max(1, -(-whole.count() // rows))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = whole.select("id", "label", "embedding", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    dealt = dealt.select("id", "label", "embedding", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def tile(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        def side(block: int):
            p = part[part["own"] == block]
            vs = [np.asarray(v, np.float64) if v is not None else np.empty(0) for v in p["embedding"]]
            size = np.array([len(v) for v in vs], np.int64)
            m = np.zeros((len(vs), max(int(size.max(initial=0)), 1)))
            for k, v in enumerate(vs):
                m[k, : len(v)] = v
            norm = np.sqrt((m * m).sum(1))
            m[norm > 0] /= norm[norm > 0, None]
            return m, size, p["id"].to_numpy(), p["label"].to_numpy()

        (a, na, ia, la), (b, nb, ib, lb) = side(key[0]), side(key[1])
        width = max(a.shape[1], b.shape[1])
        a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
        same, different = [], []
        for k in range(0, len(a), 512):
            w = slice(k, k + 512)
            d = np.where(na[w, None] == nb, 1 - a[w] @ b.T, 1.0)
            # A null label equals nothing.
            alike, apart = (la[w, None] == lb) & pd.notna(la[w])[:, None], ia[w, None] != ib
            same += [d[apart & alike].max(initial=-np.inf)]
            different += [d[apart & ~alike].min(initial=np.inf)]
        top, least = max(same, default=-np.inf), min(different, default=np.inf)
        return pd.DataFrame({"same_max": [top], "different_min": [least]})

    found = dealt.groupBy("low", "high").applyInPandas(tile, "same_max double, different_min double")
    bound = lambda c, inf: F.nullif(c, F.lit(inf).cast("double"))
    return found.agg(bound(F.max("same_max"), "-Infinity").alias("same_max"), bound(F.min("different_min"), "Infinity").alias("different_min"))


def failure_bucket(expected: Column, negative: Column, products: Column, vendors: Column, critical: Column, medium: Column, summary: Column, same_tier: Column, score: Column, decision: Column, reason: Column) -> Column:
    """Why a sample failed: the first fitting cause. `expected` is a struct of what a human expects (product, vendor, critical, medium); the next are numbers of matches."""
    return (
        F.when(negative > 0, "negative_keyword_overpowered")
        .when(expected["product"] & (products == 0), "missing_product_alias")
        .when(expected["vendor"] & (vendors == 0), "missing_vendor_alias")
        .when(expected["critical"] & (critical == 0), "missing_critical_phrase")
        .when(expected["medium"] & (medium == 0), "missing_keyword")
        .when(F.length(F.trim(F.coalesce(summary, F.lit("")))) < 40, "rss_summary_too_short")
        .when(~same_tier, "source_metadata_missing")
        .when((score > 0) & (score < 15), "threshold_too_high")
        .when((decision == "DROP") & F.contains(F.lower(reason), F.lit("body")), "signal_only_in_body")
        .otherwise("unknown")
    )


def suggested_fix(bucket: Column, tier: Column, score: Column) -> Column:
    return (
        F.when(bucket == "missing_product_alias", "add_missing_product_alias")
        .when(bucket == "missing_vendor_alias", "add_missing_vendor_alias")
        .when(bucket == "negative_keyword_overpowered", "reduce_negative_keyword_penalty")
        .when(bucket == "missing_critical_phrase", "move_phrase_to_critical_keyword_list")
        .when((bucket == "threshold_too_high") | ((tier == "security_media") & (score < 15)), "increase_security_media_boost_or_lower_maybe_threshold")
        .when(bucket.isin("rss_summary_too_short", "signal_only_in_body"), "consider_source_tier_boost_or_shadow_sampling")
        .otherwise("manual_review_required")
    )


def exact_agreement(rows: DataFrame) -> DataFrame:
    """From gold_related, gold_vendors, gold_products, gold_cves and the predicted related, vendors, products, cves: whether each agrees; vendors and products null unless gold is related."""
    same = lambda n: F.array_sort(canonical(F.col(f"gold_{n}"))) == F.array_sort(canonical(F.col(n)))
    only = lambda n: F.when(F.col("gold_related"), same(n))
    return rows.withColumns({"related": F.col("gold_related") == F.col("related"), "vendors": only("vendors"), "products": only("products"), "cves": same("cves")})


def agreement_rates(agreed: DataFrame) -> DataFrame:
    """One row of rates: no samples give 0, no judged vendors or products null."""
    n = agreed.agg(F.count("*").alias("samples"), *(F.count_if(c).alias(c) for c in ("related", "vendors", "products", "cves")), *(F.count(c).alias(f"n_{c}") for c in ("vendors", "products")))
    judged = lambda c: F.when(F.col(f"n_{c}") > 0, F.col(c) / F.col(f"n_{c}"))
    return n.select("samples", ratio(F.col("related"), F.col("samples")).alias("related_rate"), judged("vendors").alias("vendor_rate"), judged("products").alias("product_rate"), ratio(F.col("cves"), F.col("samples")).alias("cve_rate"))


def disagreement(label: Column, decision: Column, score: Column, assessment: Column) -> Column:
    """How a judge's label and the filter's decision differ: the first fitting kind."""
    critical, irrelevant = label == "CRITICAL_RELEVANT", label == "IRRELEVANT"
    return (
        F.when(critical & (decision == "DROP"), "false_negative_risk")
        .when(critical & (score < 40), "under_scored_critical")
        .when(irrelevant & (decision == "KEEP"), "false_positive_risk")
        .when(irrelevant & (score >= 40), "over_scored_irrelevant")
        .when(assessment == "REASONABLE", "reasonable")
        .otherwise("minor_difference")
    )


def labelled_metrics(items: DataFrame) -> DataFrame:
    """The seven measures of a labelled set, as one row; rates over nothing are 0, the median latency of none is null.

    From is_duplicate, predicted_duplicate, is_relevant, predicted_relevant, llm_called, extraction_success (booleans),
    expected_event_group, predicted_event_group and source_to_notification_latency_seconds. Nulls count as false, or as group none.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    grouped = F.coalesce("predicted_event_group", F.lit("none")) != "none"
    rate = lambda hit, of: ratio(F.count_if(hit & of), F.count_if(of))
    every = F.lit(True)
    row = items.agg(
        rate(yes("predicted_duplicate"), yes("is_duplicate")).alias("duplicate_reduction_rate"),
        rate(F.col("predicted_event_group").eqNullSafe(F.col("expected_event_group")), grouped).alias("event_grouping_precision"),
        rate(yes("is_relevant"), yes("predicted_relevant")).alias("classification_precision"),
        rate(yes("predicted_relevant"), ~yes("is_relevant")).alias("false_positive_rate"),
        F.when(F.count("*") == 0, 0.0).otherwise(1 - F.count_if(yes("llm_called")) / F.count("*")).alias("llm_call_reduction_rate"),
        rate(yes("extraction_success"), every).alias("extraction_success_rate"),
    )
    middle = quantiles.interpolated(items, "source_to_notification_latency_seconds", 0.5)
    return row.withColumn("median_source_to_notification_latency_seconds", F.lit(middle).cast("double"))


def pair_report(pairs: DataFrame, attach: float, uncertain: float) -> DataFrame:
    """One row for labelled pairs (label same_event, different_event or uncertain; distance): counts, errors at the thresholds, and thresholds that the clouds suggest.

    A distance that is null or not finite is unscorable; pairs labelled uncertain are counted and fit nothing. False attaches are different
    events within `attach`, misses are same events beyond it, and the band is what lies between the two. Suggested are the farthest same pair
    and the nearest different one, a hundredth to either side of their middle where they overlap, and the given ones where a cloud is empty.
    Every figure is a sum or an extreme, so pairs are read once and nothing grows with them.
    """
    d = F.col("distance")
    finite = F.coalesce(~F.isnan(d) & (F.abs(d) < float("inf")), F.lit(False))
    unsure = F.coalesce(F.col("label") == "uncertain", F.lit(False))
    same = finite & ~unsure & F.coalesce(F.col("label") == "same_event", F.lit(False))
    other = finite & ~unsure & ~F.coalesce(F.col("label") == "same_event", F.lit(False))
    c = pairs.agg(
        F.count("*").alias("labelled"), F.count_if(finite).alias("scorable"), F.count_if(~finite).alias("unscorable"), F.count_if(same).alias("fit_same"), F.count_if(other).alias("fit_different"), F.count_if(finite & unsure).alias("uncertain_labels"),
        F.count_if(other & (d <= attach)).alias("false_attaches"), F.count_if(same & (d > attach)).alias("missed"), F.count_if((same | other) & (d > attach) & (d <= uncertain)).alias("in_band"),
        F.coalesce(F.max(F.when(same, d)), F.lit(attach)).alias("a"), F.coalesce(F.min(F.when(other, d)), F.lit(uncertain)).alias("u"),
    )
    middle, crossed = (F.col("a") + F.col("u")) / 2, F.col("a") >= F.col("u")
    third = lambda x: F.floor(x * 1000 + 0.5) / 1000
    return c.withColumns({"suggested_attach": third(F.when(crossed, F.greatest(middle - 0.01, F.lit(0.0))).otherwise(F.col("a"))), "suggested_uncertain": third(F.when(crossed, middle + 0.01).otherwise(F.col("u")))}).drop("a", "u")


def pair_histogram(pairs: DataFrame, width: float = 0.02) -> DataFrame:
    """(label, bin, pairs): how many scorable pairs of each label lie in each step of distance, with which thresholds are tuned without the pairs."""
    finite = F.coalesce(~F.isnan("distance") & (F.abs("distance") < float("inf")), F.lit(False))
    return pairs.where(finite).groupBy("label", F.floor(F.col("distance") / width).alias("bin")).agg(F.count("*").alias("pairs"))
