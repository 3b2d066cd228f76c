"""Digest evaluation: runs whose predictions are kept, scores, metrics, soft gate and deltas to the baseline (E-08, E-17, W-12).

A store is two tables partitioned by run: predictions and runs. Saving a run again replaces
its partitions and no others (dynamic overwrite), so a repeated or half-done run leaves
nothing behind, and loading a run reads its partition alone.

Gold labels and predictions have article_id, related, vendors, products, cves; a prediction
that failed has an `error` and counts as unrelated and empty. Sets are compared trimmed,
in lower case and without repeats. Rates over no sample are null; precision and recall of
nothing are 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .evaluation import canonical, set_f1

# Least rates that don't warn, and gold labels from which they count.
THRESHOLDS = {"relatedness_f1": 0.8, "vendor_exact_rate": 0.7, "product_exact_rate": 0.7, "cve_exact_rate": 0.75}
LEAST_GOLD = 40
_PREDICTION = "article_id bigint, related boolean, vendors array<string>, products array<string>, cves array<string>, error string"
_LISTS = ("vendors", "products", "cves")


def save(predictions: DataFrame, store: str, run: str, mode: str, started_at: Column, finished_at: Column) -> None:
    """Keeps a run: its predictions (article_id, related, vendors, products, cves, error) and how many were saved and failed. A null `finished_at` is a run that goes on."""
    rows = predictions.selectExpr(*(f"cast({f.split()[0]} as {f.split()[1]}) as {f.split()[0]}" for f in _PREDICTION.split(", ")))
    put = lambda df, name: df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{store}/{name}")
    put(rows, "predictions")
    kept = load(predictions.sparkSession, store, run)
    put(kept.agg(F.count_if(F.col("error").isNull()).alias("saved"), F.count_if(F.col("error").isNotNull()).alias("failed")).select(F.lit(mode).alias("mode"), started_at.cast("timestamp").alias("started_at"), finished_at.cast("timestamp").alias("finished_at"), "saved", "failed"), "runs")


def load(spark: SparkSession, store: str, run: str) -> DataFrame:
    return spark.read.schema(f"{_PREDICTION}, run string").parquet(f"{store}/predictions").where(F.col("run") == run).drop("run")


def runs(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema("mode string, started_at timestamp, finished_at timestamp, saved long, failed long, run string").parquet(f"{store}/runs")


def latest(found: DataFrame, by: str = "mode") -> DataFrame:
    """Of each mode the last run that finished, ties to the greater run."""
    return found.where("finished_at is not null").groupBy(by).agg(F.max_by("run", F.struct("finished_at", "run")).alias("run"))


def scored(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each gold label with its prediction: matches, F1 of sets, and what failed. Vendors and products count only where gold is related."""
    none = F.array().cast("array<string>")
    p = predictions.select("article_id", *((F.when(F.col("error").isNull(), F.col(c))).alias(f"p_{c}") for c in ("related", *_LISTS)))
    g = gold.select("article_id", "related", *(F.coalesce(c, none).alias(c) for c in _LISTS)).join(p, "article_id", "left")
    g = g.withColumns({"p_related": F.coalesce("p_related", F.lit(False)), **{f"p_{c}": F.coalesce(f"p_{c}", none) for c in _LISTS}})
    same = lambda c: F.array_sort(canonical(F.col(c))) == F.array_sort(canonical(F.col(f"p_{c}")))
    out = g.withColumn("related_match", F.col("related") == F.col("p_related"))
    for c, one in zip(_LISTS, ("vendor", "product", "cve"), strict=True):
        counts = F.lit(True) if c == "cves" else F.col("related")
        out = out.withColumns({f"{one}_exact": F.when(counts, same(c)), f"{one}_f1": F.when(counts, set_f1(F.col(c), F.col(f"p_{c}")))})
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    wrong = [F.when(~F.col("related_match"), F.concat(F.lit("related: gold "), yes("related"), F.lit(", pred "), yes("p_related")))]
    wrong += [F.when(~F.col(f"{one}_exact"), F.concat(F.lit(f"{c}: gold "), listed(c), F.lit(", pred "), listed(f"p_{c}"))) for c, one in zip(_LISTS, ("vendor", "product", "cve"), strict=True)]
    return out.withColumn("failures", F.array_compact(F.array(*wrong)))


def metrics(samples: DataFrame) -> DataFrame:
    """One row: gold_count, related_count, relatedness precision, recall and F1, exact rates and mean F1 of the three sets."""
    g, p = F.col("related"), F.col("p_related")
    rate = lambda c: F.try_divide(F.count_if(c), F.count(c))
    c = samples.agg(F.count("*").alias("gold_count"), F.count_if(g).alias("related_count"), F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), *(rate(F.col(f"{k}_exact")).alias(f"{k}_exact_rate") for k in ("vendor", "product", "cve")), *(F.avg(f"{k}_f1").alias(f"{k}_set_f1") for k in ("vendor", "product", "cve")))
    share = lambda other: F.when(F.col("tp") + F.col(other) == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col(other)))
    c = c.withColumns({"relatedness_precision": share("fp"), "relatedness_recall": share("fn")})
    both = F.col("relatedness_precision") + F.col("relatedness_recall")
    c = c.withColumn("relatedness_f1", F.when(both == 0, 0.0).otherwise(2 * F.col("relatedness_precision") * F.col("relatedness_recall") / both))
    return c.withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("cve_exact_rate", "cve_set_f1")}).drop("tp", "fp", "fn")


def gate(found: DataFrame) -> DataFrame:
    """Adds `active` and `warnings`: the rates under their thresholds, once there are enough gold labels; null rates don't warn."""
    warnings = F.array_compact(F.array(*(F.when(F.col(k) < least, F.lit(k)) for k, least in THRESHOLDS.items())))
    active = F.col("gold_count") >= LEAST_GOLD
    return found.withColumns({"active": active, "warnings": F.when(active, warnings).otherwise(F.array(F.lit("too_few_gold_labels")))})


def delta(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """The gated rates of two rows of metrics: now less baseline, null where either is."""
    b = baseline.select(*(F.col(k).alias(f"b_{k}") for k in THRESHOLDS))
    return now.crossJoin(F.broadcast(b)).select(*((F.col(k) - F.col(f"b_{k}")).alias(k) for k in THRESHOLDS))


def evaluated(spark: SparkSession, store: str, gold: DataFrame, run: str) -> DataFrame:
    """One row for a kept run: metrics, gate, and deltas (`delta_...`) to the last finished baseline, null if there is none or it is the run itself."""
    mine = metrics(scored(gold, load(spark, store, run)))
    base = [r.run for r in latest(runs(spark, store)).where("mode = 'baseline'").collect() if r.run != run]
    if base:
        # A baseline counts by the predictions that it has.
        theirs = load(spark, store, base[0]).where("error is null")
        change = delta(mine, metrics(scored(gold.join(theirs.select("article_id"), "article_id", "left_semi"), theirs)))
    else:
        change = mine.select(*(F.lit(None).cast("double").alias(k) for k in THRESHOLDS))
    return gate(mine).crossJoin(F.broadcast(change.select(*(F.col(k).alias(f"delta_{k}") for k in THRESHOLDS))))
