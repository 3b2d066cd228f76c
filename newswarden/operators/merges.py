"""Write semantics as DataFrame merges (S-11 to S-18) and state transitions (M). Each gives the new snapshot of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_absent(table: DataFrame, new: DataFrame, keys: list[str], first: list[str]) -> DataFrame:
    """New rows only for keys that aren't there; of several new rows with a key, the first by `first`."""
    one = new.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), F.struct(*first)).alias("__r")).select("__r.*")
    return table.unionByName(one.join(table.select(*keys), keys, "left_anti"))


def upsert(table: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """New rows replace old ones; of several new rows with a key, the last by `order`."""
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), F.struct(*order)).alias("__r")).select("__r.*")
    return table.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*table.columns))


def upsert_monotone(table: DataFrame, new: DataFrame, keys: list[str], ranks: dict[str, int], ranked: str, flag: str) -> DataFrame:
    """The higher rank and the OR of the flags of old and new rows."""
    rank = F.create_map(*(F.lit(x) for p in ranks.items() for x in p))[F.col(ranked)]
    return table.unionByName(new.select(*table.columns)).groupBy(*keys).agg(F.max_by(ranked, rank).alias(ranked), F.bool_or(flag).alias(flag)).select(*table.columns)


def upsert_keep_first(table: DataFrame, new: DataFrame, keys: list[str], order: str, first: str, last: str) -> DataFrame:
    """One column keeps its first value that isn't null, another takes the latest."""
    both = table.unionByName(new.select(*table.columns))
    known = F.col(first).isNotNull()
    return both.groupBy(*keys).agg(F.max(order).alias(order), F.min_by(F.when(known, F.col(first)), F.struct(~known, F.col(order))).alias(first), F.max_by(last, order).alias(last)).select(*table.columns)


def upsert_where(table: DataFrame, new: DataFrame, keys: list[str], allowed: Column) -> DataFrame:
    """New rows replace old ones only where `allowed` holds of the old row; new keys are inserted."""
    kept = table.join(new.select(*keys), keys, "left_semi").where(~allowed).select(*keys)
    fresh = new.join(kept, keys, "left_anti")
    return table.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh.select(*table.columns))


def replace_group(table: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """All rows of a group go when new ones of it come."""
    return table.join(new.select(*group).distinct(), group, "left_anti").unionByName(new.select(*table.columns))


def append(table: DataFrame, new: DataFrame) -> DataFrame:
    return table.unionByName(new, allowMissingColumns=True)


# Seconds until the next attempt, by attempts so far.
BACKOFF = (0, 30, 120, 600, 1800)


def backoff(attempts: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BACKOFF)), F.least(F.greatest(attempts, F.lit(0)), F.lit(len(BACKOFF) - 1)).cast("int") + 1)


def failed(tasks: DataFrame, as_of: Column, most: int = 5) -> DataFrame:
    """One more attempt: pending again after the backoff, or in need of attention."""
    n = F.col("attempts") + 1
    return tasks.withColumns({"status": F.when(n >= most, "needs_attention").otherwise("pending"), "next_attempt_at": F.when(n < most, as_of + F.make_dt_interval(secs=backoff(n))), "attempts": n})


def claimed(tasks: DataFrame, as_of: Column, n: int) -> DataFrame:
    """The n pending tasks that are due first, as running."""
    due = tasks.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= as_of))
    return due.orderBy("next_attempt_at", "target_id", "task_name", "attempts").limit(n).withColumn("status", F.lit("running"))


def attached(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links with the new ones, each once."""
    return links.unionByName(new).distinct()


def detached(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone.select("event_id", "article_id"), ["event_id", "article_id"], "left_anti")


def recounted(events: DataFrame, links: DataFrame) -> DataFrame:
    """`events` with source_count, the number of their links."""
    n = links.groupBy(F.col("event_id").alias("id")).agg(F.count("*").alias("source_count"))
    return events.drop("source_count").join(n, "id", "left").withColumn("source_count", F.coalesce("source_count", F.lit(0)))


def keep_one_active(state: DataFrame, changes: DataFrame) -> DataFrame:
    """What becomes of `changes` (scope, id, is_active, at) to `state` (scope, id, is_active) where a scope must keep an active row.

    One row for each changed id, by its last change: scope, id, is_active, applied and error (unknown_id, last_active or null).
    What switches on comes before what switches off. Where all active rows of a scope would be switched off, the last of these
    changes (by time, then id) is refused; a scope without active rows has nothing to lose. Counts by scope decide, so a
    scope of any size is neither sorted nor gathered.
    """
    last = changes.groupBy("scope", "id").agg(F.max_by("is_active", "at").alias("is_active"), F.max("at").alias("at"))
    met = last.join(state.select("scope", "id", F.col("is_active").alias("was")), ["scope", "id"], "left")
    off = F.col("was") & ~F.col("is_active")
    moved = met.groupBy("scope").agg(F.count_if(F.col("was").isNotNull() & ~F.col("was") & F.col("is_active")).alias("on"), F.count_if(off).alias("off"), F.max(F.when(off, F.struct("at", "id"))).alias("latest"))
    active = state.groupBy("scope").agg(F.count_if("is_active").alias("active"))
    full = moved.join(active, "scope").where((F.col("off") > 0) & (F.col("off") >= F.col("active") + F.col("on"))).select("scope", F.col("latest.id").alias("id"), F.lit("last_active").alias("refused"))
    error = F.when(F.col("was").isNull(), "unknown_id").otherwise(F.col("refused"))
    return met.join(full, ["scope", "id"], "left").select("scope", "id", "is_active", error.isNull().alias("applied"), error.alias("error"))
