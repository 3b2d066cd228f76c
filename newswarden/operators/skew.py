"""Joins by keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from which a key's facts are broadcast; there are at most so many times fewer of them than rows.
HOT = 100_000


def attach(rows: DataFrame, facts: DataFrame, key: str, size: str, spread: str, hot: int = HOT) -> DataFrame:
    """`rows` with the columns of `facts` (one row for each value of `key`, of which `size` rows have it), null where there are none.

    Facts of frequent keys are broadcast, and their rows, like those without a key, go through the shuffle of the
    others by `spread`, so that no task gets all rows of one key.
    """
    names = [c for c in facts.columns if c not in (key, size)]
    whole = F.struct(*names)
    heavy = facts.where(F.col(size) > hot).select(key, whole.alias("__heavy"))
    light = facts.where(F.col(size) <= hot).select(F.concat(F.lit("k"), F.col(key).cast("string")).alias("__key"), whole.alias("__light"))
    out = rows.join(F.broadcast(heavy), key, "left")
    dealt = F.when(F.col("__heavy").isNull() & F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(F.concat(F.lit("s"), F.col(spread).cast("string")))
    out = out.withColumn("__key", dealt).join(light, "__key", "left").withColumn("__fact", F.coalesce("__heavy", "__light"))
    return out.select(*rows.columns, *(F.col(f"__fact.{n}").alias(n) for n in names))
