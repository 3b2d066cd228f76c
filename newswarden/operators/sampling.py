"""Samples by quota of each bucket, in the order of a hash (W-10, E-13).

A bucket's sample is what lies under a threshold of the hash, and the thresholds of all
buckets are found at once by rank selection (`quantiles.of_groups`), so no bucket is sorted
and no task holds one. What is left is as large as the quotas ask, with slack for rows that
turn out to be unfit, and is gone through in order.

Defined results: of a row that is in several buckets, the first bucket in the given order
that takes it has it; buckets that can't be filled have what there is, and the report says
how many were asked for and found. Equal hashes go by id. Null ids are never drawn.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import landing
from . import quantiles


def lot(id_: Column, seed: str = "") -> Column:
    """A number from 0 to 2^60 - 1 that depends on the id and the seed alone."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed), id_.cast("string")), 256), 1, 15), 16, 10).cast("long")


def pool(rows: DataFrame, bucket: str, id_: str, limits: dict, seed: str = "") -> DataFrame:
    """The rows of each bucket with the least lots, as many as `limits` says (more only where lots are equal), with their `lot`."""
    drawn = rows.where(F.col(id_).isNotNull() & F.col(bucket).isin(list(limits))).withColumn("lot", lot(F.col(id_), seed))
    limit = F.coalesce(*(F.when(F.col(bucket) == b, F.lit(n)) for b, n in limits.items()))
    edges = quantiles.of_groups(drawn.withColumn("__limit", limit).where("__limit > 0"), [bucket, "__limit"], "lot", {"edge": lambda n: F.least(n, F.col("__limit")) - 1})
    return drawn.join(F.broadcast(edges.select(bucket, "edge")), bucket).where("lot <= edge").drop("edge")


def by_quota(rows: DataFrame, bucket: str, id_: str, order: list[str], size: int, fit: Column, slack: float = 1.2, seed: str = "") -> tuple[DataFrame, DataFrame]:
    """(sample, report) of `rows`, one row for each bucket that a row is in.

    Each bucket of `order` gets ceil(size / their number); so many times `slack` are drawn, and those for which `fit` holds are taken
    in the order of lots until the quota is full. The sample has bucket, id and place; the report bucket, requested and found.
    """
    each = math.ceil(size / len(order))
    drawn = pool(landing.cut(rows.select(bucket, id_, F.coalesce(fit, F.lit(False)).alias("__fit")), "buckets"), bucket, id_, dict.fromkeys(order, math.ceil(each * slack)), seed)
    # As many rows as the quotas with their slack: bounded by what was asked for.
    found = sorted(drawn.select(bucket, id_, "lot", "__fit").distinct().collect(), key=lambda r: (order.index(r[0]), r[2], r[1]))
    seen, taken = set(), {b: [] for b in order}
    looked = dict.fromkeys(order, 0)
    for b, key, _, good in found:
        looked[b] += 1
        if looked[b] <= math.ceil(each * slack) and good and key not in seen and len(taken[b]) < each:
            seen.add(key)
            taken[b].append(key)
    kinds = dict(rows.dtypes)
    sample = rows.sparkSession.createDataFrame([(b, key, k) for b in order for k, key in enumerate(taken[b])], f"{bucket} {kinds[bucket]}, {id_} {kinds[id_]}, place long")
    report = rows.sparkSession.createDataFrame([(b, each, len(taken[b])) for b in order], f"{bucket} {kinds[bucket]}, requested long, found long")
    return sample, report


def harvested(rows: DataFrame, bucket: str, id_: str, limits: dict, labelled: DataFrame, candidates: DataFrame, scored: dict[str, str] | None = None, over: int = 3, seed: str = "") -> tuple[DataFrame, DataFrame]:
    """(new, report): `over` times each bucket's limit are drawn, those with an id in `labelled` or `candidates` are skipped, and the rest fills the limit.

    `scored` names buckets whose rows come by a column first, descending, nulls last. The report has bucket, added, skipped_labelled
    and skipped_candidate; skips after the limit is full don't count.
    """
    scored = scored or {}
    rows = landing.cut(rows.select(bucket, id_, *dict.fromkeys(scored.values())), "strata")
    drawn = pool(rows, bucket, id_, {b: n * over for b, n in limits.items() if b not in scored}, seed).withColumn("__score", F.lit(None).cast("double"))
    for b, column in scored.items():
        own = rows.where((F.col(bucket) == b) & F.col(id_).isNotNull()).withColumns({"lot": lot(F.col(id_), seed), "__score": F.col(column).cast("double")})
        # A bounded number of rows: each task keeps as many.
        drawn = drawn.unionByName(own.orderBy(F.col("__score").desc_nulls_last(), "lot", id_).limit(limits[b] * over))
    keys = drawn.select(bucket, id_, "lot", "__score")
    marked = keys.join(labelled.select(id_).distinct().withColumn("__l", F.lit(True)), id_, "left").join(candidates.select(id_).distinct().withColumn("__c", F.lit(True)), id_, "left")
    place = lambda r: (list(limits).index(r[bucket]), r["__score"] is None, -(r["__score"] or 0.0), r["lot"], r[id_])
    new, counts, looked, seen = [], {b: [0, 0, 0] for b in limits}, dict.fromkeys(limits, 0), set()
    for r in sorted(marked.collect(), key=place):
        b = r[bucket]
        looked[b] += 1
        if looked[b] > limits[b] * over or counts[b][0] >= limits[b]:
            continue
        kind = 1 if r["__l"] else 2 if r["__c"] or r[id_] in seen else 0
        counts[b][kind] += 1
        if not kind:
            seen.add(r[id_])
            new.append((b, r[id_]))
    kinds = dict(rows.dtypes)
    report = rows.sparkSession.createDataFrame([(b, *counts[b]) for b in limits], f"{bucket} {kinds[bucket]}, added long, skipped_labelled long, skipped_candidate long")
    return rows.sparkSession.createDataFrame(new, f"{bucket} {kinds[bucket]}, {id_} {kinds[id_]}"), report
