"""Vector search: exact top-k by cosine distance, in blocks (V-02 to V-04, J-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workers import on_path
from . import ann


def top_k(queries: DataFrame, base: DataFrame, k: int, *, blocks: int | None = None, exclude_same: bool = True) -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest rows of `base` (id, embedding) for each of `queries` (id, embedding).

    `queries` is the stated query set. The base is dealt into blocks by hash, of about
    `ann.BLOCK` rows, and each query is sent to every block. A block is compared by
    matrix products of unit vectors and keeps k rows per query before the ranking, so
    what is shuffled is queries x blocks x k. Vectors are compared with those of the
    same length; null ones are near to none.
    """
    on_path(queries.sparkSession)
    named = (lambda df: df.where("embedding is not null and id is not null")) if exclude_same else (lambda df: df.where("embedding is not null"))
    q, b = named(queries), named(base)
    blocks = blocks or max(1, -(-b.count() // ann.BLOCK))
    rows = b.select(F.size("embedding").alias("list"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", F.col("embedding").alias("v"))
    asked = q.select(F.size("embedding").alias("list"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("id").alias("query_id"), F.col("embedding").alias("v"))
    met = ann.nearest_in_blocks(rows, asked, k, exclude_same)
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)


def eligible(vectors: DataFrame, model: str, dims: int) -> DataFrame:
    return vectors.where((F.col("embedding_model") == model) & F.col("embedding").isNotNull() & (F.size("embedding") == dims))
