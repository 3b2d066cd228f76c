"""A vector index of inverted lists on Parquet: built, searched, changed and loaded again (V-05, S-20).

Centres are fitted on a bounded sample (at most `SAMPLE` vectors, the first by a hash of
the id). Every vector goes to the list of its nearest centre, and a list is a partition of
the table, so a search reads the probed lists alone. How many lists a query probes is
measured on the sample when the index is built, for the recall that is asked for: a few
where vectors are clustered, most where they lie at random. An exact search goes on to
the lists that the triangle inequality can't exclude, and gives the rows of a full
comparison.

A task holds one block of a list and a batch of queries: rows of both travel by list and
block and stream in order, the block first. Blocks bound what a task holds however many
vectors a list has, and each block keeps k rows for a query.

Vectors that are null or of other dimensions than most of the sample are not indexed.
Distances are cosine distances rounded to six places; ties go to the least id. An id
has one vector; `upsert` replaces it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from ..functions.workers import on_path
from ..sources import landing

#: Vectors that the centres are fitted on, lists at most, vectors of a block, and of a file.
SAMPLE, MOST_LISTS, BLOCK, FILE_ROWS = 16_384, 4_096, 16_384, 500_000
#: Rounds of fitting, and queries of the sample on which the number of probes is measured.
ROUNDS, ASKED = 12, 256
#: Cells of a table of distances that are computed at once.
CELLS = 1 << 22


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of length zero stays."""
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(norm > 0, norm, 1.0)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def fit(vectors: np.ndarray, lists: int) -> np.ndarray:
    """Centres of length one: from evenly drawn vectors, each round to the mean of what is nearest; an empty one moves to the vector that fits worst."""
    centres = vectors[np.linspace(0, len(vectors) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        near, best = nearest(vectors, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        empty = np.flatnonzero(np.bincount(near, minlength=lists) == 0)
        sums[empty] = vectors[np.argsort(best)[: len(empty)]]
        centres = _unit(sums)
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near, best = np.empty(len(vectors), np.int64), np.empty(len(vectors))
    step = max(1, CELLS // len(centres))
    for k in range(0, len(vectors), step):
        cos = vectors[k : k + step] @ centres.T
        near[k : k + step] = cos.argmax(axis=1)
        best[k : k + step] = cos.max(axis=1)
    return near, best


def needed_probes(vectors: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The fewest lists that give `recall` of the k nearest, for queries spread over the sample."""
    if len(vectors) < 2:
        return 1
    asked = np.unique(np.linspace(0, len(vectors) - 1, ASKED).astype(int))
    near, _ = nearest(vectors, centres)
    place = np.empty((len(asked), len(centres)), np.int64)
    np.put_along_axis(place, np.argsort(-(vectors[asked] @ centres.T), axis=1), np.arange(len(centres))[None, :], axis=1)
    k, at = min(k, len(vectors) - 1), []
    step = max(1, CELLS // len(vectors))
    for a in range(0, len(asked), step):
        cos = vectors[asked[a : a + step]] @ vectors.T
        cos[np.arange(len(cos)), asked[a : a + step]] = -2.0
        at.append(np.take_along_axis(place[a : a + step], near[np.argpartition(-cos, k - 1, axis=1)[:, :k]], axis=1))
    return int(np.quantile(np.concatenate(at), recall, method="higher")) + 1


@dataclass(frozen=True)
class Index:
    """Where the table lies, and what is known of each list: centre, rows, and the least cosine of a row to the centre."""

    path: str
    centres: np.ndarray
    rows: np.ndarray
    reach: np.ndarray
    probes: int

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")


def _assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, embedding, cosine, list) of the vectors that fit the centres."""
    on_path(vectors.sparkSession)
    dims = centres.shape[1]
    rows = vectors.select("id", F.col("embedding").cast("array<float>").alias("embedding")).where(F.size("embedding") == dims)
    known = vectors.sparkSession.sparkContext.broadcast(centres)
    schema = StructType(list(rows.schema.fields)).add("cosine", "double").add("list", "integer")
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, best = nearest(_unit(_matrix(b.column(1), dims)), known.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best), pa.array(near, pa.int32())], schema=arrow)

    return rows.mapInArrow(work, schema)


def _save(table: DataFrame, path: str, pieces: np.ndarray, mode: str) -> None:
    """Writes lists as partitions; a long list is written by several tasks."""
    piece = F.pmod(F.xxhash64("id"), F.get(F.lit(pieces.tolist()), F.col("list")))
    table.repartition(F.col("list"), piece).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("list").parquet(f"{path}/vectors")


def _described(spark: SparkSession, path: str, centres: np.ndarray, probes: int) -> Index:
    """Counts the lists and keeps what is known of them beside the table."""
    found = {r["list"]: r for r in spark.read.parquet(f"{path}/vectors").groupBy("list").agg(F.count("*").alias("n"), F.min("cosine").alias("reach")).collect()}
    n = np.array([found[k].n if k in found else 0 for k in range(len(centres))], np.int64)
    reach = np.array([found[k].reach if k in found else 1.0 for k in range(len(centres))])
    rows = [(k, centres[k].tolist(), int(n[k]), float(reach[k]), probes) for k in range(len(centres))]
    spark.createDataFrame(rows, "list int, centre array<double>, n long, reach double, probes int").write.mode("overwrite").parquet(f"{path}/lists")
    return Index(path, centres, n, reach, probes)


def load(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/lists").orderBy("list").collect()
    return Index(path, np.array([r.centre for r in rows]), np.array([r.n for r in rows], np.int64), np.array([r.reach for r in rows]), rows[0].probes)


def build(vectors: DataFrame, path: str, k: int = 10, recall: float = 0.95, lists: int | None = None) -> Index:
    """The index of `vectors` (id, embedding), saved under `path`; probes are set for `recall` of the `k` nearest."""
    spark = vectors.sparkSession
    there = vectors.where("embedding is not null and id is not null")
    total = there.count()
    drawn = [r.embedding for r in there.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").collect()]
    if not drawn:
        raise ValueError("an index needs a vector")
    sizes = [len(v) for v in drawn]
    dims = max(set(sizes), key=sizes.count)
    sample = _unit(np.array([v for v in drawn if len(v) == dims], np.float64))
    lists = lists or max(1, min(MOST_LISTS, round(math.sqrt(total)), len(sample) // 4))
    centres = fit(sample, lists)
    share = np.bincount(nearest(sample, centres)[0], minlength=lists) / len(sample)
    _save(_assigned(there, centres), path, np.maximum(1, np.ceil(share * total / FILE_ROWS)).astype(int), "overwrite")
    return _described(spark, path, centres, needed_probes(sample, centres, k, recall))


def upsert(spark: SparkSession, index: Index, vectors: DataFrame) -> Index:
    """The index with `vectors` (id, embedding; each id once): new ids come in, known ones change, and only touched lists are written anew."""
    new = landing.cut(_assigned(vectors.where("embedding is not null and id is not null"), index.centres), "vectors")
    old = index.table(spark)
    moved = old.join(new.select("id"), "id", "left_semi").select("list").union(new.select("list")).distinct()
    touched = [r["list"] for r in moved.collect()]
    if not touched:
        return index
    kept = old.where(F.col("list").isin(touched)).join(new.select("id"), "id", "left_anti").select("id", "embedding", "cosine", "list")
    staged = landing.cut(kept.unionByName(new.select("id", "embedding", "cosine", "list")), "lists")
    # A list that loses its last vector has no rows that would overwrite it.
    emptied = sorted(set(touched) - {r["list"] for r in staged.select("list").distinct().collect()})
    _save(staged, index.path, np.maximum(1, np.ceil(index.rows / FILE_ROWS)).astype(int), "overwrite")
    for gone in emptied:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{index.path}/vectors/list={gone}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return _described(spark, index.path, index.centres, index.probes)


def _probed(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, q, list) for the nearest `probes` lists of each query; with a column `limit`, for the other lists that may hold a row within that distance."""
    dims, beyond = index.centres.shape[1], "limit" in queries.columns
    known = queries.sparkSession.sparkContext.broadcast((index.centres, np.arccos(np.clip(index.reach, -1, 1)), index.rows > 0))
    rows = queries.select(F.col("id").alias("query_id"), F.col("embedding").cast("array<float>").alias("q"), *(["limit"] if beyond else [])).where(F.size("q") == dims)
    schema = StructType(rows.schema.fields[:2]).add("list", "integer")
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, filled = known.value
        for b in batches:
            cos = _unit(_matrix(b.column(1), dims)) @ centres.T
            order = np.argsort(-cos, axis=1, kind="stable")
            chosen = np.zeros(cos.shape, bool)
            np.put_along_axis(chosen, order[:, :probes], True, axis=1)
            if beyond:
                limit = b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                closest = np.cos(np.maximum(np.arccos(np.clip(cos, -1, 1)) - radius, 0.0))
                chosen = ~chosen & (1 - closest <= np.where(np.isnan(limit), np.inf, limit + 1e-6)[:, None])
            who, which = np.nonzero(chosen & filled)
            took = pa.array(who)
            yield pa.RecordBatch.from_arrays([b.column(0).take(took), b.column(1).take(took), pa.array(which, pa.int32())], schema=arrow)

    return rows.mapInArrow(work, schema)


def _best(ids: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) of the k nearest rows of each query, ties by id."""
    if distance.shape[1] > k:
        who, which = np.nonzero(distance <= np.partition(distance, k - 1, axis=1)[:, k - 1 : k])
    else:
        who, which = (x.ravel() for x in np.indices(distance.shape))
    order = np.lexsort((ids[which], distance[who, which], who))
    who, which = who[order], which[order]
    start = np.searchsorted(who, np.arange(len(distance)))
    first = np.arange(len(who)) - start[who] < k
    finite = np.isfinite(distance[who, which])
    return who[first & finite], which[first & finite]


def _met(index: Index, probed: DataFrame, k: int, exclude_same: bool) -> DataFrame:
    """(query_id, id, distance): the k nearest rows of each block for each query that probes its list."""
    spark = probed.sparkSession
    blocks = np.maximum(1, np.ceil(index.rows / BLOCK)).astype(int)
    lists = sorted(r["list"] for r in probed.select("list").distinct().collect())
    per = F.get(F.lit(blocks.tolist()), F.col("list")).cast("long")
    base = index.table(spark).where(F.col("list").isin(lists)).select("list", F.pmod(F.xxhash64("id"), per).alias("block"), "id", F.col("embedding").alias("v"))
    asked = probed.select("list", F.explode(F.sequence(F.lit(0).cast("long"), per - 1)).alias("block"), "query_id", F.col("q").alias("v"))
    return nearest_in_blocks(base, asked, k, exclude_same)


def nearest_in_blocks(base: DataFrame, asked: DataFrame, k: int, exclude_same: bool) -> DataFrame:
    """(query_id, id, distance): of `base` (list, block, id, v), the k nearest rows of each block of each list for each of `asked` (list, block, query_id, v). Vectors of a list have one length."""
    id_type, query_type = base.schema["id"].dataType, asked.schema["query_id"].dataType
    rows = base.select("list", "block", F.lit(0).alias("asked"), F.lit(None).cast(query_type).alias("query_id"), "id", "v")
    tasks = rows.union(asked.select("list", "block", F.lit(1).alias("asked"), "query_id", F.lit(None).cast(id_type).alias("id"), "v")).repartition("list", "block").sortWithinPartitions("list", "block", "asked", "id")
    schema = StructType([asked.schema["query_id"]]).add("id", id_type).add("distance", "double")
    arrow, id_type = to_arrow_schema(schema), to_arrow_type(id_type)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("list", "block", "asked")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                part = b.slice(start, stop - start)
                if tuple(key[start, :2]) != at:
                    at, parts, block = tuple(key[start, :2]), [], None
                vectors = _unit(_matrix(part.column("v"), -1))
                if not key[start, 2]:
                    parts.append((part.column("id"), vectors))
                    continue
                if block is None:
                    if not parts:
                        continue
                    found = pa.concat_arrays([p[0].cast(id_type) for p in parts])
                    block = found, found.to_numpy(zero_copy_only=False), np.concatenate([p[1] for p in parts])
                who_ids, step = part.column("query_id"), max(1, CELLS // len(block[1]))
                for a in range(0, len(vectors), step):
                    distance = np.floor((1 - vectors[a : a + step] @ block[2].T) * 1e6 + 0.5) / 1e6
                    names = who_ids.slice(a, len(distance))
                    if exclude_same:
                        distance[names.to_numpy(zero_copy_only=False)[:, None] == block[1][None, :]] = np.inf
                    # Rows of a block come in the order of ids, so their places decide ties.
                    who, which = _best(np.arange(len(block[1])), distance, k)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(who)), block[0].take(pa.array(which)), pa.array(distance[who, which])], schema=arrow)

    return tasks.mapInArrow(work, schema)


def _ranked(met: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False, exclude_same: bool = True) -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest indexed rows of each of `queries` (id, embedding).

    With `exact`, the k-th distance found so far says which other lists may hold a nearer row, and these are searched too.
    """
    on_path(queries.sparkSession)
    probes = min(probes or index.probes, len(index.centres))
    met = _met(index, _probed(index, queries, probes), k, exclude_same)
    if not exact:
        return _ranked(met, k)
    first = landing.cut(_ranked(met, k), "probed")
    limits = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("limit"))
    more = landing.cut(_probed(index, queries.select("id", "embedding").join(limits, "id", "left"), probes), "more")
    return _ranked(first.drop("rank").union(_met(index, more, k, exclude_same)), k)
