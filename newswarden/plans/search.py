"""The vector index: searches through lists, recall against full comparison, and changes (V-05, S-20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ann, vectors
from ..sources import landing
from .domain import _DISTANCE
from .registry import query

_C = F.col
_K = 10
#: Recall that the registered searches must reach, and the recall that their index is built for.
LEAST, AIMED = 0.9, 0.97


def _index(t):
    e = t.embeddings.select(_C("vec_id").alias("id"), "embedding")
    return e, ann.build(e, landing.scratch(t.spark, "index"), k=_K, recall=AIMED)


@query("v_05_index_exact", f"""WITH d AS (SELECT q.vec_id AS query_id, b.vec_id AS id, {_DISTANCE} AS distance FROM embeddings q JOIN embeddings b ON b.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
  SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) WHERE rank <= {_K}""")
def _(t):
    """Through the lists, and on to those that may hold something nearer: the rows of a full comparison."""
    e, index = _index(t)
    return ann.search(index, e.where("id % 100 = 0"), _K, probes=max(1, index.probes // 2), exact=True).select("query_id", "id", _C("rank").cast("long").alias("rank"))


@query("v_05_index_search")
def _(t):
    """Through the lists alone."""
    e, index = _index(t)
    return ann.search(index, e.where("id % 100 = 0"), _K).select("query_id", "id", "distance", _C("rank").cast("long").alias("rank"))


@query("v_05_index_recall", f"SELECT count(*) AS indexed, count(*) FILTER (vec_id % 100 = 0) AS asked, count(*) FILTER (vec_id % 100 = 0) * least({_K}, count(*) - 1) AS wanted, true AS reached FROM embeddings")
def _(t):
    """Rows in the index, queries, their true neighbours, and whether the lists found enough of these."""
    e, index = _index(t)
    asked = e.where("id % 100 = 0")
    true = vectors.top_k(asked, e, _K).select("query_id", "id")
    found = ann.search(index, asked, _K).select("query_id", "id", F.lit(1).alias("hit"))
    hit = true.join(found, ["query_id", "id"], "left").agg(F.count("*").alias("wanted"), F.count("hit").alias("hit"))
    counts = index.table(t.spark).agg(F.count("*").alias("indexed"), F.count_if(_C("id") % 100 == 0).alias("asked"))
    return counts.crossJoin(F.broadcast(hit)).select("indexed", "asked", "wanted", (_C("hit") >= LEAST * _C("wanted")).alias("reached"))


@query("s_20_vector_upsert", """SELECT vec_id AS id, round(CAST(CASE WHEN vec_id % 3 = 0 THEN -embedding[1] ELSE embedding[1] END AS DOUBLE), 5) AS first, count(*) OVER () AS rows FROM embeddings""")
def _(t):
    """An index of the ids not divisible by five, then the others and every third turned round as changes."""
    e = t.embeddings.select(_C("vec_id").alias("id"), "embedding")
    index = ann.build(e.where("id % 5 <> 0"), landing.scratch(t.spark, "index"))
    turned = F.when(_C("id") % 3 == 0, F.transform("embedding", lambda x: -x)).otherwise(_C("embedding"))
    index = ann.upsert(t.spark, index, e.where("id % 5 = 0 or id % 3 = 0").withColumn("embedding", turned))
    rows = index.table(t.spark)
    return rows.join(F.broadcast(rows.agg(F.count("*").alias("rows"))), how="cross").select("id", F.round(F.get("embedding", 0).cast("double"), 5).alias("first"), "rows")
