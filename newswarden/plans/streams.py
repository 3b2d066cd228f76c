"""Open events, as a batch and as a stream with state and timers (K-11, 2.14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities, events
from ..sources import landing
from ..streaming import registry
from .domain import _ENT
from .registry import query

_C = F.col
_QUIET, _END = 36, "2024-06-01 00:00:00"
_OPEN = f"""WITH {_ENT}, ds AS (SELECT dr.article_id, dr.grouping_key AS k, a.fetched_at AS seen FROM dr JOIN v_articles a ON a.id = dr.article_id),
  st AS (SELECT *, CASE WHEN lag(seen) OVER w IS NULL OR epoch(seen) - epoch(lag(seen) OVER w) >= {_QUIET} * 3600 THEN 1 ELSE 0 END AS opens FROM ds WHERE k <> 'unknown' WINDOW w AS (PARTITION BY k ORDER BY seen, article_id)),
  se AS (SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY seen, article_id) AS part FROM st),
  me AS (SELECT *, first_value(article_id) OVER v AS event_id, row_number() OVER v AS n FROM se WINDOW v AS (PARTITION BY k, part ORDER BY seen, article_id))
  SELECT article_id, event_id, CASE WHEN opens = 1 THEN 'create' ELSE 'attach' END AS kind, CAST(epoch(seen) AS BIGINT) AS "at", n AS articles FROM me
  UNION ALL SELECT article_id, article_id, 'create', CAST(epoch(seen) AS BIGINT), 1 FROM ds WHERE k = 'unknown'
  UNION ALL SELECT NULL, event_id, 'close', CAST(epoch(max(seen)) AS BIGINT) + {_QUIET} * 3600, count(*) FROM me GROUP BY k, event_id"""


def _drafts(t):
    d = entities.drafts(entities.extract(t.articles)).select("article_id", "grouping_key")
    return d.join(t.articles.select(_C("id").alias("article_id"), _C("fetched_at").cast("timestamp").alias("seen_at")), "article_id")


def _shown(df):
    return df.select("article_id", "event_id", "kind", F.unix_seconds("at").alias("at"), "articles")


@query("k_11_until_quiet", _OPEN)
def _(t):
    return _shown(events.group_until_quiet(_drafts(t), _QUIET, F.lit(_END).cast("timestamp")))


@query("k_11_event_stream", _OPEN)
def _(t):
    """The same by the stream: drafts in two halves of time, each a run with the same checkpoint, and one far later that closes what is open."""
    spark = t.spark
    rows = landing.cut(_drafts(t), "drafts")
    middle = rows.agg(F.timestamp_seconds(F.avg(F.unix_seconds("seen_at"))).alias("m"))
    halves = rows.join(F.broadcast(middle), how="cross").withColumn("late", _C("seen_at") >= _C("m")).drop("m")
    end = spark.range(1).select(F.lit(-1).cast("long").alias("article_id"), F.lit("end of the stream").alias("grouping_key"), F.lit(_END).cast("timestamp").alias("seen_at"))
    source, out, state = (landing.scratch(spark, x) for x in ("drafts", "events", "state"))
    for part in (halves.where("not late").drop("late"), halves.where("late").drop("late").union(end)):
        part.write.mode("append").parquet(source)
        stream = registry.open_events(spark.readStream.schema(rows.schema).parquet(source), _QUIET)
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return _shown(spark.read.parquet(out).where("event_id <> -1"))
