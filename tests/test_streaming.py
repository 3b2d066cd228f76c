"""Streams give what the batch gives."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newswarden.fixtures import Tables
from newswarden.operators import filtering, merges
from newswarden.streaming import alerts, sweeps

DIR = "/root/testdata/sf0.001"


def test_filter_stream_equals_batch(spark, tmp_path):
    articles = Tables(spark, DIR).articles.select("id", "title", "rss_summary", "source_name", "published_at", "fetched_at")
    articles.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = sweeps.filtered(sweeps.source(spark, str(tmp_path / "in"), articles.schema, files=1))
    q = sweeps.started(stream.select("id", "decision", "score").writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "c"))
    q.awaitTermination(120)
    want = sorted(map(tuple, filtering.decide(articles).select("id", "decision", "score").collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


def test_merge_sink_equals_batch_upsert(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang", "n_chars")
    for k in range(3):
        docs.where(F.col("doc_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    docs.where("doc_id < 9").withColumn("n_chars", F.col("n_chars") * 0 - 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink = sweeps.merged_by(str(tmp_path / "t"), lambda old, new: merges.upsert(old, new, ["doc_id"], ["n_chars"]))
    q = sweeps.started(sweeps.source(spark, str(tmp_path / "in"), docs.schema, files=1).writeStream.foreachBatch(sink), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert sweeps.latest_snapshot(spark, str(tmp_path / "t")).groupBy("doc_id").count().where("count > 1").count() == 0
    assert sweeps.latest_snapshot(spark, str(tmp_path / "t")).count() == docs.count()


def test_windows(spark, tmp_path):
    obs = Tables(spark, DIR).observations.select("id", "source", "value", "retrieved_at").orderBy("retrieved_at").coalesce(1)
    obs.write.parquet(str(tmp_path / "in"))
    stream = sweeps.observed(sweeps.source(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema))
    q = sweeps.started(stream.writeStream.outputMode("complete").format("memory").queryName("windows"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == obs.count()


def test_alert_suppression(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = lambda h: t0 + timedelta(hours=h)
    rows = [(1, at(0), False, False), (1, at(1), False, False), (1, at(2), True, False), (1, at(3), True, False), (1, at(4), False, True), (1, at(11), False, False), (2, at(0), True, False)]
    df = spark.createDataFrame(rows, "event_id long, at timestamp, confirmed boolean, material boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sweeps.started(alerts.suppressed(sweeps.source(spark, str(tmp_path / "in"), df.schema)).writeStream.outputMode("append").format("memory").queryName("sent"), str(tmp_path / "c"))
    q.awaitTermination(120)
    got = sorted((r.event_id, r.at, r.reason) for r in spark.table("sent").collect())
    assert got == [(1, at(0), "early_warning_unconfirmed_signal"), (1, at(2), "upgraded_to_confirmed"), (1, at(4), "material_update_bypasses_suppression"), (1, at(11), "early_warning_unconfirmed_signal"), (2, at(0), "confirmed_vendor_impact_event")]
