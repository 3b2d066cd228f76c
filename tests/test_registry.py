"""The stream of open events gives the rows of the batch, in batches of any cut and after restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newswarden.operators import events
from newswarden.streaming import registry

START = dt.datetime(2024, 1, 1)


def made(n=160):
    r = random.Random(6)
    rows = [(i, r.choice(["cve:a", "cve:b", "acme::breach", "unknown", None]), START + dt.timedelta(minutes=r.randrange(60 * 24 * 40))) for i in range(n)]
    edge = START + dt.timedelta(days=1)
    return rows + [(1000, "edge", edge), (1001, "edge", edge + dt.timedelta(hours=48)), (1002, "edge", edge + dt.timedelta(hours=95, minutes=59)), (1003, "edge", edge + dt.timedelta(hours=95, minutes=59))]


def brute(rows, quiet, until):
    out, open_ = [], {}
    close = lambda e: out.append((None, e[0], "close", e[2] + quiet, e[1]))
    for i, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        if key in (None, "unknown"):
            out.append((i, i, "create", at, 1))
            continue
        e = open_.get(key)
        if e and at - e[2] >= quiet:
            close(e)
            e = None
        open_[key] = (e[0], e[1] + 1, at) if e else (i, 1, at)
        out.append((i, open_[key][0], "attach" if e else "create", at, open_[key][1]))
    for e in open_.values():
        if e[2] + quiet <= until:
            close(e)
    return sorted(out, key=str)


def test_batch(spark):
    rows = made()
    df = spark.createDataFrame(rows, "article_id long, grouping_key string, seen_at timestamp")
    until = START + dt.timedelta(days=39)
    got = events.group_until_quiet(df, 48, F.lit(until.isoformat()).cast("timestamp"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, dt.timedelta(hours=48), until)
    assert events.group_until_quiet(df.limit(0), 48).collect() == []


@pytest.mark.parametrize("cuts", [[160], [20, 30, 90]])
def test_stream_is_the_batch(spark, tmp_path, cuts):
    """Batches in the order of time but for what comes an hour late; each a run of its own with the same checkpoint."""
    rows = sorted(made(), key=lambda r: r[2])
    end = START + dt.timedelta(days=400)
    bounds = [0, *cuts, len(rows)]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "article_id long, grouping_key string, seen_at timestamp"
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        part = rows[a:b] + ([(-1, "end", end)] if b == len(rows) else [])
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        stream = registry.open_events(spark.readStream.schema(schema).parquet(source), 48, late="1 hour")
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(out).collect() if r.event_id != -1), key=str)
    assert got == brute(rows, dt.timedelta(hours=48), end)
