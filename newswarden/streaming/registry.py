"""The registry of open events as keyed state: articles open events or attach to them, and timers close what stays quiet.

An event of a grouping key is open from its first article until `quiet` hours have passed
since its last; the next article of the key then opens another. Rows wait in the state
until the watermark has passed them and are taken in the order of time and id, so a stream
gives the rows of `events.group_until_quiet` however its batches were cut, and goes on from
its checkpoint. Rows that come later than the watermark allows are dropped by Spark.

The unknown key opens an event for each article; such rows need no state and pass by it.
State of a key goes when its event closes and nothing waits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.workers import on_path

OUT = "article_id long, event_id long, kind string, at timestamp, articles long"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ready(spark: SparkSession) -> None:
    """Keyed state with timers needs this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    on_path(spark)


def _ms(at: pd.Timestamp) -> int:
    return at.value // 1_000_000


class OpenEvents(StatefulProcessor):
    """Value state `event` (creator, articles, last moment in microseconds) and list state `waiting` (article, moment)."""

    def __init__(self, quiet_us: int):
        self.quiet = quiet_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.event = handle.getValueState("event", "creator long, articles long, last long")
        self.waiting = handle.getListState("waiting", "article long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.article_id), r.seen_at.value // 1000) for frame in rows for r in frame.itertuples()]
        self.waiting.appendList(new)
        self._wake(min(at for _, at in new))
        yield pd.DataFrame([], columns=["article_id", "event_id", "kind", "at", "articles"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(((at, article) for article, at in self.waiting.get()) if self.waiting.exists() else [])
        due, later = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        now, out = (self.event.get() if self.event.exists() else None), []

        def closed() -> None:
            out.append((None, now[0], "close", now[2] + self.quiet, now[1]))

        for at, article in due:
            if now is not None and at - now[2] >= self.quiet:
                closed()
                now = None
            fresh = now is None
            now = (article, 1, at) if fresh else (now[0], now[1] + 1, at)
            out.append((article, now[0], "create" if fresh else "attach", at, now[1]))
        if now is not None and now[2] + self.quiet <= passed:
            closed()
            now = None
        if now is None:
            self.event.clear()
        else:
            self.event.update(now)
            self._wake(now[2] + self.quiet)
        if later:
            self.waiting.put([(article, at) for at, article in later])
            self._wake(later[0][0])
        else:
            self.waiting.clear()
        frame = pd.DataFrame(out, columns=["article_id", "event_id", "kind", "at", "articles"])
        yield frame.astype({"article_id": "Int64"}).assign(at=pd.to_datetime(frame["at"], unit="us"))

    def _wake(self, at_us: int) -> None:
        self.handle.registerTimer(-(-at_us // 1000))

    def close(self) -> None:
        """Nothing is held beside the state."""


def open_events(drafts: DataFrame, quiet_hours: float = 24 * 30, late: str = "10 minutes") -> DataFrame:
    """From a stream of (article_id, grouping_key, seen_at): what each article did, and events that closed.

    Columns: article_id (null for a close), event_id (its first article), kind (create, attach, close), at, articles so far.
    """
    ready(drafts.sparkSession)
    rows = drafts.select("article_id", "grouping_key", F.col("seen_at").cast("timestamp").alias("seen_at"))
    known = rows.where("grouping_key <> 'unknown'").withWatermark("seen_at", late)
    kept = known.groupBy("grouping_key").transformWithStateInPandas(statefulProcessor=OpenEvents(int(quiet_hours * 3_600_000_000)), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
    lone = rows.where("grouping_key is null or grouping_key = 'unknown'").select("article_id", F.col("article_id").alias("event_id"), F.lit("create").alias("kind"), F.col("seen_at").alias("at"), F.lit(1).cast("long").alias("articles"))
    return kept.unionByName(lone)
