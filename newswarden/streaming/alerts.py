"""Alert suppression as a stateful stream: per event the last alert, kept for the suppression window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..context import DEFAULT, Context

OUT = "event_id long, at timestamp, tier string, reason string"


def suppressed(signals: DataFrame, context: Context = DEFAULT) -> DataFrame:
    """From (event_id, at, confirmed, material): the alerts that go out.

    The first signal of an event alerts; within the window after an alert only a
    material update or the step from early warning to confirmed does.
    """
    window = context.suppression_hours * 3600

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_at, last_tier = state.get if state.exists else (None, None)
        out = []
        for r in pd.concat(list(frames)).sort_values("at", kind="stable").itertuples():
            at, tier = r.at.timestamp(), "confirmed" if r.confirmed else "early_warning"
            if last_at is None or at - last_at >= window:
                reason = "confirmed_vendor_impact_event" if r.confirmed else "early_warning_unconfirmed_signal"
            elif r.material:
                reason = "material_update_bypasses_suppression"
            elif r.confirmed and last_tier == "early_warning":
                reason = "upgraded_to_confirmed"
            else:
                continue
            last_at, last_tier = at, tier
            out.append((key[0], r.at, tier, reason))
        if last_at is not None:
            state.update((last_at, last_tier))
            watermark = state.getCurrentWatermarkMs()
            state.setTimeoutTimestamp(max(int((last_at + window) * 1000), watermark + 1))
        yield pd.DataFrame(out, columns=["event_id", "at", "tier", "reason"])

    rows = signals.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", "10 minutes")
    return rows.groupBy("event_id").applyInPandasWithState(step, OUT, "at double, tier string", "append", GroupStateTimeout.EventTimeTimeout)
