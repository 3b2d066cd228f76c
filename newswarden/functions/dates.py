"""Times relative to an explicit `as_of` (D in the survey)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def hours(a: Column, b: Column) -> Column:
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 3.6e9


def recent(ts: Column, as_of: str, within_hours: float = 24) -> Column:
    """A time to come is recent; an unknown one is not."""
    return F.coalesce(hours(moment(as_of), ts) <= within_hours, F.lit(False))


def old(ts: Column, as_of: str, days: float = 14) -> Column:
    return F.coalesce(hours(moment(as_of), ts) > 24 * days, F.lit(False))


def day_in(ts: Column, zone: str = "Asia/Hong_Kong") -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd"), F.lit(""))
