"""Append-only logs: latest rows, changes, publication and case read models (W, K-15 to K-18, O-07, O-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers

TERMINAL = ("ok", "not_found", "no_score")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`. One hash aggregation with partial results, no sort; whole rows travel as one struct."""
    key = [F.col(k) for k in keys]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("__last"))
    return best.select("__last.*")


def first_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def terminal(observations: DataFrame) -> DataFrame:
    return observations.where(F.col("status").isin(*TERMINAL))


def changes(observations: DataFrame) -> DataFrame:
    """Terminal rows whose status or value differs from the one before of the same case and source."""
    w = Window.partitionBy("case_id", "source").orderBy("retrieved_at", "id")
    t = terminal(observations).withColumns({"__status": F.lag("status").over(w), "__value": F.lag("value").over(w)})
    return t.where(~F.col("status").eqNullSafe(F.col("__status")) | ~F.col("value").eqNullSafe(F.col("__value"))).drop("__status", "__value")


def skim(cases: DataFrame, observations: DataFrame, statuses: tuple[str, ...] | None = TERMINAL) -> DataFrame:
    """Every case with its latest value and status by source as columns; None as `statuses` takes any status."""
    rows = observations.where(F.col("status").isin(*statuses)) if statuses else observations
    last = latest(rows, ["case_id", "source"], ["retrieved_at", "id"])
    wide = last.groupBy("case_id").agg(*(F.max(F.when(F.col("source") == s, F.col(c))).alias(f"{s}_{c}") for s in ("nvd", "kev", "epss") for c in ("status", "value")))
    return cases.join(wide, cases["id"] == wide["case_id"], "left").drop("case_id")


def scores(wide: DataFrame) -> DataFrame:
    """CVSS base (0 to 10), KEV listing and EPSS (0 to 1) of the fixture's values; only of rows with status ok."""
    ok = lambda s: F.col(f"{s}_status") == "ok"
    return wide.withColumns({"cvss": F.when(ok("nvd"), F.least(F.col("nvd_value") / 10, F.lit(10.0))), "kev": F.coalesce(ok("kev") & (F.col("kev_value") > 20), F.lit(False)), "epss": F.when(ok("epss"), F.least(F.col("epss_value") / 100, F.lit(1.0)))})


def publication(scored: DataFrame) -> DataFrame:
    """Approve from CVSS 9 or a KEV listing on, else draft; and whether that changes the status."""
    meets = F.coalesce(F.col("cvss") >= 9, F.lit(False)) | F.col("kev")
    action = F.when(meets & (F.col("status") != "approved"), "publish").when(~meets & (F.col("status") == "approved"), "unpublish").otherwise("unchanged")
    return scored.withColumns({"meets_rule": meets, "action": action})


def graded(scored: DataFrame) -> DataFrame:
    return scored.withColumns({"cvss_grade": numbers.cvss_grade(F.col("cvss")), "epss_grade": numbers.epss_grade(F.col("epss"), F.lit(None).cast("double"))})


def unresolved(scored: DataFrame) -> DataFrame:
    """Sources whose latest fetch is missing or failed."""
    states = [F.when(F.coalesce(F.col(f"{s}_status"), F.lit("failed")).isin("failed", "transient_failure"), F.concat(F.lit(f"{s}:"), F.coalesce(f"{s}_status", F.lit("failed")))) for s in ("nvd", "kev", "epss")]
    return scored.withColumn("unresolved", F.array_compact(F.array(*states)))


def attention(mode: str = "spec") -> list[Column]:
    """Order of the work queue. `compat` sorts by a string of the inverted base, in which 8.5 comes before 9.8."""
    base = F.coalesce("cvss", F.lit(-1.0))
    severity = [base.desc()] if mode == "spec" else [F.format_string("%.6f", 1 - base).asc()]
    return [F.col("kev").desc(), F.coalesce("epss", F.lit(-1.0)).desc(), *severity, F.col("id").asc()]


def public_order(seen: str) -> list[Column]:
    return [dates.day_in(F.col(seen)).desc(), F.col("kev").desc(), F.coalesce("epss", F.lit(-1.0)).desc(), F.coalesce("cvss", F.lit(-1.0)).desc(), F.col("cve_id").asc()]
