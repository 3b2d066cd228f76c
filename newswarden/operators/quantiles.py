"""Exact quantiles of a whole table (A-05) and of all groups at once (A-06 to A-08), by narrowing the range that holds them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import landing
from . import skew

#: Rows that may be left in the range before their values are put in order, and the error of a narrowing step.
FEW, ERROR = 1_000_000, 0.001


def interpolated(df: DataFrame, column: str, q: float, few: int = FEW) -> float | None:
    """The quantile `q` of a numeric column, between its two nearest values; nulls and NaN don't count, nothing gives None.

    Approximate quantiles bound where it must be, and a count tells how many rows lie below; that goes on with the rows
    in between, each step a few thousandths of the one before, until `few` are left, whose distinct values are ordered.
    """
    rows = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    size = rows.count()
    if not size:
        return None
    place = q * (size - 1)
    wanted, before = (math.floor(place), math.ceil(place)), 0
    while size > few:
        ends = [max(0.0, (wanted[0] - before) / size - 2 * ERROR), min(1.0, (wanted[1] - before + 1) / size + 2 * ERROR)]
        a, b = rows.approxQuantile("v", ends, ERROR)
        n = rows.agg(F.count_if(F.col("v") < a).alias("below"), F.count_if(F.col("v") <= b).alias("upto")).first()
        if before + n.below > wanted[0] or before + n.upto <= wanted[1] or n.upto - n.below >= size:
            break  # no narrower: a few values make up the rest, and counting them is cheap
        rows, before, size = rows.where(F.col("v").between(a, b)), before + n.below, n.upto - n.below
    counted = rows.groupBy("v").agg(F.count("*").alias("n"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.orderBy("v")) + before)
    low, high = upto.agg(*(F.min(F.when(F.col("upto") > k, F.col("v"))) for k in wanted)).first()
    return low + (high - low) * (place - wanted[0])


#: Rows of a group that may be left in the range before they are put in order, points of a group's sketch, and its accuracy.
FEW_OF_GROUP, POINTS, ACCURACY = 10_000, 500, 5_000


def nearest_rank(q: float) -> Callable[[Column], Column]:
    """Places in the order are from 0, by the number of values."""
    return lambda n: F.greatest(F.ceil(F.lit(q) * n) - 1, F.lit(0))


def at_share(q: float, up: bool) -> Callable[[Column], Column]:
    """The value below, or with `up` above, the share `q` of the way from the first to the last."""
    return lambda n: (F.ceil if up else F.floor)(F.lit(q) * (n - 1))


def upper_middle(n: Column) -> Column:
    return F.floor(n / 2)


def of_groups(df: DataFrame, groups: list[str], column: str, places: dict[str, Callable[[Column], Column]], few: int = FEW_OF_GROUP) -> DataFrame:
    """The values at `places` (name to place by number of values) in each group, exactly: the group's columns, n, and a column for each name.

    Nulls and NaN don't count, and a group of them alone has no row. A sketch of each group, which is merged and of bounded
    size, gives three pivots around each place; counting what lies below and up to them tells which one is the value, or
    between which two it lies, and the next round looks there alone. A group of at most `few` values left is put in
    order. No state grows with a group, and a group's rows are spread over tasks by `skew.attach`.
    """
    names = list(places)
    base = df.select(*groups, F.to_json(F.struct(*groups)).alias("__g"), F.col(column).alias("v")).where("v is not null")
    if dict(base.dtypes)["v"] in ("double", "float"):
        base = base.where("not isnan(v)")
    rows = landing.cut(base.withColumn("__s", F.monotonically_increasing_id()), "values")
    sketch = F.percentile_approx("v", [k / POINTS for k in range(POINTS + 1)], ACCURACY).alias("points")
    sizes = rows.groupBy(*groups, "__g").agg(F.count("*").alias("n"))
    wanted = sizes.select("*", F.inline(F.array(*(F.struct(F.lit(k).alias("k"), places[name](F.col("n")).cast("long").alias("r")) for k, name in enumerate(names)))))
    none = F.lit(None).cast(rows.schema["v"].dataType)
    todo = landing.cut(wanted.select("__g", "k", "r", "n", F.col("n").alias("left"), none.alias("lo"), none.alias("hi"), none.alias("value")), "places")

    def within(targets: DataFrame, *more: str) -> DataFrame:
        """The rows of each target's range."""
        facts = targets.groupBy("__g").agg(F.max("n").alias("__n"), F.collect_list(F.struct("k", "lo", "hi", *more)).alias("t"))
        met = skew.attach(rows, facts, "__g", "__n", "__s").where("t is not null").select("__g", "v", F.inline("t"))
        return met.where((F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi"))))

    open_ = (F.col("value").isNull()) & (F.col("left") > few)
    while not todo.where(open_).isEmpty():
        points = within(todo.where(open_)).groupBy("__g", "k").agg(sketch)
        at = F.floor(F.col("r") / F.col("left") * POINTS).cast("int")
        near = [F.get("points", F.least(F.greatest(at + d, F.lit(0)), F.lit(POINTS))).alias(f"p{i}") for i, d in enumerate((-2, 0, 3))]
        tried = landing.cut(todo.where(open_).join(points, ["__g", "k"]).select("__g", "k", "r", "n", "lo", "hi", *near), "pivots")
        counted = within(tried, "p0", "p1", "p2").groupBy("__g", "k").agg(F.count("*").alias("all"), *(f(p) for p in ("p0", "p1", "p2") for f in (lambda p: F.count_if(F.col("v") < F.col(p)).alias(f"below_{p}"), lambda p: F.count_if(F.col("v") <= F.col(p)).alias(f"upto_{p}"))))
        c = tried.join(counted, ["__g", "k"])
        hit = F.coalesce(*(F.when((F.col(f"below_{p}") <= F.col("r")) & (F.col("r") < F.col(f"upto_{p}")), F.col(p)) for p in ("p0", "p1", "p2")))
        under = F.array_max(F.array(*(F.when(F.col(f"upto_{p}") <= F.col("r"), F.struct(F.col(p).alias("p"), F.col(f"upto_{p}").alias("c"))) for p in ("p0", "p1", "p2"))))
        over = F.array_min(F.array(*(F.when(F.col(f"below_{p}") > F.col("r"), F.struct(F.col(p).alias("p"), F.col(f"below_{p}").alias("c"))) for p in ("p0", "p1", "p2"))))
        c = c.withColumns({"value": hit, "under": under, "over": over})
        gone = F.coalesce(F.col("under.c"), F.lit(0))
        narrowed = c.select("__g", "k", (F.col("r") - gone).alias("r"), "n", (F.coalesce("over.c", "all") - gone).alias("left"), F.coalesce("under.p", "lo").alias("lo"), F.coalesce("over.p", "hi").alias("hi"), "value")
        todo = landing.cut(todo.where(~open_).union(narrowed), "places")
    rest = within(todo.where("value is null")).groupBy("__g", "k").agg(F.sort_array(F.collect_list("v")).alias("in_order"))
    done = todo.join(rest, ["__g", "k"], "left").select("__g", "k", F.coalesce("value", F.get("in_order", F.col("r").cast("int"))).alias("x"))
    each = done.groupBy("__g").agg(*(F.max(F.when(F.col("k") == k, F.col("x"))).alias(name) for k, name in enumerate(names)))
    return sizes.join(each, "__g").select(*groups, "n", *names)
