"""Building blocks of portals, queues and catalogues (P, J, A, O, U)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_keys(df: DataFrame, key: str, keys: list) -> DataFrame:
    """Rows of the listed keys in the list's order, with their place; a key that isn't there fails the job."""
    wanted = df.sparkSession.createDataFrame([(k, v) for k, v in enumerate(keys)], f"pos int, {key} {df.schema[key].dataType.simpleString()}")
    found = wanted.join(df.withColumn("__there", F.lit(True)), key, "left")
    checked = F.when(F.col("__there"), F.col("pos")).otherwise(F.raise_error(F.concat(F.lit("no row for key "), F.col(key).cast("string"))).cast("int"))
    return found.withColumn("pos", checked).drop("__there").orderBy("pos")


def filtered(df: DataFrame, **equal) -> DataFrame:
    """Rows that equal each given value; None asks for nothing."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def search(needle: str | None, *columns: str) -> Column:
    """Case-insensitive search in any column; % and _ in the needle are wildcards; no needle matches all."""
    if not needle:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{needle}%"), F.lit(False))
    return out


def other_than(column: str, value) -> Column:
    return F.lit(True) if value is None else F.col(column) != value


def with_flag(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Whether `other` has the row's keys, as a column."""
    return df.join(other.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def children(links: DataFrame, keys: list[str], child: str, name: str) -> DataFrame:
    return links.groupBy(*keys).agg(F.sort_array(F.collect_list(child)).alias(name))


def pairs_within(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Unordered pairs of items of one group: (group, a, b). For labelled baskets, which are small."""
    a = rows.select(group, F.col(item).alias("a"))
    b = rows.select(group, F.col(item).alias("b"))
    return a.join(b, group).where("a < b")


def pairs_across(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Unordered pairs of items of different groups. For labelled baskets, which are small."""
    a = rows.select(F.col(group).alias("ga"), F.col(item).alias("a"))
    b = rows.select(F.col(group).alias("gb"), F.col(item).alias("b"))
    return a.join(b, (F.col("ga") != F.col("gb")) & (F.col("a") < F.col("b"))).select("a", "b")


def pair_counts(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(group, within, across): unordered pairs of different items inside each group, and between it and all others.

    Counted from how often each item is in each group, so no pair becomes a row. A pair across groups counts for both.
    """
    m = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group, item).agg(F.count("*").alias("m"))
    shared = m.groupBy(item).agg(F.sum("m").alias("all"))
    by = m.join(shared, item).groupBy(group).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * (F.col("all") - F.col("m"))).alias("both"))
    total = m.agg(F.sum("m").alias("total"))
    within = ((F.col("n") * F.col("n") - F.col("mm")) / 2).cast("long")
    return by.crossJoin(F.broadcast(total)).select(group, within.alias("within"), (F.col("n") * (F.col("total") - F.col("n")) - F.col("both")).alias("across"))


def numbered(rows: DataFrame, column: str, parts: int = 32) -> DataFrame:
    """`rows` with `place`, from 0 in the order of a numeric `column` (nulls last), by ranges between its quantiles: no task sorts all rows."""
    c = F.col(column)
    bounds = sorted(set(rows.approxQuantile(column, [k / parts for k in range(1, parts)], 0.001)))
    dealt = rows.withColumn("_part", sum((F.coalesce((c > b).cast("int"), F.lit(1)) for b in bounds), F.lit(0)) + c.isNull().cast("int"))
    sizes, before = {r._part: r.n for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}, {}
    for k in sorted(sizes):
        before[k] = sum(sizes[j] for j in before)
    offset = F.coalesce(*(F.when(F.col("_part") == k, F.lit(n)) for k, n in before.items())) if before else F.lit(0)
    return dealt.withColumn("place", F.row_number().over(Window.partitionBy("_part").orderBy(c)) - 1 + offset).drop("_part")


def band(distance: Column, same: float, unsure: float) -> Column:
    return F.when(distance <= same, "same").when(distance <= unsure, "uncertain").otherwise("different")


def distribution(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts of a fixed domain's values, zeros too."""
    values = df.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    return values.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").na.fill(0, ["n"])


def top_groups(df: DataFrame, key: str, example: str, n: int, examples: int = 3) -> DataFrame:
    """The n most frequent keys with their first examples, kept by a bounded aggregate."""
    w = Window.partitionBy(key).orderBy(example)
    some = df.select(key, example).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= examples).groupBy(key).agg(F.sort_array(F.collect_list(example)).alias("examples"))
    top = df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key).limit(n)
    return top.join(some, key)


# The sort menu of the catalogue.
_MENU = {
    "recent": lambda: [F.col("published_at").desc_nulls_last()],
    "quality_asc": lambda: [F.col("content_quality").asc_nulls_last()],
    "recall_asc": lambda: [F.col("rss_recall").asc_nulls_last()],
    "vendor_desc": lambda: [F.col("vendor").desc_nulls_last()],
}


def page(df: DataFrame, sort: str, *, limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    """One page in the menu's order, newer ids first in ties; the limit is kept from 1 to `most`."""
    order = _MENU.get(sort, _MENU["recent"])()
    return df.orderBy(*order, F.col("id").desc()).offset(max(0, offset)).limit(min(max(1, limit), most))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Adds the place in the order. For results of bounded size: the order is one sequence."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def with_selected(df: DataFrame, key: str, selected, n: int, order: Column) -> DataFrame:
    """The first n rows, and the selected one wherever it stands."""
    return df.orderBy(order).limit(n).union(df.where(F.col(key) == selected)).distinct()


def overridden(base: DataFrame, over: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Union by key in which `over` wins and its own keys are added."""
    o = over.withColumnRenamed(column, "__over")
    return base.join(o, keys, "full").select(*keys, F.coalesce("__over", column).alias(column))


def distinct_caseless(values: Column) -> Column:
    """First casing of each value, in order."""
    seen = lambda acc, x: F.exists(acc, lambda y: F.lower(y) == F.lower(x))
    return F.aggregate(values, F.array().cast("array<string>"), lambda acc, x: F.when(seen(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
