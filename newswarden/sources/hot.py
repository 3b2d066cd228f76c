"""Tables laid out for a hot subset, as partial indexes are for (P-11).

The rows that a predicate holds for lie in a partition of their own, ordered by what they
are looked up by, with Bloom filters on the columns that are looked up by equality. A
reader that asks for the subset lists its files alone, skips row groups by their least and
greatest values, and pages by the filters. Both parts together are the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file at most.
FILE_ROWS = 2_000_000


def write(df: DataFrame, path: str, predicate: Column, cluster: list[str], bloom: list[str] = (), files: int = 8) -> None:
    """`df` under `path`: rows with `predicate` (null is no) as `hot=true`, each part dealt by ranges of `cluster` and ordered by it."""
    rows = df.withColumn("hot", F.coalesce(predicate, F.lit(False)))
    out = rows.repartitionByRange(files, "hot", *cluster).sortWithinPartitions("hot", *cluster).write.partitionBy("hot").option("maxRecordsPerFile", FILE_ROWS)
    for c in bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(path)


def read(spark: SparkSession, path: str, hot: bool | None = None) -> DataFrame:
    """The hot rows, the others, or with None all of them, without the mark."""
    df = spark.read.parquet(path)
    return (df if hot is None else df.where(F.col("hot") == hot)).drop("hot")
