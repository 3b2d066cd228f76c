"""Pages reach the workers a few megabytes at a time, however many rows Spark would put into a batch."""

from pyspark.sql import functions as F

from newswarden.functions import readable, workers

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_pages_come_in_bounded_batches(spark):
    spark.conf.unset(NAME)
    pages = spark.createDataFrame([("<p>one</p>", "https://example.org/")], "html string, url string")
    assert [r.method for r in readable.extracted(pages).collect()] == ["fallback"]
    assert int(spark.conf.get(NAME)) <= workers.BATCH_BYTES
    spark.conf.set(NAME, "4096")
    readable.extracted(pages)
    assert spark.conf.get(NAME) == "4096"
    spark.conf.unset(NAME)
    size = F.pandas_udf("long")(_rows)
    workers.bounded(spark, 100_000)
    rows = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("x")).select(size("x").alias("n"))
    assert max(r.n for r in rows.collect()) < 50
    spark.conf.unset(NAME)


def _rows(x):
    import pandas as pd

    return pd.Series([len(x)] * len(x))


_rows.__annotations__ = {"x": __import__("pandas").Series, "return": __import__("pandas").Series}
