"""The layout of a hot subset: what is read and what is skipped."""

import glob

from pyspark.sql import functions as F

from newswarden.sources import hot


def metrics(df):
    """Files and rows that the scan read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if hasattr(plan, "executedPlan") and plan.getClass().getSimpleName().startswith("Adaptive") else plan
    leaf = plan.collectLeaves().apply(0)
    found = leaf.metrics()
    return found.apply("numFiles").value(), found.apply("numOutputRows").value()


def test_files_and_row_groups_are_skipped(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.range(20_000).selectExpr("id", "concat('s', id % 50) AS source", "if(id % 10 = 0, id * 3, null) AS extracted", "uuid() AS text")
    hot.write(df, path, F.col("extracted").isNotNull(), ["source", "extracted"], ["id"], files=60)
    assert hot.read(spark, path).count() == 20_000 and hot.read(spark, path, True).count() == 2_000 and "hot" not in hot.read(spark, path).columns
    files = glob.glob(f"{path}/hot=true/*.parquet"), glob.glob(f"{path}/hot=false/*.parquet")
    asked = hot.read(spark, path, True).where("source = 's10'").select("id", "extracted")
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hot" in plan and "PushedFilters: [IsNotNull(source), EqualTo(source,s10)]" in plan
    read, rows = metrics(asked)
    assert read == len(files[0]) < len(files[0]) + len(files[1]) and sorted(r.id for r in asked.collect()) == [k for k in range(0, 20_000, 10) if k % 50 == 10]
    # Ordered files: only those whose range has the source give rows to the filter.
    assert rows < 2_000


def test_null_predicates_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "id int, flag boolean")
    hot.write(df, str(tmp_path / "a"), F.col("flag"), ["id"])
    assert [r.id for r in hot.read(spark, str(tmp_path / "a"), True).collect()] == [2]
    assert sorted(r.id for r in hot.read(spark, str(tmp_path / "a"), False).collect()) == [1, 3]
