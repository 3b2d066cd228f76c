"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.workers import bounded, on_path


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster sets it, or the checkpoint folder of the context."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    # Only with driver and executors in one process, as in tests, is a local folder a shared one.
    found = tempfile.mkdtemp(prefix="newswarden-")
    spark.sparkContext.setCheckpointDir(found)
    return found


#: Bytes of an Arrow batch on its way to Python, so that long texts come a few at a time.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Before work in Python: batches bounded by bytes (Spark bounds rows alone; a lower setting stays), and this package on the workers' path."""
    bounded(spark, BATCH_BYTES)
    on_path(spark)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken, out = {c.lower() for f in frames for c in f.columns}, f"__nw_{name}"
    while out in taken:
        out += "_"
    return out


def fresh(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/newswarden/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy", **options: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    df.write.options(**options).parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._nw_path = path
    return out


#: Bytes of its source for a partition of a compact table.
PART_BYTES = 4 << 20


def compact(df: DataFrame, *sources: DataFrame) -> DataFrame:
    """`df` in no more partitions than the bytes of its sources (tables of `written`) call for, or four a core: a small one does not become a file a shuffle partition."""
    context = df.sparkSession.sparkContext
    return df.coalesce(max(4 * context.defaultParallelism, sum(_bytes(x) for x in sources) // PART_BYTES))


def _bytes(df: DataFrame) -> int:
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._nw_path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def drop(df: DataFrame) -> None:
    """Removes the files behind a table of `written` once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._nw_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stable(df: DataFrame) -> DataFrame:
    """`df` itself if its plan is a scan with projections and filters, else a table of it, for what reads it more than once."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    steps = [line.strip(" +-:").split(" ")[0].split("[")[0] for line in plan.splitlines() if line.strip()]
    return df if all(s in ("Relation", "Project", "Filter") for s in steps) else written(df, "stable")
