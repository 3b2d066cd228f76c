"""Report writers, and a folder in the shared storage for files on their way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir or the checkpoint folder; with neither, only a session in one process gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="newswarden-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/landing/{name}-{uuid.uuid4().hex}"


def report(df: DataFrame, path: str, title: str | None = None) -> str:
    """`df` as JSON lines, for reports of any size; with `title` also a Markdown table beside it, for small ones (at most 1,000 rows)."""
    df.write.mode("overwrite").json(path)
    if title is not None:
        rows = df.limit(1001).collect()
        if len(rows) > 1000:
            raise ValueError("a Markdown report has at most 1,000 rows")
        cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
        lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
        spark = df.sparkSession
        spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.md")
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared storage, for what is read more than once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
