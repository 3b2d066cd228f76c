"""Python workers find this package even where they start in another folder, get batches bounded by bytes, and give freed memory back."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_BYTES = 8 << 20
ROOT = str(Path(__file__).resolve().parents[2])
#: Else a reused worker keeps what its largest arrays took: glibc raises its limits with each one freed, and Arrow's pool has its own store.
LEAN = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def on_path(spark: SparkSession | None = None) -> None:
    environment = (spark or SparkSession.active()).sparkContext.environment
    path = environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    for name, value in LEAN.items():
        environment.setdefault(name, value)


def bounded(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Arrow batches of at most so many bytes (Spark bounds rows alone); a lower setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > most:
        spark.conf.set(name, str(most))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, after which the worker returns its free heap: what lies below the heap's end stays with malloc else."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.system_memory_pool().release_unused()

    return work
