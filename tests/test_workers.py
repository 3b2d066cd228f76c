"""Python workers give the memory of large arrays back, so that reused ones stay small."""

import pyarrow as pa

from newswarden.functions import workers
from newswarden.llm import sp_bpe
from newswarden.llm.queries import SP_MODEL


def test_workers_start_with_fixed_limits(spark):
    workers.on_path(spark)

    def seen(batches):
        import os

        import pandas as pd
        import pyarrow as pa

        for _ in batches:
            yield pd.DataFrame({"name": [*workers.LEAN, "pool"], "value": [*(os.environ.get(x) for x in workers.LEAN), pa.default_memory_pool().backend_name]})

    found = {r.name: r.value for r in spark.range(1, numPartitions=1).mapInPandas(seen, "name string, value string").collect()}
    assert found == {**workers.LEAN, "pool": "system"}


def test_own_settings_stay(spark):
    environment = spark.sparkContext.environment
    before = dict(environment)
    environment["MALLOC_TRIM_THRESHOLD_"] = "1000000"
    workers.on_path(spark)
    assert environment["MALLOC_TRIM_THRESHOLD_"] == "1000000"
    environment.clear()
    environment.update(before)


def test_lean_returns_the_heap_when_the_rows_are_through(monkeypatch):
    done = []

    class Pool:
        def release_unused(self):
            done.append("released")

    def run(batches):
        for x in batches:
            done.append(x)
            yield x

    monkeypatch.setattr(pa, "system_memory_pool", Pool)
    assert list(workers.lean(run)(iter([1, 2]))) == [1, 2]
    assert done == [1, 2, "released"]


def test_encoding_leaves_no_segments_in_its_worker(spark):
    docs = spark.createDataFrame([(1, "some words of a text"), (2, "and others")], "doc_id long, text string").coalesce(1)
    seen = []

    class Frame:
        """Takes the function that the query hands to Spark."""

        schema, sparkSession = docs.schema, spark

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            seen.append(f)

    sp_bpe.encode_digests(Frame(), SP_MODEL)
    run = seen[0]

    def stored(batches):
        for batch in batches:
            list(run(iter([batch])))
            yield pa.RecordBatch.from_pydict({"n": [sp_bpe.load(SP_MODEL).n_segments]})

    assert [r.n for r in docs.mapInArrow(stored, "n long").collect()] == [0]
