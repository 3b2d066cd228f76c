"""Shards: an exact round trip of all ids, a permutation of the slots, fixed strides, and resuming."""

import glob
import os
from hashlib import sha256

import numpy as np
import pytest

from newswarden.llm import sp_bpe, token_shards
from newswarden.llm.queries import SP_MODEL


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_order_is_a_keyed_permutation(n):
    x = np.arange(n)
    order = token_shards.Order(n, 5)
    assert sorted(order.slot(x)) == list(x) and (order.number(order.slot(x)) == x).all()
    assert n < 50 or (token_shards.Order(n, 6).slot(x) != order.slot(x)).mean() > 0.9


def test_round_trip(spark, tmp_path):
    model = sp_bpe.load(SP_MODEL)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(None, None, "c"), (7, "", "c"), (7, "", "c"), (8, "é\n\r" * 5000, "c")], "doc_id long, text string, slot string")
    for df in (docs, odd):
        shards = token_shards.materialise(df, SP_MODEL, 9, length=32, per_shard=100, path=str(tmp_path / df.columns[2]))
        rows = token_shards.read_back(spark, shards).collect()
        assert sorted(r.slot for r in rows) == list(range(shards.n)) and all(r.shard == r.slot // 100 for r in rows)
        files = glob.glob(f"{shards.path}/shard=*/part-*")
        assert len(files) == -(-shards.n // 100) and sum(os.path.getsize(f) for f in files) == shards.n * shards.stride
        found = {}
        for r in sorted(rows, key=lambda r: r.place):
            found.setdefault(r.doc_id, []).append(r.ids)
        want = {}
        for r in df.collect():
            ids = [*model.library.encode(r.text or ""), model.eos]
            want.setdefault(r.doc_id, []).extend(ids[i : i + 32] for i in range(0, len(ids), 32))
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
        short = {r.slot: (r.n_ids, r.ids_sha256) for r in token_shards.read_back(spark, shards, digests=True).collect()}
        assert short == {r.slot: (len(r.ids), sha256(np.array(r.ids, "<u2").tobytes()).hexdigest()) for r in rows}
        later = token_shards.read_back(spark, shards, first=3).collect()
        assert sorted(r.slot for r in later) == list(range(3, shards.n))


def test_shuffled_input_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string").repartition(3)
    shards = token_shards.materialise(docs, SP_MODEL, 1, length=8, per_shard=16, path=str(tmp_path / "a"))
    assert shards.n == 50 and {r.doc_id for r in token_shards.read_back(spark, shards).collect()} == set(range(50))
    none = token_shards.materialise(docs.limit(0), SP_MODEL, 1, path=str(tmp_path / "b"))
    assert none.n == 0 and token_shards.read_back(spark, none).collect() == []
