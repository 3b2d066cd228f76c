"""The k nearest by matrix products in blocks, against every pair."""

import numpy as np

from newswarden.operators import vectors


def test_ties_other_lengths_and_missing_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(300)] + [(k, [1.0, float(k)]) for k in range(300, 310)] + [(310, None), (None, [1.0, 0.0, 0.0, 0.0]), (311, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    known = {k: np.array(v) for k, v in rows if k is not None and v is not None}
    unit = {k: v / (np.linalg.norm(v) or 1.0) for k, v in known.items()}

    def brute(q):
        found = sorted((float(np.floor((1 - unit[q] @ unit[b]) * 1e6 + 0.5) / 1e6), b) for b in unit if b != q and len(unit[b]) == len(unit[q]))
        return [b for _, b in found[:6]]

    for blocks in (None, 1, 7):
        got = {}
        for r in vectors.top_k(df.where("id % 10 = 0 or id is null"), df, 6, blocks=blocks).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == {q: brute(q) for q in unit if q % 10 == 0}


def test_pairs_are_no_rows(spark):
    df = spark.range(50).selectExpr("id", "array(cast(id as float), 1f) AS embedding")
    assert "Join" not in vectors.top_k(df, df, 3)._jdf.queryExecution().optimizedPlan().toString()
