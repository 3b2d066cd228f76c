"""The index of inverted lists against full comparison."""

import numpy as np
import pytest

from newswarden.operators import ann, vectors
from newswarden.sources import landing


def table(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [float(x) for x in v]) for i, v in rows], "id long, embedding array<float>")


def clustered(n=3000, dims=16, groups=60):
    r = np.random.default_rng(3)
    centres = r.normal(size=(groups, dims))
    return [(i, centres[r.integers(groups)] + 0.15 * r.normal(size=dims)) for i in range(n)]


@pytest.fixture(scope="module")
def built(spark):
    e = table(spark, clustered()).cache()
    return e, ann.build(e, landing.scratch(spark, "index"))


def pairs(df):
    return {(r.query_id, r.id) for r in df.collect()}


def test_few_lists_give_the_recall(spark, built):
    e, index = built
    asked = e.where("id % 20 = 0")
    want, got = pairs(vectors.top_k(asked, e, 10)), pairs(ann.search(index, asked))
    assert len(want & got) >= 0.9 * len(want) and index.probes <= len(index.centres) // 3 and index.rows.sum() == 3000


def test_exact_search_is_full_comparison(spark, built, monkeypatch):
    e, index = built
    asked = e.where("id % 20 = 0")
    want = sorted(map(tuple, vectors.top_k(asked, e, 7).select("query_id", "id", "rank").collect()))
    for block in (ann.BLOCK, 20):
        monkeypatch.setattr(ann, "BLOCK", block)
        got = ann.search(index, asked, 7, probes=1, exact=True)
        assert sorted(map(tuple, got.select("query_id", "id", "rank").collect())) == want


def test_a_search_reads_the_probed_lists_alone(spark, built):
    e, index = built
    plan = ann._met(index, ann._probed(index, e.where("id = 5"), 2), 3, True)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and plan.count(" IN (") + plan.count("list#") > 0


def test_loaded_again_and_changed(spark):
    rows = clustered(400, 8, 9)
    index = ann.build(table(spark, rows), landing.scratch(spark, "index"), lists=8)
    moved = {i: -v for i, v in rows if i % 7 == 0}
    new = [*moved.items(), (9001, rows[3][1]), (9002, None), (9003, [1.0, 2.0])]
    index = ann.upsert(spark, index, table(spark, new))
    again = ann.load(spark, index.path)
    assert np.allclose(again.centres, index.centres) and again.probes == index.probes and again.rows.tolist() == index.rows.tolist()
    now = {i: moved.get(i, v) for i, v in rows} | {9001: rows[3][1]}
    kept = {r.id: r.embedding for r in again.table(spark).collect()}
    assert set(kept) == set(now) and all(np.allclose(kept[i], now[i], atol=1e-5) for i in now)
    e = table(spark, now.items())
    asked = e.where("id % 11 = 0")
    assert pairs(ann.search(again, asked, 5, exact=True)) == pairs(vectors.top_k(asked, e, 5))
    assert ann.upsert(spark, again, table(spark, [])) is again


def test_ties_nulls_and_one_hot_list(spark):
    """A third of all vectors are equal: they lie in one list, and the least ids win."""
    r = np.random.default_rng(1)
    rows = [(i, np.ones(4) if i % 3 == 0 else r.normal(size=4)) for i in range(600)] + [(700, None), (701, [1.0]), (702, np.zeros(4))]
    e = table(spark, rows)
    index = ann.build(e, landing.scratch(spark, "index"))
    assert index.rows.sum() == 601
    sound = table(spark, [x for x in rows if x[1] is not None and len(x[1]) == 4])
    asked = sound.where("id in (0, 3, 4, 702)")
    got = sorted(map(tuple, ann.search(index, asked, 4, exact=True).select("query_id", "id", "rank").collect()))
    assert got == sorted(map(tuple, vectors.top_k(asked, sound, 4).select("query_id", "id", "rank").collect()))
    assert [i for q, i, _ in got if q == 0] == [3, 6, 9, 12]


def test_few_rows(spark):
    index = ann.build(table(spark, [(1, [1.0, 0.0])]), landing.scratch(spark, "index"))
    assert ann.search(index, table(spark, [(1, [1.0, 0.0])])).collect() == []
    assert [(r.id, r.rank) for r in ann.search(index, table(spark, [(2, [1.0, 1.0])])).collect()] == [(1, 1)]
    with pytest.raises(ValueError):
        ann.build(table(spark, []), landing.scratch(spark, "index"))
