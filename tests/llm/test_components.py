"""Components: what is settled takes no round, and small tables stay a few files."""

import random

from newswarden.llm import components, shared


def _roots(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def _names(monkeypatch):
    names, written = [], shared.written
    monkeypatch.setattr(shared, "written", lambda df, name, *a, **k: (names.append(name), written(df, name, *a, **k))[1])
    return names


def test_stars_to_the_least_are_settled_from_the_start(spark, monkeypatch):
    names = _names(monkeypatch)
    links = [(k, k % 3) for k in range(3, 40)] + [(7, 7)]
    found = components.components(spark.createDataFrame(links, "a int, b int"), "a", "b")
    assert {r.node: r.root for r in found.collect()} == _roots(links[:-1])
    assert names == ["links"]


def test_chains_and_random_links_settle(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)]
    links = [(a, b) for a, b in links if a != b]
    rows = components.components(spark.createDataFrame(links, "a int, b int"), "a", "b").collect()
    assert {r.node: r.root for r in rows} == _roots(links) and len(rows) == len(_roots(links))


def test_small_tables_become_few_files(spark):
    source = shared.written(spark.range(100), "source")
    dealt = source.repartition(300, "id")
    assert shared.compact(dealt, source).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
