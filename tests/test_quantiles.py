"""Values at places of groups against sorting, with the limit so low that ranges are narrowed."""

import math
import random

import pytest

from newswarden.operators import quantiles

PLACES = {"p90": quantiles.nearest_rank(0.9), "p0": quantiles.nearest_rank(0.0), "low": quantiles.at_share(0.5, False), "high": quantiles.at_share(0.5, True), "middle": quantiles.upper_middle}


def want(values):
    v, n = sorted(values), len(values)
    at = [max(math.ceil(0.9 * n) - 1, 0), 0, math.floor(0.5 * (n - 1)), math.ceil(0.5 * (n - 1)), n // 2]
    return (n, *(v[k] for k in at))


@pytest.mark.parametrize("few", [quantiles.FEW_OF_GROUP, 20])
def test_groups(spark, few, monkeypatch):
    monkeypatch.setattr(quantiles, "POINTS", 20)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    r = random.Random(2)
    groups = {
        ("even", 1): [r.random() for _ in range(3000)], ("even", None): [r.expovariate(1) ** 9 * r.choice([-1, 1]) for _ in range(1500)], (None, 1): [float(r.randrange(4)) for _ in range(900)],
        ("heavy", 2): [7.0] * 800 + [r.random() for _ in range(90)] + [8 + r.random() for _ in range(90)], ("one", 3): [5.0], ("two", 3): [5.0, -5.0], ("odd", 4): [10.0**k for k in range(-150, 150)],
    }
    rows = [(a, b, v) for (a, b), values in groups.items() for v in values] + [("even", 1, None), ("void", 1, None), ("void", 1, float("nan")), ("odd", 4, float("nan"))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "a string, b int, x double")
    got = {(x.a, x.b): tuple(x)[2:] for x in quantiles.of_groups(df, ["a", "b"], "x", PLACES, few).collect()}
    assert got == {g: want(v) for g, v in groups.items()}


def test_whole_numbers_and_nothing(spark):
    df = spark.range(5000).selectExpr("id % 3 AS g", "id * 7919 % 5003 AS v")
    rows = {}
    for r in df.collect():
        rows.setdefault(r.g, []).append(r.v)
    got = {x.g: x.middle for x in quantiles.of_groups(df, ["g"], "v", {"middle": quantiles.upper_middle}, few=50).collect()}
    assert got == {g: sorted(v)[len(v) // 2] for g, v in rows.items()}
    assert quantiles.of_groups(df.limit(0), ["g"], "v", PLACES).collect() == []
