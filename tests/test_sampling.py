"""Quota samples against going through all rows in order."""

import hashlib
import math

from pyspark.sql import functions as F

from newswarden.operators import quantiles, sampling


def lot(i, seed=""):
    return int(hashlib.sha256(f"{seed}{i}".encode()).hexdigest()[:15], 16)


ROWS = [(b, i, i % 4 != 0) for i in range(1500) for b, m in (("critical", 11), ("borderline", 3), ("relevant", 2), ("rare", 400)) if i % m == 0]
ORDER = ["critical", "borderline", "relevant", "rare", "none"]


def test_by_quota(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW_OF_GROUP", 50)
    df = spark.createDataFrame(ROWS + [("critical", None, True), ("other", 5, True)], "bucket string, id long, fit boolean")
    sample, report = sampling.by_quota(df, "bucket", "id", ORDER, 203, F.col("fit"), seed="s")
    each, seen, want, found = math.ceil(203 / 5), set(), [], []
    for b in ORDER:
        pool = sorted((lot(i, "s"), i, fit) for x, i, fit in ROWS if x == b)[: math.ceil(each * 1.2)]
        took = [i for _, i, fit in pool if fit and i not in seen][:each]
        seen |= set(took)
        want += [(b, i, k) for k, i in enumerate(took)]
        found.append((b, each, len(took)))
    assert sorted(map(tuple, sample.collect())) == sorted(want) and [tuple(r) for r in report.collect()] == found
    assert found[0][2] < each and found[3][2] == 0 and found[4] == ("none", each, 0)


def test_harvest(spark):
    rows = [(["KEEP", "MAYBE", "DROP"][i % 3], i, None if i % 9 == 2 else float(i % 50)) for i in range(900)]
    df = spark.createDataFrame(rows, "decision string, id long, score double")
    labelled, candidates = df.where("id % 4 = 0").select("id"), df.where("id % 5 = 0").select("id")
    limits = {"KEEP": 20, "MAYBE": 0, "DROP": 30}
    new, report = sampling.harvested(df, "decision", "id", limits, labelled, candidates, {"DROP": "score"})
    want, counts = [], []
    for b, n in limits.items():
        key = (lambda r: (r[2] is None, -(r[2] or 0.0), lot(r[1]), r[1])) if b == "DROP" else (lambda r: lot(r[1]))
        c = [0, 0, 0]
        for _, i, _ in sorted((r for r in rows if r[0] == b), key=key)[: n * 3]:
            if c[0] >= n:
                break
            kind = 1 if i % 4 == 0 else 2 if i % 5 == 0 else 0
            c[kind] += 1
            want += [(b, i)] * (kind == 0)
        counts.append((b, *c))
    assert sorted(map(tuple, new.collect())) == sorted(want) and [tuple(r) for r in report.collect()] == counts and counts[0][1] == 20


def test_nothing(spark):
    df = spark.createDataFrame([], "bucket string, id long, fit boolean")
    sample, report = sampling.by_quota(df, "bucket", "id", ["a", "b"], 10, F.col("fit"))
    assert sample.collect() == [] and [tuple(r) for r in report.collect()] == [("a", 5, 0), ("b", 5, 0)]
