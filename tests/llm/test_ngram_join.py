"""The chosen-path join against brute force over all pairs."""

import re

import numpy as np
import pytest

from newswarden.llm import ngram_join

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else frozenset()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    n = len(sets)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, copies = [0] * n, [1] * n
    for a in range(n):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                for k in (a, b):
                    links[k] += 1
                    copies[k] += x == y
                root[find(a)] = find(b)
    least = {}
    for k in range(n):
        least[find(k)] = min(least.get(find(k), sets[k][0]), sets[k][0])
    return {sets[k][0]: (least[find(k)], links[k], copies[k]) for k in range(n)}


def variants(rng, base, n, changes):
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.choice(len(w), changes, replace=False):
            w[at] = f"x{rng.integers(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("bucket,tile", [(200, 256), (8, 16)])
def test_against_brute_force(spark, bucket, tile):
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(3000)}"
    texts = ["", None, "...", "one two", "One, TWO", "one two three four five", "é ü ö"]
    for _ in range(6):
        base = [word() for _ in range(rng.integers(60, 400))]
        texts += variants(rng, base, 8, 2) + [" ".join(base)] * 3 + [" ".join(base[: int(len(base) * 0.85)])]
    texts += variants(rng, [word() for _ in range(300)], 60, 3)
    texts += [" ".join([word() for _ in range(80)] + [f"passage{i}" for i in range(40)]) for _ in range(40)]
    texts += [" ".join(word() for _ in range(20000))]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "c", 0) for i, t in rows], "doc_id long, text string, sig string, n_links int")
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.linked_documents(docs, bucket=bucket, tile=tile).collect()}
    assert got == brute(rows)


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.linked_documents(docs).collect()}
    assert got == brute(rows)


def test_odd_tables_and_filter(spark):
    schema = "doc_id long, text string, class_id string"
    assert ngram_join.linked_documents(spark.createDataFrame([], schema)).collect() == []
    same = "a b c d e f g h"
    rows = [(None, same, "x"), (4, same, "x"), (4, same, "x"), (5, same.upper(), "y"), (6, None, "z"), (None, "", "z"), (7, "", "z")]
    out = ngram_join.one_of_each(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "class_id"]
    assert sorted((str(r.doc_id), r.text) for r in out.collect() if r.text) == [("4", same)] and sorted(str(r.doc_id) for r in out.collect() if not r.text) == ["6", "7", "None"]


def test_repeated_and_missing_ids_keep_no_near_copy(spark):
    """A near copy goes whatever id it has: none, while another row without one stays; or that of another row that stays."""
    base = " ".join(f"w{k}" for k in range(60))
    near, other, third = base.replace("w59", "x"), " ".join(f"o{k}" for k in range(30)), " ".join(f"t{k}" for k in range(30))
    rows = [(1, base), (None, near), (None, other), (5, base.replace("w0 ", "y ")), (5, third), (None, third.replace("t29", "z")), (None, None), (None, "")]
    out = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, base), (None, other), (5, third), (None, None), (None, "")], key=str)
    # A class of rows without ids has one row too.
    rows = [(None, base), (None, near), (None, base)]
    out = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 1 and out[0].text in (base, near)


def test_survival_is_a_lower_bound_of_recall():
    q = [ngram_join.survival(d, 0.8) for d in range(1, 6)]
    assert q == sorted(q, reverse=True) and abs(q[0] - 0.84) < 1e-9 and q[-1] > 0.5


def test_hot_buckets_and_rows_without_a_name(spark, monkeypatch):
    """Small limits force pivots and broadcast facts; sets are found by id and text, so rows that share an id don't mix."""
    monkeypatch.setattr(ngram_join, "HOT_BUCKETS", 1_000_000)
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(60):
        own = list(base)
        own[int(rng.integers(60))] = f"x{k}"
        texts.append(" ".join(own))
    rows = [(None if k % 3 == 0 else k % 20, t) for k, t in enumerate(texts)] + [(None, "something else altogether in here now")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.linked_documents(df, bucket=8, tile=16).collect()
    sets = [shingles(t) for _, t in rows]
    want = sorted(sum(len(a & b) >= 0.8 * len(a | b) - 1e-9 for b in sets) - 1 for a in sets)
    assert sorted(r.n_links for r in got) == want
