"""Phrases against counting everything in Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from newswarden.llm import collocations as co


def brute(rows, longest=3, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if any(100 * b >= 50 * a and b >= least for q, b in c.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, _, left, right = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(n=300):
    r = random.Random(4)
    words = ["of", "the", "new york", "new york city", "É", "écoLE", "rock\tand  roll", "a b", "x" * 300] + [f"w{k}" for k in range(7)]
    rows = [(r.choice(["en", "en", "fr", None]), "".join(r.choice(words) + r.choice([" "] * 14 + ["  ", ". ", "\n", ":", "\x0b"]) for _ in range(r.randint(0, 120)))) for _ in range(n)]
    return rows + [("en", None), ("fr", ""), ("und", "new york city " * 30), ("en", "A B c " * 20_000), ("de", "one two")]


@pytest.mark.parametrize("buckets", [None, 64])
def test_against_counting_everything(spark, monkeypatch, buckets):
    """With few buckets all are marked, and the rows are the same."""
    monkeypatch.setattr(co, "PENDING", 50)
    monkeypatch.setattr(co, "MET", 300)
    rows = texts()
    docs = spark.createDataFrame([(lang, t, 1, "p", "k") for lang, t in rows], "lang string, text string, n int, phrase string, k string").repartition(3)
    want = brute(rows)
    assert sorted(map(tuple, co.collocations(docs, buckets=buckets).collect())) == want and len(want) > 100


def test_top_longest_and_ties(spark):
    rows = texts(120)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, co.collocations(docs, longest=4, least=3, top=25, buckets=1 << 12).collect())) == brute(rows, 4, 3, 25)


def test_marks_are_wider_than_a_byte(spark):
    rows = [("en", "a b c. " * 150), ("en", "a b c. " * 150), ("en", "a b. " * 40)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert sorted(map(tuple, co.collocations(docs, least=300, buckets=1 << 10).collect())) == brute(rows, 3, 300)


def test_no_rows_and_wrong_buckets(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert co.collocations(docs, buckets=64).collect() == []
    with pytest.raises(ValueError):
        co.frequencies(docs, buckets=100)
