"""Spelling variants against comparing all pairs of words, and words of texts against a plain count."""

import random
import re
import zlib
from collections import Counter

from newswarden.llm import spelling


def one_edit(a, b):
    letters = set(a + b)
    made = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + d :] for i in range(len(a) + 1) for c in letters for d in (0, 1)}
    return a != b and b in made


def brute(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if abs(len(x) - len(w)) <= 1 and one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best and words[best] >= 2 * n else None, len(near))
    rows = {}
    for w, (form, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, words[w], near, words[form] if form else None)
    return rows


def made_up(seed, n, letters, lengths):
    r = random.Random(seed)
    words = {}
    while len(words) < n:
        w = "".join(r.choice(letters) for _ in range(r.choice(lengths)))
        for _ in range(4):
            words.setdefault(w, r.choice([3, 3, 4, 7, 16, 40, 100]))
            at, c = r.randrange(len(w) + 1), r.choice(letters)
            w = r.choice([w[:at] + c + w[at:], w[:at] + c + w[at + 1 :], w[:at] + w[at + 1 :] if len(w) > 5 else w])
    return words


def got(spark, words, **options):
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(table, **options).collect()}


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TOGETHER", 500)
    words = made_up(1, 400, "abé", [5, 6, 7]) | made_up(2, 200, "abcdefÿ", [5, 9, 31, 32, 33, 40])
    want = brute(words)
    assert got(spark, words) == want and sum(1 for r in want.values() if r[0]) > 50
    monkeypatch.setattr(spelling, "LEAST_BLOCK", 40)
    assert got(spark, words, shard=50) == want


def test_chains_follow_to_the_root_and_ties_go_to_the_least(spark):
    chain = {"a" * 5 + "b" * k: 3 * 2**k for k in range(12)} | {"queen": 9, "quean": 9, "queer": 18, "queed": 18}
    rows = got(spark, chain)
    assert rows == brute(chain) and rows["aaaaa"][1] == "a" * 5 + "b" * 11 and rows["queen"][0] == "queed"


def test_one_edit():
    r = random.Random(5)
    words = list(made_up(3, 120, "ab", [5, 6]))
    assert all(spelling.one_edit(a, b) == one_edit(a, b) for a in words for b in r.sample(words, 60))


def test_words_of_texts(spark):
    texts = [(i, f"Straße strasse ÉCOLE école-École Word{i} abcdefgh abcdefgh") for i in range(120)] + [(7, None), (None, "école école abcdefgh"), (8, ""), (9, "x" * 50_000 + " abcdefgh")]
    want = Counter()
    for i, t in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += len(run) >= 5
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in texts], "doc_id long, text string, n int, word string")
    found = {r.word: r.n for r in spelling.counts(docs, slips=97).collect()}
    assert found == {w: n for w, n in want.items() if n >= 3}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.of_documents(docs).collect() == [] and spelling.of_documents(docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    lone = spark.createDataFrame([(1, "solitary solitary solitary")], "doc_id long, text string")
    assert [tuple(r) for r in spelling.of_documents(lone).collect()] == [("solitary", None, "solitary", 3, 0, None)]
