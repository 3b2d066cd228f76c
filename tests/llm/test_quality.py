"""Line counts against brute force; the field against enumeration; held-out accuracy."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from newswarden.llm import crf, lines, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    rows = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(windows)
    hit = {j for i, x in enumerate(windows) if many[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(rows) - len(set(rows)), len(hit)


TEXTS = ["", None, "  \n\t\n", "one", "a b\na b\n a b\na b", "é ü # *$%&|<>\n\n" * 30, " ".join(map(str, range(30))) + "\n" + " ".join(map(str, range(12))), "same " * 5000, "x\x0by\x0cz\r\nw", "漢字 🙂!! " * 9]


def test_counts_against_brute_force():
    got = []
    for t in lines.tables(pa.array(TEXTS)):
        got += list(zip(t.n_words.tolist(), t.word_chars.tolist(), t.n_symbols.tolist(), t.n_dup_lines.tolist(), t.n_repeat_words.tolist(), strict=True))
    assert got == [brute(t) for t in TEXTS]


def test_field_against_enumeration():
    rng = np.random.default_rng(5)
    row = np.array([0, 0, 0, 1, 2, 2, 2, 2])
    score, move, start = rng.normal(size=(8, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    p, _, _ = crf._Batch(row).run(score, move, start)
    best = crf._Batch(row).best(score, move, start)
    for r in range(3):
        at = np.flatnonzero(row == r)
        paths = list(itertools.product(range(2), repeat=len(at)))
        weight = np.array([start[y[0]] + sum(score[a, k] for a, k in zip(at, y)) + sum(move[a, b] for a, b in zip(y, y[1:])) for y in paths])
        assert tuple(best[at]) == paths[int(weight.argmax())]
        prob = np.exp(weight) / np.exp(weight).sum()
        for k, a in enumerate(at):
            assert np.isclose(p[a, 1], sum(w for w, y in zip(prob, paths) if y[k] == 1))


def test_held_out_accuracy_and_empty_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    trained = quality.train(docs, labels, held_out=0)
    gold = {r.doc_id: r.quality for r in labels.collect()}
    found = [(gold[r.doc_id], r.score >= quality.GOOD) for r in quality.classify(docs, trained).collect() if r.doc_id in gold and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(bool(a) == b for a, b in found) / len(found) > 0.93
    odd = spark.createDataFrame([(1, None, 0.0), (1, "", 0.0), (None, "Ok then. " * 3000, 0.0)], "doc_id long, text string, score double")
    scores = quality.classify(odd, trained).collect()
    assert len(scores) == 3 and all(0 <= r.score <= 1 for r in scores) and scores[0].score == scores[1].score == trained.prior
    assert [r.kept for r in quality.rules(odd, trained).collect()][:2] == [False, False]
    assert quality.keep_good(odd, trained).columns == odd.columns
    none = quality.train(docs.limit(0), labels.limit(0))
    assert [r.score for r in quality.classify(odd, none).collect()] == [0.5, 0.5, 0.5]


def test_rules_keep_good_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = quality.rules(docs, quality.train(docs, labels)).join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept for r in kept if r.quality == 1]) > 0.99
    assert np.mean([r.kept for r in kept if r.quality == 0]) < 0.15


def test_fit_takes_all_lines(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "\n".join(f"line {k} of {i}" for k in range(n))) for i, n in enumerate((3, 64, 65, 500))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    taken, fit = [], crf.fit
    monkeypatch.setattr(crf, "fit", lambda bins, row, *rest, **options: taken.extend(np.bincount(row).tolist()) or fit(bins, row, *rest, **options))
    quality.train(docs, labels)
    assert sorted(taken) == [3, 64, 65, 500]


def test_null_ids_are_not_held_out_and_repeated_ids_learn_alike(spark):
    rows = [(None, "one line of words here"), (3, "b text"), (3, "a text"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (5, 0)], "doc_id long, quality int")
    both = [quality.classify(d, quality.train(d, labels)).collect() for d in (df, df.repartition(3))]
    assert sorted(map(str, both[0])) == sorted(map(str, both[1]))
