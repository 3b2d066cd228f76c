"""Language-model scoring: base against brute force, gradients, normalisation, and windows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from newswarden.llm import attention_lm as lm
from newswarden.llm import sp_bpe
from newswarden.llm.queries import SP_MODEL


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize("heavy", [lm.HEAVY, 50])
def test_base_against_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(lm, "HEAVY", heavy)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "n_chars")
    df = df.union(spark.createDataFrame([(None, None, 1), (3, "", 1), (3, "Only Here é", 1), (None, "the " * 30000, 0)], "doc_id long, text string, score long"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    count = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(tokens(t)), sum(count[x] > 0 for x in tokens(t)), n, round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t)), 6)) for i, t in rows)
    out = lm.scored(df, SP_MODEL, max_docs=50).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 for r in out)
    pieces = sp_bpe.load(SP_MODEL)
    unigram = 0.0
    sub = Counter(x for i, t in rows if not held(i) for w in tokens(t)[:-1] for x in pieces.library.encode(w))
    total = sum(sub.values()) + len(rows)
    for r in out:
        text = next(t for i, t in rows if i == r.doc_id and len(tokens(t)) == r.n_tokens)
        if r.held_out:
            unigram += sum(math.log10((sub[x] + 0.5) / (total + 16000)) for w in tokens(text)[:-1] for x in pieces.library.encode(w))
    assert sum(r.score for r in out if r.held_out) > unigram  # attention beats counts of the same ids


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    model = lm.train([rng.integers(3, 40, 200) for _ in range(20)], 40, 1, 2, steps=30)
    window = rng.integers(3, 40, (1, lm.WINDOW))
    counts, behind = rng.integers(0, 9, 40).astype(float), rng.integers(0, 9, (40, 3))
    for within in (lm.id_given_class(counts, model.klass)[None], lm.id_given_class(counts, model.klass, behind)):
        for before in within:
            total = sum(np.exp(model.class_scores(window, np.full((1, lm.WINDOW), t)) + before[t]) for t in range(40))
            assert np.allclose(total, 1, atol=1e-4)


def test_attention_is_causal_and_gradients_are_right():
    rng = np.random.default_rng(2)
    model = lm.train([rng.integers(3, 20, 60) for _ in range(9)], 20, 1, 2, steps=5)
    for name in lm.Attention._names:
        setattr(model, name, getattr(model, name).astype(np.float64))
    ids, targets, on = rng.integers(0, 20, (3, lm.WINDOW)), rng.integers(0, 20, (3, lm.WINDOW)), rng.random((3, lm.WINDOW)) < 0.8
    later = ids.copy()
    later[:, 9:] = 0
    assert np.allclose(model.class_scores(ids, targets)[:, :9], model.class_scores(later, targets)[:, :9])
    _, grads = model.gradients(ids, targets, on)
    for name, g in zip(lm.Attention._names, grads, strict=True):
        value = getattr(model, name)
        at = tuple(rng.integers(0, s) for s in value.shape) if name != "embed" else (int(ids[0, 0]), 1)
        ends = []
        for step in (1e-4, -1e-4):
            value[at] += step
            ends.append(model.gradients(ids, targets, on)[0])
            value[at] -= step
        assert np.isclose((ends[0] - ends[1]) / 2e-4, g[at], atol=1e-4)


def test_each_id_is_predicted_once():
    for size in (0, 1, 11, 12, 15, 16, 17, 28, 29, 100):
        ids = np.arange(size) + 5
        inputs, targets, counted, text = lm.framed(ids, np.array([0, size]), 1, 2)
        assert sorted(targets[counted].tolist()) == sorted([*ids.tolist(), 2])
        assert all(inputs[w][p] == (1 if targets[w][p] == 5 or size == 0 else (targets[w][p] - 1 if targets[w][p] > 5 else size + 4)) for w, p in zip(*np.nonzero(counted)))


def test_learns_from_texts_beyond_the_start(spark):
    """Same words and counts; in the texts that the start doesn't reach their order is the held-out text's, or not."""
    ids = [i for i in range(400) if not held(i)]
    probe = next(i for i in range(400) if held(i))
    chain = "red house stands near old river while green boat moves under stone bridge".split()
    rng = np.random.default_rng(3)

    def score(mixed):
        rows = [(i, " ".join(chain[(i + k) % len(chain)] for k in range(60))) for i in ids]
        rows = [(i, " ".join(rng.permutation(t.split())) if mixed else t) for i, t in rows] + [(probe, " ".join(chain * 4))]
        return next(r.score for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string"), SP_MODEL, max_docs=0).collect() if r.held_out)

    assert score(False) > score(True) + 20


def test_long_text_pushes_no_other_out_of_the_start(spark):
    rows = [(0, "red house " * 600_000), *((i, f"green boat moves under bridge {i} " * 200) for i in range(2, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [lm._start(df.repartition(k, "doc_id"), SP_MODEL, "doc_id", "text", 1, 100) for k in (1, 4)]
    assert all(np.array_equal(a, b) for a, b in zip(*found, strict=True))
    long_ids = {x for w in ("red", "house") for x in sp_bpe.load(SP_MODEL).library.encode(w)}
    others = ~np.isin(found[0][0], [*long_ids, 1]).all(1)
    assert 0 < others.sum() < len(others) == lm.START_WINDOWS


def test_empty_table(spark):
    assert lm.scored(spark.createDataFrame([], "doc_id long, text string"), SP_MODEL).collect() == []


def test_windows_that_overlap_compute_only_what_they_count():
    rng = np.random.default_rng(4)
    model = lm.train([rng.integers(3, 20, 200) for _ in range(9)], 20, 1, 2, steps=5)
    ids, targets = rng.integers(0, 20, (2, 5, lm.WINDOW))
    on = rng.random((5, lm.WINDOW)) < 0.8
    on[1:4, : lm.WINDOW - lm.STRIDE] = False
    on[0, 0] = on[4, 0] = True
    assert [(w.tolist(), skip) for w, skip in lm._together(on)] == [([1, 2, 3], lm.WINDOW - lm.STRIDE), ([0, 4], 0)]
    assert np.allclose(model.class_scores(ids, targets, on), np.where(on, model.class_scores(ids, targets), 0), atol=1e-5)


def test_distinct_hashes_as_numpy_has_them():
    for h in (np.random.default_rng(5).integers(0, 50, 300).astype(np.uint64) << np.uint64(58), np.empty(0, np.uint64)):
        for mine, theirs in zip(lm._distinct(h), np.unique(h, return_index=True, return_inverse=True, return_counts=True), strict=True):
            assert mine.dtype == theirs.dtype and (mine == theirs).all()
