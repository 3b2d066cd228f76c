"""Language-model scoring with a causal self-attention model over subword ids, in numpy.

Texts are lower-cased (A-Z) and cut into words at white space; a word's subword ids
come from a public vocabulary, word by word, and a text is the ids of its words and
an end. The model factors an id's probability into its class given the ids before,
by attention, and the id given its class and the id before, by counts over all
training texts.

* Attention: ids have embeddings; a window of `WINDOW` inputs is scored at once by
  masked attention with a bias per distance. Windows overlap: each begins `STRIDE`
  inputs after the last, and of each but the first only the last `STRIDE` inputs
  predict, so each id is predicted once, with at least `WINDOW - STRIDE` ids before.
* Classes group ids by the counts of their neighbours in all training texts.
* The id given its class mixes two counts of all training texts: how often it stands in
  its class, and how often behind ids of the group (of `CONTEXTS`) of the one before it.
* Its weights start from windows drawn by hash from `max_docs` training texts, on the
  driver. From there every partition learns from all windows of all its training
  texts, and the weights are averaged: by windows, and of each embedding by how often
  the partition met the id. Steps grow with the corpus; no text is left out or cut.
  The averages depend a little on how texts are dealt to partitions.
* Counts of words and of subword ids cover all texts, and so grow with them.

The base score is a unigram model of whole words. A word that makes up a millionth
of all words is one of a million at most: those are broadcast with their counts. The
others are joined by shuffling, and none of them is frequent, so no task is hot.
Words are told apart by 64-bit hashes.

Defined results: a null or empty text is the end alone; rows with one id are scored
row by row; a null id is a training text. With no training texts the base is that of
no counts, and the model gives each class the same probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ragged as R
from . import shared, sp_bpe

WINDOW, STRIDE = 32, 28
WIDTH, CLASSES = 8, 32
#: Texts from whose windows the weights start, and how many windows are drawn.
MAX_DOCS, START_WINDOWS = 1500, 32_768
#: Windows of a step over all texts; a partition's first LEAST_STEPS steps take SMALL windows, and one too small for them is gone over again.
BATCH, LEAST_STEPS, SMALL = 2048, 100, 512
#: Neighbouring ids are counted in so many groups on each side.
CONTEXTS = 128
#: Weight of the counts of a class against those behind a group, in occurrences.
PRIOR = 8.0
#: Scores and logits are limited to this, which float32 can exponentiate and sum.
TOP = np.float32(60)
#: Windows that go through the arrays together, so that these stay in a core's cache.
TOGETHER = 128
#: Ids whose embeddings are averaged together.
BLOCK = 512
#: Share of all words from which a word's count is broadcast.
HEAVY = 1_000_000
_WORD, _SUB, _TEXTS, _CONTEXT = 0, 1, 2, 3


@dataclass
class Attention:
    """Weights: `embed` by id; attention score x M x' + bias by distance; class logits from the attended and the own embedding."""

    embed: np.ndarray
    m: np.ndarray
    bias: np.ndarray
    attended: np.ndarray
    own: np.ndarray
    out: np.ndarray
    klass: np.ndarray  # class by id

    _names = ("embed", "m", "bias", "attended", "own", "out")

    def _mask(self) -> np.ndarray:
        far = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
        return np.where(far >= 0, self.bias[np.maximum(far, 0)], np.float32(-1e9)).astype(self.embed.dtype)

    def _logits(self) -> np.ndarray:
        """Weights of the features and, as their last row, of the constant one beside them."""
        return np.concatenate([self.attended, self.own, self.out[None, :]])

    def forward(self, ids: np.ndarray, skip: int, mask: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
        """For windows: all embeddings, and from place `skip` on embeddings, scaled queries, exponentials of the attention scores and their sums, features (attended and own embedding, one) and logits of the next id's class."""
        x = self.embed.take(ids, 0)
        own = np.ascontiguousarray(x[:, skip:])
        q = (own.reshape(-1, WIDTH) @ self.m).reshape(own.shape)
        e = q @ x.transpose(0, 2, 1)
        e += mask[skip:]
        _limit(e)
        np.exp(e, out=e)
        total = (e.reshape(-1, WINDOW) @ np.ones(WINDOW, e.dtype)).reshape(*own.shape[:2], 1)
        both = np.empty((own.size // WIDTH, 2 * WIDTH + 1), x.dtype)
        both[:, :WIDTH] = (e @ x / total).reshape(-1, WIDTH)
        both[:, WIDTH:-1] = own.reshape(-1, WIDTH)
        both[:, -1] = 1
        logits = both @ weights
        _limit(logits)
        return x, own, q, e, total, both, logits

    def class_scores(self, ids: np.ndarray, targets: np.ndarray, counted: np.ndarray | None = None) -> np.ndarray:
        """Natural log-probability of each target's class, 0 at places that don't count."""
        counted = np.ones(ids.shape, bool) if counted is None else counted
        out, mask, weights = np.zeros(ids.shape), self._mask(), self._logits()
        for w, skip in _together(counted):
            logits = self.forward(ids[w], skip, mask, weights)[-1]
            picked = logits[np.arange(len(logits)), self.klass.take(targets[w, skip:].reshape(-1))]
            np.exp(logits, out=logits)
            out[w, skip:] = (picked - np.log(logits @ np.ones(CLASSES, logits.dtype))).reshape(len(w), -1)
        return np.where(counted, out, 0.0)

    def gradients(self, ids: np.ndarray, targets: np.ndarray, counted: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean log-loss over the places that count, and its gradients."""
        n = max(int(counted.sum()), 1)
        loss, rest, d_all, mask, weights = 0.0, None, np.empty((*ids.shape, WIDTH), self.embed.dtype), self._mask(), self._logits()
        for w, skip in _together(counted):
            part, d_all[w], own = self._part(ids[w], targets[w, skip:], counted[w, skip:], n, skip, mask, weights)
            loss += part
            rest = own if rest is None else [a + b for a, b in zip(rest, own, strict=True)]
        if rest is None:
            return 0.0, [np.zeros_like(getattr(self, k)) for k in Attention._names]
        place, flat = ids.reshape(-1), d_all.reshape(-1, WIDTH)
        return loss, [np.stack([np.bincount(place, flat[:, k], len(self.embed)) for k in range(WIDTH)], 1), *rest]

    def _part(self, ids: np.ndarray, targets: np.ndarray, counted: np.ndarray, n: int, skip: int, mask: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, list[np.ndarray]]:
        x, own, q, e, total, both, p = self.forward(ids, skip, mask, weights)
        kind, place, share = p.dtype, np.arange(len(p)), counted.reshape(-1) / p.dtype.type(n)
        gold = self.klass.take(targets.reshape(-1))
        picked = p[place, gold]
        np.exp(p, out=p)
        of_all = p @ np.ones(CLASSES, kind)
        loss = float((np.log(of_all) - picked) @ share)
        p *= (share / of_all)[:, None]
        p[place, gold] -= share
        d_both = p @ weights[:-1].T
        # The exponentials stay undivided; what would meet them is divided by their sums.
        d_mixed = d_both[:, :WIDTH].reshape(own.shape) / total
        d_s = d_mixed @ x.transpose(0, 2, 1)
        d_x = e.transpose(0, 2, 1) @ d_mixed
        d_s -= ((d_s * e).reshape(-1, WINDOW) @ np.ones(WINDOW, kind)).reshape(total.shape) / total
        d_s *= e
        d_q = d_s @ x
        d_x += d_s.transpose(0, 2, 1) @ q
        d_x[:, skip:] += (d_both[:, WIDTH:] + d_q.reshape(-1, WIDTH) @ self.m.T).reshape(own.shape)
        far = np.arange(skip, WINDOW)[:, None] - np.arange(WINDOW)[None, :]
        d_bias = np.bincount(np.maximum(far, 0).ravel(), (np.ones(len(e), kind) @ d_s.reshape(len(e), -1)) * (far >= 0).ravel(), WINDOW)
        d_w = both.T @ p
        return loss, d_x, [own.reshape(-1, WIDTH).T @ d_q.reshape(-1, WIDTH), d_bias, d_w[:WIDTH], d_w[WIDTH:-1], d_w[-1]]


def _together(counted: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Windows that go through the arrays together, and the first place that any of them counts: what only overlaps the window before asks for nothing."""
    late = ~counted[:, : WINDOW - STRIDE].any(1)
    for skip, which in ((WINDOW - STRIDE, np.flatnonzero(late)), (0, np.flatnonzero(~late))):
        for at in range(0, len(which), TOGETHER):
            yield which[at : at + TOGETHER], skip


def _limit(x: np.ndarray) -> None:
    """Values over TOP become it; as a rule there are none, and looking is cheaper than writing."""
    if x.size and not x.max() <= TOP:
        np.minimum(x, TOP.astype(x.dtype), out=x)


def windows_of(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of `size` inputs: the text of each window, its first input, and the first of its places that predicts."""
    n = 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, k * STRIDE, np.where(k > 0, WINDOW - STRIDE, 0)


def framed(ids: np.ndarray, bounds: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, ...]:
    """Windows of texts: inputs, targets (both windows x WINDOW), which places count, and the text of each window."""
    size = np.diff(bounds) + 1
    inputs, targets = np.insert(ids, bounds[:-1], begin), np.insert(ids, bounds[1:], end)
    text, first, least = windows_of(size)
    place = first[:, None] + np.arange(WINDOW)
    inside = place < size[text][:, None]
    at = np.where(inside, (bounds[:-1] + np.arange(len(size)))[text][:, None] + place, 0)
    return inputs[at], targets[at], inside & (np.arange(WINDOW) >= least[:, None]), text


def _classes(ids: np.ndarray, n: int, rng: np.random.Generator, contexts: int = 200) -> np.ndarray:
    """Ids grouped by what stands before and behind them in one sequence; ids not met share the last class."""
    count = np.bincount(ids, minlength=n)
    frequent = np.argsort(-count, kind="stable")[:contexts]
    column = np.full(n, contexts, np.int64)
    column[frequent] = np.arange(len(frequent))
    met = np.flatnonzero(count)
    row = np.full(n, -1, np.int64)
    row[met] = np.arange(len(met))
    wide = 2 * (contexts + 1)
    table = np.bincount(row[ids[:-1]] * wide + column[ids[1:]], minlength=len(met) * wide) + np.bincount(row[ids[1:]] * wide + contexts + 1 + column[ids[:-1]], minlength=len(met) * wide)
    return grouped(table.reshape(len(met), wide), met, count, rng)


def grouped(table: np.ndarray, met: np.ndarray, count: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Classes of ids from counts of their neighbours, a row for each id met (spherical k-means)."""
    n = len(count)
    klass = np.full(n, CLASSES - 1, np.int64)
    if not len(met):
        return klass
    row = np.full(n, -1, np.int64)
    row[met] = np.arange(len(met))
    v = np.sqrt(table + 0.0)
    v -= np.sqrt(v.mean(0) ** 2) * 0.5
    v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-9
    # The most frequent ids are seeds; classes weigh ids by their counts.
    frequent = np.argsort(-count, kind="stable")
    centre = v[row[frequent[: CLASSES - 1]]].copy() if len(met) >= CLASSES else v[rng.integers(0, len(met), CLASSES - 1)]
    near = np.zeros(len(met), np.int64)
    for _ in range(12):
        near = (v @ centre.T).argmax(1)
        for k in range(len(centre)):
            if (near == k).any():
                mean = (v[near == k] * np.sqrt(count[met][near == k])[:, None]).sum(0)
                centre[k] = mean / (np.linalg.norm(mean) + 1e-9)
    klass[met] = near
    return klass


class _Adam:
    def __init__(self, model: Attention):
        self.model, self.step = model, 0
        self.first, self.second = ([np.zeros_like(getattr(model, k)) for k in Attention._names] for _ in range(2))

    def __call__(self, grads: list[np.ndarray], pace: float) -> None:
        self.step += 1
        for k, name in enumerate(Attention._names):
            g = grads[k].astype(np.float32)
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.99 * self.second[k] + 0.01 * g * g
            value = getattr(self.model, name)
            value -= (pace * (self.first[k] / (1 - 0.9**self.step)) / (np.sqrt(self.second[k] / (1 - 0.99**self.step)) + 1e-8)).astype(np.float32)


def train(texts: list[np.ndarray], vocabulary: int, begin: int, end: int, **options) -> Attention:
    """Adam on the mean log-loss of classes over the windows of `texts`, whose neighbours give the classes."""
    if not texts:
        return fitted(None, np.arange(vocabulary) % CLASSES, begin, end, **options)
    ids, bounds = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    klass = _classes(np.insert(ids, bounds[1:], end), vocabulary, np.random.default_rng(options.get("seed", 7)))
    return fitted(framed(ids, bounds, begin, end)[:3], klass, begin, end, **options)


def fitted(windows: tuple[np.ndarray, ...] | None, klass: np.ndarray, begin: int, end: int, *, steps: int = 500, batch: int = 256, rate: float = 0.02, seed: int = 7) -> Attention:
    """Weights from windows (inputs, targets, which count); ids that they lack look like the mean of the others."""
    rng, vocabulary = np.random.default_rng(seed), len(klass)
    draw = lambda *s: rng.normal(0, 0.2, s).astype(np.float32)
    zero = lambda *s: np.zeros(s, np.float32)
    if windows is None:
        return Attention(zero(vocabulary, WIDTH), zero(WIDTH, WIDTH), zero(WINDOW), zero(WIDTH, CLASSES), zero(WIDTH, CLASSES), zero(CLASSES), klass)
    inputs, targets, counted = windows
    steps = steps if len(inputs) else 0
    model = Attention(draw(vocabulary, WIDTH), draw(WIDTH, WIDTH), zero(WINDOW), draw(WIDTH, CLASSES), draw(WIDTH, CLASSES), zero(CLASSES), klass)
    adam = _Adam(model)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(inputs), batch)
        adam(model.gradients(inputs[pick], targets[pick], counted[pick])[1], rate * min(1.0, 2 * (1 - step / (steps + 1))))
    met = np.bincount(np.concatenate([inputs[counted], targets[counted], [begin, end]]), minlength=vocabulary) > 0
    model.embed[~met] = model.embed[met].mean(0)
    return model


def id_given_class(counts: np.ndarray, klass: np.ndarray, behind: np.ndarray | None = None) -> np.ndarray:
    """Natural log-probability of each id within its class, half a count added to each; by group of the id before it, if counts behind groups (ids x CONTEXTS) are given."""
    total = np.bincount(klass, counts, CLASSES) + 0.5 * np.bincount(klass, minlength=CLASSES)
    alone = (counts + 0.5) / total[klass]
    if behind is None:
        return np.log(alone)
    out = np.empty((behind.shape[1], len(counts)), np.float32)
    for g in range(behind.shape[1]):
        n = behind[:, g].astype(np.float64)
        out[g] = np.log((n + PRIOR * alone) / (np.bincount(klass, n, CLASSES) + PRIOR)[klass])
    return out


def _distinct(h: np.ndarray) -> tuple[np.ndarray, ...]:
    """What np.unique gives with indices, inverse and counts, by hashing, so that only the distinct values are sorted."""
    met, values = pd.factorize(h)
    order = np.argsort(values)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    inverse, first = rank[met], np.empty(len(order), np.int64)
    first[inverse[::-1]] = np.arange(len(h) - 1, -1, -1)
    return values[order], first, inverse, np.bincount(inverse, minlength=len(order))


class _Words:
    """Texts of a batch as words: their rows and hashes, and the subword ids of each."""

    def __init__(self, model_path: str):
        self.model = sp_bpe.load(model_path, False)

    def parts(self, column: pa.Array) -> Iterator[tuple]:
        """Row range, rows of words, hashes of words, and the words' places in the store of ids (which is `model.values`, `model.bounds`)."""
        data, offsets = R.text_buffers(column)
        for lo, hi in R.chunks(offsets):
            part, off = R.LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
            s, e, rows = R.spans(part, off, R.NOT_SPACE)
            h, second = R.span_hashes(part, s, e), R.span_hashes(part, s, e, 1)
            own, one, inverse, times = _distinct(h)
            place = self.model.lookup(own, second[one], part, s[one], e[one])
            yield lo, hi, rows, h, own, times, place, inverse

    def sequence(self, rows: np.ndarray, n: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of `n` texts in order, and their bounds, from the rows and places of all words."""
        length = self.model.bounds[place + 1] - self.model.bounds[place]
        ids = R.gather(self.model.values, self.model.bounds, place).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(np.bincount(rows, length, n).astype(np.int64))])


def _held(id_col: str, held_out: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == held_out, F.lit(False))


def corpus_counts(df: DataFrame, model_path: str) -> DataFrame:
    """(kind, key, n, training) over all texts of (held_out, text): words by hash, subword ids, texts, and of training texts neighbours (id, then the group of the one behind or before it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(model_path)
        size = words.model.size
        subs, texts = np.zeros((2, size), np.int64), np.zeros(2, np.int64)
        near, wide = np.zeros(size * 2 * CONTEXTS, np.uint32), 2 * CONTEXTS
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0

        def emit(kind: int, key: np.ndarray, training: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key), pa.array(training + rest), pa.array(training)], names=["kind", "key", "n", "training"])

        def flush() -> pa.RecordBatch:
            key, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")
            key, a, b = key[order], a[order], b[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            held.clear()
            return emit(_WORD, key[first].view(np.int64), np.add.reduceat(a, first), np.add.reduceat(b, first))

        for batch in batches:
            out_of = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            texts += [int((~out_of).sum()), int(out_of.sum())]
            for lo, hi, rows, _, own, times, place, inverse in words.parts(batch.column(1)):
                rest = np.bincount(inverse, out_of[lo:hi][rows], len(own)).astype(np.int64)
                if not len(own):
                    continue
                kept = ~out_of[lo:hi][rows]
                ids, bounds = words.sequence(rows[kept], hi - lo, place[inverse[kept]])
                ids = np.insert(ids, bounds[1:][~out_of[lo:hi]], words.model.eos)
                np.add.at(near, ids[:-1] * wide + ids[1:] % CONTEXTS, np.uint32(1))
                np.add.at(near, ids[1:] * wide + CONTEXTS + ids[:-1] % CONTEXTS, np.uint32(1))
                held.append((own, times - rest, rest))
                length = words.model.bounds[place + 1] - words.model.bounds[place]
                ids = R.gather(words.model.values, words.model.bounds, place)
                for k, n in enumerate((times - rest, rest)):
                    subs[k] += np.bincount(ids, np.repeat(n, length), size).astype(np.int64)
                waiting += len(own)
                if waiting > 1_500_000:
                    waiting = 0
                    yield flush()
        if held:
            yield flush()
        some = np.flatnonzero(subs.sum(0))
        yield emit(_SUB, some, subs[0, some], subs[1, some])
        some = np.flatnonzero(near)
        yield emit(_CONTEXT, some, near[some].astype(np.int64), np.zeros(len(some), np.int64))
        yield emit(_TEXTS, np.zeros(1, np.int64), texts[:1], texts[1:])

    rows = df.mapInArrow(run, "kind byte, key long, n long, training long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("training").alias("training"))


def _start(df: DataFrame, model_path: str, id_col: str, text_col: str, held_out: int, max_docs: int) -> tuple[np.ndarray, ...]:
    """Windows from which the weights start: those with the smallest hashes among all windows of `max_docs` training texts."""
    chosen = df.where(~_held(id_col, held_out)).select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(max_docs)
    texts = df.select(id_col, text_col).join(F.broadcast(chosen), id_col).groupBy(id_col).agg(F.min(text_col).alias(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(model_path)
        for batch in batches:
            for lo, hi, rows, _, _, _, place, inverse in words.parts(batch.column(0)):
                ids, bounds = words.sequence(rows, hi - lo, place[inverse])
                inputs, targets, counted, text = framed(ids, bounds, words.model.bos, words.model.eos)
                first = np.concatenate([[True], text[1:] != text[:-1]])
                number = np.arange(len(text)) - np.maximum.accumulate(np.where(first, np.arange(len(text)), 0))
                key = R.mix64(batch.column(1).to_numpy()[lo:hi].view(np.uint64)[text] ^ R.mix64(number.astype(np.uint64))).view(np.int64)
                least = np.argsort(key, kind="stable")[:START_WINDOWS]
                whole = np.concatenate([inputs[least], targets[least], counted[least]], 1).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array(key[least]), pa.array([w.tobytes() for w in whole], pa.binary())], names=["key", "window"])

    found = texts.select(text_col, F.xxhash64(F.col(id_col).cast("string"))).mapInArrow(run, "key long, window binary").orderBy("key", "window").limit(START_WINDOWS).collect()
    table = np.frombuffer(b"".join(r.window for r in found), np.uint16).reshape(len(found), 3, WINDOW).astype(np.int64)
    return table[:, 0], table[:, 1], table[:, 2] > 0


def learn(texts: DataFrame, model_path: str, start: Attention) -> Attention:
    """`start` carried on over every window of every one of `texts` (one column), partition by partition, and averaged."""
    sent = texts.sparkSession.sparkContext.broadcast(start)
    blocks = -(-len(start.klass) // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, begun = _Words(model_path), sent.value
        model = Attention(*(getattr(begun, k).copy() for k in Attention._names), begun.klass)
        adam, met, n = _Adam(model), np.zeros(len(model.embed)), 0
        again: list[tuple[np.ndarray, ...]] = []
        rng = np.random.default_rng(11)

        def pass_over(windows: tuple[np.ndarray, ...]) -> None:
            order, a = rng.permutation(len(windows[0])), 0
            while a < len(order):
                pick = order[a : a + (SMALL if adam.step < LEAST_STEPS else BATCH)]
                a += len(pick)
                adam(model.gradients(*(w[pick] for w in windows))[1], 0.01 / np.sqrt(1 + adam.step / 50))

        for batch in batches:
            for lo, hi, rows, _, _, _, place, inverse in words.parts(batch.column(0)):
                ids, bounds = words.sequence(rows, hi - lo, place[inverse])
                if hi == lo:
                    continue
                windows = framed(ids, bounds, words.model.bos, words.model.eos)[:3]
                met += np.bincount(windows[0][windows[2]], minlength=len(met))
                n += int(windows[2].sum())
                pass_over(windows)
                if adam.step < LEAST_STEPS:
                    again.append(windows)
                else:
                    again.clear()
        while again and adam.step < LEAST_STEPS:
            for windows in again:
                pass_over(windows)
        if n:
            rest = np.concatenate([getattr(model, k).ravel() for k in Attention._names[1:]]).astype(np.float64)
            parts = [(model.embed[k * BLOCK : (k + 1) * BLOCK] * met[k * BLOCK : (k + 1) * BLOCK, None]).astype(np.float64).ravel() for k in range(blocks)] + [rest * n]
            weights = [met[k * BLOCK : (k + 1) * BLOCK] for k in range(blocks)] + [np.array([float(n)])]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks + 1)), pa.array([v.tobytes() for v in parts], pa.binary()), pa.array([v.tobytes() for v in weights], pa.binary())], names=["block", "total", "weight"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, *both in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = [np.frombuffer(v) for v in both]
                sums[k] = [a + b for a, b in zip(sums[k], new, strict=True)] if k in sums else new
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), *(pa.array([v[i].tobytes() for v in sums.values()], pa.binary()) for i in (0, 1))], names=["block", "total", "weight"])

    schema = "block long, total binary, weight binary"
    found = {r.block: (np.frombuffer(r.total), np.frombuffer(r.weight)) for r in texts.mapInArrow(run, schema).repartition("block").mapInArrow(add, schema).collect()}
    sent.unpersist()
    if not found:
        return start
    met = np.concatenate([found[k][1] for k in range(blocks)])
    embed = np.concatenate([found[k][0] for k in range(blocks)]).reshape(-1, WIDTH) / np.maximum(met, 1)[:, None]
    # Ids that no training text has look like the mean of the others.
    embed[met == 0] = embed[met > 0].mean(0)
    rest, at, values = found[blocks][0] / found[blocks][1], 0, []
    for name in Attention._names[1:]:
        shape = getattr(start, name).shape
        values.append(rest[at : (at := at + int(np.prod(shape)))].reshape(shape).astype(np.float32))
    return Attention(embed.astype(np.float32), *values, start.klass)


def scored(df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", held_out: int = 1, max_docs: int = MAX_DOCS) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability)."""
    spark = df.sparkSession
    shared.prepare(spark)
    df = shared.stable(df.select(F.col(id_col), F.col(text_col)))
    flagged = df.select(F.col(id_col).alias("id"), _held(id_col, held_out).alias("held_out"), F.col(text_col).alias("text"))
    counts = shared.written(corpus_counts(flagged.select("held_out", "text"), model_path), "counts")
    words = counts.where(F.col("kind") == _WORD)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("training"), F.lit(0)).alias("training"), F.count_if(F.col("training") > 0).alias("distinct")).first()
    ends = counts.where(F.col("kind") == _TEXTS).agg(F.coalesce(F.sum("training"), F.lit(0)).alias("training")).first().training
    train_tokens, distinct = total.training + ends, total.distinct + (ends > 0)
    heavy = words.where(F.col("n") * HEAVY >= total.n).select("key", "training").toPandas() if total.n else None
    known = np.sort(heavy["key"].to_numpy(np.int64)) if heavy is not None else np.empty(0, np.int64)
    times = heavy["training"].to_numpy(np.int64)[np.argsort(heavy["key"].to_numpy(np.int64))] if heavy is not None else np.empty(0, np.int64)
    pieces = sp_bpe.load(model_path, False)
    sub = np.zeros(pieces.size)
    for r in counts.where(F.col("kind") == _SUB).collect():
        sub[r.key] = r.training
    sub[pieces.eos] += ends
    if ends:
        near = np.zeros(pieces.size * 2 * CONTEXTS, np.float32)
        cells = counts.where(F.col("kind") == _CONTEXT).select("key", "n").toPandas()
        near[cells["key"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
        met = np.flatnonzero(sub)
        near = near.reshape(pieces.size, -1)
        klass = grouped(near[met], met, sub, np.random.default_rng(7))
        start = fitted(_start(df, model_path, id_col, text_col, held_out, max_docs), klass, pieces.bos, pieces.eos)
        model = learn(flagged.where(~F.col("held_out")).select("text"), model_path, start)
    else:
        model, near = train([], pieces.size, pieces.bos, pieces.eos), np.zeros((pieces.size, 2 * CONTEXTS), np.float32)
    within = id_given_class(sub, model.klass, near[:, CONTEXTS:])
    sent = spark.sparkContext.broadcast((known, times, model, within))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("id", df.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times, model, within = sent.value
        parts, at = _Words(model_path), TaskContext.get().partitionId() << 33
        logs = np.log10(times + 0.5)
        for batch in batches:
            for lo, hi, rows, h, own, _, place, inverse in parts.parts(batch.column(2)):
                n = hi - lo
                key = own.view(np.int64)
                spot = np.searchsorted(known, key)
                there = spot < len(known)
                there[there] = known[spot[there]] == key[there]
                spot = np.where(there, spot, 0)
                common = there[inverse]
                base = np.bincount(rows[common], logs[spot[inverse[common]]] if len(known) else None, n) if common.any() else np.zeros(n)
                seen = np.bincount(rows[common], times[spot[inverse[common]]] > 0, n).astype(np.int64) if common.any() else np.zeros(n, np.int64)
                length = (parts.model.bounds[place + 1] - parts.model.bounds[place])[inverse]
                ids = R.gather(parts.model.values, parts.model.bounds, place[inverse]).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(np.bincount(rows, length, n).astype(np.int64))])
                score = np.zeros(n)
                inputs, targets, counted, text = framed(ids, bounds, pieces_ends[0], pieces_ends[1])
                # A text begins behind the end of another, as in the counts.
                group = np.where(inputs == pieces_ends[0], pieces_ends[1], inputs) % CONTEXTS
                for a in range(0, len(inputs), 4096):
                    b = a + 4096
                    each = model.class_scores(inputs[a:b], targets[a:b], counted[a:b]) + np.where(counted[a:b], within[group[a:b], targets[a:b]], 0.0)
                    score += np.bincount(text[a:b], each.sum(1), n)
                words_in = R.counts(rows, n)
                name = np.arange(at, at + n)
                at += n
                rare = np.flatnonzero(~common)
                m = len(rare)
                blank = lambda kind: pa.nulls(m, kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name), pa.array(R.mix64(name.astype(np.uint64)).view(np.int64)), pa.array(np.ones(n, bool)), batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(words_in), pa.array(seen), pa.array(base), pa.array(score / np.log(10))],
                    names=schema.names,
                )
                if m:
                    yield pa.RecordBatch.from_arrays([pa.array(name[rows[rare]]), pa.array(h[rare].view(np.int64)), pa.array(np.zeros(m, bool)), blank(batch.column(0).type), blank(pa.bool_()), blank(pa.int64()), blank(pa.int64()), blank(pa.float64()), blank(pa.float64())], names=schema.names)

    pieces_ends = (pieces.bos, pieces.eos)
    rows = flagged.mapInArrow(run, schema)
    rare = words.where((F.col("n") * HEAVY < total.n) & (F.col("training") > 0)).select("key", F.col("training").alias("c"))
    met = rows.join(rare, "key", "left")
    c = F.coalesce("c", F.lit(0))
    single = ~F.col("whole")
    out = met.groupBy("row").agg(
        F.max(F.when(F.col("whole"), F.struct("id", "held_out", "tokens", "known", "base", "score"))).alias("t"),
        F.count_if(single & (c > 0)).alias("rare_known"),
        F.coalesce(F.sum(F.when(single, F.log10(c + 0.5))), F.lit(0.0)).alias("rare_base"),
    )
    n_tokens = F.col("t.tokens") + 1
    base = F.col("t.base") + F.col("rare_base") + float(np.log10(ends + 0.5)) - n_tokens * float(np.log10(train_tokens + 0.5 * (distinct + 1)))
    return out.select(F.col("t.id").alias(id_col), F.col("t.held_out").alias("held_out"), n_tokens.alias("n_tokens"), (F.col("t.known") + F.col("rare_known") + int(ends > 0)).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), F.col("t.score").alias("score"))
