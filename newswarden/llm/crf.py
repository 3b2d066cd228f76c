"""A linear-chain conditional random field over binned line features, in numpy.

A line's score for a label sums a weight for each of its own feature bins, for
those of the line before and of the line after; labels of adjacent lines have
transition weights. Documents of a batch run side by side, longest first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@dataclass
class Crf:
    own: np.ndarray  # bins of all features in a row, by label
    before: np.ndarray
    after: np.ndarray
    move: np.ndarray  # from label, to label
    start: np.ndarray
    base: np.ndarray  # first bin of each feature

    def emissions(self, bins: np.ndarray, row: np.ndarray) -> np.ndarray:
        at = bins + self.base
        score, left, right = (w[at].sum(1) for w in (self.own, self.before, self.after))
        same = row[1:] == row[:-1]
        score[1:][same] += left[:-1][same]
        score[:-1][same] += right[1:][same]
        return score

    def marginals(self, bins: np.ndarray, row: np.ndarray) -> np.ndarray:
        return _Batch(row).run(self.emissions(bins, row), self.move, self.start)[0]

    def viterbi(self, bins: np.ndarray, row: np.ndarray) -> np.ndarray:
        return _Batch(row).best(self.emissions(bins, row), self.move, self.start)


class _Batch:
    """Places of the lines of each document, step by step; `row` is sorted."""

    def __init__(self, row: np.ndarray):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(row)))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        longest = int(size[0]) if len(size) else 0
        active = len(size) - np.searchsorted(size[::-1], np.arange(longest), side="right")
        self.n, self.steps = len(row), [first[: active[t]] + t for t in range(longest)]
        self.size = size

    def run(self, score: np.ndarray, move: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals by line, summed pairwise marginals, and the summed log of the normaliser."""
        alpha, beta = np.empty_like(score), np.zeros_like(score)
        for t, at in enumerate(self.steps):
            alpha[at] = score[at] + (start if t == 0 else _log_sum(alpha[at - 1][:, :, None] + move, 1))
        for at in reversed(self.steps[1:]):
            beta[at - 1] = _log_sum(move + (score[at] + beta[at])[:, None, :], 2)
        joint = alpha + beta
        total = _log_sum(joint, 1) if len(joint) else np.zeros(0)
        both = np.zeros_like(move)
        if pairs:
            for at in self.steps[1:]:
                both += np.exp(alpha[at - 1][:, :, None] + move + (score[at] + beta[at])[:, None, :] - total[at][:, None, None]).sum(0)
        return np.exp(joint - total[:, None]), both, float(total[self.steps[0]].sum()) if self.steps else 0.0

    def best(self, score: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
        value, back = np.empty_like(score), np.zeros(score.shape, np.int8)
        for t, at in enumerate(self.steps):
            if t == 0:
                value[at] = score[at] + start
            else:
                ways = value[at - 1][:, :, None] + move
                back[at] = ways.argmax(1)
                value[at] = score[at] + ways.max(1)
        label = value.argmax(1).astype(np.int8) if len(value) else np.zeros(0, np.int8)
        for at in reversed(self.steps[1:]):
            label[at - 1] = back[at, label[at]]
        return label


def fit(bins: np.ndarray, row: np.ndarray, label: np.ndarray, sizes: list[int], *, labels: int = 2, steps: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> Crf:
    """Adam on the mean log likelihood per document; `label` by line, `sizes` the bins of each feature."""
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    width = int(sum(sizes))
    model = Crf(*(np.zeros((width, labels)) for _ in range(3)), np.zeros((labels, labels)), np.zeros(labels), base)
    if not len(row):
        return model
    batch = _Batch(row)
    docs = len(batch.size)
    gold = np.eye(labels)[label]
    same = row[1:] == row[:-1]
    moves = np.zeros((labels, labels))
    np.add.at(moves, (label[:-1][same], label[1:][same]), 1)
    at = bins + base
    names = ("own", "before", "after", "move", "start")
    first = {k: np.zeros_like(getattr(model, k)) for k in names}
    second = {k: np.zeros_like(getattr(model, k)) for k in names}
    for step in range(1, steps + 1):
        p, both, _ = batch.run(model.emissions(bins, row), model.move, model.start, True)
        error = gold - p
        ahead, behind = np.zeros_like(error), np.zeros_like(error)
        ahead[:-1][same], behind[1:][same] = error[1:][same], error[:-1][same]

        def spread(e: np.ndarray) -> np.ndarray:
            return np.stack([sum(np.bincount(at[:, f], e[:, k], width) for f in range(at.shape[1])) for k in range(labels)], 1)

        head = error[batch.steps[0]].sum(0)
        for k, g in zip(names, (spread(error), spread(ahead), spread(behind), moves - both, head), strict=True):
            value = getattr(model, k)
            g = g / docs - ridge * value
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            value += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model
