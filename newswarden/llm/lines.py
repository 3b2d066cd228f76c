"""Statistics of texts and features of their lines, from bytes.

A line is what lies between line feeds; only lines with a word (a run of
`[^\\x20\\x09-\\x0D]`) count. A text without words has no lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import ragged as R

#: Words of the windows whose repetition within a text counts.
REPEAT = 8
SYMBOLS = R.byte_class(lambda b: chr(b) in "#*$%&|<>")
UPPER = R.byte_class(lambda b: 0x41 <= b <= 0x5A)
DIGIT = R.byte_class(lambda b: 0x30 <= b <= 0x39)
CONTINUATION = R.byte_class(lambda b: 0x80 <= b < 0xC0)

#: Upper ends of the bins of each line feature; the last bin is open.
BINS = {
    "symbols_per_word": (0.0, 0.1, 0.5, 1.0, 2.0),
    "marks_per_word": (0.0, 0.1, 0.5, 1.0),
    "bars_per_word": (0.0, 0.1, 0.3),
    "upper_share": (0.02, 0.1, 0.3, 0.6),
    "digit_share": (0.0, 0.05, 0.2),
    "stutter_share": (0.0, 0.1, 0.3, 0.6),
    "repeat_share": (0.0, 0.2, 0.6, 0.95),
    "repeated_line": (0.0,),
    "words": (1, 3, 8, 20, 60),
    "word_length": (2.5, 4.0, 6.0, 9.0),
}


@dataclass
class Lines:
    """One run of rows: statistics by row, and its lines in order with their rows, lengths and feature bins."""

    lo: int
    hi: int
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    row: np.ndarray
    chars: np.ndarray
    bins: np.ndarray


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, whether it occurs more than once, and whether it occurred before."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    many, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    many[order[1:]] = before[order[1:]] = same
    many[order[:-1]] |= same
    return many, before


def tables(column: pa.Array) -> Iterator[Lines]:
    data, offsets = R.text_buffers(column)
    for lo, hi in R.chunks(offsets):
        yield _table(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo, hi)


def _table(part: np.ndarray, off: np.ndarray, lo: int, hi: int) -> Lines:
    n = hi - lo
    s, e, rows = R.spans(part, off, R.NOT_SPACE)
    wh = R.span_hashes(part, s, e)

    def upto(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(part) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total

    points, spaces, symbols = upto(~CONTINUATION[part]), upto(~R.NOT_SPACE[part]), upto(SYMBOLS[part])
    width = points[e] - points[s]

    at, h = R.windows(wh, rows, REPEAT)
    many, _ = _again(R.mix64(h + rows[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    edge = np.zeros(len(s) + 1, np.int64)
    np.add.at(edge, at[many], 1)
    np.add.at(edge, at[many] + REPEAT, -1)
    repeated = np.cumsum(edge[:-1]) > 0

    feeds = np.flatnonzero(part == 0x0A)
    begin = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], feeds + 1]))
    begin = begin[begin < len(part)]
    stop = np.searchsorted(feeds, begin)
    line_row = np.searchsorted(off, begin, side="right") - 1
    end = np.minimum(np.append(feeds, len(part))[stop] if len(begin) else begin, off[line_row + 1])
    line_of = np.searchsorted(begin, s, side="right") - 1
    words = np.bincount(line_of, minlength=len(begin))
    real = np.flatnonzero(words)
    place = np.full(len(begin), -1, np.int64)
    place[real] = np.arange(len(real))
    begin, end, row, words, line_of = begin[real], end[real], line_row[real], words[real], place[line_of]
    key = R.span_hashes(part, begin, end, 2) + R.mix64(row.astype(np.uint64) + np.uint64(1))
    _, dup = _again(key)

    stutter = np.zeros(len(s), bool)
    stutter[1:] = (wh[1:] == wh[:-1]) & (line_of[1:] == line_of[:-1])
    chars = points[end] - points[begin]
    solid = np.maximum(chars - (spaces[end] - spaces[begin]), 1)
    per = np.maximum(words, 1)

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = upto(mask)
        return (total[end] - total[begin]) / of

    latin = np.zeros(len(part), bool)
    latin[1:] = (part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E)
    values = {
        "symbols_per_word": (symbols[end] - symbols[begin]) / per,
        "marks_per_word": share(part == 0x21, per),
        "bars_per_word": share(part == 0x7C, per),
        "upper_share": share(UPPER[part] | latin, solid),
        "digit_share": share(DIGIT[part], solid),
        "stutter_share": np.bincount(line_of, stutter, len(begin)) / per,
        "repeat_share": np.bincount(line_of, repeated, len(begin)) / per,
        "repeated_line": dup.astype(float),
        "words": words,
        "word_length": solid / per,
    }
    bins = np.empty((len(begin), len(BINS)), np.int8)
    for k, (name, edges) in enumerate(BINS.items()):
        bins[:, k] = np.searchsorted(np.array(edges, float), values[name], side="left")
    total = symbols[off[1:]] - symbols[off[:-1]]
    return Lines(lo, hi, R.counts(rows, n), R.counts(rows, n, width), total, R.counts(row, n, dup), R.counts(rows, n, repeated), row, chars, bins)
