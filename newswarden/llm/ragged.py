"""Vectorised word and window kernels over Arrow string columns.

Everything here works on the raw UTF-8 bytes of an Arrow batch, so a batch of
documents costs a few numpy passes instead of a Python loop per word. All the
byte classes used by the operators contain every byte >= 0x80 or none, hence
splitting bytes is the same as splitting code points.

Nulls are empty texts. Memory is bounded by `CHUNK_BYTES` of text at a time; a
single longer text forms a chunk of its own, because a text is one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
MASK64 = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15 | 3, 0xD6E8FEB86659FD93 | 3, 0xA0761D6478BD642F | 3)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values(seed: int) -> np.ndarray:
    return mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(seed & MASK64 | 1))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, min(2 * len(self.up), CHUNK_BYTES + 1))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up, self.down


_POWERS = [_Powers(b) for b in _BASES]
_VALUES = [_byte_values(b * 7 + 11) for b in _BASES]


def byte_class(predicate) -> np.ndarray:
    return np.fromiter((bool(predicate(b)) for b in range(256)), bool, 256)


#: Bytes of `[^\x20\x09-\x0D]`.
NOT_SPACE = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, that is digits, a-z and all beyond ASCII.
ALNUM_LOWER = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if len(off) == 0:
        return raw[:0], np.zeros(1, np.int64)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes in `table`; runs end at row ends."""
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = np.unique(offsets[1:-1])
        edges = edges[(edges > 0) & (edges < len(data))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; `which` picks one of three independent ones."""
    up, down = _POWERS[which].upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[which][data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))


def windows(hashes: np.ndarray, rows: np.ndarray, width: int, which: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of all `width` consecutive words of one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = _POWERS[which].upto(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    at = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return at, mix64((total[at + width] - total[at]) * down[at] + np.uint64(width))


def counts(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights, minlength=n).astype(np.int64)


def gather(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Concatenates values[bounds[w]:bounds[w + 1]] for each w of `which`."""
    lengths = bounds[which + 1] - bounds[which]
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    index = np.arange(total, dtype=np.int64) + np.repeat(bounds[which] - (ends - lengths), lengths)
    return values[index]
