"""Benchmark decontamination: a hash set of the benchmark's n-grams, scanned by every training text.

Texts are lower-cased (A-Z) and split into runs of digits, a-z and non-ASCII
characters. Each benchmark item gives all windows of `width` words; an item with
fewer words, but at least one, is one window of its own length. Every document
window whose hash is in the set is verified against the item's words, so a hash
collision can never mark a word.

A broadcast set holds at most `max_bytes` of benchmark text (or one longer item). A
larger benchmark is read item by item into several such sets; the documents then
pass through one scan after the other, each adding its verified hits to those before,
`TOGETHER` scans in a stage and then a written table, so nothing is shuffled, the
driver holds one set at a time and the executors a bounded number. A window that many
items share is verified and kept once, with the list of its items.

Defined results: a null or empty text has no words and is never contaminated; a
null or empty item has no window; a repeated item_id counts once; null item_ids
have no name and only mark words; repeated documents are judged row by row;
other columns, whatever their names, pass through unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.workers import lean
from . import ragged as R
from . import shared

WIDTH = 10
#: Bytes of benchmark text in one broadcast set; more text means more passes.
MAX_BYTES = 8 << 20


class NgramSet:
    """Windows of benchmark items, by their number of words: sorted hashes, and for each its words and its item."""

    def __init__(self, items: list[tuple[object, str | None]], width: int = WIDTH):
        self.width = width
        self.names = [None if name is None else str(name) for name, _ in items]
        data, offsets = R.text_buffers(pa.array([t for _, t in items], pa.string()))
        data = R.LOWER[data]
        s, e, rows = R.spans(data, offsets, R.ALNUM_LOWER)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        self.blob = b" ".join(words)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
        wh, per = R.span_hashes(data, s, e), R.counts(rows, len(items))
        self.by_size: dict[int, tuple[np.ndarray, ...]] = {}
        self._items: list[list[str]] = []
        for size in range(1, width + 1):
            first, h = R.windows(wh, rows, size)
            first, h = (x[(per[rows[first]] == size) | (size == width)] for x in (first, h))
            if len(h):
                order = np.argsort(h, kind="stable")
                first, h = first[order], h[order]
                shift = 64 - max(16, int(np.ceil(np.log2(16 * len(h)))))
                table = np.zeros(1 << (64 - shift), bool)
                table[(h >> np.uint64(shift)).astype(np.int64)] = True
                begin, end = at[first], at[first + size] - 1
                # Items of a window: one entry for each distinct text, in the order of hashes.
                seen: dict[bytes, int] = {}
                kept: list[int] = []
                for p in range(len(h)):
                    window = self.blob[begin[p] : end[p]]
                    if (entry := seen.get(window)) is None:
                        entry = seen[window] = len(self._items)
                        self._items.append([])
                        kept.append(p)
                    if (name := self.names[rows[first[p]]]) is not None:
                        self._items[entry].append(name)
                one = np.array(kept, np.int64)
                self.by_size[size] = h[one], begin[one], end[one], np.fromiter((seen[self.blob[begin[p] : end[p]]] for p in kept), np.int64, len(kept)), shift, table

    def items_of(self, window: int) -> list[str]:
        """Names of the items that have a window."""
        return self._items[window]

    def scan(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words of each row, and of every verified hit: row, first word, number of words, window, first and last byte."""
        data, offsets = R.text_buffers(column)
        total = np.zeros(len(offsets) - 1, np.int64)
        hits: list[tuple[int, ...]] = []
        for lo, hi in R.chunks(offsets):
            part, off = R.LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
            s, e, rows = R.spans(part, off, R.ALNUM_LOWER)
            total[lo:hi] = R.counts(rows, hi - lo)
            wh = R.span_hashes(part, s, e)
            first = np.searchsorted(rows, np.arange(hi - lo))
            for size, (known, begin, end, item, shift, table) in self.by_size.items():
                at, h = R.windows(wh, rows, size)
                near = np.flatnonzero(table[(h >> np.uint64(shift)).astype(np.int64)])
                left, right = np.searchsorted(known, h[near]), np.searchsorted(known, h[near], side="right")
                for k in np.flatnonzero(right > left).tolist():
                    i = int(at[near[k]])
                    window = b" ".join(part[s[j] : e[j]].tobytes() for j in range(i, i + size))
                    r = int(rows[i])
                    for p in range(int(left[k]), int(right[k])):
                        if self.blob[begin[p] : end[p]] == window:
                            hits.append((lo + r, i - int(first[r]), size, int(item[p]), int(s[i] - off[r]), int(e[i + size - 1] - off[r])))
        found = np.array(hits, np.int64).reshape(-1, 6)
        return total, found[np.argsort(found[:, 0], kind="stable")]


def ngram_sets(benchmark: DataFrame, id_col: str, text_col: str, width: int = WIDTH, max_bytes: int = MAX_BYTES) -> Iterator[NgramSet]:
    """Sets of at most `max_bytes` of text each, or of one longer item; repeated rows count once."""
    items: list[tuple[object, str | None]] = []
    size = 0
    for row in benchmark.select(id_col, text_col).distinct().toLocalIterator():
        n = len((row[1] or "").encode())
        if items and size + n > max_bytes:
            yield NgramSet(items, width)
            items, size = [], 0
        items.append((row[0], row[1]))
        size += n
    yield NgramSet(items, width)


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as disjoint ones, in order."""
    order = np.argsort(start, kind="stable")
    start, top = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], start[1:] > top[:-1]])
    return start[new], top[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(top) - 1]])]


#: Sets that one stage scans with; after them the rows are written, and their sets are let go.
TOGETHER = 8


def _scanned(df: DataFrame, benchmark: DataFrame, text_col: str, id_col: str, item_text: str, width: int, max_bytes: int, finish: Callable, schema: T.StructType) -> DataFrame:
    """`finish(batch, words, hits by row, items by row)` makes the rows of `schema` from each batch after the last set."""
    shared.prepare(df.sparkSession)
    context = df.sparkSession.sparkContext
    # What earlier sets found, beside the caller's columns: spans of words and bytes, and item names.
    hits, items = shared.unused("hits", df), shared.unused("items", df)
    carry = T.StructType([*df.schema.fields, T.StructField(hits, T.BinaryType()), T.StructField(items, T.ArrayType(T.StringType()))])
    sets, k, sent = ngram_sets(benchmark, id_col, item_text, width, max_bytes), 0, []
    one = next(sets)
    while one is not None:
        after = next(sets, None)
        sent.append(context.broadcast(one))
        df = df.mapInArrow(lean(_step(sent[-1], text_col, hits, items, k > 0, None if after else finish)), carry if after else schema)
        k += 1
        if after and k % TOGETHER == 0:
            df = shared.written(df, "scanned")
            for x in sent:
                x.destroy()
            sent = []
        one = after
    return df


def _step(one, text_col: str, hits_col: str, items_col: str, later: bool, finish: Callable | None):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = one.value
        for batch in batches:
            n = batch.num_rows
            total, hits = known.scan(batch.column(text_col))
            rows = [np.empty((0, 4), np.int64)] * n
            names: list[list[str]] = [[]] * n
            cuts = np.flatnonzero(np.diff(hits[:, 0])) + 1
            for own in np.split(hits, cuts) if len(hits) else []:
                rows[own[0, 0]] = own[:, [1, 2, 4, 5]]
                names[own[0, 0]] = list({x for i in np.unique(own[:, 3]).tolist() for x in known.items_of(i)})
            if later:
                for r, (old, found) in enumerate(zip(batch.column(hits_col).to_pylist(), batch.column(items_col).to_pylist(), strict=True)):
                    if old:
                        rows[r] = np.concatenate([np.frombuffer(old, np.int64).reshape(-1, 4), rows[r]])
                        names[r] = [*{*names[r], *found}]
                batch = batch.drop_columns([hits_col, items_col])
            if finish:
                yield finish(batch, total, rows, names)
            else:
                yield batch.append_column(hits_col, pa.array([x.tobytes() for x in rows], pa.binary())).append_column(items_col, pa.array(names, pa.list_(pa.string())))

    return step


def contamination(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per row of `df`: id, n_words, n_hit, hit_spans (byte ranges of the hit text), items (sorted names)."""
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))])

    def finish(batch, total, rows, names):
        n_hit, spans = [], []
        for x in rows:
            if not len(x):
                n_hit.append(0)
                spans.append([])
                continue
            a, b = merged(x[:, 0], x[:, 0] + x[:, 1])
            n_hit.append(int((b - a).sum()))
            spans.append(np.stack(merged(x[:, 2], x[:, 3]), 1).tolist())
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(total), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x) for x in names], pa.list_(pa.string()))], names=[f.name for f in schema.fields])

    return _scanned(df.select(id_col, text_col), benchmark, text_col, item_col, item_text, width, max_bytes, finish, schema)


def decontaminate(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, max_bytes: int = MAX_BYTES, drop_share: float = 0.5, remove: str = "spans") -> DataFrame:
    """`df` without benchmark text, same columns.

    remove="spans" cuts the hit words out of a text and drops the row only where
    more than `drop_share` of its words are hit; remove="documents" drops every row
    with a hit. A cut leaves one space between the words around it.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove must be spans or documents, not {remove}")

    def finish(batch, total, rows, names):
        keep, texts = [], {}
        for r, x in enumerate(rows):
            if len(x):
                a, b = merged(x[:, 0], x[:, 0] + x[:, 1])
                if remove == "documents" or (b - a).sum() > drop_share * total[r]:
                    continue
                texts[len(keep)] = r, merged(x[:, 2], x[:, 3])
            keep.append(r)
        out = batch.take(pa.array(keep, pa.int64()))
        if texts:
            k = out.schema.get_field_index(text_col)
            new = out.column(k).to_pylist()
            for at, (_, (a, b)) in texts.items():
                raw = new[at].encode()
                parts = [raw[i:j].decode() for i, j in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True)]
                # White space goes at the cuts, and stays at the ends of the text.
                parts = [(x.lstrip() if i else x) for i, x in enumerate(parts)]
                parts = [(x.rstrip() if i < len(parts) - 1 else x) for i, x in enumerate(parts)]
                new[at] = " ".join(x for x in parts if x)
            out = out.set_column(k, out.schema.field(k), pa.array(new, out.schema.field(k).type))
        return out

    return _scanned(df, benchmark, text_col, item_col, item_text, width, max_bytes, finish, df.schema)

