"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes symbols, one per character, with spaces as U+2581 and one such mark
before the text. An agenda holds the adjacent pairs of symbols whose join is a
piece, ordered by score and then by place; the best pair is merged, its
neighbouring pairs are entered, until no pair is left. Characters that are no piece
become byte pieces.

No piece of such a vocabulary may hold a mark after another character (checked
when the model is loaded), so no merge crosses the place before a run of spaces.
Texts are therefore cut there, each distinct segment of a task is encoded once,
and rows are put together by gathers. Short segments take their agendas' best
entries all at once, in rounds over arrays; long ones use a heap each. Every
segment that is encoded is checked against the sentencepiece library, batch by
batch, and so is the first whole text of each batch; a difference raises.

Defined results: null is empty; an empty text has the begin and end ids alone and
decodes to the empty string; repeated rows are encoded alike; other columns are
not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.workers import lean
from . import ragged as R
from . import shared

MARK = "▁"
#: Symbols up to which segments are merged together in arrays; a longer one has a heap of its own.
LONG = 48
#: Distinct segments and ids that a task keeps; beyond it starts anew.
CACHE_SEGMENTS, CACHE_IDS = 1 << 21, 1 << 24
_NONE = np.int32(2**31 - 1)


class Model:
    def __init__(self, path: str, check: bool = True):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.check = check
        self.size = n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        if any(MARK in p.lstrip(MARK) for p, ok in zip(pieces, normal, strict=True) if ok):
            raise ValueError("a piece has a space mark after another character: texts can't be cut at spaces")
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.ids = {p: i for i, (p, ok) in enumerate(zip(pieces, normal, strict=True)) if ok}
        self.byte_id = np.full(256, self.unk, np.int32)
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[3:-1], 16)] = i
        self.pieces = pieces
        scores = np.array([sp.get_score(i) for i in range(n)], np.float64)
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.char_id = np.full(0x110000, -1, np.int32)
        pairs: dict[int, int] = {}
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        self.pairs = pairs
        text = [b"" if sp.is_control(i) else bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        text[self.unk] = " ⁇ ".encode()
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_bounds = np.concatenate([[0], np.cumsum([len(x) for x in text])]).astype(np.int64)
        self.forget()

    def forget(self) -> None:
        """An empty store: hashes in two sorted runs, the smaller for what is new, with places in buffers that grow by doubling."""
        self.runs = [(np.empty(0, np.uint64), np.empty(0, np.int64)) for _ in range(2)]
        self.n_segments = self.n_ids = 0
        self.second = np.empty(1 << 16, np.uint64)
        self.bounds = np.zeros(1 << 16, np.int64)
        self.values = np.empty(1 << 18, np.int32)

    def _store(self, second: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Puts segments into the buffers; gives their places."""
        n, total = self.n_segments + len(second), self.n_ids + len(ids)
        for name, need in (("second", n), ("bounds", n + 1), ("values", total)):
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros(max(need, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.second[self.n_segments : n] = second
        self.bounds[self.n_segments + 1 : n + 1] = bounds[1:] + self.n_ids
        self.values[self.n_ids : total] = ids
        places = np.arange(self.n_segments, n)
        self.n_segments, self.n_ids = n, total
        return places

    def heap(self, segment: str) -> list[int]:
        """One segment, its spaces already marks, by an agenda in a heap."""
        sym = [self.ids.get(c, -1 - ord(c)) for c in segment]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def enter(i: int) -> None:
            j = after[i]
            if j < n and sym[i] >= 0 and sym[j] >= 0 and (m := self.pairs.get(sym[i] << 32 | sym[j])) is not None:
                heapq.heappush(agenda, (int(self.rank[m]), i, sym[i], sym[j]))

        for i in range(n - 1):
            enter(i)
        gone = bytearray(n)
        while agenda:
            _, i, a, b = heapq.heappop(agenda)
            j = after[i]
            if gone[i] or sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i] = self.pairs[a << 32 | b]
            gone[j] = 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                enter(before[i])
            enter(i)
        return [x for i, x in enumerate(sym) if not gone[i]]

    def _merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ids[at], -1).astype(np.int32)

    def _rounds(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Many short segments at once: each round takes the best entry of every segment's agenda."""
        done_sym, done_seg = [], []
        join = np.full(len(sym), -1, np.int32)
        join[:-1] = self._merge_of(sym[:-1], sym[1:])
        join[:-1][seg[:-1] != seg[1:]] = -1
        while len(sym):
            rank = np.where(join >= 0, self.rank[join], _NONE)
            first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            open_ = np.repeat(best != _NONE, size)
            if not open_.all():
                done_sym.append(sym[~open_])
                done_seg.append(seg[~open_])
            top = np.flatnonzero(open_ & (rank == np.repeat(best, size)))
            if not len(top):
                break
            top = top[np.concatenate([[True], seg[top[1:]] != seg[top[:-1]]])]
            sym[top] = join[top]
            open_[top + 1] = False
            stay = np.flatnonzero(open_)
            at = np.searchsorted(stay, top)
            sym, seg, join = sym[stay], seg[stay], join[stay]
            for i in (at, at[at > 0] - 1):
                j = np.minimum(i + 1, len(sym) - 1)
                join[i] = np.where((j > i) & (seg[i] == seg[j]), self._merge_of(sym[i], sym[j]), -1)
        sym, seg = np.concatenate(done_sym or [sym]), np.concatenate(done_seg or [seg])
        order = np.argsort(seg, kind="stable")
        return sym[order], seg[order]

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of segments whose spaces are marks."""
        n = len(segments)
        size = np.fromiter(map(len, segments), np.int64, n)
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        sym = self.char_id[points]
        sym = np.where(sym < 0, -1 - points.astype(np.int64), sym).astype(np.int32)
        seg = np.repeat(np.arange(n), size)
        short = np.repeat(size <= LONG, size)
        a, b = self._rounds(sym[short], seg[short])
        long = [(k, self.heap(segments[k])) for k in np.flatnonzero(size > LONG).tolist()]
        if long:
            a = np.concatenate([a, *(np.array(x, np.int32) for _, x in long)])
            b = np.concatenate([b, *(np.full(len(x), k) for k, x in long)])
            order = np.argsort(b, kind="stable")
            a, b = a[order], b[order]
        unknown = a < 0
        if unknown.any():
            raw = [chr(-1 - int(x)).encode("utf-8", "surrogatepass") if x < 0 else b"" for x in a[unknown]]
            width = np.ones(len(a), np.int64)
            width[unknown] = [len(x) for x in raw]
            a, b = np.repeat(a, width), np.repeat(b, width)
            a[np.repeat(unknown, width)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return a, np.concatenate([[0], np.cumsum(np.bincount(b, minlength=n))]).astype(np.int64)

    def _library(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of segments from the library, for users of the ids who don't ask for the agenda."""
        theirs = self.library.encode(segments, num_threads=1)
        for k in [k for k, x in enumerate(segments) if not x]:
            # The library puts no mark before an empty text.
            theirs[k] = self.heap(MARK)
        size = np.fromiter(map(len, theirs), np.int64, len(theirs))
        return np.fromiter(chain.from_iterable(theirs), np.int32, int(size.sum())), np.concatenate([[0], np.cumsum(size)])

    def _checked(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, bounds = self.encode_segments([MARK + s for s in segments])
        theirs = self.library.encode([s.replace(MARK, " ") for s in segments], num_threads=1)
        for k in [k for k, x in enumerate(segments) if not x]:
            # The library puts no mark before an empty text, so this segment can't be asked for.
            theirs[k] = ids[bounds[k] : bounds[k + 1]].tolist()
        size = np.fromiter(map(len, theirs), np.int64, len(theirs))
        if not np.array_equal(size, np.diff(bounds)) or not np.array_equal(np.fromiter(chain.from_iterable(theirs), np.int32, int(size.sum())), ids):
            raise RuntimeError("a segment's ids differ from the sentencepiece library's")
        return ids, bounds

    def _segments(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Row range by row range: first and last row, rows of the segments, and their places in the store."""
        if column.null_count:
            column = pc.fill_null(column, "")
        if pc.any(pc.match_substring(column, MARK)).as_py():
            column = pc.replace_substring(column, MARK, " ")
        data, offsets = R.text_buffers(column)
        for lo, hi in R.chunks(offsets):
            part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            space = part == 0x20
            cut = np.zeros(len(part), bool)
            cut[off[:-1][np.diff(off) > 0]] = True
            cut[1:] |= space[1:] & ~space[:-1]
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(part))[: len(starts)]
            rows = np.searchsorted(off, starts, side="right") - 1
            # A row's first segment has the added mark before it; the others' own first space is that mark.
            begin = starts + (starts != off[rows])
            h, second = R.span_hashes(part, begin, ends), R.span_hashes(part, begin, ends, 1)
            own, one, inverse = np.unique(h, return_index=True, return_inverse=True)
            which = self.lookup(own, second[one], part, begin[one], ends[one])[inverse]
            if not np.array_equal(self.second[which], second):
                raise RuntimeError("two segments have the same hash")  # both have 64 independent bits
            yield lo, hi, rows, which

    def lengths(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Numbers of ids of the rows, without begin and end."""
        for lo, hi, rows, which in self._segments(column):
            yield np.bincount(rows, self.bounds[which + 1] - self.bounds[which], minlength=hi - lo).astype(np.int64)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Row range by row range: first and last row, all ids without begin and end, and their bounds by row."""
        for lo, hi, rows, which in self._segments(column):
            ids = R.gather(self.values, self.bounds, which)
            per = np.bincount(rows, self.bounds[which + 1] - self.bounds[which], minlength=hi - lo).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(per)])
            if self.check and lo == 0 and self.library.encode(column[0].as_py() or "") != ids[: bounds[1]].tolist():
                raise RuntimeError("a text's ids differ from the sentencepiece library's")
            yield lo, hi, ids, bounds

    def lookup(self, own: np.ndarray, second: np.ndarray, part: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of the segments (by sorted hashes), each with a mark before it, in the worker's store; those not there yet are encoded."""
        if self.n_segments > CACHE_SEGMENTS or self.n_ids > CACHE_IDS:
            self.forget()
        out = np.full(len(own), -1, np.int64)
        for known, place in self.runs:
            if len(known):
                left = np.flatnonzero(out < 0)
                at = np.minimum(np.searchsorted(known, own[left]), len(known) - 1)
                hit = known[at] == own[left]
                out[left[hit]] = place[at[hit]]
        new = np.flatnonzero(out < 0)
        if len(new):
            raw = part.tobytes()
            segments = [raw[a:b].decode() for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)]
            if self.check:
                found = self._checked([x.replace(" ", MARK) for x in segments])
            else:
                found = self._library([x.replace(MARK, " ") for x in segments] if MARK.encode() in raw else segments)
            out[new] = self._store(second[new], *found)
            (old, places), (some, their) = self.runs
            at = np.searchsorted(some, own[new])
            some, their = np.insert(some, at, own[new]), np.insert(their, at, out[new])
            if len(some) > max(1 << 16, len(old) // 4):
                at = np.searchsorted(old, some)
                old, places = np.insert(old, at, some), np.insert(places, at, their)
                some, their = some[:0], their[:0]
            self.runs = [(old, places), (some, their)]
        return out

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bounds) of rows of ids: pieces in a row, marks as spaces, without the added one."""
        raw = R.gather(self.text, self.text_bounds, ids)
        ends = np.concatenate([[0], np.cumsum(self.text_bounds[ids + 1] - self.text_bounds[ids])])[bounds]
        begin = ends[:-1].copy()
        lead = begin < ends[1:]
        lead[lead] = raw[begin[lead]] == 0x20
        return raw, np.stack([begin + lead, ends[1:]], 1)


@lru_cache(maxsize=2)
def load(path: str, check: bool = True) -> Model:
    """One model per worker process; without `check` distinct segments are encoded by the library alone, which costs a third."""
    return Model(path, check)


def encode_digests(df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens with begin and end, digests of the ids and of the text they decode to, and the ids if asked for."""
    shared.prepare(df.sparkSession)
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        try:
            yield from encoded(model, batches)
        finally:
            # A reused worker would carry the store through the stages that come after.
            model.forget()

    def encoded(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, bounds in model.encode(batch.column(1)):
                raw, ends = model.decode(ids, bounds)
                out: list[list] = [[], [], [], []]
                for r in range(hi - lo):
                    own = np.empty(bounds[r + 1] - bounds[r] + 2, "<u4")
                    own[0], own[1:-1], own[-1] = model.bos, ids[bounds[r] : bounds[r + 1]], model.eos
                    for column, x in zip(out, (len(own), sha256(own).hexdigest(), sha256(raw[ends[r, 0] : ends[r, 1]]).hexdigest(), own.tolist() if keep_ids else None), strict=True):
                        column.append(x)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
                columns = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)][: 3 + keep_ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names=[f.name for f in schema.fields])

    return df.select(id_col, text_col).mapInArrow(lean(run), schema)


def decode_ids(df: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the text of an array of ids; null ids give null. Invalid UTF-8 becomes U+FFFD."""
    shared.prepare(df.sparkSession)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                if ids is None:
                    texts.append(None)
                    continue
                own = np.array(ids, np.int64)
                raw, ends = model.decode(own, np.array([0, len(own)]))
                texts.append(raw[ends[0, 0] : ends[0, 1]].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(lean(run), schema)
