"""Spelling variants: words one edit apart, found by the halves of words in Aho-Corasick automata.

A word of L code points is cut into a first half of L // 2 and a second half. If two
words differ by one inserted, deleted or replaced code point, one half of the first
stands unharmed at the start or at the end of the second. So automaton shards hold the
two halves of every word, every word is scanned by every shard, and a hit counts where
it begins at the start (first half) or ends at the end (second half) and the lengths
differ by one at most. What is left is verified: common prefix and common suffix cover
all but the edited place. A pair that both halves find counts once. Pairs never become
rows: a shard says how many near words each scanned word has, and which is the best.

A shard holds at most about `shard` words, whatever the number of words; words to be
scanned come in blocks, a block and a shard in one task, the shard first, so a task holds
one automaton and a batch of words. All of it is joined by sorting and streams, and a lost
task is done again from the written table of words.

Defined results: a null text has no words, and a null id counts as empty text before the
colon; repeated rows count again; words of any length are taken whole; ties between forms
go to the smallest word in code-point order. An empty table has no words. Only the named
columns are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Words of an automaton, and the least number worth a task's building one.
SHARD, LEAST_BLOCK = 131_072, 4_096
#: Distinct words that a task counts before it hands them on; candidates that are verified at once.
PENDING, TOGETHER = 300_000, 1 << 18
#: Longest word that is verified in the matrix of bytes; longer ones are compared one by one.
WIDE = 32
_RUN = re.compile("[a-zÀ-ÿ]+")
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])


def _text_words(key: bytes, text: bytes, slips: int) -> Iterator[tuple[str, int]]:
    """Runs of letters with their counts; in one of `slips` (by the checksum of id and run) a code point is left out."""
    before = zlib.crc32(key + b":")
    for run, n in Counter(_RUN.findall(text.lower().decode())).items():
        if slips and (h := zlib.crc32(run.encode(), before)) % slips == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = 0, least_chars: int = 5, least: int = 3) -> DataFrame:
    """(word, n): lower-cased runs of Latin letters of at least `least_chars` code points that occur `least` times or more."""
    shared.prepare(documents.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=_COUNTS)
            held.clear()
            return batch

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in _text_words(key, text or b"", slips):
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) > PENDING:
                    yield out()
        yield out()

    rows = documents.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary").alias("k"), F.col(text_col).cast("binary").alias("t")).where("t is not null")
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    short, long = sorted((a, b), key=len)
    if len(long) - len(short) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    return short[p + (len(short) == len(long)) :] == long[p + 1 :]


class Block:
    """Words as rows of bytes, from the left and from the right, with their lengths and the set of their letters (as bits, by 64); longer than WIDE is zero."""

    def __init__(self, words: list[str]):
        self.words, self.lengths = words, np.fromiter(map(len, words), np.int64, len(words))
        coded = [w.encode("latin-1") if len(w) <= WIDE else b"" for w in words]
        self.left = np.frombuffer(b"".join(c.ljust(WIDE, b"\0") for c in coded), np.uint8).reshape(-1, WIDE)
        self.right = np.frombuffer(b"".join(c[::-1].ljust(WIDE, b"\0") for c in coded), np.uint8).reshape(-1, WIDE)
        bits = np.where(self.left > 0, np.left_shift(np.uint64(1), (self.left & 63).astype(np.uint64)), np.uint64(0))
        self.letters = np.bitwise_or.reduce(bits, axis=1) if len(words) else np.zeros(0, np.uint64)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places that the rows share from the start; WIDE where all are equal."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), WIDE)


class Shard:
    """The automaton of both halves of its words, each half with the words that have it, by length."""

    def __init__(self, words: list[str], n: list[int]):
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        self.words, self.n = [words[i] for i in order], np.array([n[i] for i in order], np.int64)
        self.block = Block(self.words)
        self.members, found = [], {}
        for second in (False, True):
            half = [w[len(w) // 2 :] if second else w[: len(w) // 2] for w in self.words]
            by = sorted(range(len(half)), key=lambda i: (half[i], len(self.words[i])))
            self.members.append(np.array(by, np.int64))
            start = 0
            for k in range(1, len(by) + 1):
                key = (half[by[start]], len(self.words[by[start]]))
                if k == len(by) or (half[by[k]], len(self.words[by[k]])) != key:
                    found.setdefault(key[0], ({}, {}))[second][key[1]] = (start, k - start)
                    start = k
        self.automaton = ahocorasick.Automaton()
        for half, ranges in found.items():
            self.automaton.add_word(half, (len(half), *ranges))
        self.automaton.make_automaton()

    def scan(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Near words of each word in the shard, and the place of the best (the most frequent, then the smallest); len(self.words) is none."""
        block, count, best = Block(words), np.zeros(len(words), np.int64), np.full(len(words), len(self.words), np.int64)
        pending: list[tuple[int, int, int, bool]] = []
        size = 0
        for i, w in enumerate(words):
            length = len(w)
            for end, (m, first, second) in self.automaton.iter(w):
                for ranges, fits, kind in ((first, end + 1 == m, False), (second, end + 1 == length, True)):
                    if fits and ranges:
                        for near in (length - 1, length, length + 1):
                            if r := ranges.get(near):
                                pending.append((i, *r, kind))
                                size += r[1]
            if size >= TOGETHER:
                self._verify(block, pending, count, best)
                pending, size = [], 0
        self._verify(block, pending, count, best)
        return count, best

    def _verify(self, block: Block, pending: list[tuple[int, int, int, bool]], count: np.ndarray, best: np.ndarray) -> None:
        if not pending:
            return
        who, start, many, kind = (np.array(x, np.int64) for x in zip(*pending, strict=True))
        place = np.repeat(start - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        u, second = np.repeat(who, many), np.repeat(kind, many) > 0
        w = np.where(second, self.members[1][place], self.members[0][place])
        # One edit takes one letter from the set and brings one, at most; most candidates differ by more. (Long words have no set here.)
        alike = np.bitwise_count(block.letters[u] ^ self.block.letters[w]) <= 2
        alike |= (block.lengths[u] > WIDE) | (self.block.lengths[w] > WIDE)
        u, w, second = u[alike], w[alike], second[alike]
        lu, lw = block.lengths[u], self.block.lengths[w]
        least, near, halved = np.minimum(lu, lw), np.zeros(len(u), bool), lw // 2
        small = np.maximum(lu, lw) <= WIDE
        us, ws, ls = u[small], w[small], least[small]
        prefix, suffix = (np.minimum(_common(a[us], b[ws]), ls) for a, b in ((block.left, self.block.left), (block.right, self.block.right)))
        # Equal words share everything; words that differ share all but the edited place.
        near[small] = ((prefix < ls) | (lu[small] != lw[small])) & (prefix + suffix >= ls - (lu[small] == lw[small])) & ~(second[small] & (prefix >= halved[small]))
        for k in np.flatnonzero(~small):
            a, b = block.words[u[k]], self.words[w[k]]
            near[k] = one_edit(a, b) and not (second[k] and a.startswith(b[: len(b) // 2]))
        np.add.at(count, u[near], 1)
        np.minimum.at(best, u[near], w[near])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, block, scanned, word, n) in this order: the words of a shard, then those that it scans."""
    at, words, n, shard = None, [], [], None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "block", "scanned")], axis=1)
        if not len(key):
            continue
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            if tuple(key[a, :2]) != at:
                at, words, n, shard = tuple(key[a, :2]), [], [], None
            if not key[a, 2]:
                words += part.column("word").to_pylist()
                n += part.column("n").to_pylist()
                continue
            shard = shard or (Shard(words, n) if words else None)
            if shard is None:
                continue
            scanned = part.column("word").to_pylist()
            count, best = shard.scan(scanned)
            hit = np.flatnonzero(count)
            forms = [shard.words[i] for i in best[hit]]
            yield pa.RecordBatch.from_arrays([pa.array([scanned[i] for i in hit], pa.string()), pa.array(count[hit]), pa.array(forms, pa.string()), pa.array(shard.n[best[hit]])], schema=_NEAR)


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n_near, form, form_n) for each distinct word of `words` (word, n) that has near ones; the form is the most frequent of them."""
    spark = words.sparkSession
    shared.prepare(spark)
    total = words.count()
    shards = max(1, math.ceil(total / shard))
    blocks = max(shards, min(spark.sparkContext.defaultParallelism, math.ceil(total / LEAST_BLOCK)), 1)
    dealt = lambda seed, n: F.pmod(F.xxhash64("word", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kept = words.select(dealt(1, shards).alias("shard"), every(blocks).alias("block"), F.lit(0).alias("scanned"), "word", "n")
    scanned = words.select(every(shards).alias("shard"), dealt(2, blocks).alias("block"), F.lit(1).alias("scanned"), "word", "n")
    tasks = kept.union(scanned).repartitionById(shards * blocks, F.col("shard") * blocks + F.col("block")).sortWithinPartitions("shard", "block", "scanned")
    found = tasks.mapInArrow(_scanned, "word string, n_near bigint, form string, form_n bigint")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("minus"), "form")).alias("b")).select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.minus")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for links (word, form) without cycles: each round doubles the steps that a link spans."""
    now = shared.written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        after = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        later = shared.written(now.join(after, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        shared.drop(now)
        now = later
    return now.select("word", "root")


def variants(words: DataFrame, ratio: int = 2, shard: int = SHARD) -> DataFrame:
    """Every word of `words` (word, n; each word once) with its form, root, n, n_near and form_n.

    The form is the near word of largest n if that is `ratio` times the word's n or more; the root is where following forms ends.
    """
    kept = shared.written(words.select("word", "n"), "words")
    near = near_words(kept, shard)
    strong = F.col("form_n") >= ratio * F.col("n")
    joined = kept.join(near, "word", "left").select("word", F.when(strong, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("form_n")).alias("form_n"))
    found = shared.written(joined, "variants")
    shared.drop(kept)
    return found.join(roots(found.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def of_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = 0, shard: int = SHARD) -> DataFrame:
    """The variants of the words of all texts."""
    return variants(counts(documents, id_col, text_col, slips), shard=shard)
