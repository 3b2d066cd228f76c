"""Phrases whose words keep company, mined with hashed buckets (PCY, DHP) and Apriori pruning.

Pass k counts the phrases of k words exactly and, on the way, those of k + 1 words by
buckets: a hash of language and words picks one of `buckets` counters, which stop at the
least frequency. Before the next pass, the buckets that got there and the phrases that are
frequent become bitmaps of one bit a bucket, whose size is fixed, and are broadcast. The
next pass counts a phrase only if both phrases of one word less are marked as frequent
(Apriori) and its own bucket is marked (PCY); and it counts the next length by buckets only
where both parts passed (DHP). Marks never miss a frequent phrase, so the counts are exact.

There are about `SPREAD` buckets for each word of the input, as a power of two, up to
`MOST_BUCKETS`: with too few, all are marked and only Apriori prunes. A task keeps only the
buckets that it met, hands them on in ranges of 65,536 when they are `MET`, and ranges are
added in a stream, so no task holds more than that, two bitmaps and one range. Words of
a batch are numbered, and phrases are made, hashed and counted as arrays.

Defined results: a null text has no words, a null language is `und`; repeated rows count
again; the empty table has no phrases. Words are bytes of UTF-8 and of any length; A-Z are
lower-cased. Only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Buckets at most (powers of two; a bitmap has an eighth as many bytes), and for each word of the input, of about six characters.
LEAST_BUCKETS, MOST_BUCKETS, SPREAD, WORD_CHARS = 1 << 16, 1 << 28, 2, 6
#: Buckets of a range, and phrases and buckets that a task counts before it hands them on.
RANGE, PENDING, MET = 1 << 16, 300_000, 1 << 22
#: What ends a piece, what parts its words.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_TABLE = bytes(10 if c in ENDS else 32 if c in GAPS else c for c in range(256))
_SCHEMA = "lang string, phrase string, n bigint, part int, marks binary"
_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("part", pa.int32()), ("marks", pa.binary())])
_SKIP, _END = 0, 1


class _Numbers(dict):
    """Numbers words in the order in which they are met."""

    def __init__(self):
        super().__init__({b"": _SKIP, b"\n": _END})
        self.words = [b"", b"\n"]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its beginning and its last word."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, seed=xxhash.xxh3_64_intdigest(lang.encode()))


def phrase_hashes(langs: list[str], phrases: list[str]) -> np.ndarray:
    """The hashes of phrases that all have the same number of words."""
    words = [[word_hash(lang, w) for w in phrase.encode().split(b" ")] for lang, phrase in zip(langs, phrases, strict=True)]
    columns = np.array(words, np.uint64).T
    out = columns[0]
    for c in columns[1:]:
        out = _mixed(out, c)
    return out


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes & np.uint64(buckets - 1)).astype(np.int64)


class _Bitmap:
    def __init__(self, marks: bytes):
        self.marks = np.frombuffer(marks, np.uint8)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.marks[at >> 3] << (at & 7).astype(np.uint8)) & 128 > 0


class _Met:
    """Counts of the buckets that a task met, handed on by ranges: two bytes for each place in the range, then the counts."""

    def __init__(self, least: int):
        self.least, self.width, self.parts, self.size = least, np.uint8 if least < 256 else np.uint32, [], 0

    def add(self, buckets: np.ndarray) -> None:
        where, n = np.unique(buckets, return_counts=True)
        self.parts.append((where.astype(np.uint32), np.minimum(n, self.least).astype(np.uint32)))
        self.size += len(where)

    def ranges(self) -> pa.RecordBatch:
        where, n = (np.concatenate([np.zeros(0, np.uint32), *(p[k] for p in self.parts)]) for k in range(2))
        if len(self.parts) > 1:
            order = np.argsort(where, kind="stable")
            where, n = where[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
            where, n = where[first], np.minimum(np.add.reduceat(n, first, dtype=np.int64), self.least)
        self.parts, self.size = [], 0
        part = where // RANGE
        cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)])) if len(part) else np.zeros(1, np.int64)
        place, n = (where % RANGE).astype("<u2"), n.astype(self.width)
        marks = [place[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        m = len(marks)
        return pa.RecordBatch.from_arrays([pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.array(part[cuts[:-1]].astype(np.int32), pa.int32()), pa.array(marks, pa.binary())], schema=_ARROW)


class _Texts:
    """The texts of one language in a batch: numbers of words, and the hash at each place of the phrase of k words that begins there."""

    def __init__(self, lang: str, texts: list[bytes]):
        numbers = _Numbers()
        tokens = b"\n".join(texts).lower().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        ids = np.array([numbers[t] for t in tokens], np.int64)
        self.lang, self.words, self.ids = lang, numbers.words, ids[ids != _SKIP]
        hashes = np.array([word_hash(lang, w) for w in numbers.words], np.uint64)
        self.first = hashes[self.ids]
        self.grown = {1: (self.first, self.ids != _END)}

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash, and whether a phrase of k words begins, at every place where there is room for one."""
        if k not in self.grown:
            h, there = self.phrases(k - 1)
            self.grown[k] = _mixed(h[:-1], self.first[k - 1 :]), there[:-1] & self.grown[1][1][k - 1 :]
        return self.grown[k]

    def counted(self, k: int, chosen: np.ndarray) -> Iterator[tuple[bytes, int]]:
        """The distinct phrases of k words that begin at the chosen places, with their counts."""
        at = np.flatnonzero(chosen)
        if not len(at):
            return
        same = self.ids[at]
        for step in range(1, k):
            _, same = np.unique(same, return_inverse=True)
            same = (same << 32) | self.ids[at + step]
        _, where, n = np.unique(same, return_index=True, return_counts=True)
        for place, count in zip(at[where].tolist(), n.tolist(), strict=True):
            yield b" ".join(self.words[i] for i in self.ids[place : place + k].tolist()), count


def _passed(documents: DataFrame, k: int, least: int, buckets: int, more: bool, shorter=None, marked=None) -> DataFrame:
    """Pass k as a written table: rows (lang, phrase, n) of partial counts, and rows (part, marks) of the next length's counters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        met = _Met(least)
        known, own = (None if x is None else _Bitmap(x.value) for x in (shorter, marked))

        def out() -> pa.RecordBatch:
            m = len(held)
            batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.string()), pa.array([x[1].decode() for x in held], pa.string()), pa.array(list(held.values()), pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=_ARROW)
            held.clear()
            return batch

        for b in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            longer = []
            for lang, texts in by.items():
                t = _Texts(lang, texts)
                if len(t.ids) < k:
                    continue
                h, chosen = t.phrases(k)
                if known is not None:
                    part = known[_bucket(t.phrases(k - 1)[0], buckets)]
                    chosen = chosen & part[:-1] & part[1:] & own[_bucket(h, buckets)]
                for phrase, n in t.counted(k, chosen):
                    held[lang, phrase] += n
                    if len(held) > PENDING:
                        yield out()
                if more and len(t.ids) > k:
                    h, there = t.phrases(k + 1)
                    longer.append(_bucket(h[there & chosen[:-1] & chosen[1:]], buckets))
            if longer:
                met.add(np.concatenate(longer))
                if met.size > MET:
                    yield met.ranges()
        yield out()
        yield met.ranges()

    return shared.written(documents.mapInArrow(work, _SCHEMA), f"phrases-{k}", "zstd")


def _summed(least: int) -> Callable:
    """Adds the counters of each range, which come one behind the other, and marks the buckets that reach `least`."""
    width = 1 if least < 256 else 4

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(RANGE, np.uint64)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["part", "marks"])
        for b in batches:
            for part, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if part != at:
                    if at is not None:
                        yield done()
                    at, total = part, np.zeros(RANGE, np.uint64)
                m = len(marks) // (2 + width)
                total[np.frombuffer(marks, "<u2", m)] += np.frombuffer(marks, np.uint8 if width == 1 else np.uint32, m, 2 * m)
        if at is not None:
            yield done()

    return work


def _bitmap(counters: DataFrame, least: int, buckets: int) -> bytes:
    """One bit a bucket: what the driver collects is `buckets` / 8 bytes at most."""
    out = bytearray(max(RANGE, buckets) // 8)
    rows = counters.where("part is not null").select("part", "marks").repartition(64, "part").sortWithinPartitions("part").mapInArrow(_summed(least), "part int, marks binary")
    for r in rows.collect():
        out[r["part"] * RANGE // 8 : (r["part"] + 1) * RANGE // 8] = r.marks
    return bytes(out)


def _marks(phrases: DataFrame, buckets: int) -> bytes:
    """The buckets of the phrases."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met(1)
        for b in batches:
            if b.num_rows:
                met.add(_bucket(phrase_hashes(b.column(0).to_pylist(), b.column(1).to_pylist()), buckets))
                if met.size > MET:
                    yield met.ranges().select(["part", "marks"])
        yield met.ranges().select(["part", "marks"])

    return _bitmap(phrases.select("lang", "phrase").mapInArrow(work, "part int, marks binary"), 1, buckets)


def frequencies(documents: DataFrame, longest: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(lang, phrase, k, f): every word with its count, and every phrase of 2 to `longest` words that occurs `least` times or more."""
    if buckets is not None and (buckets & (buckets - 1) or not 8 <= buckets <= 1 << 32):
        raise ValueError("the number of buckets must be a power of two, 2^32 at most")
    spark = documents.sparkSession
    shared.prepare(spark)
    rows = shared.stable(documents.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text")).where("text is not null"))
    if buckets is None:
        words = (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // WORD_CHARS
        buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, 1 << (SPREAD * words).bit_length()))
    shorter = marked = None
    found = []
    for k in range(1, longest + 1):
        table = _passed(rows, k, least, buckets, k < longest, shorter, marked)
        n = F.sum("n").alias("f")
        exact = table.where("phrase is not null").groupBy("lang", "phrase").agg(n).select("lang", "phrase", F.lit(k).alias("k"), "f")
        exact = shared.written(exact if k == 1 else exact.where(F.col("f") >= least), f"frequent-{k}")
        found.append(exact)
        for old in (shorter, marked):
            if old is not None:
                old.unpersist()
        if k < longest:
            shorter = spark.sparkContext.broadcast(_marks(exact.where(F.col("f") >= least), buckets))
            marked = spark.sparkContext.broadcast(_bitmap(table, least, buckets))
        shared.drop(table)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def collocations(documents: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, share: int = 50, lang_col: str = "lang", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is that of its worst cut, floor(1000000 a a / (l r)), with ties to the shortest first part. A phrase that
    lies in a longer one with at least `share` per cent of its occurrences is left out. Decimal arithmetic is exact for counts
    up to 10 to the 15th power. Ranks go by score and frequency, then by the phrase's bytes.
    """
    all_f = frequencies(documents, longest, least, lang_col, text_col, buckets)
    frequent = all_f.where(F.col("f") >= least)
    phrases = frequent.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    left = F.expr("substring_index(phrase, ' ', cut)")
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).withColumn("left", left).withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    part = lambda name, n: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    big = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * ({big('a')} * {big('a')})) div ({big('l')} * {big('r')})")
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "a", "l", "r")).alias("w")).select("lang", "phrase", "w.score", "w.a", "w.l", "w.r")
    # Longer phrases, each with all the shorter ones that lie in it.
    inner = phrases.where("k > 2").select("lang", F.col("a").alias("outer"), F.split("phrase", " ").alias("w"), "k")
    inner = inner.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("from", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    covered = inner.select("lang", F.array_join(F.slice("w", F.col("from"), F.col("size")), " ").alias("phrase"), "outer").groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = worst.join(covered, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (F.col("outer") * 100 < F.col("a") * share))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = all_f.where("k = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
