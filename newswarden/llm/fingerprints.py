"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes of a text: each byte shifts it left by one and adds
that byte's number, so it depends on the last 32 bytes alone. A chunk ends where the hash
is zero under a mask; the mask is strict up to the normal size and loose beyond it, which
draws the sizes together (normalised chunking), within a least and a greatest size. An
edit moves only the borders around it: behind it the same bytes give the same borders again.

The fingerprint is the set of the chunks' digests with their lengths, as sorted 16-digit
hexadecimal numbers in a row: 56 bits of digest, 8 bits of length. A set's weight is the
sum of its lengths, and its likeness to another is its containment: the weight of what
the other also has, as a share of its own.

`with_next` compares each document with the one after it by descending id. Documents are
dealt to ranges of ids, bounded by a sample that affects only how even they are; the first
document of each range is sent to the range before as well, so every document meets its
successor in one task that sorts and streams, one document behind the other. Ids that many
rows share are divided by a hash of the text. Long texts are chunked in blocks.

Defined results: null texts are empty; an empty text has the empty fingerprint, whose
likeness is 1 to itself and 0 to others; rows with null ids come after all others; rows of
one id are ordered by hash and text; a single document is its own successor. Ids may be of
any type that can be ordered. Only the named columns are read.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import shared


@dataclass(frozen=True)
class Chunking:
    """Sizes in bytes (the greatest at most 255), and the bits that must be zero below and from the normal size on."""

    least: int = 12
    normal: int = 40
    most: int = 160
    strict: int = 7
    loose: int = 4


DEFAULT = Chunking()
#: Bytes that the hash depends on, and bytes of a text that are hashed at once.
REACH, BLOCK = 32, 1 << 20
#: Characters of a range of documents, documents sampled for each of its bounds, and ranges at most.
RANGE_CHARS, SAMPLED, MOST_RANGES = 16 << 20, 20, 1 << 15


def _gears() -> np.ndarray:
    """A number for each byte: splitmix64's first 256 outputs, their upper halves."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEARS = _gears()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The hash behind each byte, by doubling: that of 2k bytes is two of k bytes."""
    h = GEARS[data]
    span = 1
    while span < REACH:
        later = h.copy()
        later[span:] += h[:-span] << np.uint32(span)
        h, span = later, span * 2
    return h


def chunks(data: bytes, size: Chunking = DEFAULT) -> list[bytes]:
    """The text's chunks in order."""
    out, start, n = [], 0, len(data)
    while start < n:
        base, stop = max(0, start - REACH + 1), min(n, start + BLOCK)
        h = gear_hashes(np.frombuffer(data, np.uint8, stop - base, base))
        loose = np.flatnonzero(h < np.uint32(1 << (32 - size.loose)))
        strict = (loose[h[loose] < np.uint32(1 << (32 - size.strict))] + (base + 1)).tolist()
        loose = (loose + (base + 1)).tolist()
        i = j = 0
        # Up to the last chunk that is sure to end within the block.
        while start < n and (stop == n or start + size.most <= stop):
            i = bisect_left(strict, start + size.least, i)
            end = strict[i] if i < len(strict) else n
            if end >= start + size.normal:
                j = bisect_left(loose, start + size.normal, j)
                end = min(loose[j] if j < len(loose) else n, start + size.most, n)
            out.append(data[start:end])
            start = end
    return out


def fingerprint(data: bytes, size: Chunking = DEFAULT) -> np.ndarray:
    """Sorted numbers: 56 bits of a chunk's digest, 8 of its length."""
    distinct = set(chunks(data, size))
    found = np.fromiter((xxhash.xxh3_64_intdigest(c) & ~0xFF | len(c) for c in distinct), np.uint64, len(distinct))
    return np.unique(found)


def as_text(found: np.ndarray) -> str:
    return found.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the weight of `a` that `b` has too."""
    if not len(a):
        return float(not len(b))
    weight = (a & np.uint64(0xFF)).astype(np.int64)
    if not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return float(weight[b[at] == a].sum() / weight.sum())


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: Chunking = DEFAULT) -> DataFrame:
    """(id, n_chars, fingerprint) of every text, in one pass without a shuffle."""
    shared.prepare(documents.sparkSession)
    rows = documents.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("__text"))
    schema = StructType([rows.schema[0]]).add("n_chars", "long").add("fingerprint", "string")
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([as_text(fingerprint(t.encode(), size)) for t in texts], pa.string())], schema=arrow)

    return rows.mapInArrow(work, schema)


def _sooner(key: Column, bounds: Column, n: int) -> Column:
    """How many of the `n` bounds, in descending order, the key lies below, by bisection."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(key < F.get(bounds, at + step - 1), at + step).otherwise(at))


def with_next(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: Chunking = DEFAULT, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Each document with fingerprints of its text and of its edited text, and likenesses to the latter and to the next document.

    The edited text has the last half of the code points replaced by as many (or all) of the next document, by descending id.
    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark = documents.sparkSession
    shared.prepare(spark)
    rows = shared.stable(documents.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")))
    key = F.struct(F.col("id").isNotNull().alias("there"), "id", F.xxhash64("text").alias("h"))
    total = rows.agg(F.sum(F.length("text").cast("long")), F.count("*")).first()
    n = max(1, min(MOST_RANGES, max((total[0] or 0) // range_chars, min(2 * spark.sparkContext.defaultParallelism, total[1] // 512))))
    sample = [r.k for r in rows.select(key.alias("k")).orderBy(F.xxhash64("k.h", "k.id")).limit(n * SAMPLED).select(F.to_json(F.struct("k")).alias("k"), F.col("k").alias("by")).orderBy(F.desc("by")).select("k").collect()] if n > 1 else []
    picked = sample[SAMPLED::SAMPLED]
    bounds = F.from_json(F.lit(json.dumps([json.loads(k)["k"] for k in picked])), f"array<{rows.select(key.alias('k')).schema[0].dataType.simpleString()}>")
    dealt = rows.select("id", "text", key.alias("k")).withColumn("at", _sooner(F.col("k"), bounds, len(picked)) if picked else F.lit(0))
    heads = dealt.groupBy("at").agg(F.max("k").alias("head")).orderBy("at").collect()
    before = spark.createDataFrame([(h["at"], h["head"], heads[i - 1]["at"]) for i, h in enumerate(heads)], StructType().add("at", "integer").add("head", dealt.schema["k"].dataType).add("before", "integer"))
    own, extra = F.struct(F.col("at").alias("to"), F.lit(False).alias("extra")), F.struct(F.col("before").alias("to"), F.lit(True).alias("extra"))
    sent = dealt.join(F.broadcast(before), "at").select("id", "text", "k", F.explode(F.when(F.col("k") == F.col("head"), F.array(own, extra)).otherwise(F.array(own))).alias("s"))
    tasks = sent.select(F.col("s.to").alias("to"), F.col("s.extra").alias("extra"), "k", "id", "text").repartitionById(len(picked) + 1, F.col("to")).sortWithinPartitions("to", "extra", F.desc("k"), F.desc("text")).select("to", "extra", "id", "text")
    schema = StructType([documents.select(id_col).schema[0]]).add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "string").add("edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double")
    arrow = to_arrow_schema(schema)

    def row(one: tuple, text: str, found: np.ndarray) -> tuple:
        key, own, mine = one
        half = len(own) // 2
        edited = (own[: len(own) - half] + text[:half]).encode()
        changed = fingerprint(edited, size)
        return key, len(own), sha256(edited).hexdigest(), as_text(mine), as_text(changed), containment(mine, changed), containment(mine, found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for b in batches:
            done = []
            for extra, key, text in zip(*(b.column(c).to_pylist() for c in ("extra", "id", "text")), strict=True):
                if extra and waiting is None:
                    continue
                found = fingerprint(text.encode(), size)
                if waiting is not None:
                    done.append(row(waiting, text, found))
                waiting = None if extra else (key, text, found)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True) if done else [[]] * len(arrow), arrow, strict=True)], schema=arrow)
        if waiting is not None:
            raise RuntimeError("a document did not meet the next one")

    return tasks.mapInArrow(work, schema)
