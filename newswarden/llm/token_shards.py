"""Training-order materialisation of token ids as shards of fixed-stride binary records.

Every text's ids, ended by the end id, are cut into sequences of `length` ids; the
last is padded. The sequences are numbered in the order of the input's partitions,
and a keyed Feistel permutation of the numbers, with cycle-walking, gives each its
slot in training order. A shard holds `per_shard` slots in order, so record k of
shard s is slot s * per_shard + k, at byte k * stride: a reader starts at any slot
and reads on, and a run is resumed from the number of its next slot.

A record is a header of eight 16-bit words (id of the document in four, place of the
sequence in its document in two, number of ids in two, with the highest bit set where
the id of the document is null), the ids in 16 bits each, and
one closing word, all little-endian. The shards are written by Spark's own writer,
raw bytes with the closing word as line separator, so they go to any store that
Spark writes to and a lost executor's tasks are repeated without leftovers.

Texts are encoded once, into a compressed table of ids in the shared folder that also
holds, for each piece of a partition, how many sequences came before it. What numbers
the sequences is read from that table, so it doesn't matter how Spark splits it later,
or whether executors come and go. Records travel to range partitions of whole shards,
those of a batch for one partition together and compressed. After writing, the length
of every shard is compared with its number of slots.

Defined results: a null or empty text has one sequence with the end id alone;
repeated rows have sequences of their own; a null id is a mark in the record's header,
and null again when it is read. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ragged as R
from . import shared, sp_bpe

LENGTH, PER_SHARD = 256, 8192
HEADER = 8
CLOSE = 0x0A0D
ROUNDS = 6
#: Bytes of records in a range partition, and how many partitions there are at most.
PARTITION_BYTES, MAX_PARTITIONS = 32 << 20, 50_000
#: How the table of ids is written: it lies on disk beside the records on their way and the shards, so it is compressed harder, over more of it at once.
TABLE = {"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(4 << 20)}
#: Bit of the number of ids that marks a null id of a document.
NO_NAME = np.uint32(1 << 31)


@dataclass(frozen=True)
class Order:
    """A keyed permutation of 0 .. n - 1."""

    n: int
    key: int

    def _network(self, x: np.ndarray, rounds) -> np.ndarray:
        half = max(1, ((self.n - 1).bit_length() + 1) // 2)
        mask = np.uint64((1 << half) - 1)
        a, b = x >> np.uint64(half), x & mask
        for r in rounds:
            secret = np.uint64((self.key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) & R.MASK64)
            if r % 2 == 0:
                a = a ^ (R.mix64(b ^ secret) & mask)
            else:
                b = b ^ (R.mix64(a ^ secret) & mask)
        return a << np.uint64(half) | b

    def _walk(self, x: np.ndarray, rounds: list[int]) -> np.ndarray:
        out = self._network(np.asarray(x, np.uint64), rounds)
        while len(far := np.flatnonzero(out >= np.uint64(self.n))):
            out[far] = self._network(out[far], rounds)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, list(range(ROUNDS)))

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, list(reversed(range(ROUNDS))))


@dataclass(frozen=True)
class Shards:
    path: str
    n: int
    length: int
    per_shard: int

    @property
    def stride(self) -> int:
        return 2 * (HEADER + self.length + 1)


def _encoded(df: DataFrame, model_path: str, length: int) -> DataFrame:
    """(part, first, n, names, missing, sizes, ids): a row for each piece of a partition of (id, text).

    `n` sequences, the first being number `first` of the partition; ids of the
    documents (64 bits) and whether they are null (8 bits), the number of ids of
    each (64 bits) and all ids (16 bits).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, first, part = sp_bpe.load(model_path, False), 0, TaskContext.get().partitionId()
        for batch in batches:
            missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            names = batch.column(0).fill_null(-1).to_numpy()
            for lo, hi, ids, bounds in model.encode(batch.column(1)):
                ids, size = np.insert(ids, bounds[1:], model.eos), np.diff(bounds) + 1
                n = int(((size - 1) // length + 1).sum())
                blobs = (names[lo:hi].astype("<i8"), missing[lo:hi].astype("u1"), size.astype("<i8"), ids.astype("<u2"))
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([first]), pa.array([n]), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names=["part", "first", "n", "names", "missing", "sizes", "ids"])
                first += n

    return df.mapInArrow(run, "part long, first long, n long, names binary, missing binary, sizes binary, ids binary")


def materialise(df: DataFrame, model_path: str, key: int, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, path: str | None = None) -> Shards:
    """Writes the shards under `path` (by default a new place in the shared folder)."""
    spark = df.sparkSession
    shared.prepare(spark)
    if sp_bpe.load(model_path, False).size > 1 << 16:
        raise ValueError("ids of this vocabulary don't fit 16 bits")
    table = shared.written(_encoded(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), model_path, length), "ids", compression="zstd", **TABLE)
    # One row for each partition of the input, so this is bounded by their number.
    sizes = table.groupBy("part").agg(F.sum("n").alias("n"), F.max(F.col("first") + F.col("n")).alias("end")).orderBy("part").collect()
    if any(r.n != r.end for r in sizes):
        raise RuntimeError("the table of ids has gaps")
    base = spark.sparkContext.broadcast(dict(zip((r.part for r in sizes), np.cumsum([0, *(r.n for r in sizes)]).tolist(), strict=False)))
    shards = Shards(path or shared.fresh(spark, "shards"), sum(r.n for r in sizes), length, per_shard)
    if not shards.n:
        shared.drop(table)
        return shards
    n_shards = -(-shards.n // per_shard)
    wanted = max(-(-shards.n * shards.stride // PARTITION_BYTES), 3 * spark.sparkContext.defaultParallelism)
    group = -(-n_shards // min(wanted, n_shards, MAX_PARTITIONS))
    order, width = Order(shards.n, key), 2 * (HEADER + length)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records of a batch, those for one range together: (range, their slots, the compressed records)."""
        pack = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            slots, records = [], []
            for part, first, _, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, missing, size, flat = (np.frombuffer(x, kind) for x, kind in zip(blobs, ("<i8", "u1", "<i8", "<u2"), strict=True))
                n = (size - 1) // length + 1
                row = np.repeat(np.arange(len(size)), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                used = np.minimum(length, size[row] - place * length)
                made = np.zeros((len(row), HEADER + length), "<u2")
                made[:, :4] = name[row].view("<u2").reshape(-1, 4)
                made[:, 4:6] = place.astype("<u4").view("<u2").reshape(-1, 2)
                made[:, 6:8] = (used.astype("<u4") | np.where(missing[row], NO_NAME, np.uint32(0)).astype("<u4")).view("<u2").reshape(-1, 2)
                made[:, HEADER:][np.arange(length)[None, :] < used[:, None]] = flat
                slots.append(order.slot(base.value[part] + first + np.arange(len(row))))
                records.append(made)
            slot, made = np.concatenate(slots), np.concatenate(records)
            at = np.argsort(slot)
            slot, made = slot[at], made[at]
            zone = slot // (per_shard * group)
            cuts = np.append(np.flatnonzero(np.concatenate([[True], zone[1:] != zone[:-1]])), len(slot))
            blobs = [(slot[a:b].tobytes(), pack.compress(made[a:b].tobytes())) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(zone[cuts[:-1]].astype(np.int32)), *(pa.array(x, pa.binary()) for x in zip(*blobs, strict=True))], names=["zone", "slots", "records"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for slots, records in zip(batch.column(1), batch.column(2), strict=True):
                slot = np.frombuffer(slots.as_buffer(), np.int64)
                raw = unpack.decompress(records.as_buffer())
                ends = pa.py_buffer(np.arange(len(slot) + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.Array.from_buffers(pa.binary(), len(slot), [None, ends, pa.py_buffer(raw)])], names=["slot", "record"])

    packed = table.mapInArrow(make, "zone int, slots binary, records binary").repartitionById(-(-n_shards // group), "zone")
    rows = packed.mapInArrow(spread, "slot long, record binary").withColumn("shard", F.floor(F.col("slot") / per_shard)).sortWithinPartitions("shard", "slot")
    rows.select("shard", F.col("record").cast("string").alias("value")).write.option("lineSep", CLOSE.to_bytes(2, "little").decode("latin-1")).partitionBy("shard").text(shards.path)
    files = _files(spark, shards).groupBy("shard").agg(F.sum("length").alias("length"))
    full = F.least(F.lit(per_shard), shards.n - F.col("shard") * per_shard) * shards.stride
    if files.where(F.col("length") == full).count() != n_shards:
        raise RuntimeError("a shard is missing or has another length than its slots")
    base.unpersist()
    shared.drop(table)
    return shards


def _files(spark: SparkSession, shards: Shards) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(f"{shards.path}/shard=*/part-*")
    return files.withColumn("shard", F.regexp_extract("path", "/shard=([0-9]+)/", 1).cast("long"))


def read_back(spark: SparkSession, shards: Shards, first: int = 0, digests: bool = False) -> DataFrame:
    """(slot, shard, doc_id, place, ids) of the records from slot `first` on; shards before it are not opened.

    With `digests`, n_ids and the SHA-256 of the ids (little-endian, 16 bits each) stand in place of the ids.
    """
    last = "n_ids long, ids_sha256 string" if digests else "ids array<int>"
    schema = f"slot long, shard long, doc_id long, place long, {last}"
    length, per_shard, stride = shards.length, shards.per_shard, shards.stride

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                raw = np.frombuffer(content.as_buffer(), "<u2")
                if raw.nbytes % stride:
                    raise ValueError(f"shard {shard} has a broken record")
                records = raw.reshape(-1, stride // 2)
                slot = shard * per_shard + np.arange(len(records))
                records, slot = records[slot >= first], slot[slot >= first]
                head = np.ascontiguousarray(records[:, :HEADER])
                used = head[:, 6:8].copy().view("<u4")[:, 0]
                missing = (used & NO_NAME) > 0
                used = (used & ~NO_NAME).astype(np.int64)
                columns = [pa.array(slot), pa.array(np.full(len(slot), shard)), pa.array(head[:, :4].copy().view("<i8")[:, 0], mask=missing), pa.array(head[:, 4:6].copy().view("<u4")[:, 0].astype(np.int64))]
                if digests:
                    columns += [pa.array(used), pa.array([sha256(r[HEADER : HEADER + n]).hexdigest() for r, n in zip(np.ascontiguousarray(records), used.tolist(), strict=True)], pa.string())]
                else:
                    ids = records[:, HEADER : HEADER + length][np.arange(length)[None, :] < used[:, None]].astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(used)]), pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, names=["slot", "shard", "doc_id", "place", *(["n_ids", "ids_sha256"] if digests else ["ids"])])

    if not shards.n:
        return spark.createDataFrame([], schema)
    return _files(spark, shards).where(F.col("shard") >= first // per_shard).select("shard", "content").mapInArrow(run, schema)
