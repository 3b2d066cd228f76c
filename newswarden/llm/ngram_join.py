"""Similarity self-join of texts on word shingles, by a chosen-path join.

A text is the set of its runs of five words (lower-cased A-Z; words are runs of
digits, a-z and non-ASCII characters); a text of one to four words is one shingle.
Two texts are linked if the Jaccard similarity of their sets is at least 0.8.

1. Texts with equal sets become one set with its number of copies.
2. Chosen paths. A set is carried as 64 minhash values, each a sampled token of it.
   A node of the recursion picks one position, and with probability 1/lambda - 1 a
   second one, so that a pair of similarity lambda survives in one child on average,
   and deals its sets by their tokens there. Buckets of up to `bucket` sets are
   compared by brute force on the sampled tokens. Larger ones compare each set with
   one pivot; sets near the pivot leave (each neighbour of theirs is within the
   pivot's reach, and so its candidate as well), the others recurse. Runs with fresh randomness
   are repeated until a pair at the threshold is met with probability `recall` at
   the depth that was reached.
3. Candidates' connected components are verified exactly: all pairs of a component,
   on whole shingle sets. A component of more than `tile` sets is cut into bands of
   sizes (a linked pair lies in one band or in neighbouring ones) and bands into
   blocks, and each pair of blocks is one task's tile. Pairs are counted where they
   are met and never become rows; links leave a tile as a spanning forest.

A bucket that is still large at the deepest level becomes candidates as a whole, so
nothing is capped. Links between 64-bit shingle hashes are exact but for collisions.

Defined results: null, empty and wordless texts have no set: each is its own class,
without links or copies. Rows with one id are one document with each of its texts;
null ids are documents without a name and never represent a class that has a named
one. Ties go to the smallest id. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.workers import lean
from ..operators.skew import attach
from . import ragged as R
from . import shared
from .components import components

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
TOKENS = 64
BUCKET, TILE, DEEPEST = 1500, 256, 12
HOT_BUCKETS = 1000
#: Runs of the first batch.
RUNS = 8
_SALT = R.mix64(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = R.mix64(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range by row range: distinct shingle hashes, sorted in each row, and their bounds by row."""
    data, offsets = R.text_buffers(column)
    for lo, hi in R.chunks(offsets):
        part, off = R.LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        s, e, rows = R.spans(part, off, R.ALNUM_LOWER)
        wh = R.span_hashes(part, s, e)
        at, h = R.windows(wh, rows, words)
        row, per = rows[at], R.counts(rows, hi - lo)
        for size in range(1, words):
            few = np.flatnonzero(per[rows] == size)
            if len(few):
                begin, short = R.windows(wh[few], rows[few], size)
                h, row = np.concatenate([h, short]), np.concatenate([row, rows[few][begin]])
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
        yield lo, hi, h, np.searchsorted(row, np.arange(hi - lo + 1))


def _signature(h: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128 bits of each set; None of an empty one."""
    first, second = np.zeros(len(h) + 1, np.uint64), np.zeros(len(h) + 1, np.uint64)
    np.cumsum(R.mix64(h), out=first[1:])
    np.cumsum(R.mix64(h ^ np.uint64(0x5851F42D4C957F2D)), out=second[1:])
    both = np.stack([first[bounds[1:]] - first[bounds[:-1]], second[bounds[1:]] - second[bounds[:-1]]], 1).astype(">u8")
    return [x.tobytes() if n else None for x, n in zip(both, np.diff(bounds), strict=True)]


def _sketch(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minhash values, 32 bits each, of the non-empty sets."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.empty((len(full), TOKENS), np.uint32)
    if len(full):
        starts = bounds[full]
        for k in range(TOKENS):
            out[:, k] = np.minimum.reduceat((h ^ _SALT[k]) * _ODD[k], starts) >> np.uint64(32)
    return out


def _signed(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, hash, sig, n, sketch) of every row; the hash is the text's."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("hash", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("sketch", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, bounds in shingle_sets(batch.column(1), words):
                size = np.diff(bounds).astype(np.int32)
                sketches = iter(_sketch(h, bounds))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(_signature(h, bounds), pa.binary()), pa.array(size), pa.array([next(sketches).tobytes() if k else None for k in size], pa.binary())],
                    names=["id", "hash", "sig", "n", "sketch"],
                )

    return df.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(lean(run), schema)


_ROW = "key long, sig binary, n int, sketch binary"


def _children(df: DataFrame, runs: list[int] | None, threshold: float) -> DataFrame:
    """The rows of the next level: from the roots of `runs`, or from rows with a key."""
    again = np.uint64(int((1 / threshold - 1) * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            raw = b"".join(batch.column("sketch").to_pylist())
            full = np.frombuffer(raw, np.uint32 if runs is not None else np.uint16).reshape(n, TOKENS)
            short = (full & 0xFFFF).astype(np.uint16)
            sketch = pa.array([x.tobytes() for x in short], pa.binary())
            parents = [R.mix64(np.full(n, r + 1, np.uint64)) for r in runs] if runs is not None else [batch.column("key").to_numpy().view(np.uint64)]
            for parent in parents:
                one = R.mix64(parent ^ np.uint64(0xA5A5A5A5))
                two = R.mix64(one + np.uint64(1))
                for draw, who in ((one, np.arange(n)), (two, np.flatnonzero(R.mix64(two) < again))):
                    if not len(who):
                        continue
                    place = (draw[who] % np.uint64(TOKENS)).astype(np.int64)
                    if draw is two:  # without replacement
                        place = np.where(place == (one[who] % np.uint64(TOKENS)).astype(np.int64), (place + 1) % TOKENS, place)
                    token = full[who, place].astype(np.uint64)
                    key = R.mix64(parent[who] + R.mix64(token * np.uint64(TOKENS) + place.astype(np.uint64) + np.uint64(1)))
                    pick = pa.array(who)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("sig").take(pick), batch.column("n").take(pick), sketch.take(pick)], names=["key", "sig", "n", "sketch"])

    return df.mapInArrow(lean(run), _ROW)


def _least(threshold: float) -> float:
    """Share of equal tokens from which a pair is a candidate: 3.5 standard errors under the threshold."""
    return threshold - 3.5 * math.sqrt(threshold * (1 - threshold) / TOKENS)


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the least row of its component."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _brute(rows: DataFrame, dealt: DataFrame, threshold: float) -> DataFrame:
    """Candidate links within small buckets: all pairs by tokens, as stars to the least set. Buckets come one after the other, in rows sorted by key."""
    least = _least(threshold) * TOKENS

    def judge(sig: list[bytes], tokens: np.ndarray, bounds: list[int]) -> pa.RecordBatch:
        left, right = [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a == 2:
                if (tokens[a] == tokens[a + 1]).sum() >= least:
                    left.append(sig[a])
                    right.append(sig[a + 1])
            elif b - a > 2:
                own = tokens[a:b]
                equal = np.zeros((b - a, b - a), np.int16)
                for k in range(TOKENS):
                    equal += own[:, k][:, None] == own[:, k][None, :]
                root = _forest(equal >= least)
                for i in np.flatnonzero(root != np.arange(b - a)).tolist():
                    left.append(sig[a + i])
                    right.append(sig[a + int(root[i])])
        return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sig, tokens = np.empty(0, np.int64), [], np.empty((0, TOKENS), np.uint16)
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            sig = sig + batch.column("sig").to_pylist()
            tokens = np.concatenate([tokens, np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, TOKENS)])
            first = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
            yield judge(sig, tokens, first)
            key, sig, tokens = key[first[-1] :], sig[first[-1] :], tokens[first[-1] :]
        yield judge(sig, tokens, [0, len(sig)])

    return shared.compact(rows.select("key", "sig", "sketch").repartition("key"), dealt).sortWithinPartitions("key", "sig").mapInArrow(lean(run), "a binary, b binary")


def _pivots(rows: DataFrame, threshold: float, hot: int) -> DataFrame:
    """Rows of large buckets with their pivot's tokens: adds `near` (a candidate of the pivot) and `stays` (in the recursion).

    Distances add up: with the pivot at most `reach` away, every set linked to a row
    that leaves is within `reach` as well, so such a row can leave with no link lost.
    """
    margin = 3.5 * math.sqrt(0.25 / TOKENS) / 4
    reach = 1 - threshold + 0.3 + margin
    schema = T.StructType([*rows.schema.fields[:4], T.StructField("pivot", T.BinaryType()), T.StructField("near", T.BooleanType()), T.StructField("stays", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            mine, theirs = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, TOKENS) for c in ("sketch", "other"))
            away = 1 - (mine == theirs).mean(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "sig", "n", "sketch", "pivot")), pa.array(away <= reach), pa.array(away > 0.3)], names=[f.name for f in schema.fields])

    pivot = rows.groupBy("key").agg(F.min_by(F.struct("sig", "sketch"), F.xxhash64("sig", "key")).alias("p"), F.count("*").alias("size"))
    pivot = pivot.select("key", "size", F.col("p.sig").alias("pivot"), F.col("p.sketch").alias("other"))
    return attach(rows, pivot, "key", "size", "sig", hot).select("key", "sig", "n", "sketch", "pivot", "other").mapInArrow(lean(run), schema)


def survival(depth: int, threshold: float) -> float:
    """Probability that a pair at the threshold shares a bucket of this depth in one run."""
    q = 1.0
    for _ in range(depth):
        q = 1 - (1 - threshold * q) * (1 - (1 / threshold - 1) * threshold * q)
    return q


def candidate_links(sets: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, deepest: int = DEEPEST) -> DataFrame:
    """(a, b) of candidate pairs; their components hold every linked pair with probability `recall` at least."""
    if not 0.5 <= threshold < 1:
        raise ValueError("the threshold must be at least 0.5 and under 1")
    links: list[DataFrame] = []
    # Facts of a bucket with more rows than this are broadcast; there are at most HOT_BUCKETS such buckets in a run's level.
    hot = max(bucket, sets.count() // HOT_BUCKETS)
    done, need, depth = 0, RUNS, 1
    while done < need:
        runs, level, rows = list(range(done, need)), 1, None
        while True:
            rows = _children(sets.select("sig", "n", "sketch") if rows is None else rows, runs if level == 1 else None, threshold)
            sizes = rows.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").withColumn("size", F.col("rows"))
            dealt = shared.written(attach(rows, sizes, "key", "rows", "sig", hot).where("size > 1"), "paths")
            small = dealt.where(F.col("size") <= bucket)
            large = dealt.where(F.col("size") > bucket).drop("size")
            found = _brute(small, dealt, threshold)
            deeper = not large.isEmpty()
            if deeper:
                met = shared.written(_pivots(large, threshold, hot), "pivots")
                near = met if level == deepest else met.where("near")
                found = found.union(near.where("sig != pivot").select(F.col("sig").alias("a"), F.col("pivot").alias("b")))
                rows = met.where("stays").select("key", "sig", "n", "sketch")
            links.append(shared.written(found, "candidates"))
            depth = max(depth, level)
            shared.drop(dealt)
            if not deeper or level == deepest:
                break
            level += 1
        done = need
        need = max(need, math.ceil(math.log(1 - recall) / math.log(1 - survival(depth, threshold))))
    out = links[0]
    for x in links[1:]:
        out = out.union(x)
    return out


def _overlaps(sets: list[np.ndarray], columns: int = 1 << 14) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    own = np.repeat(np.arange(n), [len(x) for x in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared_ = times[place] > 1
    rank = np.cumsum(times > 1) - 1
    own, place = own[shared_], rank[place[shared_]]
    order = np.argsort(place, kind="stable")
    own, place = own[order], place[order]
    out = np.zeros((n, n), np.float64)
    width = max(64, columns * 64 // n)
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [lo, lo + width])
        block = np.zeros((n, width), np.float32)
        block[own[a:b], place[a:b] - lo] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _verified(tiles: DataFrame, threshold: float) -> DataFrame:
    """From rows (tile, side, sig, copies, set): links counted by set, and stars of them to the least set."""
    schema = "sig binary, sets long, docs long, root binary"

    def judge(rows: list[tuple]) -> list[tuple]:
        rows = sorted({(r[2], r[1]): r for r in rows}.values(), key=lambda r: r[2])
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        side, copies = np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
        both, size = _overlaps(sets), np.array([len(s) for s in sets])
        linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
        np.fill_diagonal(linked, False)
        if (side >= 0).any():  # a tile of two blocks; pairs within a block are another tile's
            linked &= side[:, None] != side[None, :]
        root = _forest(linked)
        return [(r[2], int(x.sum()), int(copies[x].sum()), rows[int(k)][2]) for r, x, k in zip(rows, linked, root, strict=True) if x.any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out(found: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=["sig", "sets", "docs", "root"])

        for batch in batches:
            found: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[-1][0] != r[0]:
                    found += judge(rows)
                    rows = []
                rows.append(r)
            yield out(found)
        if rows:
            yield out(judge(rows))

    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(lean(run), schema)


def _tiles(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """Where each set of a component is compared: (sig, comp, tile, side). One tile for a small component; else blocks by size band."""
    sized = members.join(members.groupBy("root").agg(F.count("*").alias("size")), "root")
    small = sized.where(F.col("size") <= tile).select("sig", F.xxhash64("root", F.lit(0)).alias("tile"), F.lit(-1).alias("side"))
    large = sized.where(F.col("size") > tile).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9))
    bands = large.groupBy("root", "band").agg(F.ceil(F.count("*") / (tile // 2)).alias("blocks"))
    nearby = bands.select("root", F.col("band").alias("other"), "blocks").withColumn("band", F.explode(F.expr("array(other - 1, other, other + 1)")))
    near = nearby.groupBy("root", "band").agg(F.collect_list(F.struct("other", "blocks")).alias("others"))  # three entries at most
    own = large.join(near, ["root", "band"]).withColumn("mine", F.expr("filter(others, x -> x.other = band)[0].blocks"))
    own = own.withColumn("block", F.pmod(F.xxhash64("sig"), F.col("mine")))
    met = own.withColumn("m", F.explode(F.expr("flatten(transform(others, x -> transform(sequence(0L, x.blocks - 1L), b -> struct(x.other as band, b as block))))")))
    here, there = F.struct("band", "block"), F.col("m")
    first, last = F.least(here, there), F.greatest(here, there)
    # A block with itself is one tile, whose sides stay open.
    dealt = met.select("sig", F.xxhash64("root", first, last, F.lit(1)).alias("tile"), F.when(here == there, -1).when(here == first, 0).otherwise(1).alias("side"))
    return small.union(dealt)


def linked_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, tile: int = TILE, deepest: int = DEEPEST) -> DataFrame:
    """Per row: id, class_id (least id of its connected texts), n_links (other documents at the threshold or above), n_copies (documents with an equal set), n_linked_sets (other sets linked)."""
    out = _linked(df, id_col, text_col, words, threshold, recall, bucket, tile, deepest)
    return out.select(F.col("id").alias(id_col), "class_id", "n_links", "n_copies", "n_linked_sets")


def _linked(df: DataFrame, id_col: str, text_col: str, words: int, threshold: float, recall: float, bucket: int, tile: int, deepest: int) -> DataFrame:
    """The rows of `linked_documents`, with the hash of the text and that of the class's first text, which is null for a text without words."""
    shared.prepare(df.sparkSession)
    docs = shared.written(_signed(df, id_col, text_col, words), "signed")
    row = F.struct("id", "hash")
    named = F.coalesce(F.min(F.when(F.col("id").isNotNull(), row)), F.min(row))
    sets = docs.where("n > 0").groupBy("sig").agg(named.alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = shared.written(shared.compact(sets, docs), "sets")
    links = candidate_links(sets, threshold=threshold, recall=recall, bucket=bucket, deepest=deepest)
    comps = components(links, "a", "b").withColumnRenamed("node", "sig")
    whole = sets
    members = shared.written(shared.compact(comps.join(whole.select("sig", "rep", "copies", "n"), "sig"), sets), "members")
    tiles = _tiles(members, threshold, tile).groupBy("sig").agg(F.collect_list(F.struct("tile", "side")).alias("tiles"))
    # A set's text is that of one row: by id and hash, so rows that share an id, or have none, don't meet each other's sets.
    wanted = members.select(F.col("rep.id").alias("want"), F.col("rep.hash").alias("wanted_hash"), "sig", "copies").join(tiles, "sig")
    texts = df.select(F.col(id_col).alias("rep"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    texts = texts.join(wanted, F.col("rep").eqNullSafe(F.col("want")) & (F.col("hash") == F.col("wanted_hash")))
    if not members.where("rep.id is null").isEmpty():
        texts = texts.where("rep is not null").unionByName(texts.where("rep is null").dropDuplicates(["sig"]))
    placed = _resets(texts.select("text", "sig", "copies", "tiles"), words).select("sig", "copies", "set", F.inline("tiles"))
    found = shared.written(_verified(placed.select("tile", "side", "sig", "copies", "set"), threshold), "verified")
    counted = found.groupBy("sig").agg(F.sum("sets").alias("sets"), F.sum("docs").alias("docs"))
    roots = components(found.select("sig", "root"), "sig", "root").withColumnRenamed("node", "sig")
    named = roots.join(sets.select("sig", "rep"), "sig")
    # As for a set: the first row that has an id, or else the first.
    least = named.groupBy("root").agg(F.coalesce(F.min(F.when(F.col("rep.id").isNotNull(), F.col("rep"))), F.min("rep")).alias("least"))
    classes = named.join(least, "root").select("sig", "least")
    by_set = sets.select("sig", "rep", "copies").join(counted, "sig", "left").join(classes, "sig", "left")
    by_set = by_set.select("sig", "copies", F.coalesce("least", "rep").alias("class"), F.coalesce("sets", F.lit(0)).alias("sets"), F.coalesce("docs", F.lit(0)).alias("docs"))
    out = docs.select("id", "hash", "sig").join(by_set, "sig", "left")
    copies = F.coalesce("copies", F.lit(1))
    return out.select("id", "hash", F.coalesce("class.id", "id").alias("class_id"), F.col("class.hash").alias("class_hash"), (F.coalesce("docs", F.lit(0)) + copies - 1).alias("n_links"), copies.alias("n_copies"), F.coalesce("sets", F.lit(0)).alias("n_linked_sets"))


def _resets(texts: DataFrame, words: int) -> DataFrame:
    """(sig, copies, tiles, set) of the texts whose set is the wanted one."""
    kind = texts.schema["tiles"].dataType
    schema = T.StructType([T.StructField("sig", T.BinaryType()), T.StructField("copies", T.LongType()), T.StructField("tiles", kind), T.StructField("set", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, bounds in shingle_sets(batch.column(0), words):
                mine, wanted = _signature(h, bounds), batch.column(1).slice(lo, hi - lo).to_pylist()
                keep = [r for r in range(hi - lo) if mine[r] == wanted[r]]
                rest = [batch.column(k).slice(lo, hi - lo).take(pa.array(keep, pa.int64())) for k in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([h[bounds[r] : bounds[r + 1]].tobytes() for r in keep], pa.binary())], names=["sig", "copies", "tiles", "set"])

    return texts.mapInArrow(lean(run), schema)


def one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, tile: int = TILE, deepest: int = DEEPEST) -> DataFrame:
    """The rows of `df` that represent their class, same columns; exact repeats of a row's id and text stay once.

    A class's row is found by id and text: of rows that share an id, or have none, only the one whose text represents the class stays.
    """
    linked = _linked(df, id_col, text_col, words, threshold, recall, bucket, tile, deepest)
    first = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("hash") == F.col("class_hash"))
    keep = linked.where(F.col("class_hash").isNull() | first).select(F.col("id").alias("__nw_keep"), F.col("hash").alias("__nw_hash")).distinct()
    return df.join(keep, F.col(id_col).eqNullSafe(F.col("__nw_keep")) & (F.xxhash64(text_col) == F.col("__nw_hash")), "left_semi").dropDuplicates([id_col, text_col])
