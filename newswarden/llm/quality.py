"""Line labelling by a conditional random field: quality rules and a quality classifier.

Both label every line of a text good or bad (content or boilerplate) from its own
bins and those of its neighbours (`lines.BINS`) and learn the weights from labelled
documents, whose lines all have the document's label. The sample is bounded by
documents: `max_docs` labelled ones, those with the smallest hashes of their ids, each
with all its lines. Everything that is labelled or counted afterwards covers all lines
of all texts.

* Quality rules: counts of words, symbols, repeated lines and repeated windows, then
  Viterbi decoding; the share of characters in content lines decides retention.
* Quality classifier: forward-backward marginals of the good label, averaged with
  the lines' lengths as weights.

Defined results: a null, empty or blank text has no lines; its content share is 0
and its quality is the labelled documents' own share of good ones. Repeated ids are
judged row by row; of several labels of one document the lowest counts, and of several
texts of a labelled id the first in order is learnt from; with no labels every score is 0.5. Null labels are no labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.workers import lean
from . import crf, lines, shared

MAX_DOCS = 4000
#: Least share of characters in content lines of a retained document.
CONTENT_SHARE = 0.5
#: Least score of a document that is predicted good.
GOOD = 0.3


@dataclass
class Trained:
    model: crf.Crf
    prior: float


def remainder(id_col: str, modulus: int = 5) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def train(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int | None = None, max_docs: int = MAX_DOCS) -> Trained:
    """The field learnt from labelled documents; with `held_out`, never from ids of that remainder."""
    shared.prepare(documents.sparkSession)
    known = labels.select(id_col, label_col).where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if held_out is not None:
        known = known.where(remainder(id_col) != held_out)
    known = known.groupBy(id_col).agg(F.min(label_col).alias("__nw_label")).orderBy(F.xxhash64(id_col), id_col).limit(max_docs)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in lines.tables(batch.column(0)):
                bounds = np.searchsorted(t.row, np.arange(t.hi - t.lo + 1))
                out = [t.bins[bounds[r] : bounds[r + 1]].tobytes() for r in range(t.hi - t.lo)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(t.lo, t.hi - t.lo), pa.array(out, pa.binary())], names=["label", "bins"])

    texts = documents.select(id_col, text_col).join(F.broadcast(known), id_col).groupBy(id_col).agg(F.min(text_col).alias("__nw_text"), F.first("__nw_label").alias("__nw_label"))
    rows = texts.select("__nw_text", F.col("__nw_label").cast("int")).mapInArrow(lean(look), "label int, bins binary").collect()
    label = np.array([int(r.label > 0) for r in rows], np.int64)
    bins = [np.frombuffer(r.bins, np.int8).reshape(-1, len(lines.BINS)) for r in rows]
    size = np.array([len(b) for b in bins], np.int64)
    flat = np.concatenate(bins) if bins else np.empty((0, len(lines.BINS)), np.int8)
    row = np.repeat(np.arange(len(bins)), size)
    model = crf.fit(flat, row, np.repeat(label, size), [len(e) + 1 for e in lines.BINS.values()], steps=80)
    return Trained(model, float((label.sum() + 1) / (len(label) + 2)))


def _score(trained: Trained, t: lines.Lines) -> np.ndarray:
    n = t.hi - t.lo
    p = trained.model.marginals(t.bins, t.row)[:, 1]
    weight = np.bincount(t.row, t.chars, n)
    return np.where(weight > 0, np.bincount(t.row, p * t.chars, n) / np.maximum(weight, 1), trained.prior)


def _content(trained: Trained, t: lines.Lines) -> np.ndarray:
    n = t.hi - t.lo
    content = trained.model.viterbi(t.bins, t.row) == 1
    return np.bincount(t.row, content * t.chars, n) / np.maximum(np.bincount(t.row, t.chars, n), 1)


def classify(df: DataFrame, trained: Trained, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and score, from 0 (bad) to 1 (good)."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in lines.tables(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, t.hi - t.lo), pa.array(_score(trained, t))], names=[id_col, "score"])

    return df.select(id_col, text_col).mapInArrow(lean(run), schema)


def keep_good(df: DataFrame, trained: Trained, *, text_col: str = "text", threshold: float = GOOD) -> DataFrame:
    """The rows of `df` whose score is at least `threshold`, same columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in lines.tables(batch.column(text_col)):
                yield batch.slice(t.lo, t.hi - t.lo).filter(pa.array(_score(trained, t) >= threshold))

    return df.mapInArrow(lean(run), df.schema)


def rules(df: DataFrame, trained: Trained, *, id_col: str = "doc_id", text_col: str = "text", content_share: float = CONTENT_SHARE) -> DataFrame:
    """Per row: id, the counts, base_failed, content_share, and kept (never where base_failed)."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in names), T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in lines.tables(batch.column(1)):
                failed = (t.n_words < 20) | (100 * t.n_repeat_words > 30 * t.n_words)
                share = _content(trained, t)
                columns = [batch.column(0).slice(t.lo, t.hi - t.lo), *(pa.array(getattr(t, x), pa.int64()) for x in names), pa.array(failed), pa.array(share), pa.array(~failed & (share >= content_share))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return df.select(id_col, text_col).mapInArrow(lean(run), schema)
