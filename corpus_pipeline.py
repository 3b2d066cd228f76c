"""A training corpus from `documents`: five stages, each on all that the one before kept.

quality classifier -> n-gram Jaccard join -> benchmark decontamination -> pseudonyms
-> SentencePiece ids. All stages but the last return the columns of `documents`.

Defined results: a null text is scored and encoded as an empty one and stays null on the
way; rows with a null id, or with another row's id, are judged by their own text. Of exact
repeats of id and text one row stays after the join, and of a class the first row that has
an id, by id and hash of the text, or else the first without. Empty texts are no copies of
each other. Other columns pass through, whatever their names; an empty table gives an empty
one. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newswarden.llm import decontam, ngram_join, pseudonyms, quality, shared, sp_bpe
from newswarden.llm.queries import PSEUDONYM_KEY, SP_MODEL

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from their labels, doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return ngram_join.one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly such passages go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose personal numbers, dates and addresses are pseudonyms."""
    return pseudonyms.pseudonymised(docs, PSEUDONYM_KEY)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and their digests."""
    return sp_bpe.encode_digests(docs, SP_MODEL, keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", clean_of_benchmark),
    ("PII", pseudonymous),
    ("SentencePiece encoding and decoding", encoded),
]

#: The join, the field and the encoding can't be said in SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name.split()[0].replace("-", ""))
    return docs
