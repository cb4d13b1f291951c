"""A training corpus from documents: toxicity, quality rules, near-duplicate removal, source mix, packing.

Each stage gets what its predecessor kept, written as Parquet and read again. All stages but the last return the
columns of documents, and their decisions take effect: rejected documents are gone, a document that the mix reads
twice is there twice.

All stages take nulls in any column (a null text is empty, a null lang a language of its own, a null source the last
one; rows without a doc_id are near copies of nothing), texts of any length as a whole, ties, repeated rows (each
judged alike; of near copies, repeated ones included, one stays), tables without rows, and other columns of any name,
which they return as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard, mixing, packing, quality, toxicity
from ledgerloom.llm.common import Scratch, table

#: The method that a stage uses is not to be had in SQL; tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


#: Near copies to the pipeline: at least PERCENT of the shingles of SHINGLE words that two documents have are in both.
SHINGLE, PERCENT = 5, 80


def _whole(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and all columns as one, so that no name clashes with an operator's own."""
    return docs.select("doc_id", "text", "lang", "source", F.struct(*docs.columns).alias("_row"))


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.5; without labels of both classes, all or none by the share of toxic labels."""
    rows = toxicity.scored(_whole(docs), table(spark, sf_dir, "labels"), keep=("_row",))
    return _back(rows.where("score < 0.5"), docs)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; empty ones are too short for them."""
    return _back(quality.judged(_whole(docs), keep=("_row",)).where("kept"), docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id; rows without an id, and empty texts, stay."""
    return jaccard.one_of_each(docs, PERCENT, SHINGLE)


def in_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as training reads them; empty ones have no words to read and go."""
    return mixing.readings(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; a document read twice is packed twice."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("quality rules", of_quality),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", in_mix),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = scratch.save(docs, name.replace(" ", "_"))
    return docs
