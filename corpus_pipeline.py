"""A corpus made ready for training: toxic documents go, then copies, then near copies; what is
left is mixed over its sources and packed into sequences."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlake.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from lendlake.llm.labels import train_toxicity
from lendlake.llm.shared import read, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
CAPACITY, END_ID = 2048, 0
# Words a worker keeps for packing, beside executors whose heap earlier stages have filled.
REMEMBERED_WORDS = 300_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; null and empty texts have a low score and stay."""
    model = train_toxicity(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.where(F.col("toxicity") < 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the least id."""
    return ngram_join.one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once at least; sources below their target weight repeat."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and where each is in the packed sequences."""
    return packing.pack_documents(
        docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, CAPACITY,
        remembered=REMEMBERED_WORDS)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
    ("mixing", mix_sources), ("packing", pack)]

# Trained scores, similarity search and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written to the shared
    folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
