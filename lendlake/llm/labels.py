"""Labelled rows: which are held out, and the toxicity model of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlake.llm import toxicity
from lendlake.llm.shared import prefix

FIT = toxicity.Fit()

def with_labels(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column ``name``: the toxic label of the document, null without one. Of labels
    that repeat a document the highest counts."""
    p = prefix(docs)
    by_doc = labels.groupBy(F.col("doc_id").alias(f"{p}of")).agg(F.max("toxic").alias(name))
    return docs.join(by_doc, F.col("doc_id") == F.col(f"{p}of"), "left").drop(f"{p}of")


def held_out(parts: int, part: int) -> Column:
    """Whether a document is kept from training; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == part,
                      F.lit(False))


def train_toxicity(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Fitted on labelled documents that are not held out.

    The sample is drawn from the labels, so its bound is the broadcast's; texts are not shuffled.
    """
    p = prefix(docs)
    by_doc = labels.where(~held_out(5, 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("label"))
    sample, share = toxicity.drawn(by_doc, "label", FIT)
    sample = sample.select(F.col("doc_id").alias(f"{p}of"), F.col("label").alias(f"{p}label"))
    some = docs.join(F.broadcast(sample), F.col("doc_id") == F.col(f"{p}of"))
    return toxicity.train(some, F.lit(True), F.col(f"{p}label"), FIT, share=share)
