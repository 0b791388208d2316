"""Mixing sources to target weights: tempered shares, realised as block permutations.

Weights are the sources' token shares to the power of an exponent between 0 (equal weights) and 1
(shares as they are), normalised. The exponent is found by bisection: the largest one at which the
entropy of the weights is ``target_entropy`` times the highest possible; if then some source would
be repeated more than ``repetition_limit`` times, the smallest one that keeps the limit. Only sums
over sources leave the executors, never the sources.

A source with quota q is read in permutations of its documents, one for each epoch, until q tokens
are reached. Documents meet the running token count of their permutation in two steps (sums of
hash ranges, then inside a range), so a source with a third of all rows is no single group. A
document's place in its source's quota gives its block; inside a block, which holds a bounded number
of tokens, documents of all sources are permuted again.

DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlake.llm.shared import prefix, row_hash, stored, text_of

# A round looks at this many exponents at once, which is five halvings; eight rounds are forty.
POINTS, ROUNDS = 31, 8
DIGITS = 6
WORD = "[^ \\t\\n\\r]+"


@dataclass(frozen=True)
class Mix:
    """``target_entropy``: share of the entropy of equal weights. ``repetition_limit``: epochs of
    the most repeated source. ``budget``: tokens of the mixture; None is the least with which each
    document is used at least once. ``block_tokens``: tokens of a block, about."""

    target_entropy: float = 0.9
    repetition_limit: float = 4.0
    budget: int | None = None
    block_tokens: int = 1 << 20
    seed: str = "mix"


def word_count(text: Column) -> Column:
    """Tokens of a text: words between blanks, tabs and line ends."""
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def _permuted(*parts: str | Column) -> Column:
    return F.md5(F.concat_ws(":", *[
        F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit("null"))
        for x in parts]))


def source_shares(thin: DataFrame, source: str, tokens: str) -> DataFrame:
    """Tokens of each source and its share of all; a source without tokens has share 0."""
    totals = stored(thin.groupBy(source).agg(F.sum(tokens).alias("source_tokens")), "sources")
    everything = totals.agg(F.sum("source_tokens")).first()[0] or 1
    return totals.withColumn("share", F.col("source_tokens") / F.lit(everything))


def exponent(totals: DataFrame, mix: Mix) -> float:
    """The exponent for a table of sources with column share; 1.0 if no source has tokens."""
    some = totals.where("share > 0")
    n, low, high, tokens = some.agg(
        F.count(F.lit(1)), F.min("share"), F.max("share"), F.sum("source_tokens")).first()
    if not n or low == high:
        return 1.0
    goal = mix.target_entropy * math.log(n)

    def bisected(holds) -> float:
        """The largest exponent for which ``holds`` is true, given that it turns false once."""
        left, right = 0.0, 1.0
        for _ in range(ROUNDS):
            step = (right - left) / (POINTS + 1)
            at = [left + step * (i + 1) for i in range(POINTS)]
            kept = [x for x, good in zip(at, holds(at), strict=True) if good]
            left = kept[-1] if kept else left
            right = left + step
        return left

    def sums(at: list[float]):
        columns = [F.sum(F.pow("share", F.lit(x))) for x in at]
        columns += [F.sum(F.pow("share", F.lit(x)) * F.log("share")) for x in at]
        row = some.agg(*columns).first()
        return zip(at, row[:len(at)], row[len(at):], strict=True)

    def even_enough(at: list[float]) -> list[bool]:
        return [math.log(z) - x * s / z >= goal for x, z, s in sums(at)]

    def too_often(at: list[float]) -> list[bool]:
        if mix.budget is None:
            return [(high / low) ** (1 - x) > mix.repetition_limit for x in at]
        return [low ** (x - 1) / z * mix.budget / tokens > mix.repetition_limit
                for x, z, _ in sums(at)]

    found = 1.0 if even_enough([1.0])[0] else bisected(even_enough)
    if too_often([found])[0]:
        found = bisected(too_often)
    return round(found, DIGITS)


def quotas(shares: DataFrame, mix: Mix) -> DataFrame:
    """Weight and quota (tokens of the mixture) of each source."""
    alpha = exponent(shares, mix)
    weighed = shares.withColumn(
        "weight", F.when(F.col("share") > 0, F.pow("share", F.lit(alpha))).otherwise(F.lit(0.0)))
    total, budget = weighed.agg(
        F.sum("weight"), F.max(F.expr("source_tokens / nullif(weight, 0)"))).first()
    total = total or 1.0
    budget = mix.budget if mix.budget is not None else (budget or 0.0) * total
    return weighed.withColumn("weight", F.col("weight") / F.lit(total)).withColumn(
        "quota", F.round(F.col("weight") * F.lit(float(budget))).cast("bigint"))


def plan_mixture(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id",
                 text_col: str = "text", source_col: str = "source",
                 carried: tuple[str, ...] = (), tokens: Column | None = None) -> DataFrame:
    """One row for each use of a document: id, source, ``carried``, n_tokens, epoch (from 1),
    block (from 0) and position in the block (from 1).

    A document is used in an epoch if its place in the source's running token count lies below the
    quota. A null source is a source of its own. Null and empty texts have no tokens: they are
    used once, in the first epoch, whatever their source's quota. ``tokens`` is the token count, if it
    is not to be counted from the text. Rows that repeat an id are
    documents like any other; identical rows are interchangeable. An empty table gives no rows.
    """
    thin = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        (word_count(text_of(text_col)) if tokens is None else tokens).alias("n_tokens"), *carried)
    by_source = quotas(source_shares(thin, "source", "n_tokens"), mix)
    blocks = by_source.agg(F.sum("quota")).first()[0] or 0
    blocks = max(1, -(-int(blocks) // mix.block_tokens))
    by_source = by_source.select(
        F.col("source").alias("of"), "source_tokens", "quota",
        F.expr("greatest(1, ceil(quota / nullif(source_tokens, 0)))").alias("epochs"))
    used = (thin.join(by_source, F.col("source").eqNullSafe(F.col("of"))).drop("of")
            .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int"))))
            .withColumn("at", _permuted(F.lit(mix.seed), "epoch", "doc_id"))
            .withColumn("part", F.substring("at", 1, 3)))
    sums = used.groupBy("source", "epoch", "part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = sums.select(
        F.col("source").alias("of"), F.col("epoch").alias("in"), F.col("part").alias("from"),
        F.coalesce(F.sum("part_tokens").over(
            Window.partitionBy("source", "epoch").orderBy("part")
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("parts_before"))
    inside = Window.partitionBy("source", "epoch", "part").orderBy("at", "doc_id", *carried) \
        .rowsBetween(Window.unboundedPreceding, -1)
    placed = used.withColumn(
        "inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(
        before, F.col("source").eqNullSafe(F.col("of")) & (F.col("epoch") == F.col("in"))
        & (F.col("part") == F.col("from")))
    placed = placed.withColumn("place", F.expr(
        "(epoch - 1) * source_tokens + parts_before + inside"))
    placed = placed.where("place < quota or (epoch = 1 and n_tokens = 0)")
    block = (f"case when place < quota then least({blocks - 1}, cast(floor("
             f"cast(place as double) / quota * {blocks}) as bigint)) "
             f"else pmod(conv(part, 16, 10), {blocks}) end")
    placed = placed.withColumn("block", F.expr(block).cast("bigint"))
    order = _permuted(F.lit(mix.seed), "block", "epoch", "doc_id")
    position = F.row_number().over(Window.partitionBy("block").orderBy(
        order, "doc_id", "epoch", *carried))
    return placed.withColumn("position", position.cast("bigint")).select(
        "doc_id", "source", *carried, "n_tokens", F.col("epoch").cast("bigint").alias("epoch"),
        "block", "position")


def mix_documents(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id",
                  text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as planned, all columns kept, dealt by
    ranges of blocks and sorted by block and position, so files written from it are read in the order
    of the mixture.

    Rows meet their plan by id, a hash of the row, and a number among identical rows, which are
    interchangeable. Null and empty texts are kept once; null ids and sources are values of their
    own. An empty table gives an empty one. Columns of ``docs`` may have any name.
    """
    p = prefix(docs)
    tie, copy, tokens, block, position = (f"{p}{x}" for x in ("tie", "copy", "n", "block", "position"))

    def told_apart(rows: DataFrame) -> DataFrame:
        return rows.withColumn(copy, F.row_number().over(
            Window.partitionBy(id_col, tie).orderBy(F.lit(1))))

    # The plan needs no text: words are counted before the rows are dealt.
    thin = told_apart(docs.select(id_col, source_col, row_hash(docs).alias(tie),
                                  word_count(text_of(text_col)).alias(tokens)))
    plan = plan_mixture(thin, mix, id_col, text_col, source_col, (tie, copy), F.col(tokens)).select(
        F.col("doc_id").alias(f"{p}id"), F.col(tie).alias(f"{p}t"), F.col(copy).alias(f"{p}c"),
        F.col("block").alias(block), F.col("position").alias(position))
    used = told_apart(docs.withColumn(tie, row_hash(docs))).join(
        plan, F.col(id_col).eqNullSafe(F.col(f"{p}id")) & (F.col(tie) == F.col(f"{p}t"))
        & (F.col(copy) == F.col(f"{p}c")))
    return used.repartitionByRange(block).sortWithinPartitions(block, position).select(*docs.columns)
