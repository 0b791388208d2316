"""A uniform shuffle into shards of exact size, through a hypergeometric communication matrix.

How many rows each partition sends to each shard is drawn first, from the distribution those counts
have in a uniform shuffle: the rows of a partition, without replacement, from the places that are
left in the shards. Rows are then permuted inside their partition, cut by the counts, exchanged,
and permuted again inside their shard. Shard sizes differ by one row at most.

Partitions are dealt by a hash of the row, not by where a row was read, so a lost task repeats
the same rows in the same order. Only row counts of partitions reach the driver. The second
permutation works in hash ranges, so a shard is never one task's work.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendlake.llm.shared import prefix, row_hash, spread

RANGES = 256


def communication_matrix(rows: list[int], shards: int, seed: int = 0) -> np.ndarray:
    """Counts of rows from each partition to each shard; sums are ``rows`` and exact shard sizes.

    Shard after shard takes its places from what the shards before it have left, as one
    multivariate hypergeometric draw; the last takes the rest.
    """
    random = np.random.default_rng(seed)
    total = int(sum(rows))
    sizes = np.full(shards, total // shards, dtype=np.int64)
    sizes[random.permutation(shards)[:total % shards]] += 1
    out = np.zeros((len(rows), shards), dtype=np.int64)
    left = np.array(rows, dtype=np.int64)
    for shard in range(shards - 1):
        # The marginals method takes time and memory by partitions, not rows.
        drawn = _drawn(random, left, int(sizes[shard]))
        out[:, shard] = drawn
        left = left - drawn
    out[:, shards - 1] = left
    return out


def _drawn(random: np.random.Generator, left: np.ndarray, places: int) -> np.ndarray:
    """One multivariate hypergeometric draw; beyond what numpy takes at once, in halves."""
    if left.sum() < 10**9:
        return random.multivariate_hypergeometric(left, places, method="marginals")
    if len(left) == 1:
        return np.array([places])
    half = len(left) // 2
    here, there = int(left[:half].sum()), int(left[half:].sum())
    first = _large(random, here, there, places)
    return np.concatenate([_drawn(random, left[:half], first),
                           _drawn(random, left[half:], places - first)])


def _large(random: np.random.Generator, good: int, bad: int, places: int) -> int:
    """A hypergeometric draw of any size, by inversion: probabilities follow from their ratios to
    the most likely count, over all counts within 12 deviations of it; what lies beyond is less
    than doubles tell apart."""
    if good + bad < 10**9:
        return int(random.hypergeometric(good, bad, places))
    n = good + bad
    mode = (places + 1) * (good + 1) // (n + 2)
    reach = 50 + math.ceil(12 * math.sqrt(places * (good / n) * (bad / n) * ((n - places) / (n - 1))))
    k = np.arange(max(0, places - bad, mode - reach), min(good, places, mode + reach) + 1)
    x = k[:-1].astype(np.float64)
    ratios = np.log(good - x) + np.log(places - x) - np.log(x + 1) - np.log(bad - places + x + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    shares = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(np.searchsorted(shares, random.random() * shares[-1], side="right"), len(k) - 1)])


def shuffle_to_shards(docs: DataFrame, shards: int = 16, seed: int = 0,
                      partitions: int | None = None) -> DataFrame:
    """Every row of ``docs`` with shard (0 to shards - 1) and slot (its place there, gapless).

    Rows are told apart by a hash of all their columns; identical rows are interchangeable. Nulls
    are values like any other. An empty table gives an empty one; with fewer rows than shards some
    shards stay empty. Columns named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    p = prefix(docs)
    tie, part, rank, again, area = (f"{p}{x}" for x in ("tie", "part", "rank", "again", "range"))
    n = partitions or spread(docs)
    rows = docs.withColumn(tie, row_hash(docs))
    rows = rows.withColumn(part, F.pmod(F.xxhash64(F.lit(seed), tie), F.lit(n)))
    counts = {r[0]: r[1] for r in rows.groupBy(part).count().collect()}
    matrix = communication_matrix([counts.get(i, 0) for i in range(n)], shards, seed)
    ends = docs.sparkSession.createDataFrame(
        [(i, [int(x) for x in np.cumsum(matrix[i])]) for i in range(n)],
        f"{p}of bigint, {p}ends array<bigint>")
    first = Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed + 1), tie), tie)
    sent = rows.withColumn(rank, F.row_number().over(first)).join(
        ends, F.col(part) == F.col(f"{p}of"))
    sent = sent.withColumn("shard", F.size(F.filter(f"{p}ends", lambda e: e < F.col(rank)))) \
        .withColumn(again, F.xxhash64(F.lit(seed + 2), tie, rank)) \
        .withColumn(area, F.shiftrightunsigned(again, 56).cast("int"))
    sums = sent.groupBy("shard", area).agg(F.count(F.lit(1)).alias(f"{p}n"))
    before = sums.select("shard", area, F.coalesce(F.sum(f"{p}n").over(
        Window.partitionBy("shard").orderBy(area).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias(f"{p}before"))
    second = Window.partitionBy("shard", area).orderBy(again, tie, part, rank)
    return sent.withColumn(f"{p}in", F.row_number().over(second)).join(before, ["shard", area]) \
        .withColumn("slot", F.col(f"{p}before") + F.col(f"{p}in") - 1) \
        .select(*docs.columns, F.col("shard").cast("int").alias("shard"),
                F.col("slot").cast("bigint").alias("slot"))
