"""Ranks over a whole table without sending it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

DIGIT_BITS = 20


def ranks_descending(rows: DataFrame, value: str, rank: str | None = None,
                     dense_rank: str | None = None) -> DataFrame:
    """(value, RANK, DENSE_RANK) over ``value`` descending, to be joined back on ``value``.

    ``rank() over (order by ...)`` has no partition key and would sort every row in one task.
    Here equal values (a non-negative BIGINT) collapse first. The distinct values then fall into
    buckets by their high bits; a bucket spans 2**20 values, so no window below ever holds more
    than 2**20 rows, whatever the distribution. Each level adds what all higher buckets hold.
    """
    distinct = (rows.groupBy(value).agg(F.count("*").alias("_rows"))
                .withColumn("_low", F.shiftright(value, DIGIT_BITS)))
    per_low = distinct.groupBy("_low").agg(
        F.sum("_rows").alias("_rows"), F.count("*").alias("_values"),
    ).withColumn("_high", F.shiftright("_low", DIGIT_BITS))
    per_high = per_low.groupBy("_high").agg(
        F.sum("_rows").alias("_rows"), F.sum("_values").alias("_values"))

    def above(what: str, window: WindowSpec) -> Column:
        earlier = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(what).over(earlier), F.lit(0))

    # At most 2**23 rows: the bits of a BIGINT that remain above two digits.
    top = Window.orderBy(F.desc("_high"))
    high_offsets = per_high.select(
        "_high", above("_rows", top).alias("_rows_h"), above("_values", top).alias("_values_h"))
    middle = Window.partitionBy("_high").orderBy(F.desc("_low"))
    low_offsets = (
        per_low.select("_high", "_low", above("_rows", middle).alias("_rows_l"),
                       above("_values", middle).alias("_values_l"))
        .join(high_offsets, "_high")
        .select("_low", (F.col("_rows_l") + F.col("_rows_h")).alias("_rows_l"),
                (F.col("_values_l") + F.col("_values_h")).alias("_values_l")))
    bottom = Window.partitionBy("_low").orderBy(F.desc(value))
    ranks = distinct.select(
        value, "_low", above("_rows", bottom).alias("_rows_b"),
        F.row_number().over(bottom).alias("_dense_b")).join(low_offsets, "_low")

    wanted = []
    if rank:
        wanted.append((F.col("_rows_l") + F.col("_rows_b") + 1).alias(rank))
    if dense_rank:
        wanted.append((F.col("_values_l") + F.col("_dense_b")).alias(dense_rank))
    return ranks.select(value, *wanted)


def dense_ranks_of_counts(rows: DataFrame, count: str, dense_rank: str) -> DataFrame:
    """(count, DENSE_RANK) over a row count descending, to be joined back on ``count``.

    k distinct counts need at least k*(k+1)/2 counted rows, so 10**12 rows give at most 1.5
    million distinct counts: one window task over them is enough, and they may be broadcast.
    """
    return rows.select(count).distinct().withColumn(
        dense_rank, F.row_number().over(Window.orderBy(F.desc(count))))
