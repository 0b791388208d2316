"""New keys without a sequence and without a single task that counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlake.functions.workspace import stored


def first_free(df: DataFrame, key: str) -> Column:
    """The key after the highest one in the table (1 for an empty table), as a scalar subquery."""
    return F.coalesce(df.select(F.max(key)).scalar(), F.lit(0).cast("bigint")) + 1


def numbered(df: DataFrame, by: list[str], name: str, size: Column | None = None) -> DataFrame:
    """Add a dense number from 0 in the order of the columns ``by``, which tell rows apart.

    With ``size`` a row takes that many numbers, and gets the first of them.
    """
    return numbered_at_once(df, by, {name: F.lit(1) if size is None else size})


def numbered_at_once(df: DataFrame, by: list[str], sizes: dict[str, Column]) -> DataFrame:
    """Add one number for each name in ``sizes``, all in the order of ``by``, in one stored pass.

    Rows are dealt by ranges of ``by`` and stored with their range, so a lost task repeats the same
    numbers. Ranges are counted (one small row each), and rows are numbered inside their range. A row
    takes as many numbers of a name as its size, 0 or more, and gets the first of them.
    """
    names = list(sizes)
    dealt = stored(df.repartitionByRange(*by).select(
        "*", F.spark_partition_id().alias("_range"),
        *[sizes[n].cast("bigint").alias(f"_width{n}") for n in names]), "numbered")
    sums = dealt.groupBy("_range").agg(*[F.sum(f"_width{n}").alias(f"_sum{n}") for n in names])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    ahead = F.broadcast(sums.select("_range", *[
        F.coalesce(F.sum(f"_sum{n}").over(before), F.lit(0)).alias(f"_ahead{n}") for n in names]))
    inside = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    first = [F.coalesce(F.sum(f"_width{n}").over(inside), F.lit(0)).alias(f"_inside{n}") for n in names]
    return dealt.select("*", *first).join(ahead, "_range").select(*[c for c in df.columns if c not in names], *[
        (F.col(f"_ahead{n}") + F.col(f"_inside{n}")).alias(n) for n in names])
