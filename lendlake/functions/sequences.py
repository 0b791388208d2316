"""Look-back windows (lag, moving average) that survive a key holding a third of the rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from lendlake.functions.workspace import stored

LAST_DAY = (1 << 31) - 1


def look_back(df: DataFrame, key: str, date: str, row_id: str,
              outputs: Mapping[str, Callable[[WindowSpec], Column]], reach: int,
              blocks: int | None = None) -> DataFrame:
    """Add columns computed over (partition by key order by date, row_id).

    Every output may look at the row itself and at most ``reach`` rows before it. Missing dates
    sort last; ``row_id`` is unique. All keys take the same way: rows are dealt by ranges of
    (key, date, row_id), so a key of any size and any spacing of ids covers as many ranges as its
    rows fill, and windows run inside key and range. Only the first ``reach`` rows of a key in a
    range need rows of the ranges before, and those are among the last ``reach`` rows there; these
    edge rows of the few keys that cross a border are windowed once more on their own.
    """
    day = F.coalesce(F.unix_date(date), F.lit(LAST_DAY))
    rows = df.withColumn("_day", day)
    order = [F.col("_day"), F.col(row_id)]
    border = [F.col(key), *order]
    dealt = rows.repartitionByRange(*border) if blocks is None else rows.repartitionByRange(
        blocks, *border)
    dealt = stored(dealt.withColumn("_range", F.spark_partition_id()), "ranges")

    # A range has at most two keys that go on beyond it: this table is as small as their number.
    crossing = F.broadcast(dealt.groupBy(key).agg(
        F.min("_range").alias("_from"), F.max("_range").alias("_to")).where("_from < _to").select(
        F.col(key).alias("_crossing")))

    def with_outputs(frame: DataFrame, window: WindowSpec, *extra: Column) -> DataFrame:
        made = [make(window).alias(name) for name, make in outputs.items()]
        return frame.select("*", *made, *extra)

    part = Window.partitionBy(key, "_range")
    found = with_outputs(
        dealt, part.orderBy(*order), F.row_number().over(part.orderBy(*order)).alias("_pos"),
        F.count(F.lit(1)).over(part).alias("_size"))
    found = found.join(crossing, F.col(key).eqNullSafe(F.col("_crossing")), "left").withColumn(
        "_crosses", F.col("_crossing").isNotNull())
    names = [*df.columns, *outputs]
    inner = found.where(~F.col("_crosses") | (F.col("_pos") > reach)).select(*names)
    edges = found.where(F.col("_crosses") & (
        (F.col("_pos") <= reach) | (F.col("_pos") > F.col("_size") - reach)))
    edges = with_outputs(edges.select(*rows.columns, "_pos"),
                         Window.partitionBy(key).orderBy(*order))
    return inner.unionByName(edges.where(F.col("_pos") <= reach).select(*names))
