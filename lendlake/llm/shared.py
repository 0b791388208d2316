"""What the operators share: partition counts, free column names, tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendlake.functions.workspace import new_folder

# Rows of texts or token lists that are read, or sent to Python, at once.
_SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500",
          "spark.sql.parquet.columnarReaderBatchSize": "512"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> int:
    """Partitions for work on all of a frame: its own, or the session's shuffle partitions if
    those are more; so it follows the input. To be asked of frames read from files: one behind an
    exchange runs it to tell, and once more when it is used."""
    return max(df.rdd.getNumPartitions(),
               int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def prefix(df: DataFrame) -> str:
    """A beginning that no column of the frame has, for inner columns."""
    found = "x_"
    while any(c.lower().startswith(found) for c in df.columns):
        found = f"x{found}"
    return found


def stored(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """The frame written to the shared folder and read back: its lineage ends there, so a lost
    executor costs no second computation. The folder stays; its owner removes it after the job."""
    folder = new_folder(df.sparkSession, purpose)
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside the block read and pass wide rows in small batches, of which the JVM and Python
    each hold copies; the session's own settings come back when it ends."""
    before = {key: spark.conf.get(key) for key in _SMALL}
    for key, value in _SMALL.items():
        spark.conf.set(key, min(before[key], value, key=lambda x: (int(x) <= 0, int(x))))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def text_of(column: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns, to tell apart rows that share an id. Maps, which Spark does not
    hash, and other kinds are hashed as JSON."""
    return F.xxhash64(*[
        F.col(f"`{n}`") if t in ("string", "bigint", "int", "double", "boolean", "float", "date")
        else F.to_json(F.struct(F.col(f"`{n}`"))) for n, t in df.dtypes])


def some_of_each(rows: DataFrame, label: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each label (all, if there are fewer), by a hash of all columns: the same ones on
    every run, whatever the order of rows.

    A label never comes out empty or above ``n``, copies or not: of identical rows as many stay as
    there is room for. Hashes alone are ranked first, cut to ``n`` a label in each map task; labels
    are few, as a model holds each.
    """
    p = prefix(rows)
    key, place, cut = f"{p}key", f"{p}place", f"{p}cut"
    keyed = rows.withColumn(key, F.xxhash64(row_hash(rows), F.lit(seed)))
    order = Window.partitionBy(label).orderBy(key)
    cuts = keyed.select(label, key).withColumn(place, F.row_number().over(order)).where(
        F.col(place) <= n).groupBy(label).agg(F.max(key).alias(cut))
    return keyed.join(F.broadcast(cuts), label).where(F.col(key) <= F.col(cut)).withColumn(
        place, F.row_number().over(order)).where(F.col(place) <= n).select(*rows.columns)
