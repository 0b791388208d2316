"""Payment intake and running collections as Structured Streaming jobs."""

from __future__ import annotations

import re
import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lendlake.functions.columns import month_start, month_text
from lendlake.functions.latest import first_rows
from lendlake.functions.workspace import remove_folder
from lendlake.operators.lifecycle import close_instalments
from lendlake.schema import COLUMNS, column_names
from lendlake.sources.tables import Tables

SPREAD = 256
QUERY, BATCH, ARRIVED = "query_id", "batch_id", "arrived"
HORIZON = "7 days"
# Ids are dealt to buckets in blocks: payments numbered in a row share few buckets, and ids of any
# kind fill at most so many. Ids an equality filter may name to the files' Bloom filters: Spark's limit.
BUCKET, BUCKETS, BLOCK = "id_bucket", 1024, 1 << 20
NAMED_IDS = 10
BLOOM = {"parquet.bloom.filter.enabled#repayment_id": "true",
         "parquet.bloom.filter.adaptive.enabled": "true"}
# Snapshots of the running totals that are kept; a reader may be so many batches late, less one.
SLOTS = 8


def payment_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Payment files as a stream: repayment columns with the sender's repayment_id."""
    return spark.readStream.format(fmt).schema(COLUMNS["repayment"]).load(path)


def without_repeats(payments: DataFrame, horizon: str) -> DataFrame:
    """Drop payments delivered again within the horizon.

    The watermark runs on arrival time, which the stream itself assigns and which never goes
    back, so no payment is late and none is lost; state older than the horizon is discarded.
    Copies are first dropped within the input partition they arrive in, then across: one payment
    sent a million times reaches its final state partition once per input partition.
    Repeats beyond the horizon are caught by ``take_in``.
    """
    arrived = (payments.withColumn("_arrived", F.current_timestamp())
               .withColumn("_part", F.spark_partition_id() % SPREAD))
    return (arrived.withWatermark("_arrived", horizon)
            .dropDuplicatesWithinWatermark(["repayment_id", "_part"])
            .dropDuplicatesWithinWatermark(["repayment_id"]).drop("_arrived", "_part"))


def id_bucket(block: int = BLOCK) -> Column:
    """The bucket of a payment's id."""
    return F.expr(f"CAST(pmod(repayment_id div {block}, {BUCKETS}) AS INT)")


def _write_by_bucket(payments: DataFrame, folder: str, block: int) -> None:
    """Payments in one folder a bucket, in order of ids inside it; a full bucket spans several files."""
    (payments.withColumn(BUCKET, id_bucket(block)).repartitionByRange(BUCKET, "repayment_id")
     .sortWithinPartitions(BUCKET, "repayment_id")
     .write.mode("overwrite").options(**BLOOM).partitionBy(BUCKET).parquet(folder))


def index_ledger(ledger: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """The ids of a ledger, written to ``folder`` by bucket, for ``take_in`` to look ids up in."""
    _write_by_bucket(ledger.select("repayment_id"), folder, block)
    return read_index(ledger.sparkSession, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """An index that ``index_ledger`` wrote before."""
    return spark.read.schema(f"repayment_id BIGINT, {BUCKET} INT").parquet(folder)


def _may_hold(batch: DataFrame, block: int) -> tuple[Column, Column]:
    """Conditions on the id and on the bucket of ledger rows, so that files without any id of the
    batch can be skipped.

    A batch of few rows names its ids, which row statistics and Bloom filters understand. Any batch
    names its lowest and highest id and its buckets, at most ``BUCKETS``.
    """
    n, low, high, buckets = batch.agg(
        F.count("repayment_id"), F.min("repayment_id"), F.max("repayment_id"),
        F.collect_set(id_bucket(block))).first()
    ids = F.col("repayment_id").between(low, high)
    if n <= NAMED_IDS:
        named = batch.select("repayment_id").where("repayment_id IS NOT NULL").collect()
        ids &= F.col("repayment_id").isin(sorted({r[0] for r in named}))
    return ids, F.col(BUCKET).isin(sorted(buckets))


def take_in(batch: DataFrame, *ledgers: DataFrame, block: int = BLOCK) -> DataFrame:
    """The payments of a batch no ledger holds yet, each once.

    Of deliveries of one id that differ the one with the lowest amount counts, then the earliest
    date, the lowest instalment and the first mode. Copies are cut to one inside each map task. Of
    a ledger only files that may hold the batch's ids are read: of one in buckets (``index_ledger``,
    with the same ``block``) those of the batch's buckets, so that an old and a new id in one batch
    do not cost the years between them.
    """
    once = first_rows(batch, "repayment_id", "paid_amount", "payment_date", "emi_id", "payment_mode")
    ids, buckets = _may_hold(batch, block)
    for ledger in ledgers:
        known = ledger.where(ids & buckets if BUCKET in ledger.columns else ids)
        once = once.join(known.select("repayment_id"), "repayment_id", "left_anti")
    return once


def stream_apply_payments(payments: DataFrame, t: Tables, out: str, checkpoint: str,
                          horizon: str = HORIZON, index: DataFrame | None = None) -> StreamingQuery:
    """Write each batch of new payments below ``out/repayment``; stop when input is exhausted.

    Repeats within the ``horizon`` are dropped in state. Older ones are told by the ledger and by
    earlier batches, of which only the files that may hold the batch's ids are read. Batches are
    written in buckets of ids. The ledger is ``index`` where one is given (the ids of ``t.repayment``
    by ``index_ledger``, made once and read by every run), else ``t.repayment`` as it lies.

    A batch writes to a folder named by the stream and its number and replaces what a failed
    attempt left there, so a restart neither loses nor repeats payments, and a stream with a new
    checkpoint never overwrites what an older one wrote. ``taken_in`` reads the result.
    """
    known = t.repayment.select("repayment_id") if index is None else index

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        earlier = _in_buckets(spark, out)
        ledgers = [known]
        if earlier is not None:
            mine = (F.col(QUERY) == query) & (F.col(BATCH) >= batch_id)
            ledgers.append(earlier.where(~mine))
        _write_by_bucket(take_in(batch, *ledgers),
                         f"{out}/repayment/{QUERY}={query}/{BATCH}={batch_id}", BLOCK)

    return (without_repeats(payments, horizon).writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _in_buckets(spark: SparkSession, out: str) -> DataFrame | None:
    """The payments written so far with their buckets; None before the first batch."""
    columns = f"{COLUMNS['repayment']}, {QUERY} STRING, {BATCH} BIGINT, {BUCKET} INT"
    try:
        return spark.read.schema(columns).parquet(f"{out}/repayment")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def taken_in(spark: SparkSession, out: str) -> DataFrame:
    """The payments written so far, with the stream and the batch they came in."""
    written = _in_buckets(spark, out)
    if written is None:
        columns = f"{COLUMNS['repayment']}, {QUERY} STRING, {BATCH} BIGINT"
        return spark.createDataFrame([], columns)
    return written.drop(BUCKET)


def settle(t: Tables, paid: DataFrame) -> Tables:
    """Snapshots after the streamed payments, by the rule of ``apply_payments``: the instalment
    of any payment is closed. Payments keep the key their sender gave them."""
    return t.replace(emi_schedule=close_instalments(t.emi_schedule, paid)).append(
        repayment=paid.select(*column_names("repayment")))


def _micros(spark: SparkSession, horizon: str) -> int:
    """An interval's text in microseconds, as a watermark reads it: a month has 31 days."""
    jvm = spark._jvm
    intervals = jvm.org.apache.spark.sql.catalyst.util.IntervalUtils
    text = jvm.org.apache.spark.unsafe.types.UTF8String.fromString(horizon)
    micros = intervals.getDuration(intervals.stringToInterval(text),
                                   jvm.java.util.concurrent.TimeUnit.MICROSECONDS, 31)
    if micros < 0:
        raise ValueError(f"the horizon {horizon!r} is negative")
    return micros


def _remembered(spark: SparkSession, counted: str) -> tuple[DataFrame | None, dict[int, int]]:
    """The ids counted so far, and the arrival of each batch of them."""
    try:
        ids = spark.read.schema(f"repayment_id BIGINT, {BATCH} BIGINT, {ARRIVED} BIGINT").parquet(counted)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, {}
    found = [re.search(rf"/{BATCH}=(\d+)/{ARRIVED}=(\d+)/[^/]+$", f) for f in ids.inputFiles()]
    return ids, {int(m[1]): int(m[2]) for m in found if m}


def not_counted(batch: DataFrame, known: DataFrame | None) -> DataFrame:
    """The first delivery in a batch of every payment whose id is not among the known ones.

    Batch and known ids meet in one grouping, so copies are cut to one inside each map task, a
    missing id is an id like any other, and what does not fit into memory is sorted on disk.
    """
    rows = batch.withColumn("_known", F.lit(False))
    if known is not None:
        rows = rows.unionByName(known.select("repayment_id", F.lit(True).alias("_known")),
                                allowMissingColumns=True)
    others = [c for c in batch.columns if c != "repayment_id"]
    return (rows.groupBy("repayment_id")
            .agg(*[F.first(c).alias(c) for c in others], F.max("_known").alias("_known"))
            .where("NOT _known").select(*batch.columns))


def stream_monthly_collections(payments: DataFrame, out: str, checkpoint: str,
                               horizon: str = HORIZON) -> StreamingQuery:
    """Running totals by month, all of them written after each batch.

    A payment delivered again within the horizon counts once; where repeats come later, stream the
    ledger that ``stream_apply_payments`` writes. What the stream remembers lies in files beside its
    checkpoint, so memory does not bound it: the payments each batch counted, until a later batch
    has arrived two horizons after them, and the totals, one row a month. A batch that failed is
    counted again from what the batches before it left, so a restart neither loses nor repeats
    payments. The last ``SLOTS`` snapshots are kept, each in a folder that a later batch writes
    over, so the folder never grows with the number of batches. ``out`` belongs to one checkpoint.
    """
    counted, totals = f"{checkpoint}/counted", f"{checkpoint}/totals"
    kept = 2 * _micros(payments.sparkSession, horizon)
    amounts = payments.select("repayment_id", "paid_amount", month_start("payment_date").alias("month_start"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ids, arrivals = _remembered(spark, counted)
        for late in {batch_id, *(n for n in arrivals if n > batch_id)}:  # of a failed attempt
            remove_folder(spark, f"{counted}/{BATCH}={late}")
        earlier = {n: at for n, at in arrivals.items() if n < batch_id}
        newest = max(earlier.values(), default=0)
        if ids is not None:
            ids = ids.where((F.col(BATCH) < batch_id) & (F.col(ARRIVED) > newest - kept))
        folder = f"{counted}/{BATCH}={batch_id}/{ARRIVED}={max(newest, time.time_ns() // 1000)}"
        fresh = not_counted(batch, ids)
        fresh.write.mode("overwrite").parquet(folder)
        months = (spark.read.schema(fresh.schema).parquet(folder).groupBy("month_start")
                  .agg(F.sum("paid_amount").alias("total_collected"),
                       F.count("repayment_id").alias("payment_count")))
        if batch_id:
            before = spark.read.schema(months.schema).parquet(f"{totals}/{BATCH}={batch_id - 1}")
            kinds = dict(months.dtypes)
            months = months.unionByName(before).groupBy("month_start").agg(
                *[F.sum(c).cast(kinds[c]).alias(c) for c in ("total_collected", "payment_count")])
        now = f"{totals}/{BATCH}={batch_id}"
        months.coalesce(1).write.mode("overwrite").parquet(now)
        (spark.read.schema(months.schema).parquet(now).withColumn(BATCH, F.lit(batch_id).cast("bigint"))
         .coalesce(1).write.mode("overwrite").parquet(f"{out}/slot={batch_id % SLOTS}"))
        for old in [n for n, at in earlier.items() if at <= newest - kept]:
            remove_folder(spark, f"{counted}/{BATCH}={old}")
        remove_folder(spark, f"{totals}/{BATCH}={batch_id - 2}")

    return (amounts.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def collections_so_far(spark: SparkSession, out: str) -> DataFrame:
    """The totals of every month in the newest snapshot of ``stream_monthly_collections``.

    A month never leaves the totals, so its row of the highest batch is the newest, also while the
    next snapshot is being written.
    """
    newest = F.struct(BATCH, "total_collected", "payment_count")
    return (spark.read.parquet(out)
            .groupBy("month_start").agg(F.max(newest).alias("_last"))
            .select(month_text("month_start").alias("month"),
                    "_last.total_collected", "_last.payment_count"))
