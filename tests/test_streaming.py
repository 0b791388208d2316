import pytest
from pyspark.sql import functions as F

from lendlake.operators import access, lifecycle
from lendlake.streaming import payments as streams
from tests.micro import D, d, emi, frame, micro, rows


def deliver(spark, folder, number, payments):
    frame(spark, "repayment", payments).coalesce(1).write.parquet(f"{folder}/f{number}")


@pytest.mark.parametrize("horizon", ["1 second", "7 days"])
def test_payments_are_taken_in_once_across_batches_and_restarts(spark, tmp_path, horizon):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    t = micro(spark, emi_schedule=[emi(i, 1, "2024-01-01") for i in (1, 2, 3)],
              repayment=[(90, 9, D("1.00"), d("2023-12-01"), "Cash")])
    stream = streams.payment_files(spark, f"{inbox}/*")
    deliver(spark, inbox, 1, [(1, 1, D("5.00"), d("2024-01-02"), "UPI"),
                              (1, 1, D("5.00"), d("2024-01-02"), "UPI"),
                              (90, 9, D("1.00"), d("2023-12-01"), "Cash")])
    streams.stream_apply_payments(stream, t, out, state, horizon).awaitTermination()
    # An old payment date in a later file is not late: the horizon runs on arrival.
    deliver(spark, inbox, 2, [(1, 1, D("5.00"), d("2024-01-02"), "UPI"),
                              (2, 2, D("6.00"), d("1999-01-01"), "Cash")])
    streams.stream_apply_payments(stream, t, out, state, horizon).awaitTermination()
    streams.stream_apply_payments(stream, t, out, state, horizon).awaitTermination()
    paid = streams.taken_in(spark, out)
    assert sorted(rows(paid, "repayment_id", "payment_date")) == [
        (1, d("2024-01-02")), (2, d("1999-01-01"))]
    after = streams.settle(t, paid)
    assert sorted(rows(after.emi_schedule, "emi_id", "status")) == [
        (1, "Paid"), (2, "Paid"), (3, "Pending")]
    assert after.repayment.count() == 3


def test_a_failed_batch_written_again_changes_nothing(spark, tmp_path):
    known = frame(spark, "repayment", [])
    batch = frame(spark, "repayment", [(1, 1, D("5.00"), d("2024-01-02"), "UPI")])
    target = str(tmp_path / "repayment" / "query_id=q" / "batch_id=0")
    for _ in range(2):
        streams.take_in(batch, known).write.mode("overwrite").parquet(target)
    assert streams.taken_in(spark, str(tmp_path)).count() == 1


def test_streamed_snapshots_equal_the_batch_job(spark, star, tmp_path):
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    due = access.payable_emis(star).where(F.col("due_date") < lifecycle.day("1998-01-01"))
    # Keys far above the existing ones, as a sender would number them.
    batch = due.select((F.col("emi_id") + 10**16).alias("repayment_id"), "emi_id",
                       F.col("emi_amount").alias("paid_amount"),
                       lifecycle.day("1998-01-01").alias("payment_date"),
                       F.lit("UPI").alias("payment_mode")).dropDuplicates(["repayment_id"])
    batch.repartition(3).write.parquet(inbox)
    streams.stream_apply_payments(streams.payment_files(spark, inbox), star, out,
                                  str(tmp_path / "state")).awaitTermination()
    streamed = streams.settle(star, streams.taken_in(spark, out)).emi_schedule
    direct = lifecycle.apply_payments(
        star, batch.withColumnRenamed("repayment_id", "request_id")).emi_schedule
    assert streamed.exceptAll(direct).isEmpty() and direct.exceptAll(streamed).isEmpty()


def test_running_collections_keep_the_newest_total(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    stream = streams.payment_files(spark, f"{inbox}/*")
    for number, payments in enumerate([
            [(1, 1, D("5.00"), d("2024-01-02"), "UPI"), (2, 1, D("7.00"), d("2024-02-02"), "UPI")],
            [(3, 1, D("1.00"), d("2024-01-31"), "UPI"), (4, 1, D("2.00"), None, "UPI")]]):
        deliver(spark, inbox, number, payments)
        streams.stream_monthly_collections(stream, out, state).awaitTermination()
    assert sorted(rows(streams.collections_so_far(spark, out)), key=str) == sorted([
        ("2024-01", D("6.00"), 2), ("2024-02", D("7.00"), 1), (None, D("2.00"), 1)], key=str)


def test_redelivery_counts_once_and_a_new_checkpoint_overwrites_nothing(spark, tmp_path):
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    stream = streams.payment_files(spark, f"{inbox}/*")
    t = micro(spark)
    twice = [(1, 1, D("5.00"), d("2024-01-02"), "UPI"), (1, 1, D("4.00"), d("2024-01-03"), "Cash")]
    for number, payments in enumerate([twice, [*twice[1:], (2, 1, D("7.00"), d("2024-02-02"), "UPI")]]):
        deliver(spark, inbox, number, payments)
        streams.stream_monthly_collections(stream, f"{out}/months", str(tmp_path / "m")).awaitTermination()
        streams.stream_apply_payments(stream, t, out, str(tmp_path / f"s{number}")).awaitTermination()
    months = {r[0]: r[2] for r in rows(streams.collections_so_far(spark, f"{out}/months"),
                                       "month", "total_collected", "payment_count")}
    assert months == {"2024-01": 1, "2024-02": 1}
    assert sorted(rows(streams.taken_in(spark, out), "repayment_id")) == [(1,), (2,)]


def test_of_different_deliveries_the_lowest_amount_counts(spark):
    batch = frame(spark, "repayment", [(1, 1, D("5.00"), d("2024-01-02"), "UPI"),
                                       (1, 1, D("4.00"), d("2024-01-03"), "Cash")])
    assert rows(streams.take_in(batch, frame(spark, "repayment", [])), "paid_amount") == [(D("4.00"),)]


def test_only_the_batch_s_part_of_the_ledger_is_read(spark, star):
    batch = frame(spark, "repayment", [(70, 1, D("5.00"), d("2024-01-02"), "UPI")])
    text = streams.take_in(batch, star.repayment)._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 70" in text and "<= 70" in text


def bought(spark, *ids):
    return frame(spark, "repayment", [(i, 1, D("5.00"), d("2024-01-02"), "UPI") for i in ids])


def partition_scans(df):
    """The lines of a plan's scans that prune partitions."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in text.split("\n") if "PartitionFilters" in x and "id_bucket" in x]


def test_an_old_and_a_new_id_read_their_buckets_only(spark, tmp_path):
    # One bucket a block of 10 ids: 100 buckets, of which the two extremes are looked up.
    ledger = bought(spark, *range(0, 1000, 2))
    index = streams.index_ledger(ledger, str(tmp_path / "ids"), block=10)
    batch = bought(spark, 0, 1, 998, 999, *range(991, 998))
    taken = streams.take_in(batch, index, block=10)
    assert sorted(rows(taken, "repayment_id")) == [(1,), (991,), (993,), (995,), (997,), (999,)]
    scans = partition_scans(taken)
    assert scans and all(" IN (0,99)" in x for x in scans)
    pruned = index.where(F.col("id_bucket").isin(0, 99))
    assert len({r[0] for r in pruned.select(F.input_file_name()).distinct().collect()}) <= 4
    assert index.select("id_bucket").distinct().count() == 100


def test_a_batch_of_few_ids_names_them(spark, tmp_path):
    index = streams.index_ledger(bought(spark, *range(100)), str(tmp_path / "ids"))
    taken = streams.take_in(bought(spark, 7, 7, 5_000_000_000_000_000_001), index)
    assert rows(taken, "repayment_id") == [(5_000_000_000_000_000_001,)]
    assert "IN (7,5000000000000000001)" in taken._jdf.queryExecution().optimizedPlan().toString()


def test_buckets_of_extreme_and_missing_ids(spark, tmp_path):
    ids = [-(2**63), -1, 0, 2**20 - 1, 2**20, 2**63 - 1, None]
    index = streams.index_ledger(bought(spark, *ids), str(tmp_path / "ids"))
    assert sorted(r[0] for r in index.collect() if r[0] is not None) == sorted(ids[:-1])
    left = streams.take_in(bought(spark, *ids, 1), index)
    assert sorted(rows(left, "repayment_id"), key=str) == [(1,), (None,)]
    empty = streams.index_ledger(bought(spark), str(tmp_path / "none"))
    assert streams.take_in(bought(spark, 3), empty).count() == 1
    assert streams.take_in(bought(spark), index).count() == 0


def test_a_stream_with_an_index_takes_in_what_one_without_does(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    t = micro(spark, repayment=[(i, 1, D("5.00"), d("2024-01-02"), "UPI") for i in (1, 3)])
    index = streams.index_ledger(t.repayment, str(tmp_path / "ids"))
    # All known at first; then a stranger far off.
    for number, payments in enumerate([(1, 3), (3, 4, 10**17)]):
        bought(spark, *payments).write.parquet(f"{inbox}/f{number}")
        for name, known in (("with", index), ("without", None)):
            stream = streams.payment_files(spark, f"{inbox}/*")
            streams.stream_apply_payments(stream, t, str(tmp_path / name),
                                          str(tmp_path / f"{name}-{number}"), index=known).awaitTermination()
            paid = streams.taken_in(spark, str(tmp_path / name))
            assert sorted(rows(paid, "repayment_id")) == ([(4,), (10**17,)] if number else [])


def test_totals_keep_few_snapshots_and_survive_a_restart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "SLOTS", 3)
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    stream = streams.payment_files(spark, f"{inbox}/*")
    for number in range(5):         # each run is a restart from the checkpoint
        deliver(spark, inbox, number, [(number, 1, D("2.00"), d("2024-01-02"), "UPI")])
        streams.stream_monthly_collections(stream, out, state).awaitTermination()
        assert rows(streams.collections_so_far(spark, out)) == [("2024-01", D("2.00") * (number + 1),
                                                                 number + 1)]
    assert len([x for x in (tmp_path / "out").iterdir() if x.name.startswith("slot=")]) == 3
    assert spark.read.parquet(out).count() == 3


def months_of(spark, out):
    return sorted(rows(streams.collections_so_far(spark, out), "month", "total_collected", "payment_count"), key=str)


def test_months_keep_no_payment_in_a_state_store(spark, tmp_path):
    # A state store holds every id twice in an executor's memory: 12 million payments did not end.
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    for number in range(2):
        deliver(spark, inbox, number, [(7, 1, D("2.00"), d("2024-01-02"), "UPI")] * 3)
        query = streams.stream_monthly_collections(streams.payment_files(spark, f"{inbox}/*"), out, state)
        query.awaitTermination()
        assert query.recentProgress and not any(p.stateOperators for p in query.recentProgress)
    assert not (tmp_path / "state" / "state").exists()
    assert months_of(spark, out) == [("2024-01", D("2.00"), 1)]


def test_months_cut_copies_before_the_exchange(spark):
    batch = bought(spark, *[1] * 50, 2, 3, None, None).select("repayment_id", "paid_amount")
    fresh = streams.not_counted(batch, bought(spark, 2, 4).select("repayment_id"))
    text = fresh._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Join" not in text and "SortAggregate" not in text
    assert "partial_first" in text[text.index("Exchange"):]
    assert sorted(rows(fresh), key=str) == [(1, D("5.00")), (3, D("5.00")), (None, D("5.00"))]
    assert streams.not_counted(batch, bought(spark, None, 1, 3).select("repayment_id")).collect() == [
        (2, D("5.00"))]


def test_a_payment_without_id_counts_by_its_amount_once(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    for number in range(2):
        deliver(spark, inbox, number, [(None, 1, D("2.00"), d("2024-01-02"), "UPI"),
                                       (number, 1, None, d("2024-02-02"), "UPI")])
        streams.stream_monthly_collections(streams.payment_files(spark, f"{inbox}/*"), out,
                                           state).awaitTermination()
    assert months_of(spark, out) == [("2024-01", D("2.00"), 0), ("2024-02", None, 2)]


def test_a_failed_batch_of_months_is_counted_again(spark, tmp_path, monkeypatch):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    stream = streams.payment_files(spark, f"{inbox}/*")
    remove = streams.remove_folder

    def fails_at_last(spark, folder):
        if "/totals/" in folder:
            raise OSError("lost")
        remove(spark, folder)

    for number in range(3):
        deliver(spark, inbox, number, [(n, 1, D("2.00"), d("2024-01-02"), "UPI") for n in range(number + 1)])
        monkeypatch.setattr(streams, "remove_folder", fails_at_last)
        with pytest.raises(Exception, match="lost"):
            streams.stream_monthly_collections(stream, out, state).awaitTermination()
        monkeypatch.setattr(streams, "remove_folder", remove)
        streams.stream_monthly_collections(stream, out, state).awaitTermination()
        assert months_of(spark, out) == [("2024-01", D("2.00") * (number + 1), number + 1)]


def test_months_forget_payments_after_two_horizons(spark, tmp_path, monkeypatch):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    seconds = 1_000_000_000
    # The id 1 comes again within the horizon, at its end and, as a later batch came meanwhile, after it.
    for number, (now, ids, count) in enumerate([(100, [1], 1), (109, [1, 2], 2), (119, [1, 3], 3),
                                                (121, [1, 4], 4), (122, [1, 2], 5)]):
        deliver(spark, inbox, number, [(n, 1, D("2.00"), d("2024-01-02"), "UPI") for n in ids])
        monkeypatch.setattr(streams, "time", type("Clock", (), {"time_ns": lambda at=now: at * seconds}))
        streams.stream_monthly_collections(streams.payment_files(spark, f"{inbox}/*"), out, state,
                                           "10 seconds").awaitTermination()
        assert months_of(spark, out) == [("2024-01", D("2.00") * count, count)]
    assert sorted(x.name for x in (tmp_path / "state" / "counted").iterdir()) == [
        f"batch_id={n}" for n in range(1, 5)]
    assert sorted(x.name for x in (tmp_path / "state" / "totals").iterdir()) == ["batch_id=3", "batch_id=4"]


@pytest.mark.parametrize("horizon", ["-1 days", "soon"])
def test_months_refuse_a_wrong_horizon(spark, tmp_path, horizon):
    (tmp_path / "inbox").mkdir()
    stream = streams.payment_files(spark, str(tmp_path / "inbox"))
    with pytest.raises(Exception, match=horizon):
        streams.stream_monthly_collections(stream, str(tmp_path / "out"), str(tmp_path / "s"), horizon)
