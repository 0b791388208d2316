import random

import pytest
from pyspark.sql import functions as F

from lendlake.functions.columns import due_date
from lendlake.functions.workspace import stored
from lendlake.operators import lifecycle, maintenance
from lendlake.schema import COLUMNS, KEY, TABLES
from lendlake.sources.tables import Tables
from tests.micro import D, customer, d, emi, frame, loan, micro, rows


def test_worked_instalment_and_zero_rate(spark):
    t = micro(spark, loan=[loan(1, 1, "5000000.00", rate="7.50", tenure=240),
                           loan(2, 1, "900.00", rate="0.00", tenure=1),
                           loan(3, 1, "1000.00", rate="0.00", tenure=3)])
    quote = {r["loan_id"]: r for r in lifecycle.emi_quote(t).collect()}
    assert round(quote[1]["emi"], 2) == 40279.66
    assert (quote[2]["emi"], quote[2]["total_interest"]) == (900.0, 0.0)
    plan = rows(lifecycle.emi_schedule_generate(t.loan).where("loan_id = 3"), "emi_amount")
    assert plan == [(D("333.33"),)] * 3


@pytest.mark.parametrize("start, months, clamp, day28", [
    ("2023-01-31", 3, "2023-04-30", "2023-04-28"), ("2023-01-31", 1, "2023-02-28", "2023-02-28"),
    ("2024-01-31", 1, "2024-02-29", "2024-02-28"), ("2023-11-30", 3, "2024-02-29", "2024-02-28"),
    ("2024-02-29", 12, "2025-02-28", "2025-02-28"), ("2024-02-29", 1, "2024-03-29", "2024-03-29"),
    ("2023-12-31", 12, "2024-12-31", "2024-12-31")])
def test_month_ends(spark, start, months, clamp, day28):
    df = spark.range(1).select(
        due_date(F.lit(start).cast("date"), F.lit(months), "clamp").alias("a"),
        due_date(F.lit(start).cast("date"), F.lit(months), "day28").alias("b"))
    assert rows(df) == [(d(clamp), d(day28))]


def test_schedule_has_tenure_rows(spark, star):
    plan = lifecycle.emi_schedule_generate(star.loan).groupBy("loan_id").count()
    both = plan.join(star.loan, "loan_id")
    assert both.count() == star.loan.count()
    assert both.where("count <> tenure").isEmpty()


def test_tenures_out_of_range(spark):
    none = frame(spark, "loan", [loan(1, 1, tenure=0), loan(2, 1, tenure=-3)])
    assert rows(lifecycle.emi_schedule_generate(none)) == []
    long = frame(spark, "loan", [loan(1, 1, tenure=10_000)])
    with pytest.raises(Exception, match="tenure must be below"):
        lifecycle.emi_schedule_generate(long).collect()


def test_default_detection_edges(spark):
    late = {1: "2024-06-02", 2: "2024-06-01", 3: "2024-05-03", 4: "2024-05-02"}
    t = micro(spark, customer=[customer(1)],
              loan=[loan(i, 1) for i in (0, 1, 2, 3, 4, 5, 6)],
              emi_schedule=[emi(i, i, due) for i, due in late.items()]
              + [emi(7, 5, "2024-01-01"), emi(8, 6, "2024-07-01"), emi(9, 0, "2024-06-30"),
                 emi(10, 1, "2024-06-20", "50.00"), emi(11, 1, "2024-08-01")],
              default_record=[(1, 5, d("2024-02-01"), 9)])
    after = lifecycle.default_sweep(t, "2024-07-01")
    new = after.default_record.where("default_id > 1").join(after.penalty, "default_id")
    # 29 and 30 days: one period; 59: one; 60: two. Loan 5 has a default, loan 6 is not late.
    assert sorted(rows(new, "loan_id", "overdue_days", "penalty_amount")) == [
        (0, 1, D("2.00")), (1, 29, D("3.00")), (2, 30, D("2.00")), (3, 59, D("2.00")),
        (4, 60, D("4.00"))]
    states = dict(rows(after.loan, "loan_id", "current_status"))
    assert {k for k, v in states.items() if v == "Defaulted"} == {0, 1, 2, 3, 4}
    assert after.loan_status_history.count() == 5


def test_sweep_twice_equals_once(spark, star):
    once = lifecycle.default_sweep(star, "2000-01-01")
    twice = lifecycle.default_sweep(once, "2000-01-01")
    assert lifecycle.detect_defaults(once, "2000-01-01").isEmpty()
    for name in ("loan", "emi_schedule", "default_record", "penalty", "loan_status_history"):
        assert twice[name].exceptAll(once[name]).isEmpty()
        keys = once[name].groupBy(KEY[name]).count().where("count > 1")
        assert name == "emi_schedule" or keys.isEmpty()


def test_keys_stay_dense_over_many_runs(spark):
    """Ten disbursals, sweeps and payments in a row: no key ever leaves a gap."""
    t = micro(spark, customer=[customer(1)], loan=[loan(10**12, 1)],
              credit_history=[(1, 1, 1, 0, d("2024-01-01"))])
    terms = ("application_id BIGINT, customer_id BIGINT, loan_type_id BIGINT, loan_amount DECIMAL(14,2), "
             "interest_rate DECIMAL(5,2), tenure INT, credit_score INT, auto_approved BOOLEAN, "
             "guarantor_name STRING, guarantor_phone STRING, relationship STRING")
    for run in range(3):
        before = {n: t[n].count() for n in ("loan", "emi_schedule", "credit_score")}
        ids = [r[0] * 1000 for r in rows(t.loan, "loan_id")] + [7]
        t = lifecycle.disburse_loans(t, spark.createDataFrame(
            [(i, 1, 2, D("1200.00"), D("5.00"), 12, 700, True, "Ann", None, None) for i in set(ids)],
            terms), "2020-01-31")
        t = lifecycle.default_sweep(t, "2021-06-01")
        paid = t.emi_schedule.select(
            (F.col("emi_id") * 10**6).alias("request_id"), "emi_id",
            F.col("emi_amount").alias("paid_amount"), F.col("due_date").alias("payment_date"),
            F.lit("UPI").alias("payment_mode"))
        t = lifecycle.apply_payments(t, paid)
        t = Tables({n: stored(t[n], n) for n in TABLES})
        assert t.loan.count() == before["loan"] * 2 + 1
    for name, first in (("loan", 10**12), ("emi_schedule", 1), ("credit_score", 1), ("guarantor", 1),
                        ("repayment", 1), ("default_record", 1), ("penalty", 1),
                        ("loan_status_history", 1)):
        keys = sorted(r[0] for r in rows(t[name], KEY[name]))
        assert keys == list(range(first, first + len(keys))), name


def test_part_payment_closes_the_instalment(spark):
    t = micro(spark, emi_schedule=[emi(1, 1, "2024-01-01", status="Overdue"),
                                   emi(2, 1, "2024-02-01")],
              repayment=[(7, 9, D("1.00"), None, "UPI")])
    batch = spark.createDataFrame(
        [(0, 1, D("5.00"), d("2024-03-01"), "Cash"), (1, 1, D("6.00"), d("2024-03-01"), "UPI")],
        "request_id BIGINT, emi_id BIGINT, paid_amount DECIMAL(12,2), payment_date DATE, "
        "payment_mode STRING")
    after = lifecycle.apply_payments(t, batch)
    assert sorted(rows(after.emi_schedule, "emi_id", "status")) == [(1, "Paid"), (2, "Pending")]
    assert sorted(rows(after.repayment, "repayment_id")) == [(7,), (8,), (9,)]


def test_disbursal(spark):
    t = micro(spark, customer=[customer(1), customer(2)], loan=[loan(4, 1)],
              credit_history=[(1, 1, 1, 0, d("2024-01-01")), (2, 2, 0, 0, None)])
    decisions = spark.createDataFrame(
        [(0, 1, 2, D("1200.00"), D("0.00"), 12, 755, True, "  Ann ", " ", ""),
         (1, 1, 2, D("1200.00"), D("0.00"), 6, 601, True, "  ", "1", "Friend"),
         (2, 2, 2, D("1200.00"), D("0.00"), 6, 600, False, "Bob", "1", "Friend")],
        "application_id BIGINT, customer_id BIGINT, loan_type_id BIGINT, "
        "loan_amount DECIMAL(14,2), interest_rate DECIMAL(5,2), tenure INT, credit_score INT, "
        "auto_approved BOOLEAN, guarantor_name STRING, guarantor_phone STRING, "
        "relationship STRING")
    after = lifecycle.disburse_loans(t, decisions, "2024-01-31")
    assert sorted(rows(after.loan, "loan_id")) == [(4,), (5,), (6,)]
    assert sorted(rows(after.loan_status_history, "status_history_id", "status_label")) == [
        (1, "Approved"), (2, "Active"), (3, "Approved"), (4, "Active")]
    assert rows(after.guarantor, "loan_id", "name", "phone", "relationship") == [
        (5, "Ann", None, None)]
    assert sorted(rows(after.credit_score, "score_value", "risk_id")) == [(601, 2), (755, 1)]
    assert sorted(rows(after.credit_history, "customer_id", "total_loans", "last_updated")) == [
        (1, 3, d("2024-01-31")), (2, 0, None)]
    assert after.emi_schedule.count() == after.emi_schedule.select("emi_id").distinct().count()
    assert after.emi_schedule.count() == 18


def _one_by_one(base, batch):
    phones, emails, accepted = {c[3] for c in base}, {c[4] for c in base}, []
    for request, name, phone, email in sorted(batch):
        name, phone, email = name.strip(), phone.strip(), email.strip()
        if name and phone and email and phone not in phones and email not in emails:
            accepted.append(request)
            phones.add(phone)
            emails.add(email)
    return accepted


@pytest.mark.parametrize("seed", range(3))
def test_registration_equals_entry_one_by_one(spark, seed):
    rng = random.Random(seed)
    base = [customer(1), customer(2)]
    batch = [(i, rng.choice(["Ann", " Bo ", "Cy", " "]) if rng.random() < .3 else "Di",
              f" p{rng.randrange(14)}", f"e{rng.randrange(14)}@x ") for i in range(40)]
    t = micro(spark, customer=base)
    df = spark.createDataFrame(
        [(*r, d("1990-01-01"), D("5000.00"), "Salaried", " Co ", "s", "c", "1") for r in batch],
        "request_id BIGINT, name STRING, phone STRING, email STRING, dob DATE, "
        "monthly_income DECIMAL(12,2), employment_type STRING, company_name STRING, "
        "street STRING, city STRING, zip_code STRING")
    new, rejected, ids = maintenance.register_customers(t, df, "2024-01-01")
    expected = _one_by_one(base, batch)
    assert sorted(rows(new["customer"], "customer_id")) == [(3 + n,) for n in range(len(expected))]
    assert sorted(rows(ids, "request_id", "customer_id")) == [(r, 3 + n) for n, r in enumerate(expected)]
    assert sorted(r[0] for r in rows(rejected)) == sorted(
        set(range(40)) - set(expected))
    for name in ("income_details", "address_details", "credit_history"):
        assert new[name].count() == len(expected)


def test_a_rejected_request_does_not_block_later_ones(spark):
    t = micro(spark)
    chain = [(1, "A", "p1", "e1"), (2, "B", "p1", "e2"), (3, "C", "p3", "e2")]
    df = spark.createDataFrame(chain, "request_id BIGINT, name STRING, phone STRING, email STRING")
    assert sorted(rows(maintenance.accepted_requests(t.customer, df))) == [(1,), (3,)]


def test_a_long_chain_takes_few_jobs(spark):
    """Each request shares a contact with the next: every second one is accepted."""
    n = 10_000
    chain = spark.range(n).select(
        F.col("id").alias("request_id"), F.lit("A").alias("name"),
        F.concat(F.lit("p"), F.floor(F.col("id") / 2)).alias("phone"),
        F.concat(F.lit("e"), F.floor((F.col("id") + 1) / 2)).alias("email"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "a long chain")
    try:
        found = sorted(r[0] for r in maintenance.accepted_requests(micro(spark).customer, chain).collect())
        actions = len(tracker.getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert found == list(range(0, n, 2))
    assert actions <= 30


@pytest.mark.parametrize("seed", range(2))
def test_chains_and_stars_equal_one_by_one(spark, seed):
    draw = random.Random(seed)
    batch = [(i, "A", f"p{draw.randrange(60)}", f"e{draw.randrange(60)}") for i in range(150)]
    batch += [(1000 + i, "A", "hot", f"x{i // 2}") for i in range(40)]
    batch += [(2000 + i, "A", f"q{(i * 37 % 100) // 2}", f"f{(i * 37 % 100 + 1) // 2}") for i in range(100)]
    taken, expected = set(), []
    for i, _, phone, email in batch:
        if phone not in taken and email not in taken:
            taken |= {phone, email}
            expected.append(i)
    df = spark.createDataFrame(batch, "request_id BIGINT, name STRING, phone STRING, email STRING")
    for in_order in (10**6, 40):
        found = maintenance.accepted_requests(micro(spark).customer, df, in_order)
        assert sorted(r[0] for r in found.collect()) == expected


def test_changes_last_one_wins_and_delete_undoes_upsert(spark):
    base = frame(spark, "loan_type", [(1, "Home", D("7.50"), D("100.00")),
                                      (2, "Car", D("9.00"), D("50.00"))])
    columns = "loan_type_id BIGINT, type_name STRING, base_interest_rate DECIMAL(5,2), " \
              "max_amount DECIMAL(14,2), op STRING, seq BIGINT"
    changes = spark.createDataFrame(
        [(1, "House", D("7.00"), D("100.00"), "upsert", 1),
         (1, "Flat", D("7.25"), D("100.00"), "upsert", 2),
         (2, None, None, None, "delete", 3), (3, "Boat", D("9.50"), D("5.00"), "upsert", 4),
         (4, "Gone", D("9.50"), D("5.00"), "upsert", 5), (4, None, None, None, "delete", 6)],
        columns)
    after = maintenance.apply_changes(base, changes, "loan_type_id")
    assert sorted(rows(after, "loan_type_id", "type_name")) == [(1, "Flat"), (3, "Boat")]


def one_by_one(base, changes):
    """Plain counterpart of ``apply_checked_changes`` for unique phones and emails."""
    state, refused = {k: (p, e) for k, p, e in base}, []
    for seq, op, key, phone, email in sorted(changes):
        if op == "delete":
            state.pop(key, None)
        elif any(k != key and (p == phone or e == email) for k, (p, e) in state.items()):
            refused.append(seq)
        else:
            state[key] = (phone, email)
    return state, refused


@pytest.mark.parametrize("in_order", [10**6, 6])
def test_checked_changes_equal_entry_one_by_one(spark, in_order):
    """Values wander between few keys; a phone that a third of the changes ask for is one of them."""
    deal = random.Random(5)
    base = [(k, f"p{k}", f"e{k}@x") for k in range(1, 9)]
    changes = [(seq, "delete" if deal.random() < 0.15 else "upsert", deal.randrange(1, 13),
                "p1" if deal.random() < 0.33 else f"p{deal.randrange(1, 16)}",
                f"e{deal.randrange(1, 30)}@x") for seq in range(60)]
    state, refused = one_by_one(base, changes)
    assert 5 < len(refused) < 55
    t = micro(spark, customer=[customer(k) for k, _, _ in base])
    feed = spark.createDataFrame(
        [(k, f"C{k}", d("1980-01-01"), p, e, None, op, seq) for seq, op, k, p, e in changes],
        COLUMNS["customer"] + ", op STRING, seq BIGINT")
    after, found = maintenance.apply_checked_changes(t, "customer", feed, in_order)
    assert sorted(rows(found, "seq", "reason")) == [(s, "duplicate phone or email") for s in refused]
    assert {r[0]: r[1:] for r in rows(after.customer, "customer_id", "phone", "email")} == state


def test_checked_changes_refuse_what_breaks_rules_and_cascade(spark):
    t = micro(spark, customer=[customer(1), customer(2)], loan=[loan(1, 1)],
              income_details=[(1, 1, D("1.00"), "Salaried", None), (2, 2, D("1.00"), "Salaried", None)])
    people = COLUMNS["customer"] + ", op STRING, seq BIGINT"
    feed = spark.createDataFrame(
        [(*customer(1), "delete", 1), (*customer(2), "delete", 2), (*customer(2), "upsert", 3),
         (None, "X", d("1980-01-01"), "p9", "e9@x", None, "upsert", 4),
         (*customer(9)[:3], None, "e9@x", None, "upsert", 5), (*customer(7), "swap", 6),
         (*customer(77), "delete", 7)], people)
    after, found = maintenance.apply_checked_changes(t, "customer", feed)
    assert sorted(rows(found, "seq", "reason")) == [
        (1, "used by loan"), (4, "customer_id not null"), (5, "phone not null"), (6, "unknown op")]
    assert sorted(rows(after.customer, "customer_id")) == [(1,), (2,)]
    assert rows(after.income_details, "customer_id") == [(1,)]     # went with the deleted row
    payments = spark.createDataFrame(
        [(1, 5, D("1.00"), None, "UPI", "upsert", 1), (2, None, D("1.00"), None, "UPI", "upsert", 2),
         (3, 5, D("1.00"), None, "Shells", "upsert", 3)], COLUMNS["repayment"] + ", op STRING, seq BIGINT")
    after, found = maintenance.apply_checked_changes(t, "repayment", payments)
    assert sorted(rows(found, "seq", "reason")) == [
        (1, "no emi_schedule"), (2, "emi_id not null"), (3, "payment_mode in domain")]
    nothing, found = maintenance.apply_checked_changes(t, "customer", feed.limit(0))
    assert found.isEmpty() and nothing.customer.count() == 2


def test_cascade(spark):
    t = micro(spark, customer=[customer(1), customer(2)], loan=[loan(1, 1)],
              income_details=[(1, 1, D("1.00"), "Salaried", None),
                              (2, 2, D("1.00"), "Salaried", None)],
              emi_schedule=[emi(1, 1, "2024-01-01")],
              repayment=[(1, 1, D("1.00"), None, "UPI")],
              default_record=[(1, 1, None, 1)], penalty=[(1, 1, D("1.00"), None)])
    ids = spark.createDataFrame([(1,), (2,)], "customer_id BIGINT")
    kept = maintenance.cascade_delete(t, "customer", ids)
    assert rows(kept.customer, "customer_id") == [(1,)]         # its loan keeps customer 1
    assert rows(kept.income_details, "customer_id") == [(1,)]
    gone = maintenance.cascade_delete(t, "loan", spark.createDataFrame([(1,)], "loan_id BIGINT"))
    assert all(gone[n].isEmpty() for n in
               ("loan", "emi_schedule", "repayment", "default_record", "penalty"))
    assert maintenance.cascade_delete(
        t, "loan_type", spark.createDataFrame([(1,), (6,)], "id BIGINT")).loan_type.count() == 5


def test_rollup_shows_drift_both_ways(spark):
    t = micro(spark, loan=[loan(1, 1), loan(2, 2)], default_record=[(1, 1, None, 5)],
              credit_history=[(1, 1, 1, 0, None), (3, 3, 2, 0, None)])
    assert sorted(rows(maintenance.credit_history_rollup(t))) == [
        (1, 1, 1, 0, 1, True), (2, 0, 1, 0, 0, True), (3, 2, 0, 0, 0, True)]


def test_timeline_in_small_blocks(spark, star):
    assert sorted(rows(maintenance.status_timeline(star, blocks=9)), key=str) == sorted(
        rows(maintenance.status_timeline(star)), key=str)


def test_validation_counts_violations(spark):
    t = micro(spark,
              customer=[customer(1), customer(1),
                        (2, None, d("1980-01-01"), "p1", "x" * 151, None)],
              income_details=[(1, 9, D("0.00"), "Farmer", None)],
              credit_score=[(1, 1, 755, None, 2), (2, 1, 200, None, None), (3, 1, 800, None, 7)],
              loan=[loan(1, 1, kind=44, status="Lost")])
    found = {(a, b): n for a, b, n in rows(maintenance.validate_tables(t)) if n}
    assert found == {
        ("customer", "customer_id unique"): 1, ("customer", "phone unique"): 1,
        ("customer", "email unique"): 1, ("customer", "name not null"): 1,
        ("customer", "email length"): 1,
        ("income_details", "customer_id refers to customer"): 1,
        ("income_details", "monthly_income > 0"): 1,
        ("income_details", "employment_type in domain"): 1,
        ("credit_score", "risk_id fits score_value"): 2,
        ("credit_score", "score_value in 300..900"): 1,
        ("credit_score", "risk_id refers to risk_category"): 1,
        ("loan", "loan_type_id refers to loan_type"): 1,
        ("loan", "current_status in domain"): 1}
    assert {name for name, _ in found} <= set(TABLES)


def test_input_checks(spark):
    t = micro(spark, emi_schedule=[emi(1, 1, "2024-01-01", "100.00")])
    applications = spark.createDataFrame(
        [(1, 2, D("10000.00"), 12, D("5.00")), (2, 2, D("3200000.01"), 13, D("25.01")),
         (3, 99, D("20000.00"), 12, D("9.00"))],
        "application_id BIGINT, loan_type_id BIGINT, loan_amount DECIMAL(14,2), tenure INT, "
        "interest_rate DECIMAL(5,2)")
    found = dict(rows(maintenance.application_input_checks(t, applications)))
    assert found[1] == "" and found[3].startswith("unknown loan type")
    assert found[2] == "amount out of range; tenure not offered; rate out of range"
    payments = spark.createDataFrame(
        [(1, 1, D("150.00"), "UPI"), (2, 1, D("150.01"), "UPI"), (3, 1, D("0.00"), "Barter"),
         (4, 5, D("1.00"), "UPI")],
        "request_id BIGINT, emi_id BIGINT, paid_amount DECIMAL(12,2), payment_mode STRING")
    checked = dict(rows(maintenance.payment_input_checks(t, payments)))
    assert checked[1] == "" and checked[2] == "amount out of range"
    assert checked[3] == "amount out of range; unknown mode"
    assert checked[4].startswith("unknown instalment")
    assert {p for _, p in rows(maintenance.loan_type_input_checks(t.loan_type))} == {""}
    bands = dict(rows(maintenance.risk_band_input_checks(
        frame(spark, "risk_category", [(1, "Low", 751, 900), (2, "Odd", 299, 901)]))))
    assert bands == {1: "", 2: "min_score out of range; max_score out of range"}
    people = spark.createDataFrame(
        [(1, "A", "1", "e", d("1990-01-01"), D("1000.00"), "Salaried"),
         (2, " ", "1", "e", d("1930-01-01"), D("1.00"), "Pirate")],
        "request_id INT, name STRING, phone STRING, email STRING, dob DATE, "
        "monthly_income DECIMAL(12,2), employment_type STRING")
    assert dict(rows(maintenance.registration_input_checks(people))) == {
        1: "", 2: "name required; birth date out of range; income out of range; "
                  "unknown employment"}


def test_few_bytes_of_loans_are_expanded_in_all_tasks(spark, star):
    made = lifecycle.emi_schedule_generate(star.loan)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert made.select(F.spark_partition_id()).distinct().count() == parts
