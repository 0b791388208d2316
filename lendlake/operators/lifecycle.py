"""Loan lifecycle as set-wise jobs: quote, schedule, payments, defaults, disbursal.

Each job takes table snapshots and an explicit ``as_of`` date and returns new snapshots or the
rows to add; nothing is changed in place. The caller writes results to a new path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlake.functions.bands import assign_risk_band
from lendlake.functions.columns import blank_to_null, due_date, instalment, penalty_amount
from lendlake.functions.keys import first_free, numbered, numbered_at_once
from lendlake.functions.workspace import stored
from lendlake.schema import column_names
from lendlake.sources.tables import Tables

# An instalment key is the loan key times this, plus the instalment number.
KEYS_PER_LOAN = 10_000
BACKFILL_MONTHS = 12
PAYMENT_LAG_DAYS = 2
# Payment modes by instalment key modulo 4.
MODES_BY_KEY = ("Online", "UPI", "Cheque", "Cash")


def day(value: str | Column) -> Column:
    return F.lit(value).cast("date")


def with_emi(df: DataFrame) -> DataFrame:
    """Add emi, total_payable and total_interest to rows with amount, rate and tenure."""
    quoted = df.withColumn("emi", instalment(
        F.col("loan_amount"), F.col("interest_rate"), F.col("tenure")))
    payable = F.col("emi") * F.col("tenure")
    return (quoted.withColumn("total_payable", payable)
            .withColumn("total_interest", payable - F.col("loan_amount").cast("double")))


def emi_quote(t: Tables) -> DataFrame:
    """The quote for the terms of every loan."""
    return with_emi(t.loan).select(
        "loan_id", "loan_amount", "interest_rate", "tenure", "emi", "total_payable",
        "total_interest")


def emi_schedule_generate(loans: DataFrame, eom: str = "day28", max_n: int | None = None,
                          start: Column | None = None, first: str | None = None) -> DataFrame:
    """One Pending instalment a month, 1..tenure, counted from ``start`` (the disbursal).

    Keys are made of loan and number, or count up from the column ``first`` of the loan."""
    last = F.col("tenure") if max_n is None else F.least("tenure", F.lit(max_n))
    n = last if first else F.when(F.col("tenure") < KEYS_PER_LOAN, last).otherwise(
        F.raise_error(F.lit(f"tenure must be below {KEYS_PER_LOAN}")))
    key = F.col(first) if first else F.col("loan_id") * KEYS_PER_LOAN + 1
    # sequence(1, 0) counts down, so a tenure below 1 is excluded before it is expanded.
    terms = loans.where(F.col("tenure") >= 1).select(
        "loan_id", (start if start is not None else F.col("disbursed_date")).alias("_start"),
        instalment(F.col("loan_amount"), F.col("interest_rate"), F.col("tenure"))
        .cast("decimal(12,2)").alias("emi_amount"),
        n.alias("_last"), key.alias("_key"))
    # A loan becomes up to 360 rows: spreading the loans first costs little, evens out the tasks
    # that expand them, and leaves the schedule partitioned by loan for what follows. Their number is
    # given, as adaptive execution would merge tasks by the bytes of loans, not of instalments.
    parts = int(loans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = terms.repartition(parts, "loan_id").select(
        "loan_id", "_start", "emi_amount", "_key",
        F.explode(F.sequence(F.lit(1), F.col("_last"))).alias("n"))
    return rows.select(
        (F.col("_key") + F.col("n") - 1).alias("emi_id"), "loan_id",
        due_date(F.col("_start"), F.col("n"), eom).alias("due_date"), "emi_amount",
        F.lit("Pending").alias("status"))


def emi_schedule_backfill(loans: DataFrame, cutoff: str, as_of: str,
                          max_n: int = BACKFILL_MONTHS) -> DataFrame:
    """The first instalments of existing loans; paid if due before ``cutoff``, overdue if due
    between it and ``as_of``, else pending."""
    due = F.col("due_date")
    status = (F.when(due < day(cutoff), "Paid").when(due < day(as_of), "Overdue")
              .otherwise("Pending"))
    return emi_schedule_generate(loans, "clamp", max_n).withColumn("status", status)


def repayments_from_schedule(emis: DataFrame) -> DataFrame:
    """A full payment two days after the due date for every paid instalment."""
    mode = F.element_at(F.array(*[F.lit(m) for m in MODES_BY_KEY]),
                        (F.col("emi_id") % len(MODES_BY_KEY) + 1).cast("int"))
    return emis.where(F.col("status") == "Paid").select(
        F.col("emi_id").alias("repayment_id"), "emi_id",
        F.col("emi_amount").alias("paid_amount"),
        F.date_add("due_date", PAYMENT_LAG_DAYS).alias("payment_date"),
        mode.alias("payment_mode"))


def mark_overdue(emis: DataFrame, as_of: str) -> DataFrame:
    """Pending instalments due before ``as_of`` become overdue."""
    late = (F.col("status") == "Pending") & (F.col("due_date") < day(as_of))
    return emis.withColumn("status", F.when(late, "Overdue").otherwise(F.col("status")))


def detect_defaults(t: Tables, as_of: str) -> DataFrame:
    """Loans with overdue instalments and no default on record yet."""
    late = (t.emi_schedule.where(F.col("status") == "Overdue").groupBy("loan_id")
            .agg(F.min("due_date").alias("_oldest"), F.sum("emi_amount").alias("overdue_total")))
    return (late.join(t.default_record.select("loan_id"), "loan_id", "left_anti")
            .select("loan_id", day(as_of).alias("default_date"),
                    F.datediff(day(as_of), "_oldest").alias("overdue_days"), "overdue_total"))


def assess_penalties(new_defaults: DataFrame) -> DataFrame:
    """Add the penalty of each new default."""
    return new_defaults.withColumn("penalty_amount", penalty_amount(
        F.col("overdue_total"), F.col("overdue_days")).cast("decimal(20,2)"))


def apply_status_changes(t: Tables, changes: DataFrame, as_of: str) -> Tables:
    """Set loan statuses and log every change.

    ``changes``: change_id (unique, not negative; higher means later), loan_id, status.
    """
    final = changes.groupBy("loan_id").agg(F.max("change_id").alias("change_id"))
    final = changes.join(final.select("change_id"), "change_id", "left_semi").select(
        "loan_id", F.col("status").alias("_status"))
    status = F.coalesce("_status", "current_status")
    loans = (t.loan.join(final, "loan_id", "left").withColumn("current_status", status)
             .select(*column_names("loan")))
    known = changes.join(t.loan.select("loan_id"), "loan_id", "left_semi")
    log = numbered(known, ["change_id"], "_n").select(
        (first_free(t.loan_status_history, "status_history_id") + F.col("_n"))
        .alias("status_history_id"),
        "loan_id", F.col("status").alias("status_label"), day(as_of).alias("change_date"))
    return t.replace(loan=loans).append(loan_status_history=log)


def default_sweep(t: Tables, as_of: str) -> Tables:
    """The nightly job: mark overdue, record new defaults and penalties, set loan statuses.

    Running it twice changes nothing the second time, as recorded defaults are left out. What
    the sweep finds, at most one default per loan, is computed once and stored; all tables follow
    from it.
    """
    t = t.replace(emi_schedule=mark_overdue(t.emi_schedule, as_of))
    found = stored(numbered(assess_penalties(detect_defaults(t, as_of)), ["loan_id"], "_n"), "sweep")
    default_id = (first_free(t.default_record, "default_id") + F.col("_n")).alias("default_id")
    defaults = found.select(default_id, "loan_id", "default_date", "overdue_days")
    penalties = found.select(
        (first_free(t.penalty, "penalty_id") + F.col("_n")).alias("penalty_id"), default_id,
        F.col("penalty_amount").cast("decimal(10,2)").alias("penalty_amount"),
        F.col("default_date").alias("penalty_date"))
    changes = found.select(F.col("_n").alias("change_id"), "loan_id",
                           F.lit("Defaulted").alias("status"))
    return apply_status_changes(t, changes, as_of).append(
        default_record=defaults, penalty=penalties)


def close_instalments(emis: DataFrame, payments: DataFrame) -> DataFrame:
    """Instalments with any payment become paid."""
    paid = payments.select("emi_id").distinct().withColumn("_paid", F.lit(True))
    status = F.when(F.col("_paid"), "Paid").otherwise(F.col("status"))
    return (emis.join(paid, "emi_id", "left").withColumn("status", status)
            .select(*column_names("emi_schedule")))


def apply_payments(t: Tables, payments: DataFrame) -> Tables:
    """Record payments and close their instalments, even if paid in part.

    ``payments``: request_id (sets the order of new keys), emi_id, paid_amount, payment_date and
    payment_mode.
    """
    order = ["request_id", "emi_id", "paid_amount", "payment_date"]
    rows = numbered(payments, order, "_n").select(
        (first_free(t.repayment, "repayment_id") + F.col("_n")).alias("repayment_id"),
        "emi_id", F.col("paid_amount").cast("decimal(12,2)").alias("paid_amount"),
        "payment_date", "payment_mode")
    return t.replace(emi_schedule=close_instalments(t.emi_schedule, payments)).append(
        repayment=rows)


def disbursed_rows(t: Tables, decisions: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """The rows approved applications add to each table, except the counters.

    ``decisions``: application_id (unique), customer_id, loan_type_id, loan_amount,
    interest_rate, tenure, credit_score, auto_approved, guarantor_name, guarantor_phone,
    relationship. They are computed once: numbering stores them. New keys are dense, in the order
    of application_id. One pass numbers all: a loan takes as many schedule keys as it has
    instalments, and one guarantor key if a guarantor is named.
    """
    name = blank_to_null(F.col("guarantor_name"))
    ok = numbered_at_once(decisions.where("auto_approved"), ["application_id"], {
        "_n": F.lit(1), "_emi": F.greatest(F.col("tenure").cast("int"), F.lit(0)),
        "_g": F.when(name.isNotNull(), 1).otherwise(0)}).withColumn(
        "loan_id", first_free(t.loan, "loan_id") + F.col("_n"))
    today = day(as_of)
    terms = ok.select(
        "loan_id", "customer_id", "loan_type_id",
        F.col("loan_amount").cast("decimal(14,2)").alias("loan_amount"),
        F.col("interest_rate").cast("decimal(5,2)").alias("interest_rate"),
        F.col("tenure").cast("int").alias("tenure"), F.lit("Active").alias("current_status"),
        today.alias("disbursed_date"),
        (first_free(t.emi_schedule, "emi_id") + F.col("_emi")).alias("_first"))
    loan = terms.drop("_first")
    steps = F.inline(F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(label).alias("status_label"))
        for k, label in enumerate(("Approved", "Active"))]))
    last_step = first_free(t.loan_status_history, "status_history_id")
    history = (ok.select("loan_id", "_n", steps)
               .select((last_step + F.col("_n") * 2 + F.col("k"))
                       .alias("status_history_id"),
                       "loan_id", "status_label", today.alias("change_date")))
    schedule = emi_schedule_generate(terms, "day28", start=today, first="_first")
    guarantor = ok.where(name.isNotNull()).select(
        (first_free(t.guarantor, "guarantor_id") + F.col("_g")).alias("guarantor_id"),
        "loan_id", name.alias("name"), blank_to_null(F.col("guarantor_phone")).alias("phone"),
        F.nullif("relationship", F.lit("")).alias("relationship"))
    scores = assign_risk_band(ok.select(
        (first_free(t.credit_score, "score_id") + F.col("_n")).alias("score_id"),
        "customer_id", F.col("credit_score").cast("int").alias("score_value"),
        today.alias("score_date")), t.risk_category)
    return {"loan": loan, "loan_status_history": history, "emi_schedule": schedule,
            "guarantor": guarantor, "credit_score": scores.select(*column_names("credit_score"))}


def count_new_loans(history: DataFrame, loans: DataFrame, as_of: str) -> DataFrame:
    """Raise each customer's loan counter by the loans added."""
    added = loans.groupBy("customer_id").agg(F.count("*").cast("int").alias("_added"))
    touched = F.col("_added").isNotNull()
    return history.join(added, "customer_id", "left").select(
        "history_id", "customer_id",
        F.when(touched, (F.col("total_loans") + F.col("_added")).cast("int"))
        .otherwise(F.col("total_loans")).alias("total_loans"),
        "total_defaults",
        F.when(touched, day(as_of)).otherwise(F.col("last_updated")).alias("last_updated"))


def disburse_loans(t: Tables, decisions: DataFrame, as_of: str) -> Tables:
    """Turn approved applications into loans with log, schedule, guarantor and score."""
    rows = disbursed_rows(t, decisions, as_of)
    return t.append(**rows).replace(
        credit_history=count_new_loans(t.credit_history, rows["loan"], as_of))
