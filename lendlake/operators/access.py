"""Look-ups and dashboard queries: directories, ledgers, work lists, indicators.

Where a reference query serves one id, the id is an optional argument: given, it becomes a filter
that reaches the scan; left out, the same query covers every customer or loan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlake.functions.columns import mean_of, month_start, month_text
from lendlake.functions.latest import newest_scores
from lendlake.functions.ordering import report
from lendlake.schema import KEY, SCORE_RANGE, TABLES
from lendlake.sources.tables import Tables


def _only(df: DataFrame, column: str, value: int | None) -> DataFrame:
    return df if value is None else df.where(F.col(column) == value)


def _in_order(df: DataFrame, value: int | None, *columns: Column | str) -> DataFrame:
    """Sorted for one id; the rows of all ids stay where they are, a sort of the whole table
    would serve nobody."""
    return df if value is None else df.orderBy(*columns)


# The tables the administration page counts.
MAIN_TABLES = ("customer", "loan", "emi_schedule", "repayment", "default_record", "penalty")


def table_row_counts(t: Tables, names: tuple[str, ...] = TABLES) -> DataFrame:
    """Rows of each table; ``MAIN_TABLES`` gives the short form."""
    counts = [t[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
              for name in names]
    return reduce(DataFrame.unionByName, counts)


def preview_table(t: Tables, name: str, n: int = 20) -> DataFrame:
    """The first rows of a table by key."""
    return t[name].orderBy(KEY[name]).limit(n)


def risk_categories(t: Tables) -> DataFrame:
    return t.risk_category.orderBy(F.desc("min_score"), "risk_id")


def loan_types(t: Tables) -> DataFrame:
    return t.loan_type.orderBy("loan_type_id")


def _contacts(t: Tables, customer_id: int | None) -> DataFrame:
    return _only(t.customer, "customer_id", customer_id).drop("created_at").join(
        t.income_details.drop("income_id"), "customer_id", "left")


@report("customer_id")
def customer_directory(t: Tables) -> DataFrame:
    """Every customer with income and address."""
    address = t.address_details.select("customer_id", "city", "zip_code")
    return (_contacts(t, None).join(address, "customer_id", "left")
            .select("customer_id", "name", "phone", "email", "dob", "monthly_income",
                    "employment_type", "company_name", "city", "zip_code"))


def customer_profile(t: Tables, customer_id: int | None = None) -> DataFrame:
    """Directory entry with street and the loan and default counters."""
    counters = t.credit_history.select("customer_id", "total_loans", "total_defaults")
    return (_contacts(t, customer_id)
            .join(t.address_details.drop("address_id"), "customer_id", "left")
            .join(counters, "customer_id", "left")
            .select("customer_id", "name", "phone", "email", "dob", "monthly_income",
                    "employment_type", "company_name", "street", "city", "zip_code",
                    "total_loans", "total_defaults"))


def customer_search(t: Tables, pattern: str) -> DataFrame:
    """Directory entries whose name, city or email matches a regular expression, any case."""
    def found(column: str):
        return F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False))
    return customer_directory(t).where(found("name") | found("city") | found("email"))


def _banded_scores(t: Tables, customer_id: int | None = None) -> DataFrame:
    return _only(t.credit_score, "customer_id", customer_id).join(
        t.risk_category.select("risk_id", "risk_level"), "risk_id")


def score_history(t: Tables, customer_id: int | None = None) -> DataFrame:
    """Banded scores by date."""
    scores = _banded_scores(t, customer_id).select(
        "customer_id", "score_id", "score_date", "score_value", "risk_level")
    return _in_order(scores, customer_id, F.asc_nulls_last("score_date"), "score_id")


def latest_score(t: Tables, customer_id: int | None = None) -> DataFrame:
    """The newest banded score per customer; on one date the higher score_id counts."""
    banded = _only(t.credit_score, "customer_id", customer_id).join(
        t.risk_category.select("risk_id"), "risk_id", "left_semi")
    return (newest_scores(banded)
            .join(t.risk_category.select("risk_id", "risk_level"), "risk_id")
            .select("customer_id", "score_value", "score_date", "risk_level"))


def latest_score_all_ties(t: Tables) -> DataFrame:
    """All banded scores on the customer's newest score date."""
    newest = t.credit_score.groupBy("customer_id").agg(F.max("score_date").alias("score_date"))
    return (_banded_scores(t).join(newest, ["customer_id", "score_date"])
            .select("customer_id", "score_id", "score_value", "risk_level"))


@report("bin_start", "risk_level")
def score_histogram(t: Tables, bins: int = 20) -> DataFrame:
    """Newest scores counted in equal bins over the score range, by level."""
    low, high = SCORE_RANGE
    width = high - low
    if not 1 <= bins <= width:
        raise ValueError(f"bins must be 1 to {width}")
    number = F.least(F.floor((F.col("score_value") - low) * bins / width), F.lit(bins - 1))
    # The first whole score of the bin.
    return (latest_score_all_ties(t)
            .groupBy((F.ceil(number * width / bins) + low).alias("bin_start"), "risk_level")
            .agg(F.count("*").alias("n")))


def _typed_loans(t: Tables, loans: DataFrame) -> DataFrame:
    return loans.join(t.loan_type.select("loan_type_id", "type_name"), "loan_type_id")


LOAN_TERMS = ("loan_amount", "interest_rate", "tenure", "current_status", "disbursed_date")


def customer_loans(t: Tables, customer_id: int | None = None) -> DataFrame:
    """Loans with their type."""
    loans = _typed_loans(t, _only(t.loan, "customer_id", customer_id)).select(
        "customer_id", "loan_id", "type_name", *LOAN_TERMS)
    return _in_order(loans, customer_id, "loan_id")


@report("loan_id")
def all_loans(t: Tables) -> DataFrame:
    """Loans with customer name and type."""
    names = t.customer.select("customer_id", F.col("name").alias("customer_name"))
    return (_typed_loans(t, t.loan).join(names, "customer_id")
            .select("loan_id", "customer_name", "type_name", *LOAN_TERMS))


def recent_loans(t: Tables, n: int = 10) -> DataFrame:
    """The n highest loan ids. Every loan has a customer and a type, so the limit comes first
    and only n rows are joined."""
    newest = t.loan.orderBy(F.desc("loan_id")).limit(n)
    return (t.customer.select("customer_id", F.col("name").alias("customer"))
            .join(newest, "customer_id")
            .join(t.loan_type.select("loan_type_id", F.col("type_name").alias("type")),
                  "loan_type_id")
            .select("loan_id", "customer", "type", *LOAN_TERMS).orderBy(F.desc("loan_id")))


def emi_ledger(t: Tables, loan_id: int | None = None) -> DataFrame:
    """Instalments with their payments; 0 where nothing was paid."""
    paid = t.repayment.select("repayment_id", "emi_id", "paid_amount", "payment_date",
                              "payment_mode")
    rows = _only(t.emi_schedule, "loan_id", loan_id).join(paid, "emi_id", "left").select(
        "loan_id", "emi_id", "due_date", "emi_amount", "status",
        F.coalesce("paid_amount", F.lit(0)).cast("decimal(12,2)").alias("paid_amount"),
        "payment_date", "payment_mode", "repayment_id")
    return _in_order(rows, loan_id, "due_date", "emi_id", "repayment_id").drop("repayment_id")


def overdue_emis(t: Tables, loan_id: int | None = None) -> DataFrame:
    """Overdue instalments by due date."""
    late = (_only(t.emi_schedule, "loan_id", loan_id).where(F.col("status") == "Overdue")
            .select("loan_id", "emi_id", "due_date", "emi_amount"))
    return _in_order(late, loan_id, "due_date", "emi_id")


def payable_emis(t: Tables, loan_id: int | None = None) -> DataFrame:
    """Ledger rows still to be paid."""
    return emi_ledger(t, loan_id).where(F.col("status").isin("Pending", "Overdue"))


def overdue_worklist(t: Tables, as_of: str, n: int = 20) -> DataFrame:
    """The n oldest overdue instalments with customer, type and days overdue."""
    oldest = (t.emi_schedule.where(F.col("status") == "Overdue")
              .orderBy("due_date", "emi_id").limit(n))
    loans = t.loan.select("loan_id", "customer_id", "loan_type_id").join(oldest, "loan_id")
    return (t.customer.select("customer_id", F.col("name").alias("customer"))
            .join(loans, "customer_id")
            .join(t.loan_type.select("loan_type_id", "type_name"), "loan_type_id")
            .select("emi_id", "customer", "loan_id", "type_name", "due_date", "emi_amount",
                    F.datediff(F.lit(as_of).cast("date"), "due_date").alias("days_overdue"))
            .orderBy("due_date", "emi_id"))


def repayment_progress(t: Tables) -> DataFrame:
    """Ledger rows of every loan by status and the paid fraction, 0 without instalments.

    The counts follow the ledger: an instalment paid in two parts is two rows of it.
    """
    payments = t.repayment.groupBy("emi_id").agg(F.count("*").alias("payments"))
    rows = F.coalesce("payments", F.lit(1))
    status = F.col("status")
    per_loan = (t.emi_schedule.select("emi_id", "loan_id", "status")
                .join(payments, "emi_id", "left")
                .groupBy("loan_id").agg(
                    F.sum(F.when(status == "Paid", rows).otherwise(0)).alias("paid"),
                    F.sum(F.when(status == "Overdue", rows).otherwise(0)).alias("overdue"),
                    F.sum(F.when(status == "Pending", rows).otherwise(0)).alias("pending"),
                    F.sum(rows).alias("total")))
    fraction = F.when(F.col("total") > 0, F.col("paid") / F.col("total")).otherwise(F.lit(0.0))
    return (t.loan.select("loan_id").join(per_loan, "loan_id", "left")
            .fillna(0, ["paid", "overdue", "pending", "total"])
            .select("loan_id", "paid", "overdue", "pending", "total",
                    fraction.alias("paid_fraction")))


def loan_penalty_total(t: Tables) -> DataFrame:
    """Penalties of every loan, 0 if none."""
    charged = (t.default_record.select("default_id", "loan_id")
               .join(t.penalty.select("default_id", "penalty_amount"), "default_id")
               .groupBy("loan_id").agg(F.sum("penalty_amount").alias("penalty_total")))
    return t.loan.select("loan_id").join(charged, "loan_id", "left").select(
        "loan_id", F.coalesce("penalty_total", F.lit(0)).alias("penalty_total"))


def portfolio_kpis(t: Tables) -> DataFrame:
    """Customers, active loans, defaulted loans and penalties in one row.

    Four one-row aggregates are stacked and summed, so no join is needed to line them up.
    """
    def indicator(df: DataFrame, name: str, value) -> DataFrame:
        one = df.agg(value.cast("decimal(38,2)").alias("value"))
        return one.select(F.lit(name).alias("name"), "value")

    parts = reduce(DataFrame.unionByName, [
        indicator(t.customer, "customers", F.count("*")),
        indicator(t.loan.where(F.col("current_status") == "Active"), "active", F.count("*")),
        indicator(t.default_record, "defaulters", F.count_distinct("loan_id")),
        indicator(t.penalty, "penalties", F.sum("penalty_amount")),
    ])

    def pick(name: str):
        return F.coalesce(F.sum(F.when(F.col("name") == name, F.col("value"))), F.lit(0))

    return parts.agg(
        pick("customers").cast("bigint").alias("total_customers"),
        pick("active").cast("bigint").alias("active_loans"),
        pick("defaulters").cast("bigint").alias("defaulters"),
        pick("penalties").cast("decimal(38,2)").alias("penalties_collected"))


@report("loan_count desc", "risk_level")
def loans_by_risk(t: Tables) -> DataFrame:
    """Loans and their sum by the level of the customer's newest score, 'Unknown' without one."""
    per_customer = t.loan.groupBy("customer_id").agg(
        F.count("*").alias("loans"), F.sum("loan_amount").alias("amount"))
    return (per_customer
            .join(newest_scores(t.credit_score).select("customer_id", "risk_id"),
                  "customer_id", "left")
            .join(t.risk_category.select("risk_id", "risk_level"), "risk_id", "left")
            .groupBy("risk_level").agg(
                F.sum("loans").alias("loan_count"), F.sum("amount").alias("total_amount"))
            .select(F.coalesce("risk_level", F.lit("Unknown")).alias("risk_level"),
                    "loan_count", "total_amount"))


def _repayment_months(t: Tables) -> DataFrame:
    return t.repayment.groupBy(month_start("payment_date").alias("_month")).agg(
        F.sum("paid_amount").alias("total_collected"),
        F.count("repayment_id").alias("payment_count"))


@report("month")
def monthly_repayments(t: Tables) -> DataFrame:
    """Collected sum and payments by month."""
    return _repayment_months(t).select(
        month_text("_month").alias("month"), "total_collected", "payment_count",
    )


@report("month")
def monthly_repayments_rolling(t: Tables) -> DataFrame:
    """With the mean of up to three months. The window runs over one row per month."""
    last_three = Window.orderBy(F.asc_nulls_last("_month")).rowsBetween(-2, 0)
    mean = mean_of(F.sum("total_collected").over(last_three),
                   F.count("total_collected").over(last_three))
    return _repayment_months(t).select(
        month_text("_month").alias("month"), "total_collected", "payment_count",
        mean.alias("rolling_avg"))


DEFAULTER_SORTS = ("overdue_days", "penalty_amount", "loan_amount")


def defaulters_table(t: Tables, sort: str = "overdue_days") -> DataFrame:
    """One row per default, or per penalty of it, with customer and loan."""
    if sort not in DEFAULTER_SORTS:
        raise ValueError(f"sort must be one of {', '.join(DEFAULTER_SORTS)}, not {sort!r}")
    charged = t.default_record.join(
        t.penalty.select("default_id", "penalty_id", "penalty_amount"), "default_id", "left")
    loans = t.loan.select("loan_id", "customer_id", "loan_type_id", "loan_amount")
    rows = (_typed_loans(t, charged.join(loans, "loan_id"))
            .join(t.customer.select("customer_id", "name", "phone"), "customer_id"))
    return rows.select(
        "customer_id", "name", "phone", "loan_id", F.col("type_name").alias("loan_type"),
        "loan_amount", "default_date", "overdue_days",
        F.coalesce("penalty_amount", F.lit(0)).alias("penalty_amount"),
        "default_id", "penalty_id",
    ).orderBy(F.desc_nulls_first(sort), "default_id", "penalty_id").drop("default_id", "penalty_id")


def loan_status_breakdown(t: Tables) -> DataFrame:
    return t.loan.groupBy("current_status").agg(F.count("*").alias("count"))
