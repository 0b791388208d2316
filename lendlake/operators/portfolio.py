"""The lender's portfolio reports.

Rules followed throughout: detail rows are aggregated to their parent before any join, so a join
never multiplies amounts and a large key is combined map-side; every sort ends in a unique column,
so equal leading values can still be spread over several sort partitions; small catalogue tables
carry no broadcast hint, their size decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlake.functions.columns import (
    MONTHS_PER_YEAR,
    count_if,
    exact_ratio,
    mean_of,
    month_start,
    month_text,
    percentage,
    sum_if,
)
from lendlake.functions.latest import newest_scores
from lendlake.functions.ordering import report
from lendlake.functions.ranking import dense_ranks_of_counts, ranks_descending
from lendlake.functions.sequences import look_back
from lendlake.sources.tables import Tables


def penalties_by_default(t: Tables) -> DataFrame:
    return t.penalty.groupBy("default_id").agg(
        F.sum("penalty_amount").alias("penalty_sum"), F.count("*").alias("penalty_rows"))


def _with_customer(t: Tables, loan_rows: DataFrame) -> DataFrame:
    """Replace loan_id by the loan's customer_id."""
    return loan_rows.join(t.loan.select("loan_id", "customer_id"), "loan_id")


@report("total_defaults desc", "total_overdue_days desc nulls first", "customer_id")
def top_defaulters(t: Tables) -> DataFrame:
    """Customers with defaults: how many, days overdue, penalties, newest score.

    As in the reference, a default's days count once for each of its penalties.
    """
    defaults = t.default_record.join(penalties_by_default(t), "default_id", "left")
    weight = F.greatest(F.coalesce("penalty_rows", F.lit(1)), F.lit(1))
    per_customer = _with_customer(t, defaults).groupBy("customer_id").agg(
        F.count("default_id").alias("total_defaults"),
        F.sum(F.col("overdue_days") * weight).alias("total_overdue_days"),
        F.sum("penalty_sum").alias("penalty_sum"))
    scores = newest_scores(t.credit_score).select(
        "customer_id", F.col("score_value").alias("latest_credit_score"))
    return (per_customer.join(t.customer.select("customer_id", "name", "phone"), "customer_id")
            .join(scores, "customer_id", "left")
            .select("customer_id", "name", "phone", "total_defaults", "total_overdue_days",
                    F.coalesce("penalty_sum", F.lit(0)).alias("total_penalty_paid"),
                    "latest_credit_score"))


@report("collection_month")
def monthly_collections_by_mode(t: Tables) -> DataFrame:
    """Payments by month: count, sum, mean, and the online and UPI parts (NULL if none)."""
    mode = F.col("payment_mode")
    months = t.repayment.groupBy(month_start("payment_date").alias("_month")).agg(
        F.count("repayment_id").alias("payments_count"),
        F.sum("paid_amount").alias("total_collected"),
        sum_if(mode == "Online", "paid_amount").alias("online_collected"),
        sum_if(mode == "UPI", "paid_amount").alias("upi_collected"))
    return months.select(
        month_text("_month").alias("collection_month"), "payments_count", "total_collected",
        mean_of(F.col("total_collected"), F.col("payments_count")).alias("avg_emi_paid"),
        "online_collected", "upi_collected",
    )


def _scores_in_sequence(t: Tables, blocks: int | None) -> DataFrame:
    """Banded scores with the mean of the last three and the change since the one before."""
    banded = t.credit_score.join(t.risk_category.select("risk_id", "risk_level"), "risk_id")
    value = F.col("score_value")
    return look_back(
        banded.select("customer_id", "score_id", "score_date", "score_value", "risk_level"),
        "customer_id", "score_date", "score_id",
        {"rolling_avg": lambda w: F.avg(value).over(w.rowsBetween(-2, 0)),
         "score_change": lambda w: value - F.lag(value).over(w)},
        reach=2, blocks=blocks)


@report("customer_id", "score_date", "score_id")
def score_trend(t: Tables, blocks: int | None = None) -> DataFrame:
    """Each banded score with its 3-row moving average, change and level."""
    named = _scores_in_sequence(t, blocks).join(
        t.customer.select("customer_id", "name"), "customer_id")
    return named.select(
        "customer_id", "score_id", "name", "score_date", "score_value",
        F.round("rolling_avg", 2).alias("rolling_avg_score"), "score_change", "risk_level",
    )


@report("customer_id", "score_date", "score_id")
def score_trend_raw(t: Tables, blocks: int | None = None) -> DataFrame:
    """The short form: unrounded average, no change or level; unbanded scores count too."""
    value = F.col("score_value")
    rolled = look_back(
        t.credit_score.select("customer_id", "score_id", "score_date", "score_value"),
        "customer_id", "score_date", "score_id",
        {"rolling_avg": lambda w: F.avg(value).over(w.rowsBetween(-2, 0))}, reach=2, blocks=blocks)
    return rolled.join(t.customer.select("customer_id", "name"), "customer_id").select(
        "customer_id", "score_id", "name", "score_date", "score_value", "rolling_avg",
    )


def _loans_by_type(t: Tables) -> DataFrame:
    status = F.col("current_status")
    per_type = t.loan.groupBy("loan_type_id").agg(
        F.count("*").alias("loans"),
        count_if(status == "Active").alias("active"),
        count_if(status == "Closed").alias("closed"),
        count_if(status == "Defaulted").alias("defaulted"),
        count_if(status != "Defaulted").alias("sound"),
        F.sum("loan_amount").alias("amount"),
        F.sum("interest_rate").alias("rate_sum"))
    counts = ["loans", "active", "closed", "defaulted", "sound"]
    return (t.loan_type.select("loan_type_id", "type_name")
            .join(per_type, "loan_type_id", "left").fillna(0, counts))


@report("total_disbursed desc nulls first", "type_name")
def loan_type_performance(t: Tables) -> DataFrame:
    """Loans by type and status, share not defaulted, mean and total amount; no type is dropped."""
    return _loans_by_type(t).select(
        "type_name", F.col("loans").alias("total_loans"), F.col("active").alias("active_loans"),
        F.col("closed").alias("closed_loans"), F.col("defaulted").alias("defaulted_loans"),
        percentage(F.col("sound"), F.col("loans")).alias("success_rate_pct"),
        F.round(mean_of(F.col("amount"), F.col("loans")), 2).alias("avg_loan_amount"),
        F.col("amount").alias("total_disbursed"),
    )


@report("total_exposure desc", "type_name")
def loan_type_exposure(t: Tables) -> DataFrame:
    """Loans, exposure (0 if none), mean rate and defaulted loans by type."""
    return _loans_by_type(t).select(
        "type_name", F.col("loans").alias("loan_count"),
        F.coalesce("amount", F.lit(0)).alias("total_exposure"),
        F.round(mean_of(F.col("rate_sum"), F.col("loans")), 2).alias("avg_rate"),
        F.col("defaulted").alias("defaults"),
    )


@report("total_disbursed desc", "type_name")
def portfolio_summary(t: Tables) -> DataFrame:
    """Loans, disbursed sum (NULL if none) and mean rate by type."""
    return _loans_by_type(t).select(
        "type_name", "loans", F.col("amount").alias("total_disbursed"),
        F.round(mean_of(F.col("rate_sum"), F.col("loans")), 2).alias("avg_rate"),
    )


def _eligible(t: Tables, min_score: int, min_income: int) -> DataFrame:
    """Customers above both limits without a default on record, with their newest score."""
    income = (t.income_details.where(F.col("monthly_income") > min_income)
              .select("customer_id", "monthly_income", "employment_type"))
    clean = (t.credit_history.where(F.col("total_defaults") == 0)
             .select("customer_id", "total_defaults"))
    scored = newest_scores(t.credit_score).where(F.col("score_value") > min_score)
    return (income.join(clean, "customer_id")
            .join(scored.select("customer_id", F.col("score_value").alias("credit_score"),
                                "risk_id"), "customer_id")
            .join(t.customer.select("customer_id", "name"), "customer_id"))


@report("credit_score desc", "customer_id")
def eligible_customers(t: Tables, min_score: int = 600, min_income: int = 30000) -> DataFrame:
    """Who may borrow again, with level and number of active loans."""
    active = (t.loan.where(F.col("current_status") == "Active")
              .groupBy("customer_id").agg(F.count("*").alias("active_loans")))
    rows = (_eligible(t, min_score, min_income)
            .join(active, "customer_id", "left")
            .join(t.risk_category.select("risk_id", "risk_level"), "risk_id"))
    shown = ["customer_id", "name", "monthly_income", "employment_type", "credit_score",
             "risk_level", "total_defaults"]
    return (rows.groupBy(*shown)
            .agg(F.sum(F.coalesce("active_loans", F.lit(0))).alias("active_loans")))


@report("score_value desc", "customer_id")
def eligible_simple(t: Tables, min_score: int = 600, min_income: int = 30000) -> DataFrame:
    """The short form without level and loan counts."""
    return _eligible(t, min_score, min_income).select(
        "customer_id", "name", "monthly_income", F.col("credit_score").alias("score_value"),
    )


@report("risk_level")
def risk_distribution(t: Tables) -> DataFrame:
    """Customers, loans, exposure and mean rate by the level of the newest score."""
    loans = t.loan.groupBy("customer_id").agg(
        F.count("*").alias("loans"), F.sum("loan_amount").alias("amount"),
        F.sum("interest_rate").alias("rate_sum"))
    holders = (newest_scores(t.credit_score).select("customer_id", "risk_id")
               .join(t.risk_category.select("risk_id", "risk_level"), "risk_id")
               .join(loans, "customer_id", "left"))
    levels = holders.groupBy("risk_level").agg(
        F.count("*").alias("customer_count"),
        F.coalesce(F.sum("loans"), F.lit(0)).alias("loan_count"),
        F.sum("amount").alias("total_exposure"), F.sum("rate_sum").alias("rate_sum"))
    return levels.select(
        "risk_level", "customer_count", "loan_count", "total_exposure",
        F.round(mean_of(F.col("rate_sum"), F.col("loan_count")), 2).alias("avg_interest_rate"),
    )


def instalment_counts(t: Tables) -> DataFrame:
    status = F.col("status")
    return t.emi_schedule.groupBy("loan_id").agg(
        F.count("*").alias("total_emis"),
        count_if(status == "Paid").alias("paid_emis"),
        count_if(status == "Overdue").alias("overdue_emis"),
        count_if(status == "Pending").alias("pending_emis"))


def loans_with_instalment_counts(t: Tables) -> DataFrame:
    counts = ["total_emis", "paid_emis", "overdue_emis", "pending_emis"]
    return t.loan.join(instalment_counts(t), "loan_id", "left").fillna(0, counts)


@report("repayment_pct", "loan_id")
def emi_status_summary(t: Tables) -> DataFrame:
    """Instalments of every loan by status and the paid share (NULL without instalments)."""
    rows = (loans_with_instalment_counts(t)
            .join(t.loan_type.select("loan_type_id", "type_name"), "loan_type_id")
            .join(t.customer.select("customer_id", "name"), "customer_id"))
    return rows.select(
        "loan_id", F.col("name").alias("customer_name"), F.col("type_name").alias("loan_type"),
        "loan_amount", "total_emis", "paid_emis", "overdue_emis", "pending_emis",
        percentage(F.col("paid_emis"), F.col("total_emis")).alias("repayment_pct"),
    )


def _penalised_customers(t: Tables) -> DataFrame:
    charged = t.default_record.select("default_id", "loan_id").join(
        penalties_by_default(t), "default_id")
    return _with_customer(t, charged).groupBy("customer_id").agg(
        F.count("default_id").alias("default_count"),
        F.sum("penalty_sum").alias("total_penalty"))


def _cents(amount: str) -> Column:
    return (F.col(amount) * 100).cast("bigint")


@report("penalty_rank", "customer_id")
def penalty_leaderboard(t: Tables) -> DataFrame:
    """Customers ranked by penalty sum, densely ranked by penalised defaults."""
    totals = _penalised_customers(t).withColumn("_cents", _cents("total_penalty"))
    return (totals.join(ranks_descending(totals, "_cents", rank="penalty_rank"), "_cents")
            .join(F.broadcast(dense_ranks_of_counts(totals, "default_count", "default_rank")),
                  "default_count")
            .join(t.customer.select("customer_id", "name"), "customer_id")
            .select("customer_id", "name", "default_count", "total_penalty", "penalty_rank",
                    "default_rank"))


@report("rank", "name")
def penalty_rank_by_name(t: Tables) -> DataFrame:
    """Penalty sum and rank by name alone: customers of the same name are one row."""
    totals = (_penalised_customers(t)
              .join(t.customer.select("customer_id", "name"), "customer_id")
              .groupBy("name").agg(F.sum("total_penalty").alias("total_penalty"))
              .withColumn("_cents", _cents("total_penalty")))
    return (totals.join(ranks_descending(totals, "_cents", rank="rank"), "_cents")
            .select("name", "total_penalty", "rank"))


def _income_capacity(t: Tables, borrowed: Column) -> DataFrame:
    per_loan = t.emi_schedule.groupBy("loan_id").agg(
        F.count("*").alias("emis"), F.sum("emi_amount").alias("emi_sum"))
    per_customer = (
        t.loan.where(F.col("current_status") == "Active")
        .select("loan_id", "customer_id", "loan_amount")
        .join(per_loan, "loan_id", "left")
        .groupBy("customer_id").agg(
            F.sum(borrowed).alias("borrowed"), F.sum("emis").alias("emis"),
            F.sum("emi_sum").alias("emi_sum")))
    shown = ["customer_id", "name", "monthly_income", "employment_type"]
    rows = (t.customer.select("customer_id", "name")
            .join(t.income_details.select("customer_id", "monthly_income", "employment_type"),
                  "customer_id")
            .join(per_customer, "customer_id", "left")
            .groupBy(*shown).agg(
                F.coalesce(F.sum("borrowed"), F.lit(0)).alias("total_borrowed"),
                mean_of(F.sum("emi_sum"), F.sum("emis")).alias("_avg")))
    average = F.coalesce("_avg", F.lit(0).cast("decimal(38,16)"))
    income = F.col("monthly_income")
    return rows.select(
        *shown, "total_borrowed",
        exact_ratio(F.col("total_borrowed"), income * MONTHS_PER_YEAR)
        .alias("loan_to_income_ratio"),
        average.alias("avg_emi"),
        F.round(average.cast("decimal(30,14)") * 100
                / F.nullif(income, F.lit(0).cast("decimal(12,2)")), 2)
        .alias("emi_to_income_pct"),
    )


@report("loan_to_income_ratio desc", "customer_id")
def income_capacity(t: Tables) -> DataFrame:
    """Borrowing against income, as the reference computes it: the amount of an active loan
    counts once for each of its instalments. ``income_capacity_exact`` counts it once."""
    times = F.greatest(F.coalesce("emis", F.lit(1)), F.lit(1))
    return _income_capacity(t, F.col("loan_amount") * times)


@report("loan_to_income_ratio desc", "customer_id")
def income_capacity_exact(t: Tables) -> DataFrame:
    """Borrowing against income with every active loan counted once."""
    return _income_capacity(t, F.col("loan_amount"))


def _paid_by_loan(t: Tables) -> DataFrame:
    """Repayments as (loan_id, _month, paid_amount)."""
    paid = t.repayment.select("emi_id", month_start("payment_date").alias("_month"),
                              "paid_amount")
    return paid.join(t.emi_schedule.select("emi_id", "loan_id"), "emi_id").drop("emi_id")


@report("name", "month", "customer_id", "loan_amount")
def cumulative_repayment(t: Tables) -> DataFrame:
    """Monthly repayments and the customer's running total, set against one loan amount.

    As in the reference, equal loan amounts of a customer are one row and the running total
    covers all the customer's loans. It depends on customer and month alone, so it is computed
    on one row per customer and month and joined back: no window holds more than the months.
    """
    by_loan = _paid_by_loan(t).groupBy("loan_id", "_month").agg(
        F.sum("paid_amount").alias("paid_amount"))
    monthly = (by_loan
               .join(t.loan.select("loan_id", "customer_id", "loan_amount"), "loan_id")
               .groupBy("customer_id", "loan_amount", "_month")
               .agg(F.sum("paid_amount").alias("monthly_repayment")))
    running = Window.partitionBy("customer_id").orderBy(F.asc_nulls_last("_month"))
    totals = (monthly.groupBy("customer_id", "_month")
              .agg(F.sum("monthly_repayment").alias("_paid"))
              .select("customer_id", F.col("_month").alias("_m"),
                      F.sum("_paid").over(running).alias("cumulative_repaid"))
              .withColumnRenamed("customer_id", "_c"))
    rows = (monthly.join(totals, (F.col("customer_id") == F.col("_c"))
                         & F.col("_month").eqNullSafe(F.col("_m")))
            .join(t.customer.select("customer_id", "name"), "customer_id"))
    return rows.select(
        "customer_id", "name", month_text("_month").alias("month"), "loan_amount",
        "monthly_repayment", "cumulative_repaid",
        (F.col("loan_amount") - F.col("cumulative_repaid")).alias("estimated_outstanding"),
    )


@report("name", "month", "customer_id", "loan_id")
def cumulative_repayment_by_loan(t: Tables) -> DataFrame:
    """Monthly repayments, running total and remainder of each single loan."""
    running = Window.partitionBy("loan_id").orderBy(F.asc_nulls_last("_month"))
    rows = (_paid_by_loan(t).groupBy("loan_id", "_month")
            .agg(F.sum("paid_amount").alias("paid"))
            .withColumn("cumulative_repaid", F.sum("paid").over(running))
            .join(t.loan.select("loan_id", "customer_id", "loan_amount"), "loan_id")
            .join(t.customer.select("customer_id", "name"), "customer_id"))
    return rows.select(
        "customer_id", "name", "loan_id", month_text("_month").alias("month"), "loan_amount",
        F.col("paid").alias("monthly_repayment"), "cumulative_repaid",
        (F.col("loan_amount") - F.col("cumulative_repaid")).alias("outstanding"),
    )


@report("defaults desc", "customer_id")
def top_defaulters_simple(t: Tables) -> DataFrame:
    """The short form: defaults and days overdue only, each default counted once."""
    per_customer = _with_customer(
        t, t.default_record.select("default_id", "loan_id", "overdue_days"),
    ).groupBy("customer_id").agg(
        F.count("default_id").alias("defaults"), F.sum("overdue_days").alias("total_overdue"))
    return (per_customer.join(t.customer.select("customer_id", "name"), "customer_id")
            .select("customer_id", "name", "defaults", "total_overdue"))


@report("month")
def collections_simple(t: Tables) -> DataFrame:
    """The short form: collected sum by month."""
    return (t.repayment.groupBy(month_start("payment_date").alias("_month"))
            .agg(F.sum("paid_amount").alias("total"))
            .select(month_text("_month").alias("month"), "total"))
