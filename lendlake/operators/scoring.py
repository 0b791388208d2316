"""Credit scoring without a trained model: features, scorecards, decision texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlake.functions.columns import employment_code
from lendlake.functions.latest import first_rows
from lendlake.schema import SCORE_RANGE
from lendlake.sources.tables import Tables

# What the scoring form assumes where a customer record has gaps.
FALLBACK_EMPLOYMENT, FALLBACK_INCOME = "Salaried", 50_000

# The scorecard. A base, then weight times a share of each feature.
SCORE_BASE = 350.0
SCORE_WEIGHTS = {"income": 200.0, "employment": 80.0, "record": 200.0, "amount": -50.0}
INCOME_SCALE, EMPLOYMENT_SCALE, AMOUNT_SCALE = 300_000.0, 4.0, 5_000_000.0
POINTS_PER_DEFAULT = -30.0
LOW_RISK_FROM, MEDIUM_RISK_FROM = 751, 601

# The default scorecard and the score above which a default is expected.
DEFAULT_BASE = 0.05
DEFAULT_WEIGHTS = {"default_rate": 0.3, "overdue": 0.2, "score_gap": 0.15, "rate": 0.1,
                   "loans": 0.05}
OVERDUE_SCALE, SCORE_SCALE, RATE_SCALE, LOANS_SCALE = 200.0, 900.0, 18.0, 8.0
DEFAULT_ABOVE = 0.4

UNKNOWN_CUSTOMER = "unknown customer"

# Approval and confidence limits.
APPROVAL_SCORE, APPROVAL_PROBABILITY = 600, 0.4
CONFIDENCE_STEPS = ((0.75, "Very High"), (0.55, "High"), (0.35, "Moderate"))
LOWEST_CONFIDENCE = "Low"


def loans_as_applications(t: Tables) -> DataFrame:
    """The terms of every loan, to be assessed again as applications."""
    return t.loan.select(
        F.col("loan_id").alias("application_id"), "customer_id", "loan_type_id", "loan_amount",
        "tenure", "interest_rate")


def _customer_details(t: Tables) -> DataFrame:
    """One row per customer: income, employment and counters, with the form's defaults.

    Should a customer have several detail rows, the one with the lowest key counts.
    """
    income = first_rows(t.income_details, "customer_id", "income_id").select(
        "customer_id", F.col("monthly_income").alias("_income"),
        F.col("employment_type").alias("_employment"))
    counters = first_rows(t.credit_history, "customer_id", "history_id").select(
        "customer_id", F.col("total_loans").alias("_loans"),
        F.col("total_defaults").alias("_defaults"))
    employment = F.coalesce(F.nullif("_employment", F.lit("")), F.lit(FALLBACK_EMPLOYMENT))
    monthly = F.nullif(F.col("_income"), F.lit(0).cast("decimal(12,2)"))
    return (t.customer.select("customer_id").join(income, "customer_id", "left")
            .join(counters, "customer_id", "left").select(
                "customer_id",
                F.coalesce(monthly, F.lit(FALLBACK_INCOME)).cast("double")
                .alias("monthly_income"),
                employment.alias("employment_type"),
                employment_code(employment).alias("employment_enc"),
                F.coalesce("_loans", F.lit(0)).alias("total_loans"),
                F.coalesce("_defaults", F.lit(0)).alias("total_defaults")))


def _with_details(applications: DataFrame, details: DataFrame) -> DataFrame:
    """Every application with its customer's details; ``problem`` tells why it has none.

    A customer may have very many applications. Adaptive execution splits an oversized partition
    only where both sides of the join come straight from a shuffle, but the details are already
    partitioned by customer from the joins that made them. The second key, a function of the
    first, makes Spark shuffle them once more; they are the small side.
    """
    terms = applications.select(
        "application_id", "customer_id", F.col("loan_amount").cast("double").alias("loan_amount"),
        F.col("tenure").cast("int").alias("tenure"),
        F.col("interest_rate").cast("double").alias("interest_rate"),
        *(["loan_type_id"] if "loan_type_id" in applications.columns else []))
    part = F.pmod(F.col("customer_id"), F.lit(1024)).alias("_part")
    known = details.select("*", part, F.lit(True).alias("_known"))
    return (terms.select("*", part).join(known, ["customer_id", "_part"], "left")
            .withColumn("problem", F.when(F.col("_known").isNull(), UNKNOWN_CUSTOMER))
            .drop("_part", "_known"))


def application_features(t: Tables, applications: DataFrame) -> DataFrame:
    """Applications with income, employment and counters of the customer. A missing or zero
    income and a missing or empty employment take the form's defaults. An application of a customer
    who is not on record stays, without features, and says so in ``problem``."""
    return _with_details(applications, _customer_details(t))


def whole_score(value: Column) -> Column:
    """Limit to the score range and drop the fraction."""
    low, high = SCORE_RANGE
    inside = F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))).cast("int")
    return F.when(value.isNotNull(), inside)


def default_rate() -> Column:
    return F.col("total_defaults") / (F.col("total_loans") + 1)


def rule_credit_score() -> Column:
    """The scorecard over feature columns."""
    shares = {
        "income": F.col("monthly_income") / INCOME_SCALE,
        "employment": F.col("employment_enc") / EMPLOYMENT_SCALE,
        "record": F.lit(1.0) - default_rate(),
        "amount": F.col("loan_amount") / AMOUNT_SCALE,
    }
    total = F.lit(SCORE_BASE)
    for name, share in shares.items():
        total = total + share * SCORE_WEIGHTS[name]
    return whole_score(total + F.col("total_defaults") * POINTS_PER_DEFAULT)


def rule_risk_level(score: Column) -> Column:
    return (F.when(score >= LOW_RISK_FROM, "Low").when(score >= MEDIUM_RISK_FROM, "Medium")
            .when(score.isNotNull(), "High"))


def rule_default_score(score: Column, overdue_days: Column) -> Column:
    """The weighted sum behind the default flag."""
    shares = {
        "default_rate": default_rate(),
        "overdue": overdue_days / OVERDUE_SCALE,
        "score_gap": F.lit(1.0) - score / SCORE_SCALE,
        "rate": F.col("interest_rate") / RATE_SCALE,
        "loans": F.col("total_loans") / LOANS_SCALE,
    }
    total = F.lit(DEFAULT_BASE)
    for name, share in shares.items():
        total = total + share * DEFAULT_WEIGHTS[name]
    return total


def days_overdue_by_customer(t: Tables) -> DataFrame:
    """The longest recorded delay of each customer."""
    per_loan = t.default_record.groupBy("loan_id").agg(F.max("overdue_days").alias("days"))
    return (per_loan.join(t.loan.select("loan_id", "customer_id"), "loan_id")
            .groupBy("customer_id").agg(F.max("days").alias("overdue_days")))


def scorecard(t: Tables, applications: DataFrame) -> DataFrame:
    """Features with the rule-based score, level, default score and flag."""
    details = (_customer_details(t)
               .join(days_overdue_by_customer(t), "customer_id", "left")
               .fillna(0, ["overdue_days"]))
    rows = _with_details(applications, details).withColumn("score_value", rule_credit_score())
    score = F.col("score_value")
    return (rows.withColumn("risk_level", rule_risk_level(score))
            .withColumn("default_score", rule_default_score(score, F.col("overdue_days")))
            .withColumn("will_default", (F.col("default_score") > DEFAULT_ABOVE).cast("int")))


def confidence(probability: Column) -> Column:
    label = F.lit(LOWEST_CONFIDENCE)
    for limit, name in reversed(CONFIDENCE_STEPS):
        label = F.when(probability > limit, name).otherwise(label)
    return label


def approved(score: Column, probability: Column) -> Column:
    return (score > APPROVAL_SCORE) & (probability < APPROVAL_PROBABILITY)


def decision_reasons(score: Column, probability: Column) -> Column:
    """Why an application fails, as one sentence; empty when it passes."""
    percent = F.bround(probability.cast("decimal(10,4)") * 100, 1).cast("string")
    low_score = F.concat(F.lit("credit score "), score.cast("string"),
                         F.lit(f" is below {APPROVAL_SCORE}"))
    high_risk = F.concat(F.lit("default probability "), percent, F.lit("% exceeds 40%"))
    text = F.concat_ws("; ", F.when(score <= APPROVAL_SCORE, low_score),
                       F.when(probability >= APPROVAL_PROBABILITY, high_risk))
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, F.lit(2), F.length(text)))
