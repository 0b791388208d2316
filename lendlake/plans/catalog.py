"""The named queries: what each one runs and the columns it returns.

``COLUMNS`` fixes names and kinds of every result, for Spark and for the SQL counterpart alike.
Money and ratios leave as doubles rounded to 2 and 6 digits and dates as ISO text, so that results
of different engines can be compared value by value; inside the library they stay decimals and
dates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlake.functions.bands import assign_risk_band
from lendlake.functions.workspace import new_folder, stored
from lendlake.operators import access, lifecycle, maintenance, models, portfolio, scoring
from lendlake.schema import COLUMNS as TABLE_COLUMNS
from lendlake.schema import TABLES
from lendlake.session import SETTINGS
from lendlake.sources import exports, star
from lendlake.sources.sql import read_query
from lendlake.sources.star import tables_from_star
from lendlake.sources.tables import CSV_READ, Tables, load_published, load_tables, publish_tables
from lendlake.streaming import payments as streams

AS_OF = "2000-01-01"
CUTOFF = "1996-01-01"
SEARCH_PATTERN = "nation_1[0-9]|customer#0+7"

# Kinds: b bigint, i int, s text, d date, m money, r ratio, f double, q double to 4 digits,
# t true/false.
COLUMNS: dict[str, str] = {
    # catalogue and look-ups
    "table_row_counts": "table_name s, n b",
    "load_tables": "table_name s, version b, n b, digest b",
    "preview_table": "loan_id b, customer_id b, loan_type_id b, loan_amount m, interest_rate m, "
                     "tenure i, current_status s, disbursed_date d",
    "read_query": "employment_type s, loans b, amount m",
    "export_table": "loan_id b, customer_id b, loan_type_id b, loan_amount m, interest_rate m, "
                    "tenure i, current_status s, disbursed_date d",
    "export_all_tables": "table_name s, n b, changed b",
    "export_query_csv": "month s, total_collected m, payment_count b",
    # portfolio reports
    "top_defaulters": "customer_id b, name s, phone s, total_defaults b, total_overdue_days b, "
                      "total_penalty_paid m, latest_credit_score i",
    "monthly_collections_by_mode": "collection_month s, payments_count b, total_collected m, "
                                   "avg_emi_paid r, online_collected m, upi_collected m",
    "score_trend": "customer_id b, score_id b, name s, score_date d, score_value i, "
                   "rolling_avg_score m, score_change i, risk_level s",
    "loan_type_performance": "type_name s, total_loans b, active_loans b, closed_loans b, "
                             "defaulted_loans b, success_rate_pct m, avg_loan_amount m, "
                             "total_disbursed m",
    "eligible_customers": "customer_id b, name s, monthly_income m, employment_type s, "
                          "credit_score i, risk_level s, total_defaults i, active_loans b",
    "risk_distribution": "risk_level s, customer_count b, loan_count b, total_exposure m, "
                         "avg_interest_rate m",
    "emi_status_summary": "loan_id b, customer_name s, loan_type s, loan_amount m, total_emis b, "
                          "paid_emis b, overdue_emis b, pending_emis b, repayment_pct m",
    "penalty_leaderboard": "customer_id b, name s, default_count b, total_penalty m, "
                           "penalty_rank b, default_rank b",
    "income_capacity": "customer_id b, name s, monthly_income m, employment_type s, "
                       "total_borrowed m, loan_to_income_ratio r, avg_emi r, emi_to_income_pct m",
    "income_capacity_exact": "customer_id b, name s, monthly_income m, employment_type s, "
                             "total_borrowed m, loan_to_income_ratio r, avg_emi r, "
                             "emi_to_income_pct m",
    "cumulative_repayment": "customer_id b, name s, month s, loan_amount m, monthly_repayment m, "
                            "cumulative_repaid m, estimated_outstanding m",
    "cumulative_repayment_by_loan": "customer_id b, name s, loan_id b, month s, loan_amount m, "
                                    "monthly_repayment m, cumulative_repaid m, outstanding m",
    # access layer and pages
    "customer_directory": "customer_id b, name s, phone s, email s, dob d, monthly_income m, "
                          "employment_type s, company_name s, city s, zip_code s",
    "customer_profile": "customer_id b, name s, phone s, email s, dob d, monthly_income m, "
                        "employment_type s, company_name s, street s, city s, zip_code s, "
                        "total_loans i, total_defaults i",
    "customer_search": "customer_id b, name s, phone s, email s, dob d, monthly_income m, "
                       "employment_type s, company_name s, city s, zip_code s",
    "score_history": "customer_id b, score_id b, score_date d, score_value i, risk_level s",
    "latest_score": "customer_id b, score_value i, score_date d, risk_level s",
    "latest_score_all_ties": "customer_id b, score_id b, score_value i, risk_level s",
    "score_histogram": "bin_start b, risk_level s, n b",
    "customer_loans": "customer_id b, loan_id b, type_name s, loan_amount m, interest_rate m, "
                      "tenure i, current_status s, disbursed_date d",
    "all_loans": "loan_id b, customer_name s, type_name s, loan_amount m, interest_rate m, "
                 "tenure i, current_status s, disbursed_date d",
    "recent_loans": "loan_id b, customer s, type s, loan_amount m, interest_rate m, tenure i, "
                    "current_status s, disbursed_date d",
    "emi_ledger": "loan_id b, emi_id b, due_date d, emi_amount m, status s, paid_amount m, "
                  "payment_date d, payment_mode s",
    "overdue_emis": "loan_id b, emi_id b, due_date d, emi_amount m",
    "payable_emis": "loan_id b, emi_id b, due_date d, emi_amount m, status s, paid_amount m, "
                    "payment_date d, payment_mode s",
    "overdue_worklist": "emi_id b, customer s, loan_id b, type_name s, due_date d, emi_amount m, "
                        "days_overdue i",
    "repayment_progress": "loan_id b, paid b, overdue b, pending b, total b, paid_fraction f",
    "loan_penalty_total": "loan_id b, penalty_total m",
    "portfolio_kpis": "total_customers b, active_loans b, defaulters b, penalties_collected m",
    "loans_by_risk": "risk_level s, loan_count b, total_amount m",
    "monthly_repayments": "month s, total_collected m, payment_count b",
    "monthly_repayments_rolling": "month s, total_collected m, payment_count b, rolling_avg r",
    "defaulters_table": "customer_id b, name s, phone s, loan_id b, loan_type s, loan_amount m, "
                        "default_date d, overdue_days i, penalty_amount m",
    "loan_status_breakdown": "current_status s, count b",
    "loan_type_exposure": "type_name s, loan_count b, total_exposure m, avg_rate m, defaults b",
    "portfolio_summary": "type_name s, loans b, total_disbursed m, avg_rate m",
    "penalty_rank_by_name": "name s, total_penalty m, rank b",
    "top_defaulters_simple": "customer_id b, name s, defaults b, total_overdue b",
    "collections_simple": "month s, total m",
    "score_trend_raw": "customer_id b, score_id b, name s, score_date d, score_value i, "
                       "rolling_avg r",
    "eligible_simple": "customer_id b, name s, monthly_income m, score_value i",
    # lifecycle
    "emi_quote": "loan_id b, loan_amount m, interest_rate m, tenure i, emi m, total_payable m, "
                 "total_interest m",
    "emi_schedule_generate": "emi_id b, loan_id b, due_date d, emi_amount m, status s",
    "emi_schedule_backfill": "emi_id b, loan_id b, due_date d, emi_amount m, status s",
    "repayments_from_schedule": "repayment_id b, emi_id b, paid_amount m, payment_date d, "
                                "payment_mode s",
    "mark_overdue": "emi_id b, loan_id b, due_date d, emi_amount m, status s",
    "detect_defaults": "loan_id b, default_date d, overdue_days i, overdue_total m",
    "assess_penalties": "loan_id b, default_date d, overdue_days i, overdue_total m, "
                        "penalty_amount m",
    "default_sweep": "loan_id b, default_id b, default_date d, overdue_days i, penalty_id b, "
                     "penalty_amount m, current_status s, log_rows b",
    "apply_status_changes": "loan_id b, customer_id b, current_status s",
    "apply_status_changes_log": "status_history_id b, loan_id b, status_label s, change_date d",
    "apply_payments": "emi_id b, loan_id b, due_date d, emi_amount m, status s",
    "apply_payments_ledger": "repayment_id b, emi_id b, paid_amount m, payment_date d, "
                             "payment_mode s",
    "disburse_loans": "loan_id b, customer_id b, loan_amount m, current_status s, log_rows b, "
                      "instalments b, first_due d, last_due d, scheduled m, guarantor s, phone s, "
                      "score_value i, risk_id b",
    "disburse_loans_counters": "customer_id b, total_loans i, total_defaults i, last_updated d",
    "assign_risk_band": "score_id b, customer_id b, score_value i, score_date d, risk_id b",
    "register_customers": "request_id b, customer_id b, name s, phone s, email s, "
                          "monthly_income m, city s, total_loans i, reason s",
    "apply_changes": "customer_id b, name s, dob d, phone s, email s",
    "apply_checked_changes": "customer_id b, name s, phone s, email s, incomes b, seq b, op s, reason s",
    "cascade_delete": "table_name s, n b",
    "credit_history_rollup": "customer_id b, stored_loans b, actual_loans b, stored_defaults b, "
                             "actual_defaults b, drifted t",
    "status_timeline": "status_history_id b, loan_id b, status_label s, change_date d, "
                       "previous_status s, days_since_previous i",
    "validate_tables": "table_name s, rule s, n b",
    "application_input_checks": "application_id b, problems s",
    "payment_input_checks": "request_id b, problems s",
    # scoring
    "encode_employment": "income_id b, employment_type s, employment_enc i",
    "application_features": "application_id b, customer_id b, monthly_income m, "
                            "employment_type s, employment_enc i, total_loans i, "
                            "total_defaults i, loan_amount m, tenure i, interest_rate m, problem s",
    "rule_credit_score": "application_id b, score_value i",
    "rule_risk_level": "application_id b, score_value i, risk_level s",
    "rule_default_score": "application_id b, overdue_days i, default_score f, will_default i",
    "decision_reasons": "application_id b, score_value i, default_probability q, reasons s",
    # models
    "train_score_model": "rows b, mae_ok t, r2_ok t",
    "train_risk_model": "rows b, accuracy_ok t",
    "train_default_model": "rows b, hits b, caught b, missed b, false_alarms b, intercept q, "
                           "on_score_value q, on_overdue_days q, on_tenure q, on_interest_rate q, "
                           "on_total_defaults q",
    "predict_score": "application_id b, in_range t, near_scorecard t",
    "predict_risk": "application_id b, levels i, sums_to_one t, level_is_likeliest t",
    "predict_default": "application_id b, default_probability q, no_default_probability q, "
                       "default_expected t, default_confidence s",
    "assess_applications": "application_id b, in_range t, approval_follows t, reasons_follow t",
    "model_store": "application_id b, same t",
    # streaming
    "stream_apply_payments": "repayment_id b, emi_id b, paid_amount m, payment_date d, "
                             "payment_mode s",
    "stream_settled_instalments": "emi_id b, loan_id b, due_date d, emi_amount m, status s",
    "stream_monthly_collections": "month s, total_collected m, payment_count b",
    # one customer or loan
    "customer_profile_one": "customer_id b, name s, phone s, email s, dob d, monthly_income m, "
                            "city s, street s, total_loans i, total_defaults i",
    "score_history_one": "customer_id b, score_id b, score_date d, score_value i, risk_level s",
    "latest_score_one": "customer_id b, score_value i, score_date d, risk_level s",
    "customer_loans_one": "customer_id b, loan_id b, type_name s, loan_amount m, current_status s",
    "emi_ledger_one": "loan_id b, emi_id b, due_date d, emi_amount m, status s, paid_amount m, "
                      "payment_date d, payment_mode s",
    "defaulters_table_by_penalty": "customer_id b, loan_id b, default_date d, overdue_days i, "
                                   "penalty_amount m",
    "defaulters_table_by_amount": "customer_id b, loan_id b, default_date d, overdue_days i, "
                                  "loan_amount m",
}


def parsed(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(" ")) for part in spec.split(", ")]


KIND_SQL = {
    "b": "CAST({0} AS BIGINT)", "i": "CAST({0} AS INT)", "s": "CAST({0} AS STRING)",
    "d": "CAST({0} AS STRING)", "f": "CAST({0} AS DOUBLE)", "t": "CAST({0} AS BOOLEAN)",
    "m": "CAST(CAST({0} AS DECIMAL(38,2)) AS DOUBLE)",
    "r": "CAST(CAST({0} AS DECIMAL(38,6)) AS DOUBLE)",
    "q": "CAST(CAST({0} AS DECIMAL(38,4)) AS DOUBLE)",
}


def shown(df: DataFrame, spec: str) -> DataFrame:
    """The result with exactly the columns and kinds of its entry in ``COLUMNS``."""
    return df.selectExpr(*[f"{KIND_SQL[kind].format(name)} AS {name}"
                           for name, kind in parsed(spec)])


# --- batches derived from the data -----------------------------------------------------------

def fully_paid_changes(t: Tables) -> DataFrame:
    """Close every loan whose instalments are all paid."""
    open_rows = F.count(F.when(F.col("status") != "Paid", 1))
    done = t.emi_schedule.groupBy("loan_id").agg(open_rows.alias("open")).where("open = 0")
    return done.select(F.col("loan_id").alias("change_id"), "loan_id",
                       F.lit("Closed").alias("status"))


def half_payments(t: Tables) -> DataFrame:
    """Half of every instalment that is due and open."""
    return access.payable_emis(t).where(F.col("due_date") < lifecycle.day(AS_OF)).select(
        F.col("emi_id").alias("request_id"), "emi_id",
        F.round(F.col("emi_amount") / 2, 2).alias("paid_amount"),
        lifecycle.day(AS_OF).alias("payment_date"), F.lit("UPI").alias("payment_mode"))


def rule_probability() -> Column:
    """The default score to 4 digits. Plain double arithmetic, so that other engines agree on
    scores that lie halfway between two values."""
    return F.floor(F.col("default_score") * 10_000 + 0.5) / 10_000


def rule_decisions(t: Tables) -> DataFrame:
    """Every loan applied for once more, decided by the scorecards."""
    scored = scoring.scorecard(t, scoring.loans_as_applications(t))
    backers = t.guarantor.select(
        F.col("loan_id").alias("application_id"),
        F.concat(F.lit(" "), "name", F.lit(" ")).alias("guarantor_name"),
        F.coalesce("phone", F.lit(" ")).alias("guarantor_phone"), "relationship")
    return (scored.join(backers, "application_id", "left")
            .withColumn("credit_score", F.col("score_value"))
            .withColumn("auto_approved", scoring.approved(
                F.col("score_value"), rule_probability())))


def supplier_requests(spark: SparkSession, path: str) -> DataFrame:
    """Suppliers asking to be registered as customers, some with unusable contacts."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    digits = F.lpad(key.cast("string"), 8, "0")
    phone = (F.when(nation == 0, F.concat(F.lit("98"), digits)).when(nation == 1, " ")
             .when(nation == 2, "9600000000")
             .otherwise(F.concat(F.lit(" 95"), digits, F.lit(" "))))
    email = (F.when(nation == 3, "shared@example.com")
             .otherwise(F.concat(F.lit("s"), key.cast("string"), F.lit("@example.com"))))
    return star.source(spark, path, "supplier").select(
        (key + 1).alias("request_id"), F.concat(F.lit(" "), "s_name").alias("name"),
        F.lit("1980-01-01").cast("date").alias("dob"), phone.alias("phone"),
        email.alias("email"),
        (F.lit(20000) + F.col("s_acctbal").cast("decimal(12,2)")).alias("monthly_income"),
        F.lit("Business").alias("employment_type"), F.col("s_name").alias("company_name"),
        F.lit("1 High St").alias("street"),
        F.concat(F.lit("City "), nation.cast("string")).alias("city"),
        F.lit("000001").alias("zip_code"))


def customer_changes(t: Tables, spark: SparkSession, path: str) -> DataFrame:
    """Retired customers change email, customers without a loan leave, suppliers join."""
    retired = t.income_details.where(F.col("employment_type") == "Retired").select("customer_id")
    idle = t.customer.join(t.loan.select("customer_id"), "customer_id", "left_anti")
    moved = t.customer.join(retired, "customer_id", "left_semi").withColumn(
        "email", F.concat(F.lit("retired."), "email"))
    joined = supplier_requests(spark, path).select(
        (F.lit(10**12) + F.col("request_id")).alias("customer_id"), F.trim("name").alias("name"),
        "dob", F.col("request_id").cast("string").alias("phone"), "email",
        lifecycle.day(AS_OF).cast("timestamp_ntz").alias("created_at"))

    def change(df: DataFrame, op: str, offset: int) -> DataFrame:
        return df.select(*t.customer.columns, F.lit(op).alias("op"),
                         (F.col("customer_id") + offset).alias("seq"))

    return (change(moved, "upsert", 0).unionByName(change(idle, "delete", 10**12))
            .unionByName(change(joined, "upsert", 0)))


def contested_changes(t: Tables) -> DataFrame:
    """Changes that hand phones and emails on, break rules, or delete customers, in six steps: the
    steps of all customers come one after the other."""
    number, turn = F.col("customer_id"), F.col("customer_id") % 4

    def first_phone(key: Column) -> Column:
        return F.concat(F.lit("98"), F.lpad(key.cast("string"), 8, "0"))

    def change(step: int, who: int, op: str = "upsert", **columns: Column) -> DataFrame:
        own = {"seq": F.lit(step * 10**12) + number, **columns}
        return t.customer.where(turn == who).withColumns(own).withColumn("op", F.lit(op))

    steps = [
        change(1, 1, phone=F.concat(F.lit("97"), F.substring("phone", 3, 8))),
        change(2, 2, phone=first_phone(number - 1)),
        change(3, 3, phone=first_phone(number - 2)),
        change(4, 0, "delete"),
        change(5, 0, customer_id=number + 2 * 10**12, phone=F.concat(F.lit("96"), F.substring("phone", 3, 8)),
               name=F.when(number % 8 != 0, F.col("name"))),
        change(6, 1, phone=first_phone(number + 2))]
    return reduce(DataFrame.unionByName, steps)


# --- composed results ------------------------------------------------------------------------

def _checked_changes(t: Tables) -> DataFrame:
    """Customers after the contested changes with their incomes, and the refused changes."""
    after, refused = maintenance.apply_checked_changes(t, "customer", contested_changes(t))
    incomes = after.income_details.groupBy("customer_id").agg(F.count("*").alias("incomes"))
    kept = after.customer.join(incomes, "customer_id", "left").select(
        "customer_id", "name", "phone", "email", F.coalesce("incomes", F.lit(0)).alias("incomes"))
    return kept.unionByName(refused, allowMissingColumns=True)


def _default_sweep(t: Tables) -> DataFrame:
    after = lifecycle.default_sweep(t, AS_OF)
    new = after.default_record.join(t.default_record.select("default_id"), "default_id",
                                    "left_anti")
    log = after.loan_status_history.groupBy("loan_id").agg(F.count("*").alias("log_rows"))
    return (new.join(after.penalty.select("penalty_id", "default_id", "penalty_amount"),
                     "default_id")
            .join(after.loan.select("loan_id", "current_status"), "loan_id")
            .join(log, "loan_id"))


def _disbursed(t: Tables) -> DataFrame:
    rows = lifecycle.disbursed_rows(t, rule_decisions(t), AS_OF)
    plans = rows["emi_schedule"].groupBy("loan_id").agg(
        F.count("*").alias("instalments"), F.min("due_date").alias("first_due"),
        F.max("due_date").alias("last_due"), F.sum("emi_amount").alias("scheduled"))
    logs = rows["loan_status_history"].groupBy("loan_id").agg(F.count("*").alias("log_rows"))
    backers = rows["guarantor"].select("loan_id", F.col("name").alias("guarantor"), "phone")
    # Loan and score of one application carry keys at a fixed distance.
    distance = lifecycle.first_free(t.loan, "loan_id") - lifecycle.first_free(
        t.credit_score, "score_id")
    scores = rows["credit_score"].select((F.col("score_id") + distance).alias("loan_id"),
                                         "score_value", "risk_id")
    return (rows["loan"].join(plans, "loan_id").join(logs, "loan_id")
            .join(backers, "loan_id", "left").join(scores, "loan_id"))


def _disbursal_counters(t: Tables) -> DataFrame:
    loans = lifecycle.disbursed_rows(t, rule_decisions(t), AS_OF)["loan"]
    return lifecycle.count_new_loans(t.credit_history, loans, AS_OF)


def _registered(spark: SparkSession, t: Tables, path: str) -> DataFrame:
    new, rejected, ids = maintenance.register_customers(t, supplier_requests(spark, path), AS_OF)
    accepted = (new["customer"]
                .join(new["income_details"].select("customer_id", "monthly_income"), "customer_id")
                .join(new["address_details"].select("customer_id", "city"), "customer_id")
                .join(new["credit_history"].select("customer_id", "total_loans"), "customer_id")
                .join(ids, "customer_id"))
    return accepted.unionByName(rejected, allowMissingColumns=True)


def _published(spark: SparkSession, t: Tables) -> DataFrame:
    """Every table as the newest published version holds it: rows, and a sum over their digests. The
    version before it has no rows."""
    root = new_folder(spark, "published")
    publish_tables(t.replace(**{name: t[name].limit(0) for name in TABLES}), root)
    version = publish_tables(t, root)
    loaded = load_published(spark, root)
    return reduce(DataFrame.unionByName, [loaded[name].select(F.conv(F.substring(F.md5(F.concat_ws(
        "|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in loaded[name].columns])),
        1, 8), 16, 10).cast("bigint").alias("word")).agg(
            F.lit(name).alias("table_name"), F.lit(version).alias("version"), F.count("*").alias("n"),
            F.coalesce(F.sum("word"), F.lit(0)).alias("digest")) for name in TABLES])


def _defaulted(t: Tables) -> DataFrame:
    return t.loan.where(F.col("current_status") == "Defaulted").select("loan_id")


def _scored(t: Tables) -> DataFrame:
    return scoring.scorecard(t, scoring.loans_as_applications(t))


def _reasons(t: Tables) -> DataFrame:
    rows = _scored(t).withColumn("default_probability", rule_probability())
    return rows.withColumn("reasons", scoring.decision_reasons(
        F.col("score_value"), F.col("default_probability")))


def _exported(spark: SparkSession, t: Tables) -> DataFrame:
    folder = new_folder(spark, "export-loan")
    exports.export_table(t, "loan", folder)
    return spark.read.schema(TABLE_COLUMNS["loan"]).options(**CSV_READ).csv(folder)


def _exported_all(spark: SparkSession, t: Tables) -> DataFrame:
    folder = new_folder(spark, "export-all")
    exports.export_all_tables(t, folder)
    back = load_tables(spark, folder, "csv")
    return reduce(DataFrame.unionByName, [_compared(name, t[name], back[name]) for name in TABLES])


def _compared(name: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``after``, and how many rows, repeated ones too, only one of both holds."""
    sides = before.select("*", F.lit(0).alias("_after")).unionByName(
        after.select("*", F.lit(1).alias("_after")))
    more = F.abs(F.sum(F.col("_after") * 2 - 1))
    rows = sides.groupBy(*before.columns).agg(F.sum("_after").alias("_n"), more.alias("_more"))
    total = [F.coalesce(F.sum(c), F.lit(0)) for c in ("_n", "_more")]
    return rows.agg(F.lit(name).alias("table_name"), total[0].alias("n"), total[1].alias("changed"))


def _exported_query(spark: SparkSession, t: Tables) -> DataFrame:
    folder = new_folder(spark, "export-query")
    exports.export_query_csv(access.monthly_repayments(t), folder)
    return spark.read.schema("month STRING, total_collected DECIMAL(22,2), payment_count BIGINT"
                             ).options(**CSV_READ).csv(folder)


def _payment_stream(spark: SparkSession, path: str) -> DataFrame:
    """The order lines as a stream of payments."""
    lines = (spark.readStream.schema(star.SOURCE_COLUMNS["lineitem"])
             .option("pathGlobFilter", "lineitem.parquet").parquet(path))
    return star.payments(lines)


def _streamed_payments(spark: SparkSession, t: Tables, path: str) -> DataFrame:
    """Payments up to the cut-off are in the ledger already; the stream delivers all."""
    return streams.taken_in(spark, _payments_streamed(spark, t, path))


def _stream_settled(spark: SparkSession, t: Tables, path: str) -> DataFrame:
    """Instalments are open from the cut-off on; streamed payments close them."""
    late = (F.col("status") == "Paid") & (F.date_add("due_date", lifecycle.PAYMENT_LAG_DAYS)
                                          >= lifecycle.day(CUTOFF))
    still_open = t.replace(emi_schedule=t.emi_schedule.withColumn(
        "status", F.when(late, "Pending").otherwise(F.col("status"))))
    paid = streams.taken_in(spark, _payments_streamed(spark, t, path))
    return streams.settle(still_open, paid).emi_schedule


def _payments_streamed(spark: SparkSession, t: Tables, path: str) -> str:
    out = new_folder(spark, "stream-payments")
    known = t.replace(repayment=t.repayment.where(
        F.col("payment_date") < lifecycle.day(CUTOFF)))
    index = streams.index_ledger(known.repayment, f"{out}/known")
    streams.stream_apply_payments(_payment_stream(spark, path), known, out,
                                  f"{out}/checkpoint", index=index).awaitTermination()
    return out


def _streamed_months(spark: SparkSession, path: str) -> DataFrame:
    out = new_folder(spark, "stream-months")
    streams.stream_monthly_collections(_payment_stream(spark, path), f"{out}/months",
                                       f"{out}/checkpoint").awaitTermination()
    return streams.collections_so_far(spark, f"{out}/months")


READ_QUERY = """
SELECT i.employment_type, count(*) AS loans, sum(l.loan_amount) AS amount
FROM {loan} l JOIN {income_details} i ON i.customer_id = l.customer_id
GROUP BY i.employment_type
"""

# --- models ------------------------------------------------------------------------------------

# Floors and distances that the fitted models must keep, stated in advance.
MAE_AT_MOST, R2_AT_LEAST, ACCURACY_AT_LEAST = 12.0, 0.95, 0.97
SCORE_DISTANCE = 150


def _rows_to_learn(t: Tables) -> DataFrame:
    return stored(models.alike_together(_scored(t)), "scored")


def _reread(spark: SparkSession, name: str, model) -> object:
    """The model as a later job gets it: saved to the shared folder and loaded."""
    folder = new_folder(spark, f"model-{name}")
    models.save_model(model, folder)
    return models.load_model(folder)


def score_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.select("rows", (F.col("mae") <= MAE_AT_MOST).alias("mae_ok"),
                          (F.col("r2") >= R2_AT_LEAST).alias("r2_ok"))


def level_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.select("rows", (F.col("accuracy") >= ACCURACY_AT_LEAST).alias("accuracy_ok"))


def score_facts(predicted: DataFrame) -> DataFrame:
    """Facts that hold of a good score model for every application."""
    score = F.col("credit_score")
    return predicted.select(
        "application_id", score.between(300, 900).alias("in_range"),
        (F.abs(score - F.col("score_value")) <= SCORE_DISTANCE).alias("near_scorecard"))


def risk_facts(predicted: DataFrame) -> DataFrame:
    total = F.aggregate(F.map_values("risk_probabilities"), F.lit(0.0), lambda a, x: a + x)
    highest = F.array_max(F.map_values("risk_probabilities"))
    return predicted.select(
        "application_id", F.size("risk_probabilities").alias("levels"),
        (F.abs(total - 1) <= 0.0002).alias("sums_to_one"),
        (F.col("risk_probabilities")[F.col("predicted_level")] >= highest).alias("level_is_likeliest"))


def decision_facts(assessed: DataFrame) -> DataFrame:
    score, bad = F.col("credit_score"), F.col("default_probability")
    return assessed.select(
        "application_id", score.between(300, 900).alias("in_range"),
        (F.col("auto_approved") == scoring.approved(score, bad)).alias("approval_follows"),
        ((F.col("reasons") == "") == F.col("auto_approved")).alias("reasons_follow"))


def _trained(spark: SparkSession, t: Tables) -> models.Models:
    data = _rows_to_learn(t)
    return models.Models(*[_reread(spark, n, train(data)[0]) for n, train in (
        ("score", models.train_score_model), ("risk", models.train_risk_model),
        ("default", models.train_default_model))])


def _predicted(spark: SparkSession, t: Tables, which: str) -> DataFrame:
    train, predict = {
        "score": (models.train_score_model, models.predict_score),
        "risk": (models.train_risk_model, models.predict_risk),
        "default": (models.train_default_model, models.predict_default)}[which]
    data = _rows_to_learn(t)
    return predict(models.Models(**{which: _reread(spark, which, train(data)[0])}), data)


def _assessed(spark: SparkSession, t: Tables, path: str) -> DataFrame:
    return decision_facts(models.assess_applications(_trained(spark, t), scoring.application_features(
        t, scoring.loans_as_applications(t))))


def _model_store(spark: SparkSession, t: Tables, path: str) -> DataFrame:
    data = _rows_to_learn(t)
    kept = models.train_score_model(data)[0]
    now = models.predict_score(models.Models(score=kept), data).select("application_id", "credit_score")
    later = models.predict_score(models.Models(score=_reread(spark, "score", kept)), data).select(
        "application_id", F.col("credit_score").alias("reloaded"))
    return now.join(later, "application_id").select(
        "application_id", (F.col("credit_score") == F.col("reloaded")).alias("same"))


# --- the catalogue ---------------------------------------------------------------------------

Run = Callable[[SparkSession, Tables, str], DataFrame]


def _on_tables(operator: Callable[..., DataFrame], **arguments) -> Run:
    return lambda spark, t, path: operator(t, **arguments)


def _loans_as_applications_checked(t: Tables) -> DataFrame:
    return maintenance.application_input_checks(t, scoring.loans_as_applications(t))


def _payments_checked(t: Tables) -> DataFrame:
    return maintenance.payment_input_checks(
        t, t.repayment.withColumnRenamed("repayment_id", "request_id"))


def _encoded(t: Tables) -> DataFrame:
    return t.income_details.withColumn(
        "employment_enc", scoring.employment_code(F.col("employment_type")))


RUNS: dict[str, Run] = {
    "table_row_counts": _on_tables(access.table_row_counts),
    "load_tables": lambda spark, t, path: _published(spark, t),
    "preview_table": _on_tables(access.preview_table, name="loan"),
    "read_query": lambda spark, t, path: read_query(spark, t, READ_QUERY),
    "export_table": lambda spark, t, path: _exported(spark, t),
    "export_all_tables": lambda spark, t, path: _exported_all(spark, t),
    "export_query_csv": lambda spark, t, path: _exported_query(spark, t),
    **{f.__name__: _on_tables(f) for f in (
        portfolio.top_defaulters, portfolio.monthly_collections_by_mode, portfolio.score_trend,
        portfolio.loan_type_performance, portfolio.eligible_customers,
        portfolio.risk_distribution, portfolio.emi_status_summary, portfolio.penalty_leaderboard,
        portfolio.income_capacity, portfolio.income_capacity_exact,
        portfolio.cumulative_repayment, portfolio.cumulative_repayment_by_loan,
        portfolio.loan_type_exposure, portfolio.portfolio_summary,
        portfolio.penalty_rank_by_name, portfolio.top_defaulters_simple,
        portfolio.collections_simple, portfolio.score_trend_raw, portfolio.eligible_simple,
        access.customer_directory, access.customer_profile, access.score_history,
        access.latest_score, access.latest_score_all_ties, access.score_histogram,
        access.customer_loans, access.all_loans, access.recent_loans, access.emi_ledger,
        access.overdue_emis, access.payable_emis, access.repayment_progress,
        access.loan_penalty_total, access.portfolio_kpis, access.loans_by_risk,
        access.monthly_repayments, access.monthly_repayments_rolling, access.defaulters_table,
        access.loan_status_breakdown, lifecycle.emi_quote, maintenance.credit_history_rollup,
        maintenance.status_timeline, maintenance.validate_tables)},
    "customer_search": _on_tables(access.customer_search, pattern=SEARCH_PATTERN),
    "overdue_worklist": _on_tables(access.overdue_worklist, as_of=AS_OF),
    "emi_schedule_generate": _on_tables(lambda t: lifecycle.emi_schedule_generate(t.loan)),
    "emi_schedule_backfill": _on_tables(
        lambda t: lifecycle.emi_schedule_backfill(t.loan, CUTOFF, AS_OF)),
    "repayments_from_schedule": _on_tables(
        lambda t: lifecycle.repayments_from_schedule(t.emi_schedule)),
    "mark_overdue": _on_tables(lambda t: lifecycle.mark_overdue(t.emi_schedule, AS_OF)),
    "detect_defaults": _on_tables(lifecycle.detect_defaults, as_of=AS_OF),
    "assess_penalties": _on_tables(
        lambda t: lifecycle.assess_penalties(lifecycle.detect_defaults(t, AS_OF))),
    "default_sweep": _on_tables(_default_sweep),
    "apply_status_changes": _on_tables(
        lambda t: lifecycle.apply_status_changes(t, fully_paid_changes(t), AS_OF).loan),
    "apply_status_changes_log": _on_tables(
        lambda t: lifecycle.apply_status_changes(
            t, fully_paid_changes(t), AS_OF).loan_status_history),
    "apply_payments": _on_tables(
        lambda t: lifecycle.apply_payments(t, half_payments(t)).emi_schedule),
    "apply_payments_ledger": _on_tables(
        lambda t: lifecycle.apply_payments(t, half_payments(t)).repayment),
    "disburse_loans": _on_tables(_disbursed),
    "disburse_loans_counters": _on_tables(_disbursal_counters),
    "assign_risk_band": _on_tables(lambda t: assign_risk_band(t.credit_score, t.risk_category)),
    "register_customers": lambda spark, t, path: _registered(spark, t, path),
    "apply_changes": lambda spark, t, path: maintenance.apply_changes(
        t.customer, customer_changes(t, spark, path), "customer_id"),
    "apply_checked_changes": _on_tables(_checked_changes),
    "cascade_delete": _on_tables(lambda t: access.table_row_counts(
        maintenance.cascade_delete(t, "loan", _defaulted(t)))),
    "application_input_checks": _on_tables(_loans_as_applications_checked),
    "payment_input_checks": _on_tables(_payments_checked),
    "encode_employment": _on_tables(_encoded),
    "application_features": _on_tables(
        lambda t: scoring.application_features(t, scoring.loans_as_applications(t))),
    "rule_credit_score": _on_tables(_scored),
    "rule_risk_level": _on_tables(_scored),
    "rule_default_score": _on_tables(_scored),
    "decision_reasons": _on_tables(_reasons),
    "train_score_model": lambda spark, t, path: score_metrics(
        models.train_score_model(_rows_to_learn(t))[1]),
    "train_risk_model": lambda spark, t, path: level_metrics(
        models.train_risk_model(_rows_to_learn(t))[1]),
    "train_default_model": lambda spark, t, path: models.train_default_model(_rows_to_learn(t))[1],
    "predict_score": lambda spark, t, path: score_facts(_predicted(spark, t, "score")),
    "predict_risk": lambda spark, t, path: risk_facts(_predicted(spark, t, "risk")),
    "predict_default": lambda spark, t, path: _predicted(spark, t, "default"),
    "assess_applications": _assessed,
    "model_store": _model_store,
    "stream_apply_payments": lambda spark, t, path: _streamed_payments(spark, t, path),
    "stream_settled_instalments": _stream_settled,
    "stream_monthly_collections": lambda spark, t, path: _streamed_months(spark, path),
}


def _one(operator: Callable[..., DataFrame], table: str, key: str) -> Run:
    """A look-up for the least id that the table holds."""
    return lambda spark, t, path: operator(t, t[table].agg(F.min(key)).first()[0])


RUNS |= {
    "customer_profile_one": _one(access.customer_profile, "credit_history", "customer_id"),
    "score_history_one": _one(access.score_history, "credit_score", "customer_id"),
    "latest_score_one": _one(access.latest_score, "credit_score", "customer_id"),
    "customer_loans_one": _one(access.customer_loans, "loan", "customer_id"),
    "emi_ledger_one": _one(access.emi_ledger, "emi_schedule", "loan_id"),
    "defaulters_table_by_penalty": _on_tables(access.defaulters_table, sort="penalty_amount"),
    "defaulters_table_by_amount": _on_tables(access.defaulters_table, sort="loan_amount"),
}


def run(name: str, spark: SparkSession, path: str) -> DataFrame:
    """The named query over the star-schema files in ``path``."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    result = RUNS[name](spark, tables_from_star(spark, path), path)
    return shown(result, COLUMNS[name]) if name in COLUMNS else result
