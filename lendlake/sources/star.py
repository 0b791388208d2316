"""Loan tables derived from a generic star schema (customer, nation, orders, lineitem, events).

Every table is a deterministic projection; only ``address_details`` joins (25 nations) and only
``credit_history`` aggregates. Rows that belong together are derived from the same source row, so
no derived table needs a self-join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlake.schema import column_names, column_types
from lendlake.sources.tables import Tables

SOURCE_COLUMNS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_extendedprice DOUBLE, l_returnflag STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
}

# The bands the scorecards rely on.
RISK_BANDS = [(1, "Low", 751, 900), (2, "Medium", 601, 750), (3, "High", 300, 600)]
# Made up for the derived tables; a type for each order priority and one without loans.
LOAN_TYPES = [
    (1, "Express", "16.25", "75000"),
    (2, "Equipment", "10.75", "3200000"),
    (3, "Bridge", "13.40", "850000"),
    (4, "Harvest", "6.90", "420000"),
    (5, "Property", "5.80", "12500000"),
    (6, "Retired", "9.10", "60000"),
]

# Column expressions over the source named first.
CUSTOMER = {
    "customer_id": "c_custkey",
    "name": "c_name",
    "dob": "DATE '1970-01-01'",
    "phone": "concat('98', lpad(CAST(c_custkey AS STRING), 8, '0'))",
    "email": "concat('c', CAST(c_custkey AS STRING), '@example.com')",
    "created_at": "TIMESTAMP_NTZ '2024-01-01 00:00:00'",
}
INCOME = {
    "income_id": "c_custkey",
    "customer_id": "c_custkey",
    "monthly_income": "15000 + (CAST(c_acctbal AS DECIMAL(12,2)) + 1000) * 20",
    "employment_type": "CASE c_mktsegment WHEN 'MACHINERY' THEN 'Self-Employed' "
                       "WHEN 'FURNITURE' THEN 'Business' WHEN 'HOUSEHOLD' THEN 'Retired' "
                       "ELSE 'Salaried' END",
    "company_name": "concat('Firm ', CAST(c_custkey % 97 AS STRING))",
}
ADDRESS = {
    "address_id": "c_custkey",
    "customer_id": "c_custkey",
    "street": "concat(CAST(c_custkey % 500 AS STRING), ' Main St')",
    "city": "n_name",
    "zip_code": "lpad(CAST(c_custkey % 100000 AS STRING), 6, '0')",
}
LOAN = {
    "loan_id": "o_orderkey",
    "customer_id": "o_custkey",
    "loan_type_id": "substr(o_orderpriority, 1, 1)",
    "loan_amount": "o_totalprice",
    "interest_rate": "7.5 + (o_orderkey % 5) * 0.25",
    "tenure": "CASE o_orderkey % 6 WHEN 0 THEN 12 WHEN 1 THEN 24 WHEN 2 THEN 36 WHEN 3 THEN 60 "
              "WHEN 4 THEN 120 ELSE 240 END",
    "current_status": "CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN 'Defaulted' "
                      "WHEN o_orderstatus = 'F' THEN 'Closed' ELSE 'Active' END",
    "disbursed_date": "o_orderdate",
}
HISTORY = {
    "history_id": "customer_id",
    "customer_id": "customer_id",
    "total_loans": "loans",
    "total_defaults": "defaults",
    "last_updated": "latest",
}
SCORE = {
    "score_id": "event_id",
    "customer_id": "user_id",
    "score_value": "v",
    "score_date": "ts",
    "risk_id": "CASE WHEN v >= 751 THEN 1 WHEN v >= 601 THEN 2 ELSE 3 END",
}
STATUS_LOG = {
    "status_history_id": "loan_id * 10 + k",
    "loan_id": "loan_id",
    "status_label": "CASE k WHEN 1 THEN 'Approved' WHEN 2 THEN 'Active' ELSE current_status END",
    "change_date": "CASE WHEN k < 3 THEN disbursed_date ELSE date_add(disbursed_date, 365) END",
}
GUARANTOR = {
    "guarantor_id": "loan_id",
    "loan_id": "loan_id",
    "name": "concat('Guarantor ', CAST(loan_id AS STRING))",
    "phone": "CASE WHEN loan_id % 2 = 0 "
             "THEN concat('97', lpad(CAST(loan_id AS STRING), 8, '0')) END",
    "relationship": "CASE loan_id % 4 WHEN 0 THEN 'Spouse' WHEN 1 THEN 'Parent' "
                    "WHEN 2 THEN 'Sibling' ELSE 'Friend' END",
}
INSTALMENT = {
    "emi_id": "(l_orderkey * 8 + l_linenumber) * 2097152 + (l_partkey * 31 + l_suppkey) % 2097152",
    "loan_id": "l_orderkey",
    "due_date": "l_shipdate",
    "emi_amount": "l_extendedprice",
    "status": "CASE l_returnflag WHEN 'A' THEN 'Paid' WHEN 'R' THEN 'Overdue' "
              "ELSE 'Pending' END",
}
PAYMENT = {
    "repayment_id": "emi_id",
    "emi_id": "emi_id",
    "paid_amount": "emi_amount",
    "payment_date": "date_add(due_date, 2)",
    "payment_mode": "CASE emi_id % 4 WHEN 0 THEN 'Online' WHEN 1 THEN 'UPI' "
                    "WHEN 2 THEN 'Cheque' ELSE 'Cash' END",
}
DEFAULT = {
    "default_id": "loan_id",
    "loan_id": "loan_id",
    "default_date": "date_add(disbursed_date, 365)",
    "overdue_days": "30 + loan_id % 170",
}
PENALTY = {
    "penalty_id": "loan_id",
    "default_id": "loan_id",
    "penalty_amount": "round(loan_amount * CAST(0.02 AS DECIMAL(4,2)) "
                      "* greatest(1, CAST(floor((30 + loan_id % 170) / 30) AS INT)), 2)",
    "penalty_date": "date_add(disbursed_date, 365 + 15)",
}


def derive(df: DataFrame, table: str, expressions: Mapping[str, str]) -> DataFrame:
    """The table's columns in declared order, cast to their declared types."""
    types = column_types(table)
    return df.selectExpr(*[f"CAST({expressions[c]} AS {types[c]}) AS {c}"
                           for c in column_names(table)])


def catalogue(spark: SparkSession, table: str, rows: list[tuple]) -> DataFrame:
    """A literal table as a local relation, so its true size is known to the planner."""
    names = column_names(table)
    values = ", ".join(str(r) for r in rows)
    frame = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
    return derive(frame, table, {n: n for n in names})


def source(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_COLUMNS[name]).parquet(f"{path}/{name}.parquet")


def instalments(lines: DataFrame) -> DataFrame:
    """Schedule rows from order lines; also applied to a stream of order lines."""
    return derive(lines, "emi_schedule", INSTALMENT)


def payments(lines: DataFrame) -> DataFrame:
    """One repayment, two days late, for every paid instalment. The condition is stated on the
    source column, so it reaches the Parquet scan."""
    return derive(instalments(lines.where("l_returnflag = 'A'")), "repayment", PAYMENT)


def tables_from_star(spark: SparkSession, path: str) -> Tables:
    """The 14 tables over ``path/{customer,nation,orders,lineitem,events}.parquet``."""
    def src(name: str) -> DataFrame:
        return source(spark, path, name)

    def loan() -> DataFrame:
        return derive(src("orders"), "loan", LOAN)

    def defaulted() -> DataFrame:
        possible = src("orders").where("o_orderstatus = 'P'")
        return derive(possible, "loan", LOAN).where("current_status = 'Defaulted'")

    def address_details() -> DataFrame:
        homes = src("customer").join(src("nation"), F.expr("c_nationkey = n_nationkey"))
        return derive(homes, "address_details", ADDRESS)

    def credit_history() -> DataFrame:
        counted = loan().groupBy("customer_id").agg(
            F.expr("count(*) AS loans"),
            F.expr("count_if(current_status = 'Defaulted') AS defaults"),
            F.expr("max(disbursed_date) AS latest"))
        return derive(counted, "credit_history", HISTORY)

    def credit_score() -> DataFrame:
        valued = src("events").selectExpr("*", "300 + (event_id * 7919) % 601 AS v")
        return derive(valued, "credit_score", SCORE)

    def loan_status_history() -> DataFrame:
        last = "CASE WHEN current_status = 'Active' THEN 2 ELSE 3 END"
        steps = loan().selectExpr("*", f"explode(sequence(1, {last})) AS k")
        return derive(steps, "loan_status_history", STATUS_LOG)

    return Tables({
        "risk_category": lambda: catalogue(spark, "risk_category", RISK_BANDS),
        "loan_type": lambda: catalogue(spark, "loan_type", LOAN_TYPES),
        "customer": lambda: derive(src("customer"), "customer", CUSTOMER),
        "income_details": lambda: derive(src("customer"), "income_details", INCOME),
        "address_details": address_details,
        "credit_history": credit_history,
        "credit_score": credit_score,
        "loan": loan,
        "loan_status_history": loan_status_history,
        "guarantor": lambda: derive(loan().where("loan_id % 3 = 0"), "guarantor", GUARANTOR),
        "emi_schedule": lambda: instalments(src("lineitem")),
        "repayment": lambda: payments(src("lineitem")),
        "default_record": lambda: derive(defaulted(), "default_record", DEFAULT),
        "penalty": lambda: derive(defaulted().where("loan_id % 4 <> 0"), "penalty", PENALTY),
    })
