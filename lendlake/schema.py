"""The data model: columns, keys, references and declared rules of 14 tables."""

from __future__ import annotations

from dataclasses import dataclass

# Spark DDL, one entry per table, parents before children.
COLUMNS: dict[str, str] = {
    "risk_category": "risk_id BIGINT, risk_level STRING, min_score INT, max_score INT",
    "loan_type": "loan_type_id BIGINT, type_name STRING, base_interest_rate DECIMAL(5,2), "
                 "max_amount DECIMAL(14,2)",
    "customer": "customer_id BIGINT, name STRING, dob DATE, phone STRING, email STRING, "
                "created_at TIMESTAMP_NTZ",
    "income_details": "income_id BIGINT, customer_id BIGINT, monthly_income DECIMAL(12,2), "
                      "employment_type STRING, company_name STRING",
    "address_details": "address_id BIGINT, customer_id BIGINT, street STRING, city STRING, "
                       "zip_code STRING",
    "credit_history": "history_id BIGINT, customer_id BIGINT, total_loans INT, "
                      "total_defaults INT, last_updated DATE",
    "credit_score": "score_id BIGINT, customer_id BIGINT, score_value INT, score_date DATE, "
                    "risk_id BIGINT",
    "loan": "loan_id BIGINT, customer_id BIGINT, loan_type_id BIGINT, loan_amount DECIMAL(14,2), "
            "interest_rate DECIMAL(5,2), tenure INT, current_status STRING, disbursed_date DATE",
    "loan_status_history": "status_history_id BIGINT, loan_id BIGINT, status_label STRING, "
                           "change_date DATE",
    "guarantor": "guarantor_id BIGINT, loan_id BIGINT, name STRING, phone STRING, "
                 "relationship STRING",
    "emi_schedule": "emi_id BIGINT, loan_id BIGINT, due_date DATE, emi_amount DECIMAL(12,2), "
                    "status STRING",
    "repayment": "repayment_id BIGINT, emi_id BIGINT, paid_amount DECIMAL(12,2), "
                 "payment_date DATE, payment_mode STRING",
    "default_record": "default_id BIGINT, loan_id BIGINT, default_date DATE, overdue_days INT",
    "penalty": "penalty_id BIGINT, default_id BIGINT, penalty_amount DECIMAL(10,2), "
               "penalty_date DATE",
}

TABLES: tuple[str, ...] = tuple(COLUMNS)


def column_types(table: str) -> dict[str, str]:
    """Column names and types; a comma followed by a space ends a column."""
    return dict(part.split(" ", 1) for part in COLUMNS[table].split(", "))


def column_names(table: str) -> list[str]:
    return list(column_types(table))


# The primary key is always the first column.
KEY: dict[str, str] = {t: column_names(t)[0] for t in TABLES}


@dataclass(frozen=True)
class Reference:
    child: str
    column: str
    parent: str
    cascades: bool      # deleting the parent deletes the child row
    nullable: bool = False


REFERENCES: tuple[Reference, ...] = (
    Reference("income_details", "customer_id", "customer", True),
    Reference("address_details", "customer_id", "customer", True),
    Reference("credit_history", "customer_id", "customer", True),
    Reference("credit_score", "customer_id", "customer", True),
    Reference("credit_score", "risk_id", "risk_category", False, nullable=True),
    Reference("loan", "customer_id", "customer", False),
    Reference("loan", "loan_type_id", "loan_type", False),
    Reference("loan_status_history", "loan_id", "loan", True),
    Reference("guarantor", "loan_id", "loan", True),
    Reference("emi_schedule", "loan_id", "loan", True),
    Reference("repayment", "emi_id", "emi_schedule", True),
    Reference("default_record", "loan_id", "loan", True),
    Reference("penalty", "default_id", "default_record", True),
)

# Columns that must hold a value, apart from the key and non-nullable references.
REQUIRED: dict[str, tuple[str, ...]] = {
    "risk_category": ("risk_level", "min_score", "max_score"),
    "loan_type": ("type_name", "base_interest_rate", "max_amount"),
    "customer": ("name", "dob", "phone", "email"),
    "income_details": ("monthly_income", "employment_type"),
    "credit_score": ("score_value",),
    "loan": ("loan_amount", "interest_rate", "tenure"),
    "loan_status_history": ("status_label",),
    "guarantor": ("name",),
    "emi_schedule": ("due_date", "emi_amount"),
    "repayment": ("paid_amount",),
    "penalty": ("penalty_amount",),
}

# Unique columns besides the key.
UNIQUE: dict[str, tuple[str, ...]] = {
    "risk_category": ("risk_level",),
    "loan_type": ("type_name",),
    "customer": ("phone", "email"),
}

# Longest text accepted.
MAX_LENGTH: dict[str, dict[str, int]] = {
    "risk_category": {"risk_level": 20},
    "loan_type": {"type_name": 80},
    "customer": {"name": 120, "phone": 15, "email": 150},
    "income_details": {"employment_type": 50, "company_name": 150},
    "address_details": {"street": 200, "city": 100, "zip_code": 10},
    "loan": {"current_status": 30},
    "loan_status_history": {"status_label": 30},
    "guarantor": {"name": 120, "phone": 15, "relationship": 60},
    "emi_schedule": {"status": 15},
    "repayment": {"payment_mode": 30},
}

# The words each coded column may hold.
DOMAINS: dict[tuple[str, str], tuple[str, ...]] = {
    ("income_details", "employment_type"): ("Salaried", "Self-Employed", "Business", "Retired"),
    ("loan", "current_status"): ("Active", "Closed", "Defaulted"),
    ("emi_schedule", "status"): ("Pending", "Paid", "Overdue"),
    ("repayment", "payment_mode"): ("Online", "UPI", "Cheque", "Cash"),
}

# Declared checks.
SCORE_RANGE = (300, 900)
CHECKS: dict[str, dict[str, str]] = {
    "income_details": {"monthly_income > 0": "monthly_income > 0"},
    "credit_score": {"score_value in 300..900": "score_value BETWEEN 300 AND 900"},
    "loan": {"loan_amount > 0": "loan_amount > 0", "tenure > 0": "tenure > 0"},
}
