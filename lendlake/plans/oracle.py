"""SQL counterparts of the named queries, for DuckDB over the same star-schema files.

Each text states the definition of a result in its own way: windows where the Spark side
aggregates and joins, whole-number arithmetic where it divides decimals. ``borrower`` is the
customer table (the files already hold a table of that name).
"""

from __future__ import annotations

import re

from lendlake.plans.catalog import AS_OF, COLUMNS, CUTOFF, SEARCH_PATTERN, parsed
from lendlake.schema import TABLES, column_types

# The loan tables as views over the star schema, in order of dependence.
VIEWS: dict[str, str] = {
    "risk_category": """
        SELECT * FROM (VALUES (1, 'Low', 751, 900), (2, 'Medium', 601, 750), (3, 'High', 300, 600))
        v(risk_id, risk_level, min_score, max_score)""",
    "loan_type": """
        SELECT loan_type_id, type_name, CAST(rate AS DECIMAL(5,2)) AS base_interest_rate,
               CAST(mx AS DECIMAL(14,2)) AS max_amount
        FROM (VALUES (1, 'Express', 16.25, 75000), (2, 'Equipment', 10.75, 3200000),
                     (3, 'Bridge', 13.40, 850000), (4, 'Harvest', 6.90, 420000),
                     (5, 'Property', 5.80, 12500000), (6, 'Retired', 9.10, 60000))
             v(loan_type_id, type_name, rate, mx)""",
    "borrower": """
        SELECT c_custkey AS customer_id, c_name AS name, DATE '1970-01-01' AS dob,
               concat('98', lpad(CAST(c_custkey AS VARCHAR), 8, '0')) AS phone,
               concat('c', CAST(c_custkey AS VARCHAR), '@example.com') AS email,
               TIMESTAMP '2024-01-01 00:00:00' AS created_at
        FROM customer""",
    "income_details": """
        SELECT c_custkey AS income_id, c_custkey AS customer_id,
               CAST(15000 + (CAST(c_acctbal AS DECIMAL(12,2)) + 1000) * 20 AS DECIMAL(12,2))
                   AS monthly_income,
               CASE c_mktsegment WHEN 'MACHINERY' THEN 'Self-Employed'
                    WHEN 'FURNITURE' THEN 'Business' WHEN 'HOUSEHOLD' THEN 'Retired'
                    ELSE 'Salaried' END AS employment_type,
               concat('Firm ', CAST(c_custkey % 97 AS VARCHAR)) AS company_name
        FROM customer""",
    "address_details": """
        SELECT c_custkey AS address_id, c_custkey AS customer_id,
               concat(CAST(c_custkey % 500 AS VARCHAR), ' Main St') AS street, n_name AS city,
               lpad(CAST(c_custkey % 100000 AS VARCHAR), 6, '0') AS zip_code
        FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "loan": """
        SELECT o_orderkey AS loan_id, o_custkey AS customer_id,
               CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS loan_type_id,
               CAST(o_totalprice AS DECIMAL(14,2)) AS loan_amount,
               CAST(7.5 + (o_orderkey % 5) * 0.25 AS DECIMAL(5,2)) AS interest_rate,
               CASE o_orderkey % 6 WHEN 0 THEN 12 WHEN 1 THEN 24 WHEN 2 THEN 36 WHEN 3 THEN 60
                    WHEN 4 THEN 120 ELSE 240 END AS tenure,
               CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN 'Defaulted'
                    WHEN o_orderstatus = 'F' THEN 'Closed' ELSE 'Active' END AS current_status,
               CAST(o_orderdate AS DATE) AS disbursed_date
        FROM orders""",
    "credit_history": """
        SELECT customer_id AS history_id, customer_id, CAST(count(*) AS INTEGER) AS total_loans,
               CAST(count(*) FILTER (WHERE current_status = 'Defaulted') AS INTEGER)
                   AS total_defaults,
               max(disbursed_date) AS last_updated
        FROM loan GROUP BY customer_id""",
    "credit_score": """
        SELECT event_id AS score_id, user_id AS customer_id, v AS score_value,
               CAST(ts AS DATE) AS score_date,
               CASE WHEN v >= 751 THEN 1 WHEN v >= 601 THEN 2 ELSE 3 END AS risk_id
        FROM (SELECT *, CAST(300 + (event_id * 7919) % 601 AS INTEGER) AS v FROM events)""",
    "loan_status_history": """
        SELECT loan_id * 10 + k AS status_history_id, loan_id,
               CASE k WHEN 1 THEN 'Approved' WHEN 2 THEN 'Active' ELSE current_status END
                   AS status_label,
               CAST(CASE WHEN k < 3 THEN disbursed_date ELSE disbursed_date + INTERVAL 365 DAY END
                    AS DATE) AS change_date
        FROM loan CROSS JOIN (VALUES (1), (2), (3)) s(k)
        WHERE k < 3 OR current_status <> 'Active'""",
    "guarantor": """
        SELECT loan_id AS guarantor_id, loan_id,
               concat('Guarantor ', CAST(loan_id AS VARCHAR)) AS name,
               CASE WHEN loan_id % 2 = 0
                    THEN concat('97', lpad(CAST(loan_id AS VARCHAR), 8, '0')) END AS phone,
               CASE loan_id % 4 WHEN 0 THEN 'Spouse' WHEN 1 THEN 'Parent' WHEN 2 THEN 'Sibling'
                    ELSE 'Friend' END AS relationship
        FROM loan WHERE loan_id % 3 = 0""",
    "emi_schedule": """
        SELECT (l_orderkey * 8 + l_linenumber) * 2097152 + (l_partkey * 31 + l_suppkey) % 2097152
                   AS emi_id,
               l_orderkey AS loan_id, CAST(l_shipdate AS DATE) AS due_date,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS emi_amount,
               CASE l_returnflag WHEN 'A' THEN 'Paid' WHEN 'R' THEN 'Overdue' ELSE 'Pending' END
                   AS status
        FROM lineitem""",
    "repayment": """
        SELECT emi_id AS repayment_id, emi_id, emi_amount AS paid_amount,
               CAST(due_date + INTERVAL 2 DAY AS DATE) AS payment_date,
               CASE emi_id % 4 WHEN 0 THEN 'Online' WHEN 1 THEN 'UPI' WHEN 2 THEN 'Cheque'
                    ELSE 'Cash' END AS payment_mode
        FROM emi_schedule WHERE status = 'Paid'""",
    "default_record": """
        SELECT loan_id AS default_id, loan_id,
               CAST(disbursed_date + INTERVAL 365 DAY AS DATE) AS default_date,
               CAST(30 + loan_id % 170 AS INTEGER) AS overdue_days
        FROM loan WHERE current_status = 'Defaulted'""",
    "penalty": """
        SELECT d.default_id AS penalty_id, d.default_id,
               CAST(round(l.loan_amount * CAST(0.02 AS DECIMAL(4,2))
                    * greatest(1, CAST(floor(d.overdue_days / 30) AS INTEGER)), 2)
                    AS DECIMAL(10,2)) AS penalty_amount,
               CAST(d.default_date + INTERVAL 15 DAY AS DATE) AS penalty_date
        FROM default_record d JOIN loan l ON l.loan_id = d.loan_id
        WHERE d.default_id % 4 <> 0""",
    # Helpers several results share.
    "newest": """
        SELECT * FROM credit_score
        QUALIFY row_number() OVER (PARTITION BY customer_id
                                   ORDER BY score_date DESC NULLS LAST, score_id DESC) = 1""",
    "application": f"""
        SELECT l.loan_id AS application_id, l.customer_id, l.loan_type_id, l.loan_amount, l.tenure,
               l.interest_rate, CAST(i.monthly_income AS DOUBLE) AS income, i.employment_type,
               CASE i.employment_type WHEN 'Salaried' THEN 3 WHEN 'Self-Employed' THEN 2
                    WHEN 'Business' THEN 4 WHEN 'Retired' THEN 1 ELSE 2 END AS employment_enc,
               coalesce(h.total_loans, 0) AS loans, coalesce(h.total_defaults, 0) AS defaults,
               CAST(l.loan_amount AS DOUBLE) AS amount,
               coalesce((SELECT max(d.overdue_days) FROM default_record d JOIN loan x
                         ON x.loan_id = d.loan_id WHERE x.customer_id = l.customer_id), 0)
                   AS overdue_days
        FROM loan l JOIN income_details i ON i.customer_id = l.customer_id
        LEFT JOIN credit_history h ON h.customer_id = l.customer_id""",
    "scored": """
        SELECT *, 0.05 + (defaults / (loans + 1.0)) * 0.3 + (overdue_days / 200.0) * 0.2
                  + (1 - score_value / 900.0) * 0.15 + (CAST(interest_rate AS DOUBLE) / 18.0) * 0.1
                  + (loans / 8.0) * 0.05 AS default_score
        FROM (SELECT *, CAST(trunc(least(900, greatest(300,
                  350 + (income / 300000) * 200 + (employment_enc / 4.0) * 80
                  + (1 - defaults / (loans + 1.0)) * 200 - (amount / 5000000) * 50
                  - defaults * 30.0))) AS INTEGER) AS score_value
              FROM application)""",
    "late": f"""
        SELECT loan_id, CAST(DATE '{AS_OF}' - min(due_date) AS INTEGER) AS overdue_days,
               sum(emi_amount) AS overdue_total
        FROM emi_schedule
        WHERE status = 'Overdue' AND loan_id NOT IN (SELECT loan_id FROM default_record)
        GROUP BY loan_id""",
    "request": """
        SELECT s_suppkey + 1 AS request_id, trim(s_name) AS name,
               CASE WHEN s_nationkey = 0 THEN '98' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0')
                    WHEN s_nationkey = 2 THEN '9600000000'
                    WHEN s_nationkey <> 1 THEN '95' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0')
               END AS phone,
               CASE WHEN s_nationkey = 3 THEN 'shared@example.com'
                    ELSE 's' || CAST(s_suppkey AS VARCHAR) || '@example.com' END AS email,
               20000 + CAST(s_acctbal AS DECIMAL(12,2)) AS monthly_income,
               'City ' || CAST(s_nationkey AS VARCHAR) AS city
        FROM supplier""",
}


def cents(money: str) -> str:
    return f"CAST(({money}) * 100 AS HUGEINT)"


def half_up(numerator: str, denominator: str, digits: int) -> str:
    """numerator / denominator of whole non-negative numbers, rounded half up, as double."""
    scale = 10 ** digits
    return (f"CAST((2 * CAST(({numerator}) AS HUGEINT) * {scale} + ({denominator}))"
            f" // nullif(2 * ({denominator}), 0) AS DOUBLE) / {scale}")


def mean_money(total: str, n: str, digits: int) -> str:
    """Mean of a money sum: cents over n, kept to ``digits`` digits of the currency unit."""
    return half_up(f"{cents(total)} * {10 ** (digits - 2)}", n, 0) + f" / {10 ** digits}.0"


LATEST_TIES = """
SELECT s.customer_id, s.score_id, s.score_value, r.risk_level
FROM (SELECT *, max(score_date) OVER (PARTITION BY customer_id) AS top FROM credit_score) s
JOIN risk_category r USING (risk_id) WHERE s.score_date = s.top"""

LOANS = """
SELECT l.*, b.name, ty.type_name FROM loan l
JOIN borrower b USING (customer_id) JOIN loan_type ty USING (loan_type_id)"""

LEDGER = """
SELECT e.loan_id, e.emi_id, e.due_date, e.emi_amount, e.status,
       CASE WHEN p.emi_id IS NULL THEN 0 ELSE p.paid_amount END AS paid_amount,
       p.payment_date, p.payment_mode
FROM emi_schedule e LEFT JOIN repayment p USING (emi_id)"""

DIRECTORY = """
SELECT * FROM borrower LEFT JOIN income_details USING (customer_id)
LEFT JOIN address_details USING (customer_id)"""

MONTHS = """
SELECT strftime(payment_date, '%Y-%m') AS month, sum(paid_amount) AS total_collected,
       count(*) AS payment_count
FROM repayment GROUP BY 1"""

DEFAULTS_BY_CUSTOMER = """
SELECT l.customer_id, d.default_id, d.overdue_days, sum(p.penalty_amount) AS charged,
       count(p.penalty_id) AS charges
FROM default_record d JOIN loan l USING (loan_id) LEFT JOIN penalty p USING (default_id)
GROUP BY ALL"""

BY_TYPE = """
SELECT ty.type_name, count(l.loan_id) AS n, sum(l.loan_amount) AS amount,
       sum(l.interest_rate) AS rates,
       count(*) FILTER (WHERE l.current_status = 'Active') AS active,
       count(*) FILTER (WHERE l.current_status = 'Closed') AS closed,
       count(*) FILTER (WHERE l.current_status = 'Defaulted') AS bad
FROM loan_type ty LEFT JOIN loan l USING (loan_type_id) GROUP BY ty.type_name"""


def score_sequence(banded: bool) -> str:
    bands = "JOIN risk_category r USING (risk_id)" if banded else ""
    level = ", r.risk_level" if banded else ""
    return f"""
SELECT s.customer_id, s.score_id, b.name, s.score_date, s.score_value{level},
       s.score_value - lag(s.score_value) OVER seq AS score_change,
       sum(s.score_value) OVER three AS total3, count(*) OVER three AS n3
FROM credit_score s {bands} JOIN borrower b USING (customer_id)
WINDOW seq AS (PARTITION BY s.customer_id ORDER BY s.score_date NULLS LAST, s.score_id),
       three AS (PARTITION BY s.customer_id ORDER BY s.score_date NULLS LAST, s.score_id
                 ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""


def eligible(columns: str, extra: str = "") -> str:
    return f"""
SELECT {columns} FROM borrower b JOIN income_details i USING (customer_id)
JOIN credit_history h USING (customer_id) JOIN newest n USING (customer_id)
JOIN risk_category r USING (risk_id) {extra}
WHERE n.score_value > 600 AND h.total_defaults = 0 AND i.monthly_income > 30000"""


def capacity(times: str) -> str:
    """``times``: how often an active loan's amount counts, given its number of instalments."""
    annual = "i.monthly_income * 12"
    average = mean_money("e.total", "e.n", 6)
    return f"""
WITH per_loan AS (
    SELECT l.customer_id, l.loan_amount, count(s.emi_id) AS n, sum(s.emi_amount) AS total
    FROM loan l LEFT JOIN emi_schedule s USING (loan_id) WHERE l.current_status = 'Active'
    GROUP BY l.loan_id, l.customer_id, l.loan_amount),
e AS (SELECT customer_id, sum(loan_amount * {times}) AS borrowed, sum(n) AS n,
             sum(total) AS total
      FROM per_loan GROUP BY customer_id)
SELECT b.customer_id, b.name, i.monthly_income, i.employment_type,
       coalesce(e.borrowed, 0) AS total_borrowed,
       {half_up(cents("coalesce(e.borrowed, 0)"), cents(annual), 6)} AS loan_to_income_ratio,
       coalesce({average}, 0) AS avg_emi,
       coalesce({half_up(f"{cents('e.total')} * 100", f"e.n * {cents('i.monthly_income')}", 2)},
                0) AS emi_to_income_pct
FROM borrower b JOIN income_details i USING (customer_id) LEFT JOIN e USING (customer_id)"""


PAID = """
SELECT l.customer_id, l.loan_id, l.loan_amount, p.paid_amount,
       strftime(p.payment_date, '%Y-%m') AS month
FROM repayment p JOIN emi_schedule e USING (emi_id) JOIN loan l ON l.loan_id = e.loan_id"""

# Annuity payment in doubles.
RATE = "(CAST(interest_rate AS DOUBLE) / 1200.0)"
GROWTH = f"pow({RATE} + 1.0, CAST(tenure AS DOUBLE))"
PAYMENT = f"CAST(loan_amount AS DOUBLE) * {RATE} * {GROWTH} / ({GROWTH} - 1.0)"


def schedule(last: str, day28: bool) -> str:
    target = "CAST(start + to_months(CAST(n AS INTEGER)) AS DATE)"
    if day28:
        due = (f"CASE WHEN day({target}) < day(start) "
               f"THEN CAST(date_trunc('month', {target}) + INTERVAL 27 DAY AS DATE) "
               f"ELSE {target} END")
    else:
        due = target
    return f"""
SELECT loan_id * 10000 + n AS emi_id, loan_id, {due} AS due_date,
       CAST({PAYMENT} AS DECIMAL(12,2)) AS emi_amount
FROM (SELECT *, disbursed_date AS start, unnest(generate_series(1, {last})) AS n FROM loan)"""


PENALTY = "round(overdue_total * CAST(0.02 AS DECIMAL(2,2)) * greatest(1, " \
          "CAST(floor(overdue_days / 30.0) AS BIGINT)), 2)"

FULLY_PAID = """
SELECT loan_id FROM emi_schedule GROUP BY loan_id
HAVING count(*) = count(*) FILTER (WHERE status = 'Paid')"""

DUE_AND_OPEN = f"status <> 'Paid' AND due_date < DATE '{AS_OF}'"

APPROVED = """
SELECT application_id + (SELECT max(loan_id) + 1 FROM loan) AS loan_id, s.*, g.name AS backer,
       g.phone AS backer_phone
FROM scored s LEFT JOIN guarantor g ON g.loan_id = s.application_id
WHERE s.score_value > 600 AND floor(s.default_score * 10000 + 0.5) < 4000"""

# Percent with one digit, halves to the even tenth, from hundredths of a percent.
BASIS_POINTS = "CAST(floor(default_score * 10000 + 0.5) AS BIGINT)"
TENTHS = (f"({BASIS_POINTS} // 10 + CASE WHEN {BASIS_POINTS} % 10 > 5 OR ({BASIS_POINTS} % 10 = 5 "
          f"AND {BASIS_POINTS} // 10 % 2 = 1) THEN 1 ELSE 0 END)")

LEVEL = "CASE WHEN score_value > 750 THEN 'Low' WHEN score_value > 600 THEN 'Medium' ELSE 'High' END"
BUCKET = "((application_id % 10000) * 7919 + (application_id // 10000) % 10000) % 10000"


def held_out(label: str) -> str:
    """Rows held out where each class is cut at the last bucket within a fifth of it."""
    return f"""
WITH b AS (SELECT {label} AS label, {BUCKET} AS bucket, count(*) AS n FROM scored GROUP BY ALL),
c AS (SELECT label, n, sum(n) OVER (PARTITION BY label ORDER BY bucket) <= 0.2 * sum(n) OVER (
          PARTITION BY label) AS test FROM b)
SELECT sum(n) FILTER (test) AS rows, true AS accuracy_ok FROM c"""


FITTED_ON = ("score_value", "overdue_days", "tenure", "interest_rate", "total_defaults")
NEWTON_STEPS = 25


def newton() -> str:
    """Views for the default regression, solved here once more: ``parted`` (every application with
    its label y and whether it is held out), ``scale`` (of the training rows) and ``fit`` (b0 to b5).

    Each step of the recursion sums gradient and curvature over the training rows and solves the
    six equations by elimination; every line of the elimination is one nested SELECT.
    """
    size = range(len(FITTED_ON) + 1)
    betas = ", ".join(f"b{i}" for i in size)
    step = ", ".join(["i", betas, *[f"sum(w * (p - y) * x{i}) / any_value(n) + "
                                    f"{'0' if i == 0 else f'b{i} / any_value(n)'} AS g{i}" for i in size],
                      *[f"sum(w * p * (1 - p) * x{i} * x{j}) / any_value(n)"
                        f"{' + 1.0 / any_value(n)' if 0 < i == j else ''} AS h{i}{j}"
                        for i in size for j in size if i <= j]])
    margin = " + ".join(f"b{i} * x{i}" for i in size)
    inner = (f"SELECT {step} FROM (SELECT *, 1 / (1 + exp(-({margin}))) AS p FROM newton, points "
             f"WHERE i < {NEWTON_STEPS}) GROUP BY i, {betas}")
    for k in list(size)[:-1]:
        lines = [f"g{i} - h{k}{i} / h{k}{k} * g{k} AS g{i}" for i in size if i > k]
        lines += [f"h{i}{j} - h{k}{i} / h{k}{k} * h{k}{j} AS h{i}{j}" for i in size for j in size
                  if k < i <= j]
        inner = f"SELECT * REPLACE ({', '.join(lines)}) FROM ({inner})"
    for k in reversed(size):
        known = "".join(f" - h{k}{j} * d{j}" for j in size if j > k)
        inner = f"SELECT *, (g{k}{known}) / h{k}{k} AS d{k} FROM ({inner})"
    scaled = ", ".join(f"({f} - m{i + 1}) / s{i + 1} AS x{i + 1}" for i, f in enumerate(FITTED_ON))
    return f"""
labelled AS (SELECT application_id, score_value, overdue_days, tenure,
                    CAST(interest_rate AS DOUBLE) AS interest_rate, defaults AS total_defaults,
                    CAST(default_score > 0.4 AS INTEGER) AS y, {BUCKET} AS bucket FROM scored),
shares AS (SELECT y, bucket, sum(count(*)) OVER (PARTITION BY y ORDER BY bucket)
                  <= 0.2 * sum(count(*)) OVER (PARTITION BY y) AS inside FROM labelled GROUP BY y, bucket),
parted AS (SELECT labelled.*, inside AS test FROM labelled JOIN shares USING (y, bucket)),
scale AS (SELECT count(*)::DOUBLE AS n, sum(y)::DOUBLE AS bad,
                 {', '.join(f'avg({f}) AS m{i + 1}, stddev_pop({f}) AS s{i + 1}' for i, f in enumerate(FITTED_ON))}
          FROM parted WHERE NOT test),
points AS MATERIALIZED (SELECT y, n, CASE WHEN y = 1 THEN n / (2 * bad) ELSE n / (2 * (n - bad)) END AS w,
                  1.0 AS x0, {scaled} FROM parted, scale WHERE NOT test),
newton AS (SELECT 0 AS i, {', '.join(f'0.0::DOUBLE AS b{i}' for i in size)}
           UNION ALL
           SELECT i + 1, {', '.join(f'b{i} - d{i}' for i in size)} FROM ({inner})),
fit AS (SELECT {betas} FROM newton WHERE i = {NEWTON_STEPS}),
judged AS (SELECT *, 1 / (1 + exp(-(b0 + {' + '.join(f'b{i + 1} * ({f} - m{i + 1}) / s{i + 1}' for i, f in enumerate(FITTED_ON))})))
                  AS chance FROM parted, scale, fit)"""


# (table, rule, condition on a bad row)
ROW_RULES = [
    ("risk_category", "risk_id not null", "risk_id IS NULL"),
    ("risk_category", "risk_level not null", "risk_level IS NULL"),
    ("risk_category", "min_score not null", "min_score IS NULL"),
    ("risk_category", "max_score not null", "max_score IS NULL"),
    ("risk_category", "risk_level length", "length(risk_level) > 20"),
    ("loan_type", "loan_type_id not null", "loan_type_id IS NULL"),
    ("loan_type", "type_name not null", "type_name IS NULL"),
    ("loan_type", "base_interest_rate not null", "base_interest_rate IS NULL"),
    ("loan_type", "max_amount not null", "max_amount IS NULL"),
    ("loan_type", "type_name length", "length(type_name) > 80"),
    ("customer", "customer_id not null", "customer_id IS NULL"),
    ("customer", "name not null", "name IS NULL"),
    ("customer", "dob not null", "dob IS NULL"),
    ("customer", "phone not null", "phone IS NULL"),
    ("customer", "email not null", "email IS NULL"),
    ("customer", "name length", "length(name) > 120"),
    ("customer", "phone length", "length(phone) > 15"),
    ("customer", "email length", "length(email) > 150"),
    ("income_details", "income_id not null", "income_id IS NULL"),
    ("income_details", "customer_id not null", "customer_id IS NULL"),
    ("income_details", "monthly_income not null", "monthly_income IS NULL"),
    ("income_details", "employment_type not null", "employment_type IS NULL"),
    ("income_details", "monthly_income > 0", "monthly_income <= 0"),
    ("income_details", "employment_type in domain",
     "employment_type NOT IN ('Salaried', 'Self-Employed', 'Business', 'Retired')"),
    ("income_details", "employment_type length", "length(employment_type) > 50"),
    ("income_details", "company_name length", "length(company_name) > 150"),
    ("address_details", "address_id not null", "address_id IS NULL"),
    ("address_details", "customer_id not null", "customer_id IS NULL"),
    ("address_details", "street length", "length(street) > 200"),
    ("address_details", "city length", "length(city) > 100"),
    ("address_details", "zip_code length", "length(zip_code) > 10"),
    ("credit_history", "history_id not null", "history_id IS NULL"),
    ("credit_history", "customer_id not null", "customer_id IS NULL"),
    ("credit_score", "score_id not null", "score_id IS NULL"),
    ("credit_score", "customer_id not null", "customer_id IS NULL"),
    ("credit_score", "score_value not null", "score_value IS NULL"),
    ("credit_score", "score_value in 300..900", "score_value < 300 OR score_value > 900"),
    ("loan", "loan_id not null", "loan_id IS NULL"),
    ("loan", "customer_id not null", "customer_id IS NULL"),
    ("loan", "loan_type_id not null", "loan_type_id IS NULL"),
    ("loan", "loan_amount not null", "loan_amount IS NULL"),
    ("loan", "interest_rate not null", "interest_rate IS NULL"),
    ("loan", "tenure not null", "tenure IS NULL"),
    ("loan", "loan_amount > 0", "loan_amount <= 0"),
    ("loan", "tenure > 0", "tenure <= 0"),
    ("loan", "current_status in domain",
     "current_status NOT IN ('Active', 'Closed', 'Defaulted')"),
    ("loan", "current_status length", "length(current_status) > 30"),
    ("loan_status_history", "status_history_id not null", "status_history_id IS NULL"),
    ("loan_status_history", "loan_id not null", "loan_id IS NULL"),
    ("loan_status_history", "status_label not null", "status_label IS NULL"),
    ("loan_status_history", "status_label length", "length(status_label) > 30"),
    ("guarantor", "guarantor_id not null", "guarantor_id IS NULL"),
    ("guarantor", "loan_id not null", "loan_id IS NULL"),
    ("guarantor", "name not null", "name IS NULL"),
    ("guarantor", "name length", "length(name) > 120"),
    ("guarantor", "phone length", "length(phone) > 15"),
    ("guarantor", "relationship length", "length(relationship) > 60"),
    ("emi_schedule", "emi_id not null", "emi_id IS NULL"),
    ("emi_schedule", "loan_id not null", "loan_id IS NULL"),
    ("emi_schedule", "due_date not null", "due_date IS NULL"),
    ("emi_schedule", "emi_amount not null", "emi_amount IS NULL"),
    ("emi_schedule", "status in domain", "status NOT IN ('Pending', 'Paid', 'Overdue')"),
    ("emi_schedule", "status length", "length(status) > 15"),
    ("repayment", "repayment_id not null", "repayment_id IS NULL"),
    ("repayment", "emi_id not null", "emi_id IS NULL"),
    ("repayment", "paid_amount not null", "paid_amount IS NULL"),
    ("repayment", "payment_mode in domain",
     "payment_mode NOT IN ('Online', 'UPI', 'Cheque', 'Cash')"),
    ("repayment", "payment_mode length", "length(payment_mode) > 30"),
    ("default_record", "default_id not null", "default_id IS NULL"),
    ("default_record", "loan_id not null", "loan_id IS NULL"),
    ("penalty", "penalty_id not null", "penalty_id IS NULL"),
    ("penalty", "default_id not null", "default_id IS NULL"),
    ("penalty", "penalty_amount not null", "penalty_amount IS NULL"),
]
UNIQUE_RULES = [
    ("risk_category", "risk_id"), ("risk_category", "risk_level"), ("loan_type", "loan_type_id"),
    ("loan_type", "type_name"), ("customer", "customer_id"), ("customer", "phone"),
    ("customer", "email"), ("income_details", "income_id"), ("address_details", "address_id"),
    ("credit_history", "history_id"), ("credit_score", "score_id"), ("loan", "loan_id"),
    ("loan_status_history", "status_history_id"), ("guarantor", "guarantor_id"),
    ("emi_schedule", "emi_id"), ("repayment", "repayment_id"), ("default_record", "default_id"),
    ("penalty", "penalty_id"),
]
REFERENCE_RULES = [
    ("income_details", "customer_id", "customer"), ("address_details", "customer_id", "customer"),
    ("credit_history", "customer_id", "customer"), ("credit_score", "customer_id", "customer"),
    ("credit_score", "risk_id", "risk_category"), ("loan", "customer_id", "customer"),
    ("loan", "loan_type_id", "loan_type"), ("loan_status_history", "loan_id", "loan"),
    ("guarantor", "loan_id", "loan"), ("emi_schedule", "loan_id", "loan"),
    ("repayment", "emi_id", "emi_schedule"), ("default_record", "loan_id", "loan"),
    ("penalty", "default_id", "default_record"),
]
TABLE_LIST = ("risk_category loan_type customer income_details address_details credit_history "
              "credit_score loan loan_status_history guarantor emi_schedule repayment "
              "default_record penalty").split()


def view(table: str) -> str:
    return "borrower" if table == "customer" else table


def validation() -> str:
    parts = [f"SELECT '{t}' AS table_name, '{rule}' AS rule, "
             f"(SELECT count(*) FROM {view(t)} WHERE {bad}) AS n" for t, rule, bad in ROW_RULES]
    parts += [f"SELECT '{t}', '{c} unique', (SELECT count(*) FROM (SELECT {c} FROM {view(t)} "
              f"WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1))"
              for t, c in UNIQUE_RULES]
    parts += [f"SELECT '{t}', '{c} refers to {p}', (SELECT count(*) FROM {view(t)} "
              f"WHERE {c} NOT IN (SELECT {c} FROM {view(p)}))" for t, c, p in REFERENCE_RULES]
    parts.append("SELECT 'credit_score', 'risk_id fits score_value', (SELECT count(*) FROM "
                 "credit_score s LEFT JOIN risk_category r ON s.score_value BETWEEN r.min_score "
                 "AND r.max_score WHERE s.risk_id IS DISTINCT FROM r.risk_id)")
    return " UNION ALL ".join(parts)


def counts(deleted: str | None = None) -> str:
    """Rows per table, leaving out what hangs on the loans in ``deleted``."""
    parts = []
    for t in TABLE_LIST:
        keep = ""
        if deleted:
            loans = f"(SELECT loan_id FROM loan WHERE {deleted})"
            if t in ("loan", "loan_status_history", "guarantor", "emi_schedule",
                     "default_record"):
                keep = f" WHERE loan_id NOT IN {loans}"
            elif t == "repayment":
                keep = (f" WHERE emi_id NOT IN (SELECT emi_id FROM emi_schedule "
                        f"WHERE loan_id IN {loans})")
            elif t == "penalty":
                keep = (f" WHERE default_id NOT IN (SELECT default_id FROM default_record "
                        f"WHERE loan_id IN {loans})")
        parts.append(f"SELECT '{t}' AS table_name, count(*) AS n FROM {view(t)}{keep}")
    return " UNION ALL ".join(parts)


def checked_changes() -> str:
    """The contested changes step by step: each step's changes are judged against the customers
    after the step before, as those of one step do not touch each other."""
    def phone(key: str) -> str:
        return f"concat('98', lpad(CAST({key} AS VARCHAR), 8, '0'))"

    steps = [  # whose turn, op, new key, name, phone
        (1, "upsert", "customer_id", "name", "concat('97', substr(phone, 3, 8))"),
        (2, "upsert", "customer_id", "name", phone("customer_id - 1")),
        (3, "upsert", "customer_id", "name", phone("customer_id - 2")),
        (0, "delete", "customer_id", "name", "phone"),
        (0, "upsert", "customer_id + 2000000000000",
         "CASE WHEN customer_id % 8 <> 0 THEN name END", "concat('96', substr(phone, 3, 8))"),
        (1, "upsert", "customer_id", "name", phone("customer_id + 2"))]
    parts = ["s0 AS (SELECT customer_id, name, phone, email FROM borrower)"]
    for i, (turn, op, key, name, number) in enumerate(steps, 1):
        fault = ("CASE WHEN w.customer_id IN (SELECT customer_id FROM loan) THEN 'used by loan' END"
                 if op == "delete" else
                 f"""CASE WHEN w.name IS NULL THEN 'name not null'
                     WHEN EXISTS (SELECT 1 FROM s{i - 1} h WHERE h.phone = w.phone AND h.customer_id <> w.customer_id)
                       OR EXISTS (SELECT 1 FROM s{i - 1} h WHERE h.email = w.email AND h.customer_id <> w.customer_id)
                     THEN 'duplicate phone or email' END""")
        parts.append(f"""r{i} AS (SELECT *, {fault} AS reason FROM (
            SELECT {i * 10**12} + customer_id AS seq, '{op}' AS op, {key} AS customer_id, {name} AS name,
                   {number} AS phone, email FROM borrower WHERE borrower.customer_id % 4 = {turn}) w)""")
        after = (f"SELECT * FROM s{i - 1} WHERE customer_id NOT IN "
                 f"(SELECT customer_id FROM r{i} WHERE reason IS NULL)")
        if op == "upsert":
            after += f" UNION ALL SELECT customer_id, name, phone, email FROM r{i} WHERE reason IS NULL"
        parts.append(f"s{i} AS ({after})")
    refused = "\n".join(f"UNION ALL SELECT customer_id, NULL, NULL, NULL, NULL, seq, op, reason "
                        f"FROM r{i} WHERE reason IS NOT NULL" for i in range(1, 7))
    return f"""WITH {", ".join(parts)}
SELECT customer_id, name, phone, email,
       (SELECT count(*) FROM income_details i WHERE i.customer_id = s6.customer_id) AS incomes,
       NULL AS seq, NULL AS op, NULL AS reason FROM s6
{refused}"""


def ranked_penalties(group: str) -> str:
    return f"""
SELECT {group}, sum(d.charged) AS total_penalty, count(*) AS default_count,
       rank() OVER (ORDER BY sum(d.charged) DESC) AS penalty_rank,
       dense_rank() OVER (ORDER BY count(*) DESC) AS default_rank
FROM ({DEFAULTS_BY_CUSTOMER}) d JOIN borrower b USING (customer_id)
WHERE d.charges > 0 GROUP BY {group}"""


CORE: dict[str, str] = {
    "table_row_counts": counts(),
    "load_tables": "\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, 2 AS version, count(*) AS n, coalesce(sum(('0x' || md5(concat_ws("
        f"'|', {', '.join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in column_types(name))}))[1:8])::BIGINT), 0)"
        f" AS digest FROM {'borrower' if name == 'customer' else name}" for name in TABLES),
    "preview_table": "SELECT * FROM loan ORDER BY loan_id LIMIT 20",
    "read_query": """
SELECT employment_type, count(*) AS loans, sum(loan_amount) AS amount
FROM income_details JOIN loan USING (customer_id) GROUP BY employment_type""",
    "export_table": "SELECT * FROM loan",
    "export_all_tables": f"SELECT *, 0 AS changed FROM ({counts()})",
    "export_query_csv": MONTHS,
    "top_defaulters": f"""
SELECT b.customer_id, b.name, b.phone, count(*) AS total_defaults,
       sum(d.overdue_days * greatest(d.charges, 1)) AS total_overdue_days,
       coalesce(sum(d.charged), 0) AS total_penalty_paid,
       max(n.score_value) AS latest_credit_score
FROM ({DEFAULTS_BY_CUSTOMER}) d JOIN borrower b USING (customer_id)
LEFT JOIN newest n USING (customer_id) GROUP BY b.customer_id, b.name, b.phone""",
    "monthly_collections_by_mode": f"""
SELECT month AS collection_month, n AS payments_count, total AS total_collected,
       {mean_money("total", "n", 6)} AS avg_emi_paid, online AS online_collected,
       upi AS upi_collected
FROM (SELECT strftime(payment_date, '%Y-%m') AS month, count(*) AS n, sum(paid_amount) AS total,
             sum(CASE payment_mode WHEN 'Online' THEN paid_amount END) AS online,
             sum(CASE payment_mode WHEN 'UPI' THEN paid_amount END) AS upi
      FROM repayment GROUP BY month)""",
    "score_trend": f"SELECT *, {half_up('total3', 'n3', 2)} AS rolling_avg_score "
                   f"FROM ({score_sequence(True)})",
    "score_trend_raw": f"SELECT *, {half_up('total3', 'n3', 6)} AS rolling_avg "
                       f"FROM ({score_sequence(False)})",
    "loan_type_performance": f"""
SELECT type_name, n AS total_loans, active AS active_loans, closed AS closed_loans,
       bad AS defaulted_loans, {half_up("(n - bad) * 100", "n", 2)} AS success_rate_pct,
       {mean_money("amount", "n", 2)} AS avg_loan_amount, amount AS total_disbursed
FROM ({BY_TYPE})""",
    "loan_type_exposure": f"""
SELECT type_name, n AS loan_count, coalesce(amount, 0) AS total_exposure,
       {mean_money("rates", "n", 2)} AS avg_rate, bad AS defaults FROM ({BY_TYPE})""",
    "portfolio_summary": f"""
SELECT type_name, n AS loans, amount AS total_disbursed,
       {mean_money("rates", "n", 2)} AS avg_rate FROM ({BY_TYPE})""",
    "eligible_customers": eligible(
        "b.customer_id, b.name, i.monthly_income, i.employment_type, n.score_value AS credit_score,"
        " r.risk_level, h.total_defaults, (SELECT count(*) FROM loan l "
        "WHERE l.customer_id = b.customer_id AND l.current_status = 'Active') AS active_loans"),
    "eligible_simple": eligible("b.customer_id, b.name, i.monthly_income, n.score_value"),
    "risk_distribution": f"""
SELECT risk_level, people AS customer_count, n AS loan_count, amount AS total_exposure,
       {mean_money("rates", "n", 2)} AS avg_interest_rate
FROM (SELECT r.risk_level, count(DISTINCT s.customer_id) AS people, count(l.loan_id) AS n,
             sum(l.loan_amount) AS amount, sum(l.interest_rate) AS rates
      FROM newest s JOIN risk_category r USING (risk_id) LEFT JOIN loan l USING (customer_id)
      GROUP BY r.risk_level)""",
    "emi_status_summary": f"""
SELECT loan_id, name AS customer_name, type_name AS loan_type, loan_amount, n AS total_emis,
       paid AS paid_emis, overdue AS overdue_emis, n - paid - overdue AS pending_emis,
       {half_up("paid * 100", "n", 2)} AS repayment_pct
FROM (SELECT l.loan_id, l.name, l.type_name, l.loan_amount, count(e.emi_id) AS n,
             count(CASE e.status WHEN 'Paid' THEN 1 END) AS paid,
             count(CASE e.status WHEN 'Overdue' THEN 1 END) AS overdue
      FROM ({LOANS}) l LEFT JOIN emi_schedule e USING (loan_id) GROUP BY ALL)""",
    "penalty_leaderboard": ranked_penalties("b.customer_id, b.name"),
    "penalty_rank_by_name": f"SELECT name, total_penalty, penalty_rank AS rank "
                            f"FROM ({ranked_penalties('b.name')})",
    "income_capacity": capacity("greatest(n, 1)"),
    "income_capacity_exact": capacity("1"),
    "cumulative_repayment": """
SELECT *, loan_amount - cumulative_repaid AS estimated_outstanding
FROM (SELECT g.customer_id, b.name, g.month, g.loan_amount, g.paid AS monthly_repayment,
             (SELECT sum(x.paid_amount) FROM p x
              WHERE x.customer_id = g.customer_id AND x.month <= g.month) AS cumulative_repaid
      FROM (SELECT customer_id, loan_amount, month, sum(paid_amount) AS paid FROM p
            GROUP BY ALL) g
      JOIN borrower b USING (customer_id))""",
    "cumulative_repayment_by_loan": """
SELECT *, loan_amount - cumulative_repaid AS outstanding
FROM (SELECT g.customer_id, b.name, g.loan_id, g.month, g.loan_amount,
             g.paid AS monthly_repayment,
             (SELECT sum(x.paid_amount) FROM p x
              WHERE x.loan_id = g.loan_id AND x.month <= g.month) AS cumulative_repaid
      FROM (SELECT customer_id, loan_id, loan_amount, month, sum(paid_amount) AS paid FROM p
            GROUP BY ALL) g
      JOIN borrower b USING (customer_id))""",
    "top_defaulters_simple": """
SELECT b.customer_id, b.name, count(DISTINCT d.default_id) AS defaults,
       sum(d.overdue_days) AS total_overdue
FROM borrower b, loan l, default_record d
WHERE l.customer_id = b.customer_id AND d.loan_id = l.loan_id GROUP BY b.customer_id, b.name""",
    "collections_simple": f"SELECT month, total_collected AS total FROM ({MONTHS})",
    "customer_directory": DIRECTORY,
    "customer_profile": f"""
SELECT d.*, h.total_loans, h.total_defaults
FROM ({DIRECTORY}) d LEFT JOIN credit_history h USING (customer_id)""",
    "customer_search": f"""
SELECT * FROM ({DIRECTORY}) WHERE regexp_matches(name, '{SEARCH_PATTERN}', 'i')
   OR regexp_matches(coalesce(city, ''), '{SEARCH_PATTERN}', 'i')
   OR regexp_matches(email, '{SEARCH_PATTERN}', 'i')""",
    "score_history": "SELECT * FROM credit_score JOIN risk_category USING (risk_id)",
    "latest_score": "SELECT * FROM newest JOIN risk_category USING (risk_id)",
    "latest_score_all_ties": LATEST_TIES,
    "score_histogram": f"""
SELECT least(300 + (score_value - 300) // 30 * 30, 870) AS bin_start, risk_level, count(*) AS n
FROM ({LATEST_TIES}) GROUP BY ALL""",
    "customer_loans": LOANS,
    "all_loans": f"SELECT *, name AS customer_name FROM ({LOANS})",
    "recent_loans": f"SELECT *, name AS customer, type_name AS type FROM ({LOANS}) "
                    "ORDER BY loan_id DESC LIMIT 10",
    "emi_ledger": LEDGER,
    "overdue_emis": "SELECT * FROM emi_schedule WHERE status = 'Overdue'",
    "payable_emis": f"SELECT * FROM ({LEDGER}) WHERE status <> 'Paid'",
    "overdue_worklist": f"""
SELECT e.emi_id, l.name AS customer, l.loan_id, l.type_name, e.due_date, e.emi_amount,
       DATE '{AS_OF}' - e.due_date AS days_overdue
FROM emi_schedule e JOIN ({LOANS}) l USING (loan_id) WHERE e.status = 'Overdue'
ORDER BY e.due_date, e.emi_id LIMIT 20""",
    "repayment_progress": f"""
SELECT l.loan_id, count(*) FILTER (WHERE x.status = 'Paid') AS paid,
       count(*) FILTER (WHERE x.status = 'Overdue') AS overdue,
       count(*) FILTER (WHERE x.status = 'Pending') AS pending, count(x.emi_id) AS total,
       coalesce(paid / nullif(total, 0), 0) AS paid_fraction
FROM loan l LEFT JOIN ({LEDGER}) x USING (loan_id) GROUP BY l.loan_id""",
    "loan_penalty_total": """
SELECT l.loan_id, coalesce(sum(p.penalty_amount), 0) AS penalty_total
FROM loan l LEFT JOIN default_record d USING (loan_id) LEFT JOIN penalty p USING (default_id)
GROUP BY l.loan_id""",
    "portfolio_kpis": """
SELECT (SELECT count(*) FROM borrower) AS total_customers,
       (SELECT count(*) FROM loan WHERE current_status = 'Active') AS active_loans,
       (SELECT count(DISTINCT loan_id) FROM default_record) AS defaulters,
       (SELECT coalesce(sum(penalty_amount), 0) FROM penalty) AS penalties_collected""",
    "loans_by_risk": """
SELECT coalesce(r.risk_level, 'Unknown') AS risk_level, count(*) AS loan_count,
       sum(l.loan_amount) AS total_amount
FROM loan l LEFT JOIN newest n USING (customer_id) LEFT JOIN risk_category r USING (risk_id)
GROUP BY 1""",
    "monthly_repayments": MONTHS,
    "monthly_repayments_rolling": f"""
SELECT month, total_collected, payment_count, {mean_money("s3", "n3", 6)} AS rolling_avg
FROM (SELECT *, sum(total_collected) OVER three AS s3, count(*) OVER three AS n3
      FROM ({MONTHS})
      WINDOW three AS (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))""",
    "defaulters_table": f"""
SELECT l.customer_id, l.name, b.phone, l.loan_id, l.type_name AS loan_type, l.loan_amount,
       d.default_date, d.overdue_days, coalesce(p.penalty_amount, 0) AS penalty_amount
FROM default_record d JOIN ({LOANS}) l USING (loan_id) JOIN borrower b USING (customer_id)
LEFT JOIN penalty p USING (default_id)""",
    "loan_status_breakdown": "SELECT current_status, count(*) AS count FROM loan "
                             "GROUP BY current_status",
    "emi_quote": f"""
SELECT *, emi * tenure AS total_payable, emi * tenure - CAST(loan_amount AS DOUBLE)
           AS total_interest
FROM (SELECT *, {PAYMENT} AS emi FROM loan)""",
    "emi_schedule_generate": f"SELECT *, 'Pending' AS status FROM ({schedule('tenure', True)})",
    "emi_schedule_backfill": f"""
SELECT *, CASE WHEN due_date < DATE '{CUTOFF}' THEN 'Paid'
               WHEN due_date < DATE '{AS_OF}' THEN 'Overdue' ELSE 'Pending' END AS status
FROM ({schedule("least(tenure, 12)", False)})""",
    "repayments_from_schedule": """
SELECT emi_id AS repayment_id, emi_id, emi_amount AS paid_amount, due_date + 2 AS payment_date,
       (['Online', 'UPI', 'Cheque', 'Cash'])[emi_id % 4 + 1] AS payment_mode
FROM emi_schedule WHERE status = 'Paid'""",
    "mark_overdue": f"""
SELECT * REPLACE (CASE WHEN status = 'Pending' AND due_date < DATE '{AS_OF}' THEN 'Overdue'
                       ELSE status END AS status) FROM emi_schedule""",
    "detect_defaults": f"SELECT *, DATE '{AS_OF}' AS default_date FROM late",
    "assess_penalties": f"SELECT *, DATE '{AS_OF}' AS default_date, {PENALTY} AS penalty_amount "
                        "FROM late",
    "default_sweep": f"""
WITH marked AS (SELECT * REPLACE (
        CASE WHEN status = 'Pending' AND due_date < DATE '{AS_OF}' THEN 'Overdue' ELSE status END
        AS status) FROM emi_schedule),
bad AS (SELECT loan_id, CAST(DATE '{AS_OF}' - min(due_date) AS INTEGER) AS overdue_days,
               sum(emi_amount) AS overdue_total
        FROM marked ANTI JOIN default_record USING (loan_id) WHERE status = 'Overdue'
        GROUP BY loan_id)
SELECT loan_id, row_number() OVER (ORDER BY loan_id) + (SELECT max(default_id) FROM default_record)
           AS default_id,
       DATE '{AS_OF}' AS default_date, overdue_days,
       row_number() OVER (ORDER BY loan_id) + (SELECT max(penalty_id) FROM penalty) AS penalty_id,
       {PENALTY} AS penalty_amount,
       'Defaulted' AS current_status,
       1 + (SELECT count(*) FROM loan_status_history h WHERE h.loan_id = bad.loan_id) AS log_rows
FROM bad""",
    "apply_status_changes": f"""
SELECT loan_id, customer_id, CASE WHEN loan_id IN ({FULLY_PAID}) THEN 'Closed'
       ELSE current_status END AS current_status FROM loan""",
    "apply_status_changes_log": f"""
SELECT * FROM loan_status_history UNION ALL
SELECT row_number() OVER (ORDER BY loan_id) + (SELECT max(status_history_id)
           FROM loan_status_history), loan_id, 'Closed', DATE '{AS_OF}' FROM ({FULLY_PAID})""",
    "apply_payments": f"""
SELECT * REPLACE (CASE WHEN emi_id IN (SELECT emi_id FROM emi_schedule WHERE {DUE_AND_OPEN})
                       THEN 'Paid' ELSE status END AS status) FROM emi_schedule""",
    "apply_payments_ledger": f"""
SELECT * FROM repayment UNION ALL
SELECT row_number() OVER (ORDER BY emi_id, emi_amount) + (SELECT max(repayment_id) FROM repayment),
       emi_id,
       CAST(({cents("emi_amount")} + 1) // 2 AS DECIMAL(14,2)) / 100, DATE '{AS_OF}', 'UPI'
FROM emi_schedule WHERE {DUE_AND_OPEN}""",
    "disburse_loans": f"""
SELECT row_number() OVER (ORDER BY a.application_id) + (SELECT max(loan_id) FROM loan) AS loan_id,
       a.customer_id, a.loan_amount, 'Active' AS current_status, 2 AS log_rows,
       a.tenure AS instalments, CAST(DATE '{AS_OF}' + INTERVAL 1 MONTH AS DATE) AS first_due,
       CAST(DATE '{AS_OF}' + to_months(CAST(a.tenure AS INTEGER)) AS DATE) AS last_due,
       CAST({PAYMENT} AS DECIMAL(12,2)) * a.tenure AS scheduled, a.backer AS guarantor,
       a.backer_phone AS phone, a.score_value,
       CASE WHEN a.score_value > 750 THEN 1 WHEN a.score_value > 600 THEN 2 ELSE 3 END AS risk_id
FROM ({APPROVED}) a""",
    "disburse_loans_counters": f"""
SELECT h.customer_id, h.total_loans + coalesce(a.n, 0) AS total_loans, h.total_defaults,
       CASE WHEN a.n > 0 THEN DATE '{AS_OF}' ELSE h.last_updated END AS last_updated
FROM credit_history h LEFT JOIN (SELECT customer_id, count(*) AS n FROM ({APPROVED})
                                 GROUP BY customer_id) a USING (customer_id)""",
    "assign_risk_band": """
SELECT s.* EXCLUDE (risk_id), r.risk_id FROM credit_score s
LEFT JOIN risk_category r ON s.score_value >= r.min_score AND s.score_value <= r.max_score""",
    "register_customers": """
WITH judged AS (
    SELECT *, row_number() OVER (PARTITION BY phone ORDER BY request_id) AS phone_turn,
           row_number() OVER (PARTITION BY email ORDER BY request_id) AS email_turn
    FROM request WHERE phone IS NOT NULL AND phone NOT IN (SELECT phone FROM borrower)),
good AS (SELECT * FROM judged WHERE phone_turn = 1 AND email_turn = 1)
SELECT request_id, row_number() OVER (ORDER BY request_id)
           + (SELECT max(customer_id) FROM borrower) AS customer_id, name,
       phone, email, monthly_income, city, 0 AS total_loans, NULL AS reason FROM good
UNION ALL
SELECT request_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       CASE WHEN phone IS NULL THEN 'missing field' ELSE 'duplicate contact' END
FROM request WHERE request_id NOT IN (SELECT request_id FROM good)""",
    "apply_changes": """
SELECT customer_id, name, dob, phone,
       CASE WHEN employment_type = 'Retired' THEN 'retired.' || email ELSE email END AS email
FROM borrower JOIN income_details USING (customer_id) SEMI JOIN loan USING (customer_id)
UNION ALL
SELECT 1000000000000 + request_id, name, DATE '1980-01-01', CAST(request_id AS VARCHAR), email
FROM request""",
    "apply_checked_changes": checked_changes(),
    "cascade_delete": counts("current_status = 'Defaulted'"),
    "credit_history_rollup": """
SELECT *, stored_loans <> actual_loans OR stored_defaults <> actual_defaults AS drifted FROM (
SELECT b.customer_id, coalesce(h.total_loans, 0) AS stored_loans,
       (SELECT count(*) FROM loan l WHERE l.customer_id = b.customer_id) AS actual_loans,
       coalesce(h.total_defaults, 0) AS stored_defaults,
       (SELECT count(*) FROM loan l JOIN default_record d USING (loan_id)
        WHERE l.customer_id = b.customer_id) AS actual_defaults
FROM borrower b LEFT JOIN credit_history h USING (customer_id)
WHERE h.customer_id IS NOT NULL OR b.customer_id IN (SELECT customer_id FROM loan))""",
    "status_timeline": """
SELECT *, lag(status_label) OVER seq AS previous_status,
       change_date - lag(change_date) OVER seq AS days_since_previous
FROM loan_status_history
WINDOW seq AS (PARTITION BY loan_id ORDER BY change_date, status_history_id)""",
    "validate_tables": validation(),
    "application_input_checks": """
SELECT a.loan_id AS application_id, concat_ws('; ',
       CASE WHEN a.loan_amount < 10000 OR a.loan_amount > ty.max_amount
            THEN 'amount out of range' END,
       CASE WHEN NOT list_contains([12, 18, 24, 36, 48, 60, 84, 120, 180, 240, 300, 360],
                                   a.tenure) THEN 'tenure not offered' END,
       CASE WHEN a.interest_rate < 5 OR a.interest_rate > 25 THEN 'rate out of range' END)
       AS problems
FROM loan a JOIN loan_type ty USING (loan_type_id)""",
    "payment_input_checks": """
SELECT p.repayment_id AS request_id,
       CASE WHEN p.paid_amount < 0.01 OR p.paid_amount > 1.5 * e.emi_amount
            THEN 'amount out of range' ELSE '' END AS problems
FROM repayment p JOIN emi_schedule e USING (emi_id)""",
    "encode_employment": """
SELECT income_id, employment_type,
       coalesce(map_extract_value(MAP {'Salaried': 3, 'Self-Employed': 2, 'Business': 4,
                                       'Retired': 1}, employment_type), 2) AS employment_enc
FROM income_details""",
    "application_features": """
SELECT application_id, customer_id, income AS monthly_income, employment_type, employment_enc,
       loans AS total_loans, defaults AS total_defaults, loan_amount, tenure, interest_rate,
       NULL AS problem
FROM application""",
    "rule_credit_score": "SELECT * FROM scored",
    "rule_risk_level": "SELECT *, CASE WHEN score_value > 750 THEN 'Low' WHEN score_value > 600 "
                       "THEN 'Medium' ELSE 'High' END AS risk_level FROM scored",
    "rule_default_score": "SELECT *, CAST(default_score > 0.4 AS INTEGER) AS will_default "
                          "FROM scored",
    "decision_reasons": f"""
SELECT *, upper(substr(why, 1, 1)) || substr(why, 2) AS reasons
FROM (SELECT *, {BASIS_POINTS} / 10000 AS default_probability, concat_ws('; ',
             CASE WHEN score_value <= 600
                  THEN 'credit score ' || score_value || ' is below 600' END,
             CASE WHEN {BASIS_POINTS} >= 4000
                  THEN 'default probability ' || ({TENTHS} // 10) || '.' || ({TENTHS} % 10)
                       || '% exceeds 40%' END) AS why FROM scored)""",
    "train_score_model": f"SELECT count(*) AS rows, true AS mae_ok, true AS r2_ok FROM scored "
                         f"WHERE {BUCKET} < 2000",
    "train_risk_model": held_out(LEVEL),
    "train_default_model": f"""
WITH RECURSIVE {newton()}
SELECT count(*) AS rows, count(*) FILTER ((chance > 0.5) = (y = 1)) AS hits,
       count(*) FILTER (chance > 0.5 AND y = 1) AS caught,
       count(*) FILTER (chance <= 0.5 AND y = 1) AS missed,
       count(*) FILTER (chance > 0.5 AND y = 0) AS false_alarms, any_value(b0) AS intercept,
       {', '.join(f'any_value(b{i + 1}) AS on_{f}' for i, f in enumerate(FITTED_ON))}
FROM judged WHERE test""",
    "predict_score": "SELECT application_id, true AS in_range, true AS near_scorecard FROM scored",
    "predict_risk": f"SELECT application_id, (SELECT count(DISTINCT {LEVEL}) FROM scored) AS levels, "
                    "true AS sums_to_one, true AS level_is_likeliest FROM scored",
    "predict_default": f"""
WITH RECURSIVE {newton()}
SELECT application_id, chance AS default_probability, 1 - chance AS no_default_probability,
       chance > 0.5 AS default_expected,
       CASE WHEN chance > 0.75 THEN 'Very High' WHEN chance > 0.55 THEN 'High'
            WHEN chance > 0.35 THEN 'Moderate' ELSE 'Low' END AS default_confidence
FROM judged""",
    "assess_applications": "SELECT application_id, true AS in_range, true AS approval_follows, "
                           "true AS reasons_follow FROM scored",
    "model_store": "SELECT application_id, true AS same FROM scored",
    "stream_apply_payments": f"SELECT * FROM repayment WHERE payment_date >= DATE '{CUTOFF}'",
    "stream_monthly_collections": MONTHS,
}

CORE |= {
    "stream_settled_instalments": "SELECT * FROM emi_schedule",
    "customer_profile_one": f"SELECT * FROM ({CORE['customer_profile']}) WHERE customer_id = "
                            "(SELECT min(customer_id) FROM credit_history)",
    "score_history_one": f"SELECT * FROM ({CORE['score_history']}) WHERE customer_id = "
                         "(SELECT min(customer_id) FROM credit_score)",
    "latest_score_one": f"SELECT * FROM ({CORE['latest_score']}) WHERE customer_id = "
                        "(SELECT min(customer_id) FROM credit_score)",
    "customer_loans_one": f"SELECT * FROM ({LOANS}) WHERE customer_id = "
                          "(SELECT min(customer_id) FROM loan)",
    "emi_ledger_one": f"SELECT * FROM ({LEDGER}) WHERE loan_id = "
                      "(SELECT min(loan_id) FROM emi_schedule)",
    "defaulters_table_by_penalty": CORE["defaulters_table"],
    "defaulters_table_by_amount": CORE["defaulters_table"],
}


def _with_views(core: str) -> str:
    """The views the text names, and those they name, as leading WITH entries."""
    needed: set[str] = set()
    waiting = [core]
    while waiting:
        text = waiting.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                waiting.append(VIEWS[name])
    return ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed)


def _shown(name: str, kind: str) -> str:
    digits = {"m": 2, "r": 6, "q": 4}
    types = {"b": "BIGINT", "i": "INTEGER", "s": "VARCHAR", "f": "DOUBLE", "t": "BOOLEAN"}
    if kind in digits:
        return f"CAST(CAST({name} AS DECIMAL(38,{digits[kind]})) AS DOUBLE) AS {name}"
    if kind == "d":
        return f"CAST(CAST({name} AS DATE) AS VARCHAR) AS {name}"
    return f"CAST({name} AS {types[kind]}) AS {name}"


def oracle(name: str) -> str:
    """Complete SQL for a named query, with exactly the columns its entry declares."""
    core = CORE[name]
    if re.search(r"\bFROM p\b", core):
        core = f"WITH p AS ({PAID}) {core}"
    columns = ",\n       ".join(_shown(n, k) for n, k in parsed(COLUMNS[name]))
    return f"WITH {_with_views(core)},\nresult AS ({core})\nSELECT {columns}\nFROM result"
