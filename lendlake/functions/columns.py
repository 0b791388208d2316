"""Column expressions shared by the operators. All run inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Employment codes used by the scoring models; anything else is 2.
EMPLOYMENT_CODES = {"Salaried": 3, "Self-Employed": 2, "Business": 4, "Retired": 1}
OTHER_EMPLOYMENT = 2

MONTHS_PER_YEAR = 12
PENALTY_RATE = "0.02"
PENALTY_PERIOD_DAYS = 30


def month_start(date: Column | str) -> Column:
    """First day of the month: the cheap grouping key (a date, no formatting per row)."""
    return F.trunc(date, "MM")


def month_text(date: Column | str) -> Column:
    return F.date_format(date, "yyyy-MM")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sum_if(condition: Column, value: Column | str) -> Column:
    """NULL where no row meets the condition."""
    return F.sum(F.when(condition, F.col(value) if isinstance(value, str) else value))


def exact_ratio(numerator: Column, denominator: Column) -> Column:
    """Decimal quotient with 16 fraction digits; NULL for a zero denominator."""
    return (numerator.cast("decimal(22,2)")
            / F.nullif(denominator.cast("decimal(16,2)"), F.lit(0).cast("decimal(16,2)")))


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole to 2 digits, half away from zero; NULL when whole is 0."""
    share = (part.cast("decimal(18,0)") * F.lit(100).cast("decimal(3,0)")
             / F.nullif(whole.cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)")))
    return F.round(share, 2)


def mean_of(total: Column, count: Column) -> Column:
    """total / count with 16 fraction digits (``avg`` stops at 4 more); NULL for no rows."""
    return (total.cast("decimal(24,2)")
            / F.nullif(count.cast("decimal(14,0)"), F.lit(0).cast("decimal(14,0)")))


def instalment(principal: Column, annual_rate: Column, months: Column) -> Column:
    """Level monthly payment of an annuity loan (rate in percent a year), as double."""
    amount, n = principal.cast("double"), months.cast("double")
    rate = annual_rate.cast("double") / F.lit(1200.0)
    growth = F.pow(rate + F.lit(1.0), n)
    return F.when(rate == 0, amount / n).otherwise(amount * rate * growth / (growth - F.lit(1.0)))


def due_date(start: Column, months: Column, eom: str) -> Column:
    """``start`` plus months. A day the month lacks becomes its last day ('clamp') or 28."""
    clamped = F.add_months(start, months)
    if eom == "clamp":
        return clamped
    if eom == "day28":
        cut = F.dayofmonth(clamped) < F.dayofmonth(start)
        return F.when(cut, F.date_add(F.trunc(clamped, "MM"), 27)).otherwise(clamped)
    raise ValueError(f"eom must be 'clamp' or 'day28', not {eom!r}")


def penalty_amount(overdue_total: Column, overdue_days: Column) -> Column:
    """2 % of the overdue sum for each full 30 days late, at least one period."""
    periods = F.greatest(F.lit(1), F.floor(overdue_days / PENALTY_PERIOD_DAYS).cast("int"))
    rate = F.lit(PENALTY_RATE).cast("decimal(2,2)")
    return F.round(overdue_total.cast("decimal(20,2)") * rate * periods, 2)


def employment_code(employment: Column) -> Column:
    code = F.lit(OTHER_EMPLOYMENT)
    for label, value in EMPLOYMENT_CODES.items():
        code = F.when(employment == label, value).otherwise(code)
    return code


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))
