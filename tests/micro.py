"""Small hand-made tables."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from lendlake.schema import COLUMNS, TABLES, column_names
from lendlake.sources.star import LOAN_TYPES, RISK_BANDS, catalogue
from lendlake.sources.tables import Tables

D = Decimal


def d(text: str | None) -> date | None:
    return None if text is None else date.fromisoformat(text)


def frame(spark, table: str, rows: list[tuple]):
    return spark.createDataFrame(rows, COLUMNS[table])


def micro(spark, **rows: list[tuple]) -> Tables:
    """Given tables from tuples, catalogue tables by default, everything else empty."""
    built = {name: frame(spark, name, rows.get(name, [])) for name in TABLES}
    if "risk_category" not in rows:
        built["risk_category"] = catalogue(spark, "risk_category", RISK_BANDS)
    if "loan_type" not in rows:
        built["loan_type"] = catalogue(spark, "loan_type", LOAN_TYPES)
    return Tables(built)


def customer(key: int, name: str | None = None) -> tuple:
    return (key, name or f"C{key}", d("1980-01-01"), f"p{key}", f"e{key}@x", None)


def loan(key: int, owner: int, amount="1000.00", kind=1, rate="12.00", tenure=12,
         status="Active", start="2024-01-31") -> tuple:
    return (key, owner, kind, D(amount), D(rate), tenure, status, d(start))


def emi(key: int, loan_id: int, due: str, amount="100.00", status="Pending") -> tuple:
    return (key, loan_id, d(due), D(amount), status)


def rows(df, *columns: str) -> list[tuple]:
    """The result in its own order."""
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def names(table: str) -> list[str]:
    return column_names(table)
