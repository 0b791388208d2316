"""CSV exports that come back unchanged: quotes, line breaks, outer blanks, '' and NULL survive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lendlake.functions.workspace import side_by_side
from lendlake.schema import KEY, TABLES
from lendlake.sources.tables import CSV, Tables


def export_query_csv(df: DataFrame, path: str) -> None:
    """Any result as a folder of CSV files with headers, written in parallel."""
    df.write.mode("error").options(**CSV).csv(path)


def export_table(t: Tables, name: str, path: str, fmt: str = "csv") -> None:
    """A whole table ordered by its first column; file names follow the order."""
    ordered = t[name].orderBy(KEY[name])
    if fmt == "csv":
        export_query_csv(ordered, path)
    else:
        ordered.write.mode("error").format(fmt).save(path)


def export_all_tables(t: Tables, path: str) -> None:
    """All 14 tables as CSV, one folder per table."""
    frames = {name: t[name] for name in TABLES}  # built here, in the caller's thread
    side_by_side(frames[TABLES[0]].sparkSession,
                 lambda name: export_table(t, name, f"{path}/{name}"), TABLES)
