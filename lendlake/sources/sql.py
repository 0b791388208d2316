"""Running SQL text over the tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lendlake.schema import TABLES
from lendlake.sources.tables import Tables


def read_query(spark: SparkSession, t: Tables, sql: str) -> DataFrame:
    """A SELECT naming tables in braces: ``SELECT count(*) FROM {loan}``.

    Only the tables named are built, and no view is left behind in the session.
    """
    used = set(re.findall(r"\{(\w+)\}", sql)) & set(TABLES)
    return spark.sql(sql, **{name: t[name] for name in used})


def register_views(t: Tables, prefix: str = "") -> None:
    """Temporary views under the plain table names, for SQL written without braces."""
    for name in TABLES:
        t[name].createOrReplaceTempView(f"{prefix}{name}")
