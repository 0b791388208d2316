"""The bundle of the 14 tables every operator takes, and its Parquet/CSV reader."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlake.functions.workspace import side_by_side
from lendlake.schema import COLUMNS, KEY, TABLES

# CSV as other programs write it: quotes doubled inside quotes. NULL is \\N, as an empty field is an
# empty text; a text that is \\N itself cannot be told from NULL.
CSV = {"header": "true", "quote": '"', "escape": '"', "nullValue": "\\N",
       "emptyValue": '""', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# A malformed field ends the job; it never becomes NULL.
CSV_READ = {**CSV, "emptyValue": "", "multiLine": "true", "mode": "FAILFAST"}

Frame = DataFrame | Callable[[], DataFrame]


class Tables:
    """The 14 tables as attributes; a frame is only built when it is first asked for."""

    def __init__(self, frames: Mapping[str, Frame]):
        unknown = set(frames) - set(TABLES)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self._frames: dict[str, Frame] = dict(frames)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise ValueError(f"table {name!r} is not one of {', '.join(TABLES)}")
        frame = self._frames[name]
        if not isinstance(frame, DataFrame):
            frame = self._frames[name] = frame()
        return frame

    def __contains__(self, name: str) -> bool:
        return name in self._frames

    def replace(self, **frames: DataFrame) -> Tables:
        """A new snapshot in which the given tables stand in for the old ones."""
        return Tables({**self._frames, **frames})

    def append(self, **rows: DataFrame) -> Tables:
        """A new snapshot with rows added to the given tables."""
        return self.replace(**{n: self[n].unionByName(r) for n, r in rows.items()})


def load_tables(spark: SparkSession, path: str, fmt: str = "parquet") -> Tables:
    """Read ``path/<table>`` for every table with its declared schema (no inference job)."""
    options = CSV_READ if fmt == "csv" else {}

    def reader(name: str) -> Callable[[], DataFrame]:
        return lambda: (spark.read.format(fmt).options(**options)
                        .schema(COLUMNS[name]).load(f"{path}/{name}"))

    return Tables({name: reader(name) for name in TABLES})


# Rows of one customer or loan lie together, so that a look-up by id skips most row groups. The
# key ends every list: a customer with very many rows still spreads over several files.
LAYOUT: dict[str, tuple[str, ...]] = {
    "income_details": ("customer_id", "income_id"),
    "address_details": ("customer_id", "address_id"),
    "credit_history": ("customer_id", "history_id"),
    "credit_score": ("customer_id", "score_id"),
    "loan": ("customer_id", "loan_id"),
    "loan_status_history": ("loan_id", "status_history_id"),
    "guarantor": ("loan_id", "guarantor_id"),
    "emi_schedule": ("loan_id", "emi_id"),
    "repayment": ("emi_id", "repayment_id"),
    "default_record": ("loan_id", "default_id"),
    "penalty": ("default_id", "penalty_id"),
}


def save_tables(t: Tables, path: str) -> None:
    """Write a snapshot as Parquet, one folder per table, for ``load_tables`` to read.

    ``path`` must be new: a snapshot is never written over the files it is read from. A job that
    ends early leaves part of a snapshot; use ``publish_tables`` where readers must not see that.
    """
    frames = {name: t[name] for name in TABLES}

    def write(name: str) -> None:
        order = LAYOUT.get(name, (KEY[name],))
        (frames[name].repartitionByRange(*order).sortWithinPartitions(*order)
         .write.mode("error").parquet(f"{path}/{name}"))

    side_by_side(frames[TABLES[0]].sparkSession, write, TABLES)


MANIFEST = "version BIGINT, folder STRING"


def _manifests(spark: SparkSession, root: str) -> DataFrame | None:
    """What has been published in ``root``; None if nothing has."""
    try:
        return spark.read.schema(MANIFEST).json(f"{root}/manifests/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def publish_tables(t: Tables, root: str) -> int:
    """Write a snapshot into ``root`` and publish it whole; returns its version, from 1.

    The 14 tables go to a new folder that no reader knows. Only when all are written a manifest of
    one row names it, in a folder of the new version: one file, which appears at once or not at all.
    So a crash at any time leaves the newest published version in force. Of two jobs that publish at
    the same time one fails, as the version's folder is there already, and may try again. Folders
    that no manifest names are left-overs of such jobs; their owner may remove them.
    """
    spark = t[TABLES[0]].sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    save_tables(t, f"{root}/{folder}")
    before = _manifests(spark, root)
    newest = before.agg(F.max("version")).first()[0] if before is not None else None
    version = (newest or 0) + 1
    spark.createDataFrame([(version, folder)], MANIFEST).coalesce(1).write.mode("error").json(
        f"{root}/manifests/{version}")
    return version


def load_published(spark: SparkSession, root: str, version: int | None = None) -> Tables:
    """The tables of a published version, by default the newest."""
    known = _manifests(spark, root)
    row = None if known is None else (
        known if version is None else known.where(F.col("version") == version)
    ).orderBy(F.desc("version")).first()
    if row is None:
        raise ValueError(f"nothing is published in {root}" if version is None
                         else f"version {version} is not published in {root}")
    return load_tables(spark, f"{root}/{row['folder']}")
