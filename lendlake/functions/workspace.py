"""Shared scratch space: reliable checkpoints, folders for intermediate files, and who removes them."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from multiprocessing.pool import ThreadPool

from py4j.java_gateway import JavaObject
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
WRITES_AT_ONCE = 4
_HELD: ContextVar[list[str] | None] = ContextVar("held", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder all nodes share: the session's checkpoint directory.

    Only a local session without one gets a temporary folder; on a cluster its absence is an
    error, because a machine-local folder is invisible to the other executors.
    """
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder all nodes can reach")
        folder = tempfile.mkdtemp(prefix="lendlake-")
        warnings.warn(f"{SETTING} is not set: scratch tables go to {folder}", stacklevel=2)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, folder: str) -> tuple[JavaObject, JavaObject]:
    """The file system that holds a folder, and the folder's path there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder with all it holds; nothing happens if there is none."""
    system, path = _path(spark, folder)
    system.delete(path, True)


@contextmanager
def lease(spark: SparkSession) -> Iterator[list[str]]:
    """Scratch tables written inside the block are removed when it ends, also by an error.

    Frames made inside read those tables, so their results are written or collected before the end.
    Blocks may be nested: each removes what was written while it was the innermost of its thread.
    Yields the folders held so far.
    """
    held: list[str] = []
    token = _HELD.set(held)
    try:
        yield held
    finally:
        _HELD.reset(token)
        for folder in held:
            remove_folder(spark, folder)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read back, so that it is computed once.

    The folder goes with the innermost ``lease`` of this thread, and without one when the driver's
    process ends. A driver that is killed leaves it.
    """
    spark = df.sparkSession
    folder = new_folder(spark, purpose)
    held = _HELD.get()
    if held is not None:
        held.append(folder)  # before it is written: a failed write leaves files too
    df.write.parquet(folder)
    if held is None:
        system, path = _path(spark, folder)
        system.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame written to the reliable checkpoint folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def side_by_side(spark: SparkSession, write: Callable[[str], None], names: Iterable[str]) -> None:
    """Writes that do not depend on each other, a few at a time: the last tasks of one leave cores to
    the next. Ends when all have ended; an error of one is raised."""
    with ThreadPool(WRITES_AT_ONCE) as pool:
        pool.map(inheritable_thread_target(spark)(write), names, chunksize=1)
