"""Exact deduplication that no large group of copies can hold up.

Texts are combined three times, and each time the whole text is a grouping key, so equal digests
alone never merge two rows: within each input partition (map-side), by digest and salt, and by
digest over the winners of all salts. A group with a third of all rows reaches the last step as
one row for each salt. The way back takes the same steps: winners go to the (digest, salt) pairs
of large groups, and rows meet those pairs, so no task sees more than one salt of a group.

DataFrame functions only; texts are shuffled twice, after equal ones of a partition were merged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlake.llm.shared import prefix, row_hash, spread, stored, text_of

ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    salts: int | None = None,
                    digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256.

    Rows with the same text form a group; the one with the largest id stays and ``keep_id`` is
    its id. ``digest`` only deals rows out; texts that share a digest are told apart.

    A null text is empty, and empty texts are equal. A null id is smaller than any other; a group
    of null ids only has a null ``keep_id`` and keeps one row. Of rows that share text and id one
    is kept, by a hash of all columns. Columns of ``docs`` named as an added one are replaced.
    An empty table gives an empty one.
    """
    docs = docs.drop(*ADDED)
    p = prefix(docs)
    key, salt, text, tie = f"{p}key", f"{p}salt", f"{p}text", f"{p}tie"
    rows = (docs.withColumn(tie, row_hash(docs)).withColumn(text, text_of(text_col))
            .withColumn("text_sha256", sha256(F.col(text))).withColumn(key, digest(F.col(text)))
            .withColumn(salt, F.pmod(F.xxhash64(id_col), F.lit(salts or spread(docs)))))
    merged = rows.groupBy(key, salt, text).agg(
        F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = (merged.repartition(key).groupBy(key, text)
              .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
              .withColumn(f"{p}texts", F.count(F.lit(1)).over(Window.partitionBy(key))))
    several = F.col(f"{p}texts") > 1
    groups = stored(groups.where(several | (F.col("group_size") > 1))
                    .withColumn(text, F.when(several, F.col(text))), "duplicate-groups")

    clear = groups.where(~several).select(key, "keep_id", "group_size")
    pairs = rows.select(key, salt).distinct().join(clear, key)
    marked = rows.join(pairs, [key, salt], "left")
    alone = [key, salt, id_col]
    if not groups.where(several).isEmpty():  # texts that share a digest
        alone.append(text)
        mixed = groups.where(several).select(
            key, text, F.col("keep_id").alias(f"{p}keep"), F.col("group_size").alias(f"{p}size"))
        marked = marked.join(mixed, [key, text], "left").withColumns({
            "keep_id": F.coalesce("keep_id", f"{p}keep"),
            "group_size": F.coalesce("group_size", f"{p}size")})
    first = F.row_number().over(Window.partitionBy(*alone).orderBy(tie))
    marked = marked.withColumns({
        "keep_id": F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id")),
        "group_size": F.coalesce("group_size", F.lit(1).cast("bigint"))})
    return marked.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")) & (first == 1)) \
        .select(*docs.columns, *ADDED)


def drop_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The kept rows of ``mark_duplicates`` with the columns of ``docs``."""
    return mark_duplicates(docs, **options).where("kept").select(*docs.columns)
