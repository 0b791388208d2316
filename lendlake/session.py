"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes partitions after each shuffle, splits oversized join partitions and
# turns joins with a small side into broadcasts. Splitting is allowed even where it costs another
# shuffle: a customer may hold a third of all loans.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above. Shuffle partitions, memory and the shared checkpoint
    folder (``spark.checkpoint.dir``) belong to the cluster and are left alone."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
