"""Score to risk band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlake.schema import SCORE_RANGE


def score_bands(bands: DataFrame) -> DataFrame:
    """(score_value, risk_id) for every whole score a band covers: at most 601 rows.

    Bands are inclusive and scores are whole numbers, so the range condition becomes an
    equality. Where bands overlap the one with the highest min_score counts.
    """
    low, high = SCORE_RANGE
    first, last = F.greatest("min_score", F.lit(low)), F.least("max_score", F.lit(high))
    covered = bands.where(first <= last).select(
        "risk_id", "min_score", F.explode(F.sequence(first, last)).alias("score_value"))
    return covered.groupBy("score_value").agg(
        F.max_by("risk_id", F.col("min_score").cast("bigint") * (1 << 32) - F.col("risk_id"))
        .alias("risk_id"))


def assign_risk_band(scores: DataFrame, bands: DataFrame) -> DataFrame:
    """Set risk_id from score_value; NULL where no band covers it.

    The broadcast side holds one row per whole score in 300..900, whatever the data.
    """
    rest = [c for c in scores.columns if c != "risk_id"]
    return (scores.select(*rest)
            .join(F.broadcast(score_bands(bands)), "score_value", "left")
            .select(*rest, "risk_id"))
