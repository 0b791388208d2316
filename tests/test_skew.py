"""A customer holding a third of all loans: joins are split, results stay whole."""

import pytest
from pyspark.sql import functions as F

from lendlake.operators import access, portfolio, scoring

# Thresholds lowered to the size of the test data; many small input files.
FORCE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
}


@pytest.fixture
def skewed(spark, star, tmp_path):
    hot = F.when(F.col("loan_id") % 3 == 0, 7).otherwise(F.col("customer_id"))
    star.loan.withColumn("customer_id", hot).repartition(16).write.parquet(str(tmp_path / "loan"))
    settings = {**FORCE, "spark.sql.files.maxPartitionBytes": "2KB",
                "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield star.replace(loan=spark.read.schema(star.loan.schema).parquet(str(tmp_path / "loan")))
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def features(t):
    return scoring.application_features(t, scoring.loans_as_applications(t))


@pytest.mark.parametrize("operator", [features, access.all_loans, portfolio.emi_status_summary])
def test_joins_with_a_hot_customer_are_split(spark, skewed, operator):
    result = operator(skewed)
    n = len(result.collect())
    assert n == skewed.loan.count()
    assert "skew=true" in result._jdf.queryExecution().executedPlan().toString()


def test_reports_over_customers_shuffle_combined_rows(spark, skewed):
    """One row per map task and customer crosses the network, however many loans there are."""
    text = portfolio.risk_distribution(skewed)._jdf.queryExecution().executedPlan().toString()
    assert "keys=[customer_id" in text and "partial_sum(loan_amount" in text
    total = sum(r["loan_count"] for r in access.loans_by_risk(skewed).collect())
    assert total == skewed.loan.count()
