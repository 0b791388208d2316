import numpy as np
import pytest
from pyspark.sql import functions as F

from lendlake.operators import models, scoring
from lendlake.plans import catalog
from tests.micro import D, customer, loan, micro, rows


def test_features_fall_back_to_the_form_defaults(spark):
    t = micro(spark, customer=[customer(i) for i in (1, 2, 3)],
              income_details=[(5, 1, D("80000.00"), "Business", None),
                              (4, 1, D("70000.00"), "Retired", None),
                              (6, 2, D("0.00"), "", None)],
              credit_history=[(1, 1, 3, 1, None)],
              loan=[loan(1, 1), loan(2, 2), loan(3, 3)])
    found = rows(scoring.application_features(t, scoring.loans_as_applications(t))
                 .orderBy("application_id"), "monthly_income", "employment_type",
                 "employment_enc", "total_loans", "total_defaults")
    assert found == [(70000.0, "Retired", 1, 3, 1), (50000.0, "Salaried", 3, 0, 0),
                     (50000.0, "Salaried", 3, 0, 0)]


def test_applications_of_unknown_customers_stay(spark):
    t = micro(spark, customer=[customer(1)], loan=[loan(1, 1), loan(2, 99)])
    found = scoring.application_features(t, scoring.loans_as_applications(t))
    assert rows(found.orderBy("application_id"), "application_id", "problem") == [
        (1, None), (2, "unknown customer")]
    card = rows(scoring.scorecard(t, scoring.loans_as_applications(t)).orderBy("application_id"),
                "application_id", "score_value")
    assert card[0][1] is not None and card[1] == (2, None)


def test_no_sort_aggregate_in_features(spark, star):
    plan = scoring.application_features(star, scoring.loans_as_applications(star))
    assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()


def test_unknown_employment_codes_as_two(spark):
    df = spark.createDataFrame([("Salaried",), ("Pirate",), (None,)], "e STRING")
    assert rows(df.select(scoring.employment_code(F.col("e")))) == [(3,), (2,), (2,)]


def test_scorecard_limits(spark):
    df = spark.createDataFrame(
        [(300000.0, 4, 0, 0, 0.0), (0.0, 1, 9, 9, 5e6), (900000.0, 4, 0, 0, 0.0)],
        "monthly_income DOUBLE, employment_enc INT, total_loans INT, total_defaults INT, "
        "loan_amount DOUBLE")
    assert rows(df.select(scoring.rule_credit_score())) == [(830,), (300,), (900,)]


@pytest.mark.parametrize("score, probability, ok, reasons", [
    (601, 0.3999, True, ""),
    (600, 0.1, False, "Credit score 600 is below 600"),
    (601, 0.4, False, "Default probability 40.0% exceeds 40%"),
    (480, 0.5125, False, "Credit score 480 is below 600; default probability 51.2% exceeds 40%")])
def test_decisions(spark, score, probability, ok, reasons):
    s, p = F.lit(score), F.lit(probability)
    df = spark.range(1).select(scoring.approved(s, p), scoring.decision_reasons(s, p))
    assert rows(df) == [(ok, reasons)]


def test_probability_is_rounded_before_the_decision(spark):
    for raw, ok in ((0.39994, True), (0.39996, False)):
        p = F.round(F.lit(raw), models.PROBABILITY_DIGITS)
        assert rows(spark.range(1).select(scoring.approved(F.lit(700), p))) == [(ok,)]


def test_confidence_steps(spark):
    df = spark.createDataFrame([(0.35,), (0.36,), (0.55,), (0.56,), (0.75,), (0.76,)], "p DOUBLE")
    assert [r[0] for r in rows(df.select(scoring.confidence(F.col("p"))))] == [
        "Low", "Moderate", "Moderate", "High", "High", "Very High"]


@pytest.fixture(scope="module")
def data(star):
    return scoring.scorecard(star, scoring.loans_as_applications(star))


def test_stratified_split_keeps_shares_and_is_a_partition(spark, data):
    train, test = models.split(data, "risk_level")
    assert train.count() + test.count() == data.count()
    assert train.select("application_id").intersect(test.select("application_id")).isEmpty()
    whole = dict(rows(data.groupBy("risk_level").count()))
    held = dict(rows(test.groupBy("risk_level").count()))
    for level, n in whole.items():
        assert abs(held.get(level, 0) - n * models.TEST_SHARE) <= 1 + 0.02 * n


def test_models(spark, data, star, tmp_path):
    score, score_metrics = models.train_score_model(data, trees=10, depth=6)
    metrics = score_metrics.first()
    assert metrics["mae"] < 25 and metrics["r2"] > 0.7
    risk, risk_metrics = models.train_risk_model(data, trees=10, depth=6)
    assert risk_metrics.first()["accuracy"] > 0.9
    default, default_metrics = models.train_default_model(data)
    found = default_metrics.first()
    assert found["hits"] > 0.8 * found["rows"]
    assert found["caught"] + found["missed"] + found["false_alarms"] <= found["rows"]
    fitted = models.Models(score, risk, default)

    features = scoring.application_features(star, scoring.loans_as_applications(star))
    stranger = features.limit(1).withColumn("application_id", F.lit(-1).cast("bigint")).withColumn(
        "problem", F.lit("unknown customer"))
    refused = models.assess_applications(fitted, features.unionByName(stranger)).where(
        "application_id = -1").first()
    assert refused["auto_approved"] is False and refused["reasons"] == "Unknown Customer"
    result = models.assess_applications(fitted, features)
    assert result.count() == star.loan.count()
    for row in result.limit(200).collect():
        assert 300 <= row["credit_score"] <= 900
        assert row["risk_level"] in row["risk_probabilities"]
        assert abs(sum(row["risk_probabilities"].values()) - 1) < 0.001
        assert 0 <= row["default_probability"] <= 1
        ok = row["credit_score"] > 600 and row["default_probability"] < 0.4
        assert row["auto_approved"] == ok and (row["reasons"] == "") == ok

    models.save_models(fitted, str(tmp_path / "models"))
    again = models.assess_applications(models.load_models(str(tmp_path / "models")), features)
    shown = ("application_id", "credit_score", "default_probability", "risk_level")
    assert again.select(*shown).exceptAll(result.select(*shown)).isEmpty()


def test_one_class_only(spark, data):
    for label in (0, 1):
        one = data.withColumn("will_default", F.lit(label))
        model, metrics = models.train_default_model(one)
        assert metrics.first()["hits"] == metrics.first()["rows"]
        chances = model.transform(one).select("default_chance").distinct()
        assert rows(chances) == [(float(label),)]


def test_default_model_is_the_optimum(spark, data):
    """No part of the gradient is left, and a constant feature takes no part."""
    flat = data.withColumn("tenure", F.lit(12))
    train, _ = models.split(flat, "will_default")
    _, metrics = models.train_default_model(flat)
    found = metrics.first()
    beta = np.array([found["intercept"], *(found[f"on_{f}"] for f in models.DEFAULT_FEATURES)])
    kept = np.array(rows(train.select("will_default", *models.DEFAULT_FEATURES)), dtype=float)
    y, x = kept[:, 0], kept[:, 1:]
    spread = x.std(axis=0)
    x = (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1)
    x = np.column_stack([np.ones(len(y)), x])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    p = 1 / (1 + np.exp(-x @ beta))
    gradient = (weight * (p - y)) @ x / len(y) + np.r_[0, beta[1:]] / len(y)
    assert np.abs(gradient).max() < 1e-9
    assert abs(found["on_tenure"]) < 1e-12


def test_score_forest_sees_every_row(spark, data):
    train, _ = models.split(data)
    n = train.count()
    for trees, slice_rows, slices in ((200, 10**9, 1), (200, 300, -(-n // 300)), (3, 10, 3)):
        _, found = models._slices(train, trees, slice_rows)
        assert sum(found.values()) == n and len(found) == slices
    model, metrics = models.train_score_model(data, trees=7, depth=6, slice_rows=400)
    assert [f.getNumTrees for f in model.stages[1:-1]] == [3, 2, 2]
    assert metrics.first()["mae"] < 30


def test_slices_are_bounded_and_hold_every_row(spark, data):
    train, _ = models.split(data)
    _, found = models._slices(train, 200, 10)
    assert len(found) == models.SLICES_AT_MOST and sum(found.values()) == train.count()


def test_like_applications_are_scored_one_after_the_other(spark, data):
    models_ = models.Models(score=models.train_score_model(data, trees=2, depth=4)[0])
    scored = models.predict_score(models_, data.repartition(2)).select(
        F.spark_partition_id().alias("part"), F.struct(*models.ALIKE).alias("x")).collect()
    for part in {r["part"] for r in scored}:
        found = [tuple(r["x"]) for r in scored if r["part"] == part]
        assert found == sorted(found)


def test_applications_are_assessed_in_many_tasks(spark, data):
    """All cores have some, however few bytes they are."""
    models_ = models.train_models(data, trees=2, fit_rows=200)
    known = data.withColumn("problem", F.lit(None).cast("string"))
    parts = models.assess_applications(models_, known).select(F.spark_partition_id()).distinct()
    assert parts.count() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_saved_forests_walked_by_duckdb(spark, data, tmp_path):
    """Predictions of every application by a recursive query over the table of tree nodes."""
    import duckdb

    score, _ = models.train_score_model(data, trees=6, depth=7, slice_rows=600)
    risk, _ = models.train_risk_model(data, trees=5, depth=5)
    levels = risk.stages[-1].getLabels()
    for name, model, features, add in (
            ("score", score, models.SCORE_FEATURES, models.predict_score),
            ("risk", risk, models.RISK_FEATURES, models.predict_risk)):
        models.save_model(model, f"{tmp_path}/{name}")
        nodes = models.forest_nodes(spark, f"{tmp_path}/{name}").toArrow()
        ours = add(models.Models(**{name: models.load_model(f"{tmp_path}/{name}")}), data)
        inputs = ours.select("application_id", F.array(
            *[F.col(f).cast("double") for f in features]).alias("x")).toArrow()
        con = duckdb.connect()
        con.register("nodes", nodes)
        con.register("inputs", inputs)
        leaves = """
            WITH RECURSIVE walk AS (
                SELECT application_id, x, forest, tree, 0 AS node
                FROM inputs, (SELECT DISTINCT forest, tree FROM nodes)
                UNION ALL
                SELECT application_id, x, forest, tree,
                       CASE WHEN x[feature + 1] <= threshold THEN "left" ELSE "right" END
                FROM walk JOIN nodes USING (forest, tree, node) WHERE feature IS NOT NULL)
            SELECT application_id, value, counts FROM walk JOIN nodes USING (forest, tree, node)
            WHERE feature IS NULL"""
        if name == "score":
            theirs = con.sql(f"""SELECT application_id, CAST(trunc(least(900, greatest(300, avg(value))))
                AS INTEGER) FROM ({leaves}) GROUP BY ALL ORDER BY ALL""").fetchall()
            assert theirs == sorted(rows(ours, "application_id", "credit_score"))
        else:
            theirs = con.sql(f"""SELECT application_id, list_transform(range({len(levels)}), lambda k:
                list_avg(list_transform(list(counts), lambda c: c[k + 1] / list_sum(c))))
                FROM ({leaves}) GROUP BY ALL ORDER BY ALL""").fetchall()
            found = dict(rows(ours, "application_id", "risk_probabilities"))
            assert len(theirs) == len(found)
            for i, p in theirs:
                assert all(abs(found[i][level] - x) < 0.000051 for level, x in zip(levels, p))


def test_flags_of_the_model_queries_can_fail(spark, data):
    """A model of shuffled labels misses every floor and distance."""
    noise = data.withColumn("score_value", (300 + F.pmod(F.xxhash64("application_id"), F.lit(601))).cast("int"))
    model, metrics = models.train_score_model(noise, trees=3, depth=2)
    assert rows(catalog.score_metrics(metrics), "mae_ok", "r2_ok") == [(False, False)]
    facts = catalog.score_facts(models.predict_score(models.Models(score=model), noise))
    assert not facts.where("not near_scorecard").isEmpty()
    levels = data.withColumn("risk_level", F.element_at(F.array(*map(F.lit, ("Low", "High"))), (
        F.pmod(F.xxhash64("application_id"), F.lit(2)) + 1).cast("int")))
    assert rows(catalog.level_metrics(models.train_risk_model(levels, trees=3, depth=2)[1]),
                "accuracy_ok") == [(False,)]
    bad = spark.createDataFrame([(1, 950, 0.1, False, "")], "application_id int, credit_score int, "
                                "default_probability double, auto_approved boolean, reasons string")
    assert rows(catalog.decision_facts(bad)) == [(1, False, False, False)]


def test_fit_sample_is_bounded_and_repeatable(spark, data):
    some = models.fit_sample(data, 300)
    assert 150 < some.count() < 600
    assert some.exceptAll(models.fit_sample(data, 300)).isEmpty()
    assert models.fit_sample(data, 10**9).count() == data.count()


def test_fit_sample_of_many_rows(spark):
    """Tens of millions of rows give as many rows as fewer do, not none."""
    for n in (15_000_000, 30_000_000):
        many = spark.range(n).withColumnRenamed("id", "application_id")
        assert 1_700 < models.fit_sample(many, 2_000).count() < 2_300
