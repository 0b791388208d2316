"""Trained scoring: a score forest and a level forest of MLlib, and a default regression.

Labels come from the scorecards, as stored scores carry no relation to the features. Forests have
200 trees, of depth 12 and 10.

The score forest sees every training row: rows are dealt into slices by a hash of their id, each
slice grows its share of the trees on its own rows, and the forest is all of them. There are as many
slices as ``slice_rows`` asks for, and 16 at most; beyond that slices grow with the table, as each
one takes a row of jobs to fit, a stage of the model, and files of its own where that is saved. The
level forest, a classifier, is fitted on a bounded sample of the training rows, ``fit_rows``. The
default regression is solved by Newton steps, each one sum over all training rows. Metrics are taken
over all rows held out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendlake.functions.workspace import new_folder, stored
from lendlake.operators.scoring import approved, confidence, decision_reasons, whole_score

SCORE_FEATURES = ["monthly_income", "employment_enc", "total_loans", "total_defaults",
                  "loan_amount", "tenure"]
RISK_FEATURES = ["score_value", "total_defaults", "monthly_income", "loan_amount"]
DEFAULT_FEATURES = ["score_value", "overdue_days", "tenure", "interest_rate", "total_defaults"]

TEST_SHARE = 0.2
SEED = 42
BUCKETS = 10_000
# A prime that spreads ids over the buckets.
SPLIT_STEP = 7_919
# The sample needs finer buckets, so that its share is above 0 for any number of rows.
SAMPLE_BUCKETS = 1 << 40
TREES, SCORE_DEPTH, RISK_DEPTH = 200, 12, 10
FIT_ROWS = 2_000
SLICE_ROWS, SLICES_AT_MOST = 6_000, 16
# Rows a task of a fit holds. Every task sends the statistics of all nodes that are split together.
ROWS_OF_TASK = 250_000
# Slices that are fitted at a time; each fit is a row of small jobs.
FITS_AT_ONCE = 8
# Memory for the statistics of the nodes that are split together, in MB.
NODE_MEMORY = 1_024
PROBABILITY_DIGITS = 4
# Newton steps end when no part of the gradient, of a mean loss, is larger.
GRADIENT_AT_MOST, STEPS_AT_MOST = 1e-13, 60

# Rows that are alike take the same ways down the trees, whose nodes then are in the core's cache:
# features of few values come first.
ALIKE = ["total_defaults", "employment_enc", "total_loans", "monthly_income", "loan_amount"]


@dataclass(frozen=True)
class Models:
    """The models a job needs; a prediction with one model needs that one only."""

    score: PipelineModel | None = None
    risk: PipelineModel | None = None
    default: PipelineModel | None = None


def _bucket() -> Column:
    """A bucket of the id by whole-number arithmetic that any engine can repeat."""
    return F.expr(f"pmod(pmod(application_id, {BUCKETS}) * {SPLIT_STEP} "
                  f"+ pmod(application_id div {BUCKETS}, {BUCKETS}), {BUCKETS})")


def fit_sample(train: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of the training rows (all, if there are fewer), the same ones on every run,
    stored, as a forest reads them once for each level of its trees."""
    n = train.count()
    share = SAMPLE_BUCKETS * min(1.0, rows / max(1, n))
    bucket = F.pmod(F.xxhash64("application_id"), F.lit(SAMPLE_BUCKETS))
    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(train.where(bucket < F.lit(share)).repartition(parts, "application_id"), "fit")


def split(df: DataFrame, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """80 % for training, 20 % held out, by a hash of the id: the same on every run.

    With ``label`` each class is cut at its own bucket. Classes are counted per bucket, so the
    window sees at most 10,000 rows of a class, however large it is.
    """
    rows = df.withColumn("_bucket", _bucket())
    if label is None:
        test = F.col("_bucket") < int(BUCKETS * TEST_SHARE)
        return rows.where(~test).drop("_bucket"), rows.where(test).drop("_bucket")
    counts = rows.groupBy(label, "_bucket").agg(F.count("*").alias("n"))
    in_class = Window.partitionBy(label)
    counts = counts.select(
        label, "_bucket", F.sum("n").over(in_class.orderBy("_bucket")).alias("_so_far"),
        F.sum("n").over(in_class).alias("_all"))
    cuts = counts.where(F.col("_so_far") <= F.col("_all") * TEST_SHARE).groupBy(label).agg(
        F.max("_bucket").alias("_cut"))
    # One row per class.
    rows = rows.join(F.broadcast(cuts), label, "left")
    test = F.coalesce(F.col("_bucket") <= F.col("_cut"), F.lit(False))
    helpers = ("_bucket", "_cut")
    return rows.where(~test).drop(*helpers), rows.where(test).drop(*helpers)


def alike_together(df: DataFrame) -> DataFrame:
    """The rows of each partition in an order that puts like applications side by side."""
    return df.sortWithinPartitions(*ALIKE)


def _assembled(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features")


def _slices(train: DataFrame, trees: int, slice_rows: int) -> tuple[str, dict[int, int]]:
    """The training rows written by slice, and the rows of each slice."""
    n = max(1, min(trees, SLICES_AT_MOST, math.ceil(train.count() / slice_rows)))
    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(train.sparkSession, "slices")
    dealt = train.withColumn("_slice", F.pmod(F.xxhash64("application_id"), F.lit(n)).cast("int"))
    # A slice is dealt to as many tasks as its share of them, at least one.
    salt = F.pmod(F.xxhash64("application_id", F.lit("salt")), F.lit(max(1, parts // n)))
    dealt.repartition(max(parts, n), "_slice", salt).write.partitionBy("_slice").parquet(folder)
    written = train.sparkSession.read.parquet(folder)
    return folder, {r["_slice"]: r["count"] for r in written.groupBy("_slice").count().collect()}


def train_score_model(data: DataFrame, trees: int = TREES, depth: int = SCORE_DEPTH,
                      slice_rows: int = SLICE_ROWS) -> tuple[PipelineModel, DataFrame]:
    """Forest regression of the score on all training rows; metrics on the held-out part: mae, r2.

    The model's prediction is the mean over the trees of all slices.
    """
    train, test = split(data)
    train = train.select("application_id", "score_value", *SCORE_FEATURES)
    folder, rows = _slices(train, trees, slice_rows)
    spark = data.sparkSession
    numbers = sorted(rows)
    shares = {k: trees // len(numbers) + (i < trees % len(numbers)) for i, k in enumerate(numbers)}
    assembler = _assembled(SCORE_FEATURES)

    def fit(number: int):
        forest = RandomForestRegressor(
            labelCol="score_value", predictionCol=f"score_{number}", numTrees=shares[number],
            maxDepth=depth, featureSubsetStrategy="all", seed=SEED + number, maxMemoryInMB=NODE_MEMORY)
        part = spark.read.schema(train.schema).parquet(f"{folder}/_slice={number}")
        return forest.fit(assembler.transform(part.coalesce(math.ceil(rows[number] / ROWS_OF_TASK))))

    pool = ThreadPool(min(FITS_AT_ONCE, max(1, len(numbers))))
    try:
        forests = pool.map(inheritable_thread_target(spark)(fit), numbers)
    finally:
        pool.close()
    total = " + ".join(f"score_{k} * {shares[k]}" for k in numbers)
    mean = SQLTransformer(statement=f"SELECT *, ({total}) / {trees} AS predicted_score FROM __THIS__")
    model = PipelineModel(stages=[assembler, *forests, mean])
    label, guess = F.col("score_value").cast("double"), F.col("predicted_score")
    metrics = model.transform(alike_together(test)).agg(
        F.count("*").alias("rows"), F.avg(F.abs(label - guess)).alias("mae"),
        (F.lit(1.0) - F.sum(F.pow(label - guess, 2)) / (F.var_pop(label) * F.count("*")))
        .alias("r2"))
    return model, metrics


def train_risk_model(data: DataFrame, trees: int = TREES, depth: int = RISK_DEPTH,
                     fit_rows: int = FIT_ROWS) -> tuple[PipelineModel, DataFrame]:
    """Forest classification of the level; metric on the held-out part: accuracy."""
    train, test = split(data, "risk_level")
    indexer = StringIndexer(inputCol="risk_level", outputCol="risk_index",
                            stringOrderType="alphabetAsc").fit(train)
    train = fit_sample(train, fit_rows)
    forest = RandomForestClassifier(
        labelCol="risk_index", predictionCol="risk_index_predicted",
        probabilityCol="risk_probability", rawPredictionCol="risk_raw", numTrees=trees,
        maxDepth=depth, seed=SEED, maxMemoryInMB=NODE_MEMORY)
    assembler = _assembled(RISK_FEATURES)
    fitted = forest.fit(assembler.transform(indexer.transform(train)))
    names = IndexToString(inputCol="risk_index_predicted", outputCol="predicted_level",
                          labels=indexer.labels)
    model = PipelineModel(stages=[assembler, fitted, names])
    hit = (F.col("predicted_level") == F.col("risk_level")).cast("double")
    return model, model.transform(test).agg(
        F.count("*").alias("rows"), F.avg(hit).alias("accuracy"))


def _balanced(rows: DataFrame) -> tuple[int, int]:
    size = rows.agg(F.count("*").alias("n"), F.sum("will_default").alias("bad")).first()
    return size["n"], size["bad"] or 0


def _newton(rows: DataFrame, n: int, bad: int) -> np.ndarray:
    """Intercept and coefficients that minimise the mean weighted log-loss over the scaled columns
    x1, x2, ... plus sum(coefficient**2) / 2n. Classes weigh the same in total.

    Each step is one row of sums: loss, gradient and curvature. A step that does not lower the loss
    is halved, so the loss falls until the gradient is zero to double precision.
    """
    names = [F.lit(1.0), *(F.col(f"x{i + 1}") for i in range(len(DEFAULT_FEATURES)))]
    k = len(names)
    weight = F.when(F.col("y") == 1, n / (2.0 * bad)).otherwise(n / (2.0 * (n - bad)))
    penalty = np.array([0.0] + [1.0 / n] * (k - 1))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def summed(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = sum((c * float(b) for c, b in zip(names[1:], beta[1:])), F.lit(float(beta[0])))
        p = 1 / (1 + F.exp(-z))
        loss = F.greatest(z, F.lit(0.0)) - F.col("y") * z + F.log1p(F.exp(-F.abs(z)))
        some = rows.select(weight.alias("w"), p.alias("p"), loss.alias("loss"), "y",
                           *[c.alias(f"c{i}") for i, c in enumerate(names)])
        error, bend = F.expr("w * (p - y)"), F.expr("w * p * (1 - p)")
        row = some.agg(F.sum(F.expr("w * loss")), *[F.sum(error * F.col(f"c{i}")) for i in range(k)],
                       *[F.sum(bend * F.col(f"c{i}") * F.col(f"c{j}")) for i, j in pairs]).first()
        curve = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[1 + k:]):
            curve[i, j] = curve[j, i] = x / n
        return (row[0] / n + penalty @ beta**2 / 2, np.array(row[1:1 + k]) / n + penalty * beta,
                curve + np.diag(penalty))

    beta = np.zeros(k)
    loss, gradient, curve = summed(beta)
    for _ in range(STEPS_AT_MOST):
        if np.abs(gradient).max() <= GRADIENT_AT_MOST:
            break
        step = np.linalg.lstsq(curve, gradient, rcond=None)[0]
        new = summed(beta - step)
        while new[0] > loss + 1e-15 * abs(loss) and np.abs(step).max() > 1e-12:
            step = step / 2
            new = summed(beta - step)
        if not np.abs(new[1]).max() < np.abs(gradient).max() and new[0] >= loss:
            break
        beta, (loss, gradient, curve) = beta - step, new
    return beta


def train_default_model(data: DataFrame) -> tuple[PipelineModel, DataFrame]:
    """Regularised logistic regression with balanced classes; scaling sees training rows only.

    The optimum is unique, so any solver that reaches it gives these numbers. Metrics on the
    held-out part: rows, hits (right flags), caught (defaults flagged), missed, false_alarms; beside
    them the fitted intercept and coefficients, of features scaled to mean 0 and deviation 1. With
    one class only the probability is that class's, 0 or 1.
    """
    train, test = split(data, "will_default")
    n, bad = _balanced(train)
    facts = train.agg(*[x for f in DEFAULT_FEATURES for x in (
        F.avg(f), F.stddev_pop(f))]).first()
    means, scales = facts[::2], facts[1::2]
    scaled = [(F.col(f).cast("double") - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
              for f, m, s in zip(DEFAULT_FEATURES, means, scales)]
    if 0 < bad < n:
        rows = stored(train.select(F.col("will_default").cast("double").alias("y"), *[
            c.alias(f"x{i + 1}") for i, c in enumerate(scaled)]), "scaled")
        beta = _newton(rows, n, bad).tolist()
        terms = "".join(f" + {b!r}D * ((CAST({f} AS DOUBLE) - {m!r}D) / {s!r}D)" for f, m, s, b in zip(
            DEFAULT_FEATURES, means, scales, beta[1:]) if s)
        chance = f"1 / (1 + exp(-({beta[0]!r}D{terms})))"
    else:
        beta, chance = [0.0] * (len(DEFAULT_FEATURES) + 1), f"{float(bad > 0)!r}D"
    model = PipelineModel(stages=[SQLTransformer(
        statement=f"SELECT *, {chance} AS default_chance FROM __THIS__")])
    flag, label = F.col("default_chance") > 0.5, F.col("will_default") == 1
    metrics = model.transform(test).agg(
        F.count("*").alias("rows"), F.count_if(flag == label).alias("hits"),
        F.count_if(flag & label).alias("caught"), F.count_if(~flag & label).alias("missed"),
        F.count_if(flag & ~label).alias("false_alarms"))
    return model, metrics.select("*", F.lit(beta[0]).alias("intercept"), *[
        F.lit(b).alias(f"on_{f}") for f, b in zip(DEFAULT_FEATURES, beta[1:])])


def train_models(data: DataFrame, trees: int = TREES, fit_rows: int = FIT_ROWS) -> Models:
    """All three models from scorecard rows (see ``scoring.scorecard``)."""
    return Models(train_score_model(data, trees)[0],
                  train_risk_model(data, trees, fit_rows=fit_rows)[0], train_default_model(data)[0])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_models(models: Models, path: str) -> None:
    for name in ("score", "risk", "default"):
        save_model(getattr(models, name), f"{path}/{name}")


def load_models(path: str) -> Models:
    return Models(*[PipelineModel.load(f"{path}/{name}") for name in ("score", "risk", "default")])


def forest_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The trees of the model saved in ``path`` as a table: forest (which of the model's forests),
    tree, node, and for inner nodes feature (its number), threshold (a value at most as large goes to
    ``left``, others to ``right``), for all nodes value (the prediction) and counts (rows of each
    class, for a classifier). Categorical splits, which no model here has, are left out."""
    from pyspark.ml.util import DefaultParamsReader

    stages = DefaultParamsReader.loadMetadata(path, spark)["paramMap"]["stageUids"]
    found = None
    for number, uid in enumerate(u for u in stages if u.startswith("RandomForest")):
        at = stages.index(uid)
        width = len(str(len(stages)))
        nodes = spark.read.parquet(f"{path}/stages/{at:0{width}d}_{uid}/data").select(
            F.lit(number).alias("forest"), F.col("treeID").alias("tree"),
            F.col("nodeData.id").alias("node"),
            F.when(F.col("nodeData.leftChild") >= 0, F.col("nodeData.split.featureIndex")).alias("feature"),
            F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
            F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
            F.col("nodeData.prediction").alias("value"), F.col("nodeData.impurityStats").alias("counts"))
        found = nodes if found is None else found.unionByName(nodes)
    return found


def _added(result: DataFrame, before: DataFrame, *columns: Column) -> DataFrame:
    """Only the input columns and the named ones; the models' working columns go."""
    return result.select(*before.columns, *columns)


def predict_score(models: Models, df: DataFrame) -> DataFrame:
    """Add credit_score, limited to 300..900 and cut to a whole number."""
    score = whole_score(F.col("predicted_score")).alias("credit_score")
    return _added(models.score.transform(alike_together(df)), df, score)


def predict_risk(models: Models, df: DataFrame) -> DataFrame:
    """Add the level and the probability of every level."""
    labels = F.array(*[F.lit(name) for name in models.risk.stages[-1].getLabels()])
    shares = F.transform(vector_to_array("risk_probability"),
                         lambda p: F.round(p, PROBABILITY_DIGITS))
    return _added(models.risk.transform(df), df, F.col("predicted_level"),
                  F.map_from_arrays(labels, shares).alias("risk_probabilities"))


def predict_default(models: Models, df: DataFrame) -> DataFrame:
    """Add both probabilities, the flag and how sure the model is."""
    bad = F.col("default_chance")
    return _added(
        models.default.transform(df), df, (bad > 0.5).alias("default_expected"),
        F.round(bad, PROBABILITY_DIGITS).alias("default_probability"),
        F.round(1 - bad, PROBABILITY_DIGITS).alias("no_default_probability"),
        confidence(bad).alias("default_confidence"))


def assess_applications(models: Models, features: DataFrame) -> DataFrame:
    """Score, level and default probability of applications, with the decision and its reasons.

    Each model sees the score the first one predicts; new applications have no overdue days. An
    application of an unknown customer is not scored and not approved, and says why.
    """
    known, unknown = features.where("problem is null"), features.where("problem is not null")
    # Adaptive execution would leave few tasks: it goes by bytes, but each row takes hundreds of trees.
    parts = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = predict_score(models, known.select(
        "application_id", "customer_id", "monthly_income", "employment_enc", "total_loans",
        "total_defaults", "loan_amount", "tenure", "interest_rate").repartition(parts, "application_id"))
    scored = scored.withColumn("score_value", F.col("credit_score")).withColumn(
        "overdue_days", F.lit(0))
    judged = predict_default(models, predict_risk(models, scored))
    score, probability = F.col("credit_score"), F.col("default_probability")
    decided = judged.select(
        "application_id", "customer_id", "credit_score",
        F.col("predicted_level").alias("risk_level"), "risk_probabilities",
        "default_probability", F.col("default_expected").alias("will_default"),
        "default_confidence", approved(score, probability).alias("auto_approved"),
        decision_reasons(score, probability).alias("reasons"))
    refused = unknown.select("application_id", "customer_id", F.lit(False).alias("auto_approved"),
                             F.initcap("problem").alias("reasons"))
    return decided.unionByName(refused, allowMissingColumns=True)
