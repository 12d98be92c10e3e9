"""Training, calibration fits and model packages with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.fixed import MODEL_CLASSES
from flowloom.operators.evaluation import balanced_weights, class_index, logit

FOREST_TREES = 300
BOOST_ROUNDS, BOOST_DEPTH, BOOST_RATE = 300, 5, 0.08
CALIBRATION_REG = 1e-6
SEED = 42


def model_columns(df: DataFrame) -> list[str]:
    columns = sorted(c for c in df.columns if c.startswith(("feature__", "available__")))
    if not columns:
        raise ValueError("the table holds no feature columns")
    return columns


def as_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Feature and availability columns as doubles."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def assembly_stages(columns: Sequence[str]) -> list:
    """Median imputation of features (Spark ML takes no missing values), then one vector."""
    features = [c for c in columns if c.startswith("feature__")]
    imputed = [f"imputed__{c}" for c in features]
    others = [c for c in columns if c not in features]
    return [
        Imputer(strategy="median", inputCols=features, outputCols=imputed),
        VectorAssembler(inputCols=[*imputed, *others], outputCol="features"),
    ]


def usable_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least one value; an imputer has no median for the rest."""
    seen = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if seen[c]]


def train_forest(
    train: DataFrame, classes: Sequence[str], trees: int = FOREST_TREES, depth: int = 12
) -> PipelineModel:
    """Class-balanced forest; adds ``raw`` (one probability per class) through ``score``."""
    columns = usable_columns(train, model_columns(train))
    rows = balanced_weights(as_matrix(train, columns)).withColumn("label_idx", class_index(F.col("label"), classes))
    forest = RandomForestClassifier(
        labelCol="label_idx", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=SEED
    )
    return Pipeline(stages=[*assembly_stages(columns), forest]).fit(rows)


def score_forest(model: PipelineModel, df: DataFrame, classes: Sequence[str] | None = None) -> DataFrame:
    """Adds ``raw``; with ``classes`` it has one entry for each, also for last ones that the training rows did not show."""
    columns = [c for c in df.columns if c.startswith(("feature__", "available__"))]
    scored = model.transform(as_matrix(df, columns))
    raw = vector_to_array("probability")
    if classes is not None:
        raw = F.array(*[F.coalesce(F.get(raw, F.lit(i)), F.lit(0.0)) for i in range(len(classes))])
    return scored.withColumn("raw", raw).select(*df.columns, "raw")


def train_boosted(
    train: DataFrame, classes: Sequence[str] = MODEL_CLASSES, rounds: int = BOOST_ROUNDS,
    depth: int = BOOST_DEPTH, rate: float = BOOST_RATE,
) -> tuple[PipelineModel, list]:
    """One boosted binary model per class on shared, weighted inputs: (input stages, models)."""
    from flowloom.session import checkpoint

    columns = usable_columns(train, [c for c in model_columns(train) if c.startswith("feature__")])
    inputs = Pipeline(stages=assembly_stages(columns)).fit(as_matrix(train, columns))
    rows = balanced_weights(train).withColumn("label_idx", class_index(F.col("label"), classes))
    ready = checkpoint(
        inputs.transform(as_matrix(rows, columns)).select("features", "label_idx", "weight")
    )
    models = [
        GBTClassifier(
            labelCol="target", featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth,
            stepSize=rate, subsamplingRate=0.9, seed=SEED,
        ).fit(ready.withColumn("target", (F.col("label_idx") == i).cast("double")))
        for i in range(len(classes))
    ]
    for i, model in enumerate(models):
        model.setRawPredictionCol(f"raw_{i}").setProbabilityCol(f"probability_{i}").setPredictionCol(f"prediction_{i}")
    return inputs, models


def score_boosted(package: tuple[PipelineModel, list], df: DataFrame) -> DataFrame:
    inputs, models = package
    columns = [c for c in df.columns if c.startswith("feature__")]
    scored = inputs.transform(as_matrix(df, columns))
    for model in models:
        scored = model.transform(scored)
    shares = F.array(*[vector_to_array(f"probability_{i}")[1] for i in range(len(models))])
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    even = F.lit(1.0 / len(models))
    raw = F.transform(shares, lambda x: F.when(total > 0, x / total).otherwise(even))
    return scored.select(*df.columns, raw.alias("raw"))


def fit_sigmoid(
    scores: DataFrame, classes: Sequence[str], probability: str = "raw", label_index: str = "label_idx", *, keep_unseen: bool = False
) -> DataFrame:
    """Slope and intercept per class: a weakly regularised logistic fit on the score's logit.

    A class without positive or without negative rows has no fit: an error, or with ``keep_unseen`` slope 1 and intercept 0, so it keeps its score.
    """
    k = len(classes)
    support = scores.agg(
        *[F.count_if(F.col(label_index) == i).alias(f"p{i}") for i in range(k)], F.count("*").alias("n")
    ).first()
    unseen = [support[f"p{i}"] in (0, support["n"]) for i in range(k)]
    if any(unseen) and not keep_unseen:
        raise ValueError("calibration needs positive and negative rows for each class")
    rows = []
    for i, name in enumerate(classes):
        if unseen[i]:
            rows.append((i, name, 1.0, 0.0))
            continue
        column = scores.select(
            logit(F.get(F.col(probability), F.lit(i))).alias("x"), (F.col(label_index) == i).cast("double").alias("y")
        )
        ready = VectorAssembler(inputCols=["x"], outputCol="features").transform(column)
        fit = LogisticRegression(
            featuresCol="features", labelCol="y", regParam=CALIBRATION_REG, standardization=False, maxIter=200
        ).fit(ready)
        rows.append((i, name, float(fit.coefficients[0]), float(fit.intercept)))
    return scores.sparkSession.createDataFrame(rows, "class_idx int, class_name string, slope double, intercept double")


def coefficient_list(table: DataFrame) -> list[tuple[float, float]]:
    """Coefficients in class order (one row per class)."""
    return [(r["slope"], r["intercept"]) for r in table.orderBy("class_idx").collect()]


def check_package(classes: Sequence[str], thresholds: dict[str, float]) -> None:
    if not classes or len(set(classes)) != len(classes) or set(thresholds) != set(classes):
        raise ValueError("classes and thresholds must be complete and consistent")
    if any(not 0 <= t <= 1 for t in thresholds.values()):
        raise ValueError("thresholds must lie between 0 and 1")


def save_package(
    path: str, model: PipelineModel, classes: Sequence[str], thresholds: dict[str, float], coefficients: DataFrame
) -> None:
    """Model and side tables below ``path``; an existing package is never overwritten."""
    check_package(classes, thresholds)
    spark = coefficients.sparkSession
    model.write().save(f"{path}/model")
    side = spark.createDataFrame(
        [(i, c, float(thresholds[c])) for i, c in enumerate(classes)], "class_idx int, class_name string, threshold double"
    )
    side.join(coefficients.drop("class_name"), "class_idx").coalesce(1).write.parquet(f"{path}/classes")


def load_package(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str], dict[str, float], list[tuple[float, float]]]:
    rows = spark.read.parquet(f"{path}/classes").orderBy("class_idx").collect()  # one row per class
    classes = [r["class_name"] for r in rows]
    thresholds = {r["class_name"]: r["threshold"] for r in rows}
    check_package(classes, thresholds)
    return (
        PipelineModel.load(f"{path}/model"), classes, thresholds, [(r["slope"], r["intercept"]) for r in rows]
    )
