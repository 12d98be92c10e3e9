"""Calibrated scores, thresholds and metrics over class probabilities."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.fixed import MINIMUM_PRECISION, MODEL_CLASSES
from flowloom.operators.scan import chunk_scan

LOGIT_FLOOR = 1e-7
PROBABILITY_FLOOR = 1e-12


def class_index(label: Column, classes: Sequence[str] = MODEL_CLASSES) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(classes):
        out = F.when(label == name, F.lit(i)).otherwise(out)
    return out


def class_name(index: Column, classes: Sequence[str] = MODEL_CLASSES) -> Column:
    return F.get(F.array(*[F.lit(c) for c in classes]), index)


def logit(p: Column) -> Column:
    bounded = F.greatest(F.lit(LOGIT_FLOOR), F.least(F.lit(1 - LOGIT_FLOOR), p))
    return F.log(bounded / (1 - bounded))


def apply_sigmoid(probability: Column, coefficients: Sequence[tuple[float, float]]) -> Column:
    """Per-class sigmoid of the logit, then normalised: ``coefficients`` are (slope, intercept) by class."""
    raw = [
        1 / (1 + F.exp(-(slope * logit(F.get(probability, F.lit(i))) + intercept)))
        for i, (slope, intercept) in enumerate(coefficients)
    ]
    bounded = [F.greatest(F.lit(PROBABILITY_FLOOR), F.least(F.lit(1.0), r)) for r in raw]
    total = reduce(lambda a, b: a + b, bounded)
    return F.array(*[b / total for b in bounded])


def argmax(probability: Column) -> Column:
    """0-based position of the largest value, the first one on a tie."""
    return (F.array_position(probability, F.array_max(probability)) - 1).cast("int")


def score_batch(
    df: DataFrame, raw: str = "raw", calibrated: str = "calibrated", classes: Sequence[str] = MODEL_CLASSES
) -> DataFrame:
    """Class of the calibrated maximum with its calibrated and raw score; bad rows fail the job."""
    width = len(classes)
    sound = (
        (F.size(raw) == width) & (F.size(calibrated) == width)
        & F.forall(F.concat(raw, calibrated), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    )
    index = argmax(F.col(calibrated))
    return (
        df.withColumn("_index", F.when(sound, index).otherwise(F.raise_error(F.lit("probabilities are not finite or have the wrong width"))))
        .withColumn("threat_class", class_name(F.col("_index"), classes))
        .withColumn("raw_score", F.get(F.col(raw), F.col("_index")))
        .withColumn("calibrated_confidence", F.get(F.col(calibrated), F.col("_index")))
        .drop("_index")
    )


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight`` = rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))  # one row per class
    totals = counts.agg(F.sum("_n").alias("_rows"), F.count("*").alias("_classes"))
    weights = counts.crossJoin(F.broadcast(totals)).select(
        label, (F.col("_rows") / (F.col("_classes") * F.col("_n"))).alias("weight")
    )
    return df.join(F.broadcast(weights), label)


def class_thresholds(
    df: DataFrame, probability: str = "probability", label_index: str = "label_idx",
    minimum: float = MINIMUM_PRECISION, classes: Sequence[str] = MODEL_CLASSES,
) -> DataFrame:
    """Per class the lowest score whose precision at or above it reaches ``minimum`` (null: none does).

    Rows are first counted per distinct score; the running counts are cut at score chunks.
    """
    if not 0 < minimum <= 1:
        raise ValueError("minimum must be in (0, 1]")
    scored = df.select(
        label_index, F.posexplode(probability).alias("class_idx", "score")
    )
    per_score = scored.groupBy("class_idx", "score").agg(
        F.count("*").alias("n"), F.count_if(F.col("class_idx") == F.col(label_index)).alias("hits")
    )
    running = chunk_scan(
        per_score, ["class_idx"], F.floor(F.col("score") * 1024), [F.col("score").desc()],
        {"total": ("sum", F.col("n"), True), "positives": ("sum", F.col("hits"), True)},
        reverse=True,
    )
    reached = F.col("positives") / F.col("total") >= minimum
    return running.groupBy("class_idx").agg(
        F.min(F.when(reached, F.col("score"))).alias("threshold"), F.sum("hits").alias("support")
    ).select(class_name(F.col("class_idx"), classes).alias("class_name"), "threshold", "support")


def require_thresholds(table: DataFrame) -> dict[str, float]:
    """Thresholds of all classes as a dict (one entry per class); fails on an absent class or none reached."""
    out = {}
    for row in table.collect():
        if not row["support"]:
            raise ValueError(f"no examples of class {row['class_name']!r}")
        if row["threshold"] is None:
            raise ValueError(f"no threshold for {row['class_name']!r} reaches the precision")
        out[row["class_name"]] = row["threshold"]
    return out


def predictions(df: DataFrame, probability: str = "probability", label_index: str = "label_idx") -> DataFrame:
    p = F.col(probability)
    return df.select(
        F.col(label_index).alias("label_idx"),
        argmax(p).alias("predicted_idx"),
        F.array_max(p).alias("confidence"),
        p.alias("probability"),
    )


def confusion_counts(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("label_idx", "predicted_idx").agg(F.count("*").alias("n"))


def confusion_matrix(predicted: DataFrame, classes: Sequence[str] = MODEL_CLASSES) -> DataFrame:
    """Dense class-by-class counts, zero cells included (the class list spans the cells)."""
    cells = predicted.sparkSession.createDataFrame(
        [(i, j, a, b) for i, a in enumerate(classes) for j, b in enumerate(classes)],
        "label_idx int, predicted_idx int, label string, predicted string",
    )
    counts = confusion_counts(predicted)  # at most classes squared rows
    return cells.join(F.broadcast(counts), ["label_idx", "predicted_idx"], "left").select(
        "label", "predicted", F.coalesce("n", F.lit(0).cast("long")).alias("rows")
    )


def classification_report(predicted: DataFrame, classes: Sequence[str] = MODEL_CLASSES) -> DataFrame:
    """Precision, recall, F1 and support per class, then the macro averages; 0 where undefined."""
    matrix = confusion_matrix(predicted, classes)
    c = F.col
    per_class = matrix.select(
        F.explode(
            F.array(
                F.struct(c("label").alias("class_name"), c("rows").alias("actual"), F.lit(0).cast("long").alias("named"),
                         F.when(c("label") == c("predicted"), c("rows")).otherwise(0).alias("hit")),
                F.struct(c("predicted").alias("class_name"), F.lit(0).cast("long").alias("actual"), c("rows").alias("named"),
                         F.lit(0).cast("long").alias("hit")),
            )
        ).alias("_r")
    ).groupBy("_r.class_name").agg(
        F.sum("_r.actual").alias("support"), F.sum("_r.named").alias("named"), F.sum("_r.hit").alias("hit")
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    scored = per_class.withColumn("precision", ratio(c("hit"), c("named"))).withColumn(
        "recall", ratio(c("hit"), c("support"))
    ).withColumn("f1", ratio(2 * c("hit"), c("named") + c("support")))
    rows = scored.select("class_name", "precision", "recall", "f1", "support")
    macro = rows.agg(
        F.lit("macro avg").alias("class_name"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"), F.sum("support").alias("support"),
    )
    return rows.unionByName(macro)


def accuracy_and_brier(predicted: DataFrame) -> DataFrame:
    squares = F.aggregate(
        F.transform(
            "probability",
            lambda p, i: (p - (i == F.col("label_idx")).cast("double")) * (p - (i == F.col("label_idx")).cast("double")),
        ),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    return predicted.agg(
        F.avg((F.col("label_idx") == F.col("predicted_idx")).cast("double")).alias("accuracy"),
        F.avg(squares).alias("brier"),
    )


def reliability_bins(predicted: DataFrame, bins: int = 10) -> DataFrame:
    index = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return predicted.groupBy(index.alias("bin")).agg(
        F.count("*").alias("support"),
        F.avg((F.col("label_idx") == F.col("predicted_idx")).cast("double")).alias("accuracy"),
        F.avg("confidence").alias("mean_confidence"),
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected calibration error from the reliability bins."""
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence")) * F.col("support")
    return bins.agg((F.sum(gap) / F.sum("support")).alias("calibration_error"))
