"""Calibration when the rows show none of a class, as when conflict removal has taken all of them."""

import pytest
from pyspark.sql import functions as F

from flowloom.fixed import MODEL_CLASSES
from flowloom.operators import evaluation, modeling


def test_a_class_without_rows_keeps_its_score(spark):
    rows = [(k, [0.7 if i == k else 0.1 for i in range(4)]) for k in (1, 2, 3)] * 4 + [(1, [0.1, 0.1, 0.7, 0.1]), (2, [0.1, 0.1, 0.1, 0.7]), (3, [0.1, 0.7, 0.1, 0.1])]
    df = spark.createDataFrame(rows, "label_idx int, raw array<double>")
    with pytest.raises(ValueError):
        modeling.fit_sigmoid(df, MODEL_CLASSES)
    table = modeling.fit_sigmoid(df, MODEL_CLASSES, keep_unseen=True)
    own = modeling.coefficient_list(table)
    assert own[0] == (1.0, 0.0) and len(own) == 4
    seen = modeling.coefficient_list(modeling.fit_sigmoid(df.unionByName(spark.createDataFrame([(0, [0.7, 0.1, 0.1, 0.1])], df.schema)), MODEL_CLASSES))
    assert seen[0] != (1.0, 0.0)
    got = df.select(evaluation.apply_sigmoid(F.col("raw"), own).alias("p")).collect()
    assert all(abs(sum(r["p"]) - 1) < 1e-9 for r in got)


def test_forest_scores_have_an_entry_for_each_class(spark):
    rows = [(MODEL_CLASSES[i % 2], float(i % 2) + i / 100) for i in range(40)]
    df = spark.createDataFrame(rows, "label string, feature__x double").withColumn("available__x", F.lit(True))
    model = modeling.train_forest(df, MODEL_CLASSES, trees=2, depth=2)
    got = modeling.score_forest(model, df, MODEL_CLASSES).collect()
    assert all(len(r["raw"]) == 4 and abs(sum(r["raw"]) - 1) < 1e-9 and r["raw"][2:] == [0.0, 0.0] for r in got)
