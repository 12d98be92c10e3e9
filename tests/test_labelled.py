"""Labelled data preparation, splits, evaluation and models."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from flowloom.fixed import FLOW_CSV_COLUMNS, MODEL_CLASSES
from flowloom.operators import evaluation, labelled, modeling
from flowloom.sources import tables


def test_role_bounds_match_the_published_group_counts():
    train, validation, calibration = labelled.role_bounds(1370)
    assert (train, validation - train, calibration - validation, 1370 - calibration) == (959, 137, 137, 137)
    with pytest.raises(ValueError):
        labelled.role_bounds(1)


def test_names_are_normalised_and_missing_ones_reported(spark):
    df = spark.createDataFrame([(1, "x")], "` Flow   Duration ` int, Label string")
    assert labelled.normalize_columns(df, ["Flow Duration", "Label"]).columns == ["Flow Duration", "Label"]
    with pytest.raises(ValueError, match="Total Fwd Packets"):
        labelled.normalize_columns(df)


def test_numbers_are_coerced(spark):
    df = spark.createDataFrame([("1.5",), ("n/a",), ("Infinity",), ("-2",), (None,), ("NaN",)], "v string")
    got = labelled.coerce_numeric(df, ["v"]).collect()
    assert [r["v"] for r in got] == [1.5, None, None, None, None, None]
    assert [r["nonfinite_cells"] for r in got] == [0, 1, 1, 0, 1, 1]


def raw_rows(spark, n=400):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        label = rng.choice(["BENIGN", "DDoS", " PortScan ", "Bot", "Other"])
        rows.append((f"file{i % 2}", i // 2, str(rng.choice([-1, 0, 1000, 2000])), "1", str(rng.randrange(2)), "5", "0", "0", "0",
                     rng.choice(["0", "x"]), label))
    return spark.createDataFrame(rows, "source_name string, source_index long, " + ", ".join(f"`{c}` string" for c in FLOW_CSV_COLUMNS) + ", Label string")


def test_removed_and_kept_rows_add_up(spark):
    report = {r["reason"]: r["rows"] for r in labelled.preparation_report(raw_rows(spark)).collect()}
    removed = ("unsupported_label_rows", "invalid_core_rows_removed", "conflicting_rows_removed", "duplicate_rows_removed", "rows_kept")
    assert report["rows_in"] == sum(report[k] for k in removed) == 400
    table = labelled.prepared_rows(raw_rows(spark))
    two_steps = labelled.dedupe_exact(labelled.drop_conflicting(table))
    assert sorted(map(str, two_steps.collect())) == sorted(map(str, labelled.unique_vectors(table).collect()))


def test_splits_keep_groups_whole(spark):
    df = spark.createDataFrame([(f"g{i % 40}", MODEL_CLASSES[i % 4], i) for i in range(800)], "group_id string, label string, n int")
    split, _ = labelled.first_complete_split(df)
    assert labelled.split_leakage(split).count() == 0
    summary = {r["split"]: r for r in labelled.split_summary(split).collect()}
    assert {k: v["groups"] for k, v in summary.items()} == {"train": 28, "validation": 4, "calibration": 4, "test": 4}
    assert sum(v["rows"] for v in summary.values()) == 800
    one = df.where("label = 'DDOS'").withColumn("label", F.when(F.col("group_id") == "g1", "RECON").otherwise(F.col("label")))
    with pytest.raises(ValueError):
        labelled.first_complete_split(one, tries=3)


def test_class_support(spark):
    df = spark.createDataFrame([(c,) for c in MODEL_CLASSES], "label string")
    assert labelled.require_classes(df) is df
    with pytest.raises(ValueError):
        labelled.require_classes(df.where("label <> 'RECON'"))


def test_raw_score_is_read_at_the_calibrated_class(spark):
    df = spark.createDataFrame([(1, [0.1, 0.6, 0.2, 0.1], [0.1, 0.7, 0.1, 0.1]), (2, [0.1, 0.2, 0.6, 0.1], [0.1, 0.1, 0.2, 0.6])],
                               "n int, raw array<double>, calibrated array<double>")
    got = evaluation.score_batch(df).orderBy("n").collect()
    assert [(r["threat_class"], r["raw_score"], r["calibrated_confidence"]) for r in got] == [("DDOS", 0.6, 0.7), ("BOT_OR_C2_LIKE", 0.1, 0.6)]
    with pytest.raises(Exception, match="not finite"):
        evaluation.score_batch(df.withColumn("raw", F.array(F.lit(float("nan")), *[F.lit(0.1)] * 3))).collect()


def test_calibration_fits_and_normalises(spark):
    rows = [(c, [0.7 if i == c else 0.1 for i in range(4)]) for c in range(4)] * 4 + [(1, [0.7, 0.1, 0.1, 0.1]), (0, [0.1, 0.7, 0.1, 0.1]),
            (3, [0.1, 0.1, 0.7, 0.1]), (2, [0.1, 0.1, 0.1, 0.7])]
    df = spark.createDataFrame(rows, "label_idx int, raw array<double>")
    coefficients = modeling.coefficient_list(modeling.fit_sigmoid(df, MODEL_CLASSES))
    got = df.select("raw", evaluation.apply_sigmoid(F.col("raw"), coefficients).alias("c")).collect()
    assert all(abs(sum(r["c"]) - 1) < 1e-9 for r in got)
    assert any(abs(a - b) > 1e-3 for r in got for a, b in zip(r["raw"], r["c"]))
    with pytest.raises(ValueError):
        modeling.fit_sigmoid(df.where("label_idx <> 2"), MODEL_CLASSES)


def test_thresholds(spark):
    rows = [(0, 0.9), (1, 0.8), (0, 0.7), (0, 0.6), (0, 0.5), (1, 0.4)]
    df = spark.createDataFrame([(y, [p, 1 - p]) for y, p in rows], "label_idx int, probability array<double>")
    got = evaluation.require_thresholds(evaluation.class_thresholds(df, classes=("A", "B"), minimum=0.8))
    assert got["A"] == 0.5  # the precision dips to one half on the way and comes back
    assert got["B"] == pytest.approx(0.6)
    with pytest.raises(ValueError):
        evaluation.require_thresholds(evaluation.class_thresholds(df.where("label_idx = 0"), classes=("A", "B")))


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([(i, f"g{i % 3}", "x") for i in range(50)], "v int, g string, y string")
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "a.csv"))
    df.write.parquet(str(tmp_path / "b.parquet"))
    assert tables.read_labelled(spark, str(tmp_path / "a.csv"), "y", "g", ["v"], schema="v int").agg(F.sum("v")).first()[0] == 1225
    assert tables.read_labelled(spark, str(tmp_path / "b.parquet"), "y", "g").count() == 50
    with pytest.raises(ValueError, match="nope"):
        tables.read_labelled(spark, str(tmp_path / "b.parquet"), "y", "g", ["nope"])
    with pytest.raises(ValueError):
        tables.read_labelled(spark, str(tmp_path / "c.txt"), "y", "g")
    with pytest.raises(FileNotFoundError):
        tables.existing_files(spark, str(tmp_path), ["a.csv", "zzz.csv"])


def test_row_numbers_follow_the_file_over_splits(spark, tmp_path):
    text = "n\n" + "".join(f"{i}\n" for i in range(5000))
    (tmp_path / "f.csv").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = spark.read.option("header", True).schema("n long").csv(str(tmp_path / "f.csv")).select("*", "_metadata")
        assert raw.rdd.getNumPartitions() > 1
        numbered = tables.with_row_numbers(raw)
        assert numbered.where("n <> source_index").count() == 0 and numbered.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_package_is_not_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(MODEL_CLASSES[i % 4], float(i % 4) if i % 5 else None, i % 5 > 0) for i in range(80)],
                               "label string, feature__x double, available__x boolean")
    model = modeling.train_forest(df, MODEL_CLASSES, trees=3, depth=3)
    scored = modeling.score_forest(model, df).withColumn("label_idx", evaluation.class_index(F.col("label")))
    assert scored.where(F.size("raw") != 4).count() == 0
    fit = modeling.fit_sigmoid(scored, MODEL_CLASSES)
    path = str(tmp_path / "package")
    modeling.save_package(path, model, MODEL_CLASSES, dict.fromkeys(MODEL_CLASSES, 0.5), fit)
    _, classes, thresholds, coefficients = modeling.load_package(spark, path)
    assert tuple(classes) == MODEL_CLASSES and thresholds["DDOS"] == 0.5 and len(coefficients) == 4
    with pytest.raises(Exception, match="exists"):
        modeling.save_package(path, model, MODEL_CLASSES, dict.fromkeys(MODEL_CLASSES, 0.5), fit)
    with pytest.raises(ValueError):
        modeling.check_package(MODEL_CLASSES, {"DDOS": 0.5})


def test_stable_buckets_of_whole_names(spark):
    from hashlib import blake2b, sha256

    from flowloom.functions.text import stable_bucket

    names = ["", "a.example", "m.ththth.example.net", "é" * 40]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for fn, digest in (("blake2b", lambda b: blake2b(b, digest_size=8).digest()), ("sha2", lambda b: sha256(b).digest()[:8])):
        got = [r[0] for r in df.select(stable_bucket(F.col("n"), 8, fn)).collect()]
        assert got == [int.from_bytes(digest(n.encode()), "big") % 8 for n in names]


def longest_method(df, capsys):
    """Bytes of the largest generated method of a plan; the JVM never compiles one above 8,000."""
    import re

    capsys.readouterr()
    df.explain("codegen")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))


def test_prepared_rows_are_compiled_and_odd_cells_stay_odd(spark, capsys):
    from flowloom.fixed import FLOW_CSV_COLUMNS
    from flowloom.operators import labelled

    cells = ["7", "0", "-1", "Infinity", "-Infinity", "NaN", "x", None]
    rows = [("f", i, " Bot ", *[v] * len(FLOW_CSV_COLUMNS)) for i, v in enumerate(cells)]
    names = ", ".join(f"`{n}` string" for n in FLOW_CSV_COLUMNS)
    raw = spark.createDataFrame(rows, f"source_name string, source_index long, Label string, {names}")
    found = {r["source_index"]: (r["nonfinite_cells"], r[FLOW_CSV_COLUMNS[0]]) for r in labelled.coerce_numeric(raw).collect()}
    n = len(FLOW_CSV_COLUMNS)
    assert found == {0: (0, 7.0), 1: (0, 0.0), 2: (0, None), 3: (n, None), 4: (n, None), 5: (n, None), 6: (n, None), 7: (n, None)}
    numeric = spark.createDataFrame([("f", 0, "Bot", *[1.0] * n)], "source_name string, source_index long, Label string, "
                                    + ", ".join(f"`{c}` double" for c in FLOW_CSV_COLUMNS))
    assert longest_method(labelled.prepared_rows(numeric), capsys) < 8000
