import glob
import json
import math

import pytest
from pyspark.sql import functions as F

from kinfold.fixed import REVIEW_COLUMNS
from kinfold.functions.scores import scores_from_columns
from kinfold.operators import manifest, report, review, scoring
from kinfold.plans import training, views
from kinfold.sources import tables
from kinfold.sources.models import load_heads


@pytest.fixture(scope="module")
def two_classes(spark):
    rows = [
        (f"item{i:03d}", f"{'ab'[i % 2]} one-{i % 8}", f"{'ab'[i % 2]} one", "colony", "na", "unknown", None, "cmu",
         (i * 29 % 100) / 100, 1 - (i * 29 % 100) / 100) for i in range(80)
    ]
    schema = ("image_path string, isolate_id string, species string, modality string, view string, device string, day int,"
              " source string, `prob_a one` double, `prob_b one` double")
    return spark.createDataFrame(rows, schema)


def document(path):
    part = f"{path}/metrics.json"
    return json.loads(open(part).read())


def test_report_document_and_comparison(spark, tmp_path, two_classes):
    classes = ["a one", "b one", "never"]
    df = two_classes.withColumn("prob_never", F.lit(0.0))
    full = report.evaluate(df, classes, n_boot=20, seed=1)
    tables.write_report(report.report_row(full, {"split": F.lit("kfold")}), f"{tmp_path}/with/metrics.json")
    bare = report.evaluate(df, classes, n_boot=0)
    tables.write_report(report.report_row(bare), f"{tmp_path}/without/metrics.json")

    doc = document(f"{tmp_path}/with")
    assert list(doc) == ["split", "image_level", "isolate_level"]
    item = doc["image_level"]
    assert item["n"] == 80 and doc["isolate_level"]["n"] == 8
    assert item["classes_without_support"] == ["never"] and math.isnan(float(item["per_class"]["never"]["auc"]))
    assert sum(map(sum, item["confusion_matrix"])) == 80 and len(item["confusion_matrix"]) == 3
    assert item["accuracy"] == pytest.approx(sum(item["confusion_matrix"][k][k] for k in range(3)) / 80)
    ci = item["ci95_isolate_bootstrap"]
    assert ci["method"] == "isolates within class" and ci["replicates"] == 20 and ci["accuracy"][0] <= item["accuracy"] <= ci["accuracy"][1]
    assert "ci95_isolate_bootstrap" not in document(f"{tmp_path}/without")["image_level"]

    runs = tables.read_reports(spark, [f"{tmp_path}/with", f"{tmp_path}/without"])
    rows = {(r["run"], r["level"]): r for r in report.compare_runs(runs).collect()}
    assert set(rows) == {(r, lv) for r in ("with", "without") for lv in ("image", "isolate")}
    assert "[" in rows["with", "image"]["accuracy"] and rows["without", "image"]["accuracy"] == f"{item['accuracy']:.3f}"
    assert rows["with", "image"]["accuracy"].startswith(rows["without", "image"]["accuracy"])
    assert rows["without", "image"]["macro_auc"] == f"{item['macro']['auc']:.3f}"


def test_prediction_csv_is_a_valid_manifest(spark, tmp_path, two_classes):
    classes = ["a one", "b one"]
    scored = two_classes.withColumn("scores", scores_from_columns(classes))
    table = scoring.prediction_table(scored, classes, F.lit("fold0")).withColumn("image_path", F.concat(F.lit("/abs/"), "image_path"))
    tables.write_csv(table, f"{tmp_path}/predictions.csv")
    raw, root = tables.read_manifest_csv(spark, f"{tmp_path}/predictions.csv")
    again = manifest.load(raw, root)
    assert again.select("image_path", "isolate_id").exceptAll(table.select("image_path", "isolate_id")).count() == 0
    assert again.count() == 80 and "prob_a one" in again.columns


def test_review_sheet_file(spark, tmp_path, two_classes):
    classes = ["a one", "b one"]
    sample = review.first_per_class(two_classes, 1).withColumn("scores", scores_from_columns(classes)).withColumn("predicted", F.lit("a one"))
    sheet = review.review_sheet(sample)
    tables.write_review_sheet(sheet.coalesce(1), f"{tmp_path}/sheet")
    [part] = glob.glob(f"{tmp_path}/sheet/part-*.csv")
    lines = open(part).read().splitlines()
    assert lines[0] == ",".join(REVIEW_COLUMNS)
    assert lines[1] == "item000,,a one,1.0,0000_item000.png,,,,,"
    assert len(lines) == 3


def test_ranking_and_routing(spark, two_classes):
    classes = ["a one", "b one"]
    ranked = scoring.ranking(two_classes.withColumn("scores", scores_from_columns(classes)), classes)
    per_item = ranked.groupBy("image_path").agg(F.sum("score").alias("s"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max("score").alias("m"))
    assert per_item.where("abs(s - 1) > 1e-9 or top <> m").count() == 0
    with pytest.raises(ValueError, match="same classes"):
        scoring.combine_modalities([two_classes, two_classes.drop("prob_b one")], classes)


def test_class_absent_from_training_keeps_its_place(spark, sf_dir):
    rows = views.vectors(spark, sf_dir).where("species in ('class_0', 'class_2')")
    classes = ["class_0", "class_1", "class_2", "class_3"]
    model = scoring.fit_head(rows, classes, max_iter=50)
    got = scoring.score(model, rows)
    assert got.where(F.size("scores") != 4).count() == 0
    assert got.where((F.col("scores")[1] > 0.01) | (F.col("scores")[3] != 0)).count() == 0
    correct = got.where(F.array_position("scores", F.array_max("scores")) - 1 == F.when(F.col("species") == "class_0", 0).otherwise(2))
    assert correct.count() / rows.count() > 0.9


def test_too_many_fits_are_refused(spark, sf_dir):
    with pytest.raises(ValueError, match="max_folds"):
        training.cross_validate(views.vectors(spark, sf_dir), strategy="loio", max_folds=10)


def test_whole_run_and_evaluation_of_its_head(spark, tmp_path, sf_dir):
    rows = views.vectors(spark, sf_dir)
    run = training.run_training(rows, str(tmp_path / "run"), n_folds=3, max_iter=5, n_boot=10, fit_final=True)
    assert run.predictions.count() == rows.count() == run.predictions.select("image_path").distinct().count()
    assert {r[0] for r in run.predictions.select("fold").distinct().collect()} == {"fold0", "fold1", "fold2"}
    folds_per_group = run.predictions.groupBy("isolate_id").agg(F.countDistinct("fold").alias("n"))
    assert folds_per_group.where("n > 1").count() == 0
    doc = document(tmp_path / "run")
    assert doc["split"] == "kfold" and len(doc["folds"]) == 3 and doc["image_level"]["n"] == rows.count()
    assert doc["image_level"]["ci95_isolate_bootstrap"]["replicates"] == 10
    _, meta = load_heads(spark, str(tmp_path / "run" / "model"))
    assert meta["classes"] == run.classes and meta["folds"] == ["all"] and meta["modality"] == "microscopic"
    by_fold, _ = load_heads(spark, str(tmp_path / "run" / "folds"))
    assert by_fold.folds == ["fold0", "fold1", "fold2"] and (by_fold.weights == run.heads.weights).all()

    predictions, _ = training.evaluate_saved_head(spark, str(tmp_path / "run" / "model"), rows, str(tmp_path / "eval"), n_boot=0)
    assert {r[0] for r in predictions.select("fold").distinct().collect()} == {"eval"}
    again, _ = training.score_saved_head(spark, str(tmp_path / "run" / "model"), rows)
    assert again.exceptAll(predictions).count() == 0
    with pytest.raises(ValueError, match="class list"):
        training.score_saved_head(spark, str(tmp_path / "run" / "model"), rows.withColumn("species", F.lit("new")))
    with pytest.raises(ValueError, match="nothing selected"):
        training.score_saved_head(spark, str(tmp_path / "run" / "model"), rows, modality="colony")


def test_a_class_named_nan_stays_a_name(spark, tmp_path):
    rows = [(f"i{i}", f"{'NaN' if i % 2 else 'x'}-{i % 4}", "NaN" if i % 2 else "x", i / 10, 1 - i / 10) for i in range(10)]
    df = spark.createDataFrame(rows, "image_path string, isolate_id string, species string, `prob_NaN` double, prob_x double").withColumn("prob_never", F.lit(0.0))
    result = report.evaluate(df, ["NaN", "x", "never"], n_boot=0)
    extra = {"classes": F.array(F.lit("NaN"), F.lit("x")), "note": F.lit("NaN"), "loss": F.lit(float("nan"))}
    tables.write_report(report.report_row(result, extra), f"{tmp_path}/run/metrics.json")
    text = open(f"{tmp_path}/run/metrics.json").read()
    assert '"classes":["NaN","x"]' in text and '"note":"NaN"' in text and '"loss":NaN' in text
    doc = json.loads(text)
    assert doc["classes"] == ["NaN", "x"] and math.isnan(doc["loss"]) and math.isnan(doc["image_level"]["per_class"]["never"]["auc"])
    assert "NaN" in doc["image_level"]["per_class"]
    read = tables.read_reports(spark, [f"{tmp_path}/run"]).first()
    assert read["image_level"]["classes_without_support"] == ["never"] and math.isnan(read["image_level"]["per_class"]["never"]["auc"])
