"""Rows in, rows out: nothing is lost, changed or cut without an error."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kinfold.functions.text import fixed_decimals, is_fractional, whole_number
from kinfold.operators import manifest, scoring, weights
from kinfold.sources import images, tables


def test_csv_cells_come_back_as_they_were(spark, tmp_path):
    cells = [" a ", "b\nc", 'q"uote', "x,y", "", "\tt", "plain"]
    df = spark.createDataFrame([(f"/r/{i}.png", c) for i, c in enumerate(cells)], "image_path string, species string").repartition(2)
    tables.write_manifest_csv(df, f"{tmp_path}/m.csv", "/r")
    raw, _ = tables.read_manifest_csv(spark, f"{tmp_path}/m.csv")
    assert {r["image_path"]: r["species"] for r in raw.collect()} == {f"{i}.png": c for i, c in enumerate(cells)}


def test_csv_rows_with_too_many_cells_fail(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("image_path,species\na,1\nb,2,3\n")
    with pytest.raises(PySparkException, match="more cells"):
        tables.read_manifest_csv(spark, str(path))[0].collect()
    path.write_text("image_path,species\na\nb,2\n")
    assert sorted(map(tuple, tables.read_manifest_csv(spark, str(path))[0].collect())) == [("a", ""), ("b", "2")]


def test_broken_images_are_reported(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(b"no image")
    with pytest.raises(PySparkException, match="cannot decode"):
        images.read_images(spark, str(tmp_path)).collect()
    kept = images.read_images(spark, str(tmp_path), strict=False)
    assert [r["pixels"] for r in kept.collect()] == [None]
    assert images.broken_images(kept).first()["value"].endswith("x.png")


def test_rows_of_a_modality_without_model_fail(spark):
    rows = [(f"i{k}", "ab"[k % 2], f"g{k}", "m", [float(k % 2), 1.0]) for k in range(20)]
    df = spark.createDataFrame(rows, "image_path string, species string, isolate_id string, modality string, embedding array<double>")
    model = scoring.fit_head(df, ["a", "b"], imbalance="none")
    assert scoring.route_by_modality({"m": model}, df).count() == 20
    odd = df.withColumn("modality", F.when(F.col("image_path") == "i3", "other").otherwise("m"))
    with pytest.raises(PySparkException, match="no model for modality other"):
        scoring.route_by_modality({"m": model}, odd).collect()


@pytest.mark.parametrize("mode", ["sampler", "loss", "none"])
def test_labels_outside_the_list_fail_in_every_mode(spark, mode):
    df = spark.createDataFrame([("1", "a", "g"), ("2", "zz", "h")], "image_path string, species string, isolate_id string")
    assert weights.weight_column(df, mode, ["a", "zz"]).count() == 2
    with pytest.raises(PySparkException, match="zz"):
        weights.weight_column(df, mode, ["a"]).collect()
    with pytest.raises(PySparkException, match="zz"):
        weights.weighted_resample(df, ["a"], 1).collect()


def test_rows_without_group_or_label_get_weights(spark):
    rows = [("1", None, "g"), ("2", "a", None), ("3", "a", None), ("4", "a", "g")]
    df = spark.createDataFrame(rows, "image_path string, species string, isolate_id string")
    for floor in (0, 1000):
        assert {r["image_path"]: r["weight"] for r in weights.balanced_weights(df, floor=floor).collect()}.keys() == {"1", "2", "3", "4"}


def test_days_are_64_bit(spark):
    texts = ["3000000000", " 7.0 ", "9007199254740993", "1e3", "3.5", "x", "", "99999999999999999999"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", whole_number(F.col("t")).alias("d"), is_fractional(F.col("t")).alias("f")).orderBy("i").collect()
    assert [r["d"] for r in got] == [3000000000, 7, 9007199254740993, 1000, None, None, None, None]
    assert [r["f"] for r in got] == [False, False, False, False, True, False, False, True]


def test_error_text_names_all_bad_values(spark):
    rows = [(f"p{i}", "s", f"g{i}", f"bad{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "image_path string, species string, isolate_id string, modality string")
    with pytest.raises(ValueError) as error:
        manifest.load(df, "/r")
    assert all(f"bad{i}" in str(error.value) for i in range(9))


@pytest.mark.parametrize("digits", [2, 3, 4])
def test_decimals_equal_pythons(spark, digits):
    rng = random.Random(digits)
    values = [k / 40 for k in range(41)] + [k / 80 for k in range(81)] + [k / 2000 for k in range(2001)] + [rng.random() for _ in range(6000)]
    values += [k / 1024 for k in range(1025)] + [0.2625, 0.715, 0.925, 1e-12, 12345.0625, -0.125, -1.5, 2**-30, 5e-4, 1 - 2**-53, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed_decimals(F.col("v"), digits).alias("t"))
    wrong = [(r["v"], r["t"], f"{r['v']:.{digits}f}") for r in df.collect() if r["t"] != f"{r['v']:.{digits}f}"]
    assert not wrong, wrong[:5]
