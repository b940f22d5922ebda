import os

import pytest
from pyspark.sql import functions as F

from kinfold.functions.text import resolve_path, stem, strip, value_with_interval, whole_number
from kinfold.operators import manifest as M
from kinfold.sources import tables


def write(folder, header, *rows):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / "m.csv"
    path.write_text("\n".join([header, *rows]) + "\n")
    return str(path)


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


def test_good_manifest(spark, tmp_path):
    path = write(tmp_path, "image_path,species,isolate_id,modality,source,extra", "x.png,A, I1 ,colony,cmu,NA", "y.png,A,,colony,openfungi,")
    raw, root = tables.read_manifest_csv(spark, path)
    df = M.load(raw, root).orderBy("image_path")
    assert column(df, "isolate_id") == ["I1", f"img:{tmp_path}/y.png"]
    assert column(df, "extra") == ["NA", ""]
    row = df.first()
    assert (row["view"], row["device"], row["day"], row["source"]) == ("na", "unknown", None, "cmu")


def test_relative_manifest_path_gives_absolute_items(spark, tmp_path, monkeypatch):
    write(tmp_path / "sub", "image_path,species,isolate_id,modality", "x.png,A,I1,colony")
    monkeypatch.chdir(tmp_path)
    raw, root = tables.read_manifest_csv(spark, os.path.abspath("sub/m.csv"))
    assert column(M.load(raw, root), "image_path") == [f"{tmp_path}/sub/x.png"]


@pytest.mark.parametrize("rows, message", [
    (["x.png,A,I1,colony,cmu,", "x.png,B,I1,colony,cmu,"], "I1"),
    (["x.png,A,,colony,cmu,"], "blank group"),
    (["x.png,A,I1,histology,cmu,"], "histology"),
    (["x.png,A,I1,colony,elsewhere,"], "elsewhere"),
    (["x.png,A,I1,colony,cmu,3.5"], "fractional"),
])
def test_bad_manifests(spark, tmp_path, rows, message):
    path = write(tmp_path, "image_path,species,isolate_id,modality,source,day", *rows)
    raw, root = tables.read_manifest_csv(spark, path)
    with pytest.raises(ValueError, match=message):
        M.load(raw, root)
    assert M.load(raw, root, strict=False).count() == len(rows)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="modality"):
        M.load(spark.createDataFrame([("x", "a", "i")], "image_path string, species string, isolate_id string"), "/r")


def test_every_broken_rule_is_counted_with_examples(spark):
    rows = [(f"p{i}", "A", "", "colony", "cmu") for i in range(5)] + [("q", "A", "g", "weird", "cmu"), ("r", "A", "g", "colony", "cmu")]
    raw = spark.createDataFrame(rows, "image_path string, species string, isolate_id string, modality string, source string")
    listing = spark.createDataFrame([(f"/d/p{i}",) for i in range(5)] + [("/d/q",)], "path string")
    found = {(r["rule"], r["value"]): (r["n"], r["examples"]) for r in M.violations(raw, "/d", listing).collect()}
    assert found == {
        ("blank_group", ""): (5, ["/d/p0", "/d/p1", "/d/p2"]), ("domain", "weird"): (1, ["/d/q"]), ("missing_item", ""): (1, ["/d/r"]),
    }


def test_listing_of_a_folder(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(b"1")
    (tmp_path / "other.txt").write_bytes(b"1")
    assert column(tables.listing(spark, str(tmp_path), "*.png"), "path") == [f"{tmp_path}/x.png"]


def test_paths(spark):
    cases = {
        "a/b.png": "/r/a/b.png", "/x/y.png": "/x/y.png", "./a/../b.png": "/r/b.png", "../up.png": "/up.png", "a//b": "/r/a/b",
        "s3://bucket/a/./b/../c": "s3://bucket/a/c", "s3://bucket/a/c": "s3://bucket/a/c", "a/.hidden": "/r/a/.hidden",
        "/a/b/": "/a/b", "//a/b": "/a/b", "/../x": "/x", "a/b..png": "/r/a/b..png",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string").select("p", resolve_path(F.col("p"), "/r/").alias("v"))
    assert {r["p"]: r["v"] for r in df.collect()} == cases


def test_text_cells(spark):
    df = spark.createDataFrame([(" \t x y \n",)], "c string")
    assert df.select(strip(F.col("c"))).first()[0] == "x y"
    days = {"3": 3, "3.0": 3, " 3 ": 3, "": None, "abc": None, "3.5": None, "3d": None, "1e1": 10, "-2": -2}
    df = spark.createDataFrame([(k,) for k in days], "c string")
    assert {r[0]: r[1] for r in df.select("c", whole_number(F.col("c"))).collect()} == days
    names = {"/a/b.c.png": "b.c", "x": "x", "/a/.hid": ".hid", "d.e/f": "f"}
    df = spark.createDataFrame([(k,) for k in names], "c string")
    assert {r[0]: r[1] for r in df.select("c", stem(F.col("c"))).collect()} == names


def test_value_with_interval(spark):
    df = spark.createDataFrame([(5 / 6, 0.6, 1.0), (0.5, None, None), (None, None, None)], "v double, a double, b double")
    got = [r[0] for r in df.select(value_with_interval(F.col("v"), F.col("a"), F.col("b"))).collect()]
    assert got == ["0.833 [0.60-1.00]", "0.500", "nan"]


def test_class_list(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "species string")
    assert M.resolve_classes(df) == ["a", "b"]
    assert M.resolve_classes(df, ["b", "x", "a"]) == ["b", "x", "a"]
    with pytest.raises(ValueError, match="'a'"):
        M.resolve_classes(df, ["b"])
    assert [tuple(r) for r in M.unknown_labels(df, ["a"]).collect()] == [("b", 2)]


def test_selection_and_guards(spark):
    df = spark.createDataFrame([("colony", "cmu"), ("microscopic", "openfungi")], "modality string, source string")
    assert M.select(df, "colony").count() == 1 and M.select(df).count() == 2 and M.select(df, "colony", "openfungi").count() == 0
    with pytest.raises(ValueError, match="nothing selected"):
        M.require_rows(M.select(df, "colony", "openfungi"), "x")
    for bad in ({"modality": "x"}, {"imbalance": "both"}, {"strategy": "x"}, {"source": "x"}, {"val_fraction": 0.0}):
        with pytest.raises(ValueError):
            M.check_parameters(**bad)


def test_raw_selection_is_pushed_into_the_scan(spark, tmp_path):
    rows = [("1", "colony", "cmu"), ("2", "colony", ""), ("3", "colony", None), ("4", "colony", "openfungi"), ("5", "microscopic", "cmu")]
    raw = spark.createDataFrame(rows, "image_path string, modality string, source string").selectExpr("*", "'a' AS species", "'g' AS isolate_id")
    raw.write.parquet(str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    for source in ("cmu", "openfungi", "all"):
        loaded = M.load(stored, "/r", strict=False, modality="colony", source=source)
        plain = M.select(M.clean(stored, "/r"), "colony", source)
        assert sorted(column(loaded, "image_path")) == sorted(column(plain, "image_path"))
    plan = M.load(stored, "/r", strict=False, modality="colony", source="openfungi")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(modality,colony)" in plan and "EqualTo(source,openfungi)" in plan
    bare = stored.drop("source")
    assert M.load(bare, "/r", strict=False, source="openfungi").count() == 0
    assert M.load(bare, "/r", strict=False, source="cmu").count() == 5


def test_validated_while_written(spark, tmp_path):
    """Once over the manifest: its rows are counted where they are read."""
    rows = [(f"x{i}.png", "a" if i % 2 else "b", f"g{i % 4}", "colony", str(i)) for i in range(40)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    raw = spark.createDataFrame(rows, "image_path string, species string, isolate_id string, modality string, day string")
    raw = raw.mapInArrow(counted, raw.schema)
    there = spark.createDataFrame([(f"/r/x{i}.png",) for i in range(40)], "path string")
    got = M.load_into(raw, "/r", str(tmp_path / "clean"), there)
    assert read.value == 40
    assert got.exceptAll(M.clean(raw, "/r")).count() == 0 and got.count() == 40
    for broken, text in (
        (raw.withColumn("modality", F.lit("sound")), "outside its domain"), (raw.withColumn("day", F.lit("1.5")), "fractional"),
        (raw.withColumn("isolate_id", F.lit("one")), "several labels"),
    ):
        with pytest.raises(ValueError, match=text):
            M.load_into(broken, "/r", str(tmp_path / "broken"), there)
    with pytest.raises(ValueError, match="no file"):
        M.load_into(raw, "/r", str(tmp_path / "broken"), there.where("path <> '/r/x3.png'"))
    assert [p.name for p in tmp_path.iterdir()] == ["clean"]
