import pytest
from pyspark.sql import functions as F

from kinfold.operators import weights as Wt


@pytest.fixture(scope="module")
def small(spark):
    rows = [("1", "a", "a1"), ("2", "a", "a1"), ("3", "a", "a2"), ("4", "b", "b1")]
    return spark.createDataFrame(rows, "image_path string, species string, isolate_id string")


@pytest.mark.parametrize("floor", [0, 200_000])
def test_balanced_weights(small, floor):
    got = {r["image_path"]: r["weight"] for r in Wt.balanced_weights(small, floor=floor).collect()}
    assert got == {"1": 0.25, "2": 0.25, "3": 0.5, "4": 1.0}


def test_class_loss_weights(small):
    got = {r["species"]: (r["k"], r["n"], r["weight"]) for r in Wt.class_loss_weights(small, ["b", "a", "c"]).collect()}
    assert got == {"b": (0, 1, pytest.approx(4 / 3)), "a": (1, 3, pytest.approx(4 / 9)), "c": (2, 0, 0.0)}


def test_modes_never_combine(small):
    sums = {m: Wt.weight_column(small, m, ["a", "b"]).agg(F.sum("weight")).first()[0] for m in ("sampler", "loss", "none")}
    assert sums == {"sampler": pytest.approx(2.0), "loss": pytest.approx(4.0), "none": 4.0}
    with pytest.raises(ValueError, match="imbalance"):
        Wt.weight_column(small, "both", ["a", "b"])


@pytest.mark.parametrize("floor", [0, 200_000])
def test_resample_draws_classes_and_groups_equally(spark, floor):
    # Class a: one group of 2900 items and one of 100; class b: one group of 1000.
    items = spark.range(4000).select(
        F.concat(F.lit("i"), F.col("id")).alias("image_path"),
        F.when(F.col("id") < 3000, "a").otherwise("b").alias("species"),
        F.when(F.col("id") < 2900, "a1").when(F.col("id") < 3000, "a2").otherwise("b1").alias("isolate_id"),
    )
    drawn = Wt.weighted_resample(items, ["a", "b"], 3, floor=floor)
    by_group = {r[0]: r[1] for r in drawn.groupBy("isolate_id").agg(F.sum("copies")).collect()}
    assert sum(by_group.values()) == 4000
    assert abs(by_group["b1"] - 2000) < 200 and abs(by_group["a1"] - 1000) < 150 and abs(by_group["a2"] - 1000) < 150
    again = Wt.weighted_resample(items.repartition(7), ["a", "b"], 3, floor=floor)
    assert drawn.select("image_path", "copies").exceptAll(again.select("image_path", "copies")).count() == 0
    assert Wt.expand_copies(drawn, chunk=3).count() == 4000
    assert Wt.expand_copies(drawn).groupBy("image_path").count().exceptAll(drawn.select("image_path", "copies")).count() == 0


def test_every_draw_lands_for_unique_and_repeated_items(spark):
    """Items that stand in several rows are told apart by their rank, unique ones by their key; NULL groups are drawn, too."""
    rows = [(f"i{i}", "ab"[i % 2], None if i % 5 == 0 else f"g{i % 6}", i) for i in range(120)]
    unique = spark.createDataFrame(rows, "image_path string, species string, isolate_id string, extra int")
    drawn = Wt.weighted_resample(unique, ["a", "b"], 3)
    assert drawn.columns == [*unique.columns, "copies"]
    assert drawn.agg(F.sum("copies")).first()[0] == 120
    assert drawn.where("isolate_id IS NULL").count() > 0 and drawn.select("image_path").distinct().count() == drawn.count()
    repeated = unique.unionByName(unique.where("extra < 30").withColumn("extra", F.col("extra") + 1000))
    assert Wt.weighted_resample(repeated, ["a", "b"], 3).agg(F.sum("copies")).first()[0] == 150
