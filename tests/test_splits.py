"""Splits of groups of very different sizes: one huge, many single items, a class of one group."""

import random

import pytest
from pyspark.sql import functions as F

from kinfold.operators import splits as S
from kinfold.operators.skew import attach

CLASSES = ["lone", "pair", "many", "huge"]


def make_rows():
    rng = random.Random(31)
    rows = []
    for label, n_groups in (("lone", 1), ("pair", 2), ("many", 17), ("huge", 3)):
        for g in range(n_groups):
            size = 120 if (label, g) == ("huge", 0) else rng.choice([1, 1, 2, 5])
            rows += [(f"/{label}/{g}/{i}", label, f"{label}#{g}") for i in range(size)]
    rng.shuffle(rows)
    return rows


ROWS = make_rows()
GROUPS = sorted({r[2] for r in ROWS})


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ROWS, "image_path string, species string, isolate_id string").repartition(3)


def validated(folds):
    return {r["isolate_id"]: r["fold"] for r in folds.collect()}


@pytest.mark.parametrize("strategy, options", [("kfold", {"n_folds": 4}), ("kfold", {"n_folds": 40}), ("holdout", {"val_fraction": 0.3}), ("loio", {})])
def test_sides_never_share_a_group_and_hold_every_item(items, strategy, options):
    folds = S.make_folds(items, strategy, seed=13, **options)
    assigned = S.assign_folds(items, folds, floor=10)  # the huge group is spread
    S.assert_assignment(items, assigned)
    fold_of = validated(folds)
    assert sorted(fold_of) == GROUPS
    found = {r["image_path"]: r["fold"] for r in assigned.collect()}
    assert found == {path: fold_of[g] for path, _, g in ROWS}
    for fold in sorted({f for f in fold_of.values() if f})[:3]:
        sides = S.fold_sides(assigned, fold)
        S.assert_no_leakage(items, sides)
        assert {r["isolate_id"] for r in sides.where("side = 'val'").collect()} == {g for g, f in fold_of.items() if f == fold}


@pytest.mark.parametrize("n_folds", [2, 3, 7, 50])
def test_deal_is_even_and_spreads_every_class(items, n_folds):
    fold_of = validated(S.make_folds(items, "kfold", n_folds=n_folds, seed=5))
    sizes = [list(fold_of.values()).count(f"fold{i}") for i in range(n_folds)]
    assert sum(sizes) == len(GROUPS) and max(sizes) - min(sizes) <= 1
    for label in CLASSES:
        own = [f for g, f in fold_of.items() if g.startswith(f"{label}#")]
        assert len(set(own)) == min(len(own), n_folds)


def test_same_seed_same_deal_for_any_partitioning(items):
    deals = [validated(S.make_folds(items.repartition(n), "kfold", n_folds=3, seed=s)) for n, s in ((1, 8), (6, 8), (6, 9))]
    assert deals[0] == deals[1] != deals[2]


def test_holdout_takes_the_wanted_share(items):
    for fraction in (0.1, 0.25, 0.5, 0.99):
        parts = S.holdout_splits(fraction)
        held = [g for g, f in validated(S.make_folds(items, "holdout", val_fraction=fraction, seed=2)).items() if f]
        assert parts == max(2, round(1 / fraction))
        assert abs(len(held) - len(GROUPS) / parts) < 1


def test_one_fold_for_each_group(items):
    assert validated(S.make_folds(items, "loio")) == {g: f"loio_{g}" for g in GROUPS}


def test_description_equals_a_direct_count(items):
    folds = S.make_folds(items, "kfold", n_folds=30, seed=4)
    fold_of = validated(folds)
    names = S.fold_names("kfold", 30)
    got = {r["fold"]: r for r in S.describe_folds(folds, CLASSES, names).collect()}
    assert sorted(got) == sorted(names)
    for name, r in got.items():
        groups = [g for g, f in fold_of.items() if f == name]
        n_items = sum(row[2] in groups for row in ROWS)
        assert (r["val_groups"], r["val_items"]) == (len(groups), n_items)
        assert (r["train_groups"], r["train_items"]) == (len(GROUPS) - len(groups), len(ROWS) - n_items)
        assert r["val_classes_without_groups"] == [c for c in CLASSES if not any(g.startswith(f"{c}#") for g in groups)]


def test_a_cut_group_is_named(items):
    cut = F.when(F.col("image_path").isin("/huge/0/3", "/huge/0/90"), "val").otherwise("train")
    with pytest.raises(AssertionError, match="huge#0"):
        S.assert_no_leakage(items, items.withColumn("fold", F.lit("x")).withColumn("side", cut))


def test_lost_and_repeated_items_are_found(items):
    assigned = S.assign_folds(items, S.make_folds(items, "kfold", n_folds=3))
    lost, again = ROWS[0][0], ROWS[1][0]
    without = assigned.where(F.col("image_path") != lost)
    for wrong in (without, assigned.union(assigned.where(F.col("image_path") == again)), without.union(assigned.where(F.col("image_path") == again))):
        with pytest.raises(AssertionError, match="lost or repeated"):
            S.assert_assignment(items, wrong)
        sides = wrong.drop("fold").withColumn("fold", F.lit("x")).withColumn("side", F.lit("train"))
        with pytest.raises(AssertionError, match="exactly once"):
            S.assert_no_leakage(items, sides)


def test_null_groups_are_assigned_like_any_other(spark):
    rows = [("a", "l", None), ("b", "l", None), ("c", "l", "g"), ("d", "m", "h")]
    df = spark.createDataFrame(rows, "image_path string, species string, isolate_id string")
    for floor in (0, 1000):
        out = S.assign_folds(df, S.make_folds(df, "kfold", n_folds=2), floor=floor).collect()
        assert sorted(r["image_path"] for r in out) == ["a", "b", "c", "d"]
        assert all(r["fold"] for r in out)
    facts = spark.createDataFrame([(None, 5), ("g", 6)], "isolate_id string, v int")
    assert sorted(r["v"] for r in attach(df, facts, ["isolate_id"], "image_path", floor=0).collect()) == [5, 5, 6]


def test_bad_parameters(items):
    for options in ({"strategy": "thirds"}, {"strategy": "holdout", "val_fraction": 0.0}, {"strategy": "holdout", "val_fraction": 1.5}):
        with pytest.raises(ValueError):
            S.make_folds(items, **options)
