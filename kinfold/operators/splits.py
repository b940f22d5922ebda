"""Leakage-free stratified folds over groups.

Folds are decided on the group table (one row per group) and only then attached to item rows, so all
rows of a group land on one side. The fold table says which fold validates a group; training is the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.fixed import SPLIT_STRATEGIES
from kinfold.functions.hashing import digest
from kinfold.functions.scores import class_array
from kinfold.operators.manifest import check_choice
from kinfold.operators.skew import HOT_FLOOR, attach, hashed_rank
from kinfold.sources.shared import settle

SHOWN = 5


def group_table(df: DataFrame, label: str = "species", group: str = "isolate_id") -> DataFrame:
    """One row per group: its label and how many items it has."""
    return df.groupBy(group).agg(F.min(label).alias(label), F.count(F.lit(1)).alias("n_items"))


def deal(groups: DataFrame, n_splits: int, seed: int, label: str = "species", group: str = "isolate_id") -> DataFrame:
    """Adds ``fold_index``: classes in seeded order, groups in seeded order inside each class, dealt round-robin.
    The deal goes on from one class to the next, so fold sizes differ by at most one group and a class
    of m groups touches min(m, n_splits) folds."""
    ranked = hashed_rank(groups, [label], group, seed, across=[digest(seed, F.col(label)), F.col(label)])
    return ranked.withColumn("fold_index", F.pmod("ordinal", F.lit(n_splits)).cast("int")).drop("ordinal", "parent_size")


def holdout_splits(val_fraction: float) -> int:
    return max(2, round(1 / val_fraction))


def fold_names(strategy: str, n_folds: int) -> list[str]:
    """Names of the folds that exist whatever the data is (leave-one-out folds depend on it)."""
    return {"holdout": ["holdout"], "kfold": [f"fold{i}" for i in range(n_folds)], "loio": []}[strategy]


def make_folds(
    df: DataFrame,
    strategy: str,
    n_folds: int = 5,
    val_fraction: float = 0.2,
    seed: int = 42,
    label: str = "species",
    group: str = "isolate_id",
) -> DataFrame:
    """``fold, group, label, n_items``, one row per group: the fold that validates it, NULL when none does.
    Strategies: holdout, kfold, loio (leave one group out).

    The item rows are read once, into the group table; it and the result are written, because the later
    steps read them several times."""
    check_choice("split", strategy, SPLIT_STRATEGIES)
    if not 0 < val_fraction < 1:
        raise ValueError("val_fraction must lie between 0 and 1")
    groups = settle(group_table(df, label, group))
    if strategy == "loio":
        named = groups.withColumn("fold", F.concat(F.lit("loio_"), F.col(group)))
    elif strategy == "kfold":
        dealt = deal(groups, n_folds, seed, label, group)
        named = dealt.withColumn("fold", F.concat(F.lit("fold"), F.col("fold_index").cast("string")))
    else:
        dealt = deal(groups, holdout_splits(val_fraction), seed, label, group)
        named = dealt.withColumn("fold", F.when(F.col("fold_index") == 0, F.lit("holdout")))
    return settle(named.select("fold", group, label, "n_items"))


def assign_folds(
    df: DataFrame, folds: DataFrame, group: str = "isolate_id", item: str = "image_path", floor: int = HOT_FLOOR
) -> DataFrame:
    """Adds ``fold`` = the fold that validates the row (NULL: trained on in every fold). The table keeps
    its size: training rows of a fold are those with another ``fold``."""
    sizes = folds.select(group, F.col("n_items").alias("__size"))
    return attach(df, folds.select("fold", group), [group], item, sizes=sizes, floor=floor)


def fold_sides(assigned: DataFrame, fold: str) -> DataFrame:
    """All rows with ``side`` = val or train for one fold."""
    side = F.when(F.col("fold") == fold, F.lit("val")).otherwise(F.lit("train"))
    others = [c for c in assigned.columns if c != "fold"]
    return assigned.select(*others, side.alias("side"), F.lit(fold).alias("fold"))


def leaking_groups(sides: DataFrame, group: str = "isolate_id") -> DataFrame:
    """Groups on both sides of a fold, from a table with ``fold, side, group``."""
    return sides.groupBy("fold", group).agg(F.min("side").alias("low"), F.max("side").alias("high")).where(
        F.col("low") != F.col("high")
    ).select("fold", group)


def fold_coverage(df: DataFrame, sides: DataFrame, item: str = "image_path") -> DataFrame:
    """Per fold: rows held, distinct items held, items wanted, and whether each item is held exactly once."""
    held = sides.groupBy("fold", item).agg(F.count(F.lit(1)).alias("n"))
    per_fold = held.groupBy("fold").agg(F.sum("n").cast("bigint").alias("rows"), F.count(F.lit(1)).alias("items"))
    wanted = df.agg(F.count(F.lit(1)).alias("wanted")).scalar()
    return per_fold.withColumn("wanted", wanted).withColumn(
        "covered", (F.col("rows") == F.col("wanted")) & (F.col("items") == F.col("wanted"))
    )


def assigned_coverage(df: DataFrame, assigned: DataFrame, names: Sequence[str], item: str = "image_path") -> DataFrame:
    """``fold_coverage`` of all folds of an assigned table without a copy per fold: every fold holds each row of the table once,
    on one side or the other, so the table is counted once."""
    held = assigned.groupBy(item).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("items"))
    wanted = df.agg(F.count(F.lit(1)).alias("wanted")).scalar()
    return held.select(F.explode(class_array(names)).alias("fold"), F.col("rows").cast("bigint").alias("rows"), "items").withColumn("wanted", wanted).withColumn(
        "covered", (F.col("rows") == F.col("wanted")) & (F.col("items") == F.col("wanted"))
    )


def assert_no_leakage(df: DataFrame, sides: DataFrame, group: str = "isolate_id", item: str = "image_path") -> None:
    """Raises when a group sits on both sides of a fold or a fold does not hold every item exactly once."""
    leaks = leaking_groups(sides, group).orderBy("fold", group).limit(SHOWN).collect()
    if leaks:
        raise AssertionError(f"{leaks[0]['fold']}: groups on both sides: {[r[group] for r in leaks]}")
    uncovered = fold_coverage(df, sides, item).where(~F.col("covered")).orderBy("fold").limit(1).collect()
    if uncovered:
        raise AssertionError(f"{uncovered[0]['fold']}: not every item is held exactly once")


def assert_assignment(df: DataFrame, assigned: DataFrame, group: str = "isolate_id", item: str = "image_path") -> None:
    """The leakage check for an assigned table, all folds in one pass: a group is validated by one fold at
    most, so it cannot sit on both sides, and the assignment has neither lost nor repeated rows."""
    validated = F.coalesce("fold", F.lit(""))
    spans = assigned.groupBy(group).agg(F.min(validated).alias("low"), F.max(validated).alias("high"))
    leaks = spans.where(F.col("low") != F.col("high")).orderBy(group).limit(SHOWN).collect()
    if leaks:
        raise AssertionError(f"{leaks[0]['high']}: groups on both sides: {[r[group] for r in leaks]}")
    [found] = assigned_coverage(df, assigned, ["all"], item).collect()
    given = df.agg(F.countDistinct(item)).first()[0]
    if found["rows"] != found["wanted"] or found["items"] != given:
        raise AssertionError("the assignment lost or repeated items")


def describe_folds(
    folds: DataFrame, classes: Sequence[str], names: Sequence[str] = (), label: str = "species"
) -> DataFrame:
    """Items and groups per fold and side, and the classes without a validation group (class order).

    Groups are disjoint, so train = total - val and only validation membership is aggregated: linear in
    the number of groups even with one fold per group. ``names`` adds folds that drew no group."""
    per_fold = folds.where(F.col("fold").isNotNull()).groupBy("fold").agg(
        F.sum("n_items").alias("val_items"), F.count(F.lit(1)).alias("val_groups"), F.collect_set(label).alias("present")
    )
    if names:
        listed = folds.sparkSession.range(1).select(F.explode(class_array(names)).alias("fold"))
        per_fold = listed.join(per_fold, "fold", "left").na.fill(0, ["val_items", "val_groups"])
    totals = folds.agg(F.sum("n_items").alias("items"), F.count(F.lit(1)).alias("groups"))
    totals = totals.select(F.struct("items", "groups").alias("t")).scalar()
    present = F.coalesce("present", F.array().cast("array<string>"))
    return per_fold.withColumn("__t", totals).select(
        "fold",
        (F.col("__t.items") - F.col("val_items")).cast("bigint").alias("train_items"),
        F.col("val_items").cast("bigint").alias("val_items"),
        (F.col("__t.groups") - F.col("val_groups")).cast("bigint").alias("train_groups"),
        F.col("val_groups").cast("bigint").alias("val_groups"),
        F.array_except(class_array(classes), present).alias("val_classes_without_groups"),
    )
