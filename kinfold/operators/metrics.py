"""Confusion cells, one-vs-rest metrics, macro averages and group votes.

``by`` columns (level, run, replicate, ...) are extra grouping keys: one job evaluates them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.fixed import CLASS_METRICS, GROUP_LEVEL, ITEM_LEVEL, RATIO_METRICS
from kinfold.functions.scores import argmax_index, class_at, label_index, ratio, scores_from_columns
from kinfold.operators.auc import auc_one_vs_rest, score_ties
from kinfold.operators.skew import null_safe_join
from kinfold.sources.shared import settle

#: Group means are rounded before the vote, so that equal means tie the same way for every summation order.
MEAN_DECIMALS = 12


def scored(df: DataFrame, classes: Sequence[str], label: str = "species", keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns, ``true_k``, ``pred_k`` and the ``scores`` array of a wide prediction table."""
    # Two projections: the array is built once per row and then read by name.
    rows = df.select(*keep, label_index(F.col(label), classes).alias("true_k"), scores_from_columns(classes).alias("scores"))
    return rows.select(*keep, "true_k", argmax_index(F.col("scores")).alias("pred_k"), "scores")


def confusion_cells(rows: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Count per (true_k, pred_k), non-empty cells only. Map-side partial counts: K x K rows per task."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return rows.groupBy(*by, "true_k", "pred_k").agg(n.cast("bigint").alias("n"))


def both_levels(spark: SparkSession) -> DataFrame:
    """The two report levels as a table, for callers that know their ``by`` values beforehand."""
    return spark.range(1).select(F.explode(F.array(F.lit(ITEM_LEVEL), F.lit(GROUP_LEVEL))).alias("level"))


def _class_grid(keys: DataFrame, by: Sequence[str], size: int, names: Sequence[str]) -> DataFrame:
    """Every class index (or pair of indices) for each distinct ``by`` value."""
    cell = F.explode(F.sequence(F.lit(0), F.lit(size ** len(names) - 1))).alias("__cell")
    if by:
        grid = keys.select(*by).distinct().select(*by, cell)
    else:
        grid = keys.sparkSession.range(1).select(cell)
    index = [(F.floor(F.col("__cell") / size ** (len(names) - 1 - i)) % size).cast("int").alias(name) for i, name in enumerate(names)]
    return grid.select(*by, *index)


def dense_confusion(cells: DataFrame, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The full K x K matrix, zeros included: row = true class, column = predicted class."""
    keys = [*by, "true_k", "pred_k"]
    grid = _class_grid(cells, by, len(classes), ["true_k", "pred_k"])
    # Two tables of at most K x K rows per ``by`` value.
    return grid.join(cells, keys, "left").select(
        *keys,
        class_at(F.col("true_k"), classes).alias("true_label"),
        class_at(F.col("pred_k"), classes).alias("pred_label"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def one_vs_rest_counts(
    cells: DataFrame, by: Sequence[str] = (), classes: Sequence[str] | None = None, grid_of: DataFrame | None = None
) -> DataFrame:
    """tp, fn, fp, tn, support and total per class. With ``classes`` absent classes appear as zero rows
    (for every ``by`` value of ``grid_of``, or of the cells); without, only classes that occur."""
    keys = [*by, "k"]
    zero = F.lit(0).cast("bigint")

    def part(k: str, tp: Column = zero, fn: Column = zero, fp: Column = zero) -> Column:
        return F.struct(F.col(k).alias("k"), tp.alias("tp"), fn.alias("fn"), fp.alias("fp"))

    n = F.col("n")
    hit, miss = F.array(part("true_k", tp=n)), F.array(part("true_k", fn=n), part("pred_k", fp=n))
    parts = F.explode(F.when(F.col("true_k") == F.col("pred_k"), hit).otherwise(miss))
    counts = (
        cells.select(*by, parts.alias("c"))
        .groupBy(*by, F.col("c.k").alias("k"))
        .agg(*[F.sum(f"c.{name}").alias(name) for name in ("tp", "fn", "fp")])
    )
    if classes is not None:
        grid = _class_grid(cells if grid_of is None else grid_of, by, len(classes), ["k"])
        counts = grid.join(counts, keys, "left").na.fill(0, ["tp", "fn", "fp"])
    support = F.col("tp") + F.col("fn")
    counts = counts.withColumn("support", support).withColumn("total", F.sum(support).over(W.partitionBy(*by)))
    return counts.withColumn("tn", F.col("total") - F.col("tp") - F.col("fn") - F.col("fp"))


def ratios() -> dict[str, Column]:
    """One-vs-rest ratios over tp, fn, fp, tn, support and total. Undefined ones are NULL.
    A class with support that is never predicted has PPV 0."""
    tp, fn, fp, tn = (F.col(name) for name in ("tp", "fn", "fp", "tn"))
    never_predicted = F.when(F.col("support") > 0, F.lit(0.0))
    return {
        "sensitivity": ratio(tp, tp + fn),
        "specificity": ratio(tn, tn + fp),
        "ppv": F.when(tp + fp > 0, ratio(tp, tp + fp)).otherwise(never_predicted),
        "npv": ratio(tn, tn + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "accuracy_ovr": ratio(tp + tn, F.col("total")),
    }


def class_metrics(
    cells: DataFrame,
    classes: Sequence[str] | None = None,
    by: Sequence[str] = (),
    auc: DataFrame | None = None,
    grid_of: DataFrame | None = None,
) -> DataFrame:
    """Counts and metrics per class; ``auc`` (``by``, k, auc) is joined in when given."""
    counts = one_vs_rest_counts(cells, by, classes, grid_of)
    values = ratios()
    table = counts.select(
        *by, "k", "tp", "fn", "fp", "tn", "support", "total", *[values[m].alias(m) for m in RATIO_METRICS]
    )
    if auc is not None:
        table = table.join(auc.select(*by, "k", "auc"), [*by, "k"], "left")
    return table


def with_labels(table: DataFrame, classes: Sequence[str]) -> DataFrame:
    return table.withColumn("label", class_at(F.col("k"), classes))


def macro_metrics(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, accuracy and the mean of each metric over the classes with support, undefined values skipped."""
    metrics = [m for m in CLASS_METRICS if m in per_class.columns]
    supported = F.col("support") > 0
    return per_class.groupBy(*by).agg(
        F.coalesce(F.max("total"), F.lit(0)).alias("n"),
        ratio(F.sum("tp"), F.max("total")).alias("accuracy"),
        *[F.avg(F.when(supported, F.col(m))).alias(f"macro_{m}") for m in metrics],
    )


def classes_without_support(per_class: DataFrame, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return with_labels(per_class.where(F.col("support") == 0), classes).select(*by, "k", "label")


def group_summary(
    df: DataFrame, classes: Sequence[str], label: str = "species", group: str = "isolate_id", item: str = "image_path"
) -> DataFrame:
    """One row per group: its label, row count, mean scores (missing ones skipped), and ``cells``, the confusion counts
    of its rows by each row's own label. Everything at group level derives from it, and so do the item-level cells.

    A group whose rows carry several labels takes that of its first row: by item path, if there is one, then by class order. The item
    rows are reduced to numbers per (group, true, predicted class) on the map side and that table is written once; paths are read for groups
    with several labels only."""
    rows = scored(df, classes, label, [group])
    size = len(classes)
    present = [F.when(~F.isnan(F.col("scores")[k]), F.col("scores")[k]) for k in range(size)]
    parts = settle(rows.groupBy(group, "true_k", "pred_k").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(p).alias(f"__sum_{k}") for k, p in enumerate(present)], *[F.count(p).alias(f"__seen_{k}") for k, p in enumerate(present)],
    ))
    summed = parts.groupBy(group).agg(
        F.min("true_k").alias("true_k"), F.sum("n").alias("n_items"),
        F.array_sort(F.collect_list(F.struct("true_k", "pred_k", "n"))).alias("cells"),
        *[F.try_divide(F.sum(f"__sum_{k}"), F.sum(f"__seen_{k}")).alias(f"__mean_{k}") for k in range(size)],
    )
    if item in df.columns:
        mixed = parts.groupBy(group).agg(F.min("true_k").alias("low"), F.max("true_k").alias("high")).where("low < high").select(group)
        if not mixed.isEmpty():
            labelled = null_safe_join(df.select(group, item, label_index(F.col(label), classes).alias("true_k")), mixed, [group])
            first = labelled.groupBy(group).agg(F.min(F.struct(item, "true_k")).alias("first")).select(group, F.col("first.true_k").alias("first"))
            summed = null_safe_join(summed, first, [group], "left").withColumn("true_k", F.coalesce("first", "true_k"))
    means = [F.coalesce(F.round(f"__mean_{k}", MEAN_DECIMALS), F.lit(float("nan"))) for k in range(size)]
    named = class_at(F.col("true_k"), classes).alias(label)
    return summed.select(group, named, "true_k", "n_items", F.array(*means).alias("scores"), "cells")


def group_vote(df: DataFrame, classes: Sequence[str], label: str = "species", group: str = "isolate_id") -> DataFrame:
    """Mean-score vote: one row per group with its mean score columns and the winning class."""
    means = group_summary(df, classes, label, group)
    return means.select(
        group, label, "n_items", class_at(argmax_index(F.col("scores")), classes).alias("predicted"),
        *[F.col("scores")[k].alias(f"prob_{c}") for k, c in enumerate(classes)],
    )


def level_cells() -> Column:
    """The confusion counts of a group of the summary at both levels, as an array of ``level, true_k, pred_k, n``."""
    def cell(level: str, true: Column, pred: Column, n: Column) -> Column:
        return F.struct(
            F.lit(level).alias("level"), true.cast("int").alias("true_k"), pred.cast("int").alias("pred_k"), n.cast("bigint").alias("n")
        )

    items = F.transform("cells", lambda c: cell(ITEM_LEVEL, c["true_k"], c["pred_k"], c["n"]))
    return F.concat(items, F.array(cell(GROUP_LEVEL, F.col("true_k"), argmax_index(F.col("scores")), F.lit(1))))


def two_level_cells(summary: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Confusion counts of every group at both levels: ``level, true_k, pred_k, n`` per group."""
    return summary.select(*keep, F.explode(level_cells()).alias("c")).select(*keep, "c.*")


def two_level_ties(
    df: DataFrame, summary: DataFrame, classes: Sequence[str], label: str = "species", auc_decimals: int | None = None
) -> DataFrame:
    """Tie groups of both levels, the input of the AUC."""
    items = scored(df, classes, label).withColumn("level", F.lit(ITEM_LEVEL))
    groups = summary.withColumn("level", F.lit(GROUP_LEVEL))
    return score_ties(items, ["level"], auc_decimals).unionByName(score_ties(groups, ["level"], auc_decimals))


def two_level_class_metrics(
    df: DataFrame,
    classes: Sequence[str],
    label: str = "species",
    group: str = "isolate_id",
    auc_decimals: int | None = None,
) -> DataFrame:
    """Metrics per (level, class) for item rows and for group votes."""
    summary = settle(group_summary(df, classes, label, group))  # read by both branches
    cells = confusion_cells(two_level_cells(summary), ["level"], "n")
    auc = auc_one_vs_rest(two_level_ties(df, summary, classes, label, auc_decimals), ["level"])
    return with_labels(class_metrics(cells, classes, ["level"], auc, both_levels(df.sparkSession)), classes)
