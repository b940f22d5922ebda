"""Two-level evaluation reports: long tables, one nested document per run, and the comparison of runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.fixed import CLASS_METRICS, COMPARED_METRICS, GROUP_LEVEL, INTERVAL_KEY, ITEM_LEVEL
from kinfold.functions.scores import class_array
from kinfold.functions.text import value_with_interval
from kinfold.operators.auc import auc_one_vs_rest
from kinfold.operators.bootstrap import bootstrap_replicates, intervals, strata
from kinfold.operators.metrics import (
    both_levels, class_metrics, confusion_cells, dense_confusion, group_summary, macro_metrics, two_level_cells,
    two_level_ties, with_labels,
)
from kinfold.sources.shared import settle

_CLASS_FIELDS = "support: bigint, " + ", ".join(f"{m}: double" for m in CLASS_METRICS)
REPORT_SCHEMA = (
    f"n bigint, accuracy double, macro map<string,double>, per_class map<string,struct<{_CLASS_FIELDS}>>,"
    " confusion_matrix array<array<bigint>>, classes_without_support array<string>,"
    f" {INTERVAL_KEY} struct<method: string, replicates: int, "
    + ", ".join(f"{m}: array<double>" for m in ("accuracy", *[f"macro_{m}" for m in CLASS_METRICS]))
    + ">"
)


@dataclass(frozen=True)
class Evaluation:
    """The tables of one evaluation. ``interval`` is None without bootstrap."""

    per_class: DataFrame
    macro: DataFrame
    confusion: DataFrame
    interval: DataFrame | None
    classes: tuple[str, ...]
    replicates: int


def evaluate(
    df: DataFrame,
    classes: Sequence[str],
    n_boot: int = 1000,
    seed: int = 0,
    label: str = "species",
    group: str = "isolate_id",
    auc_decimals: int | None = None,
) -> Evaluation:
    """Item-level and group-level metrics of a prediction table, with group-bootstrap intervals when ``n_boot`` > 0.
    Both levels resample the same groups. The group table is reduced once and shared by all parts."""
    summary = settle(group_summary(df, classes, label, group))
    cells = confusion_cells(two_level_cells(summary), ["level"], "n")
    auc = auc_one_vs_rest(two_level_ties(df, summary, classes, label, auc_decimals), ["level"])
    levels = both_levels(df.sparkSession)
    per_class = settle(with_labels(class_metrics(cells, classes, ["level"], auc, levels), classes))
    interval = None
    if n_boot:
        replicates = bootstrap_replicates(df, classes, n_boot, seed, label, group, auc_decimals=auc_decimals, summary=summary)
        method = strata(summary, label).agg(F.max("method").alias("method")).scalar()
        interval = settle(intervals(replicates).withColumn("method", method).withColumn("replicates", F.lit(n_boot)))
    return Evaluation(
        per_class, macro_metrics(per_class, ["level"]), dense_confusion(cells, classes, ["level"]), interval, tuple(classes), n_boot
    )


def _by_name(names: Sequence[str], column: str = "{}") -> Column:
    return F.map_from_arrays(class_array(names), F.array(*[F.col(column.format(n)).cast("double") for n in names]))


def documents(result: Evaluation, by: Sequence[str] = ("level",)) -> DataFrame:
    """One row per level with the nested ``report``. Undefined values become NaN. Bounded by K x K values."""
    classes = class_array(result.classes)

    def in_order(pairs: Column) -> Column:
        return F.transform(F.array_sort(pairs), lambda e: e["v"])

    per_class = result.per_class.na.fill(float("nan"), list(CLASS_METRICS)).withColumn(
        "m", F.struct(F.col("support").cast("bigint").alias("support"), *CLASS_METRICS)
    )
    class_part = per_class.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("label", "m"))).alias("per_class"),
        F.array_intersect(classes, F.collect_set(F.when(F.col("support") == 0, F.col("label")))).alias("classes_without_support"),
    )
    rows = result.confusion.groupBy(*by, "true_k").agg(in_order(F.collect_list(F.struct("pred_k", F.col("n").alias("v")))).alias("v"))
    matrix = rows.groupBy(*by).agg(in_order(F.collect_list(F.struct("true_k", "v"))).alias("confusion_matrix"))
    macro = result.macro.na.fill(float("nan"), ["accuracy", *[f"macro_{m}" for m in CLASS_METRICS]]).select(
        *by, "n", "accuracy", _by_name(CLASS_METRICS, "macro_{}").alias("macro")
    )
    document = macro.join(class_part, list(by)).join(matrix, list(by))
    fields = ["n", "accuracy", "macro", "per_class", "confusion_matrix", "classes_without_support"]
    if result.interval is not None:
        names = ("accuracy", *[f"macro_{m}" for m in CLASS_METRICS])
        nan = F.lit(float("nan"))
        pair = F.array(F.coalesce("low", nan), F.coalesce("high", nan))
        wide = result.interval.groupBy(*by).agg(
            F.first("method").alias("method"), F.first("replicates").alias("replicates"),
            *[F.max(F.when(F.col("metric") == m, pair)).alias(m) for m in names],
        )
        document = document.join(wide.select(*by, F.struct("method", "replicates", *names).alias(INTERVAL_KEY)), list(by))
        fields.append(INTERVAL_KEY)
    return document.select(*by, F.struct(*fields).alias("report"))


def report_row(result: Evaluation, extras: dict[str, Column] | None = None) -> DataFrame:
    """The whole run document as one row: extras first, then one column per level."""
    levels = [F.any_value(F.when(F.col("level") == level, F.col("report")), True).alias(level) for level in (ITEM_LEVEL, GROUP_LEVEL)]
    row = documents(result).agg(*levels)
    return row.select(*[column.alias(name) for name, column in (extras or {}).items()], ITEM_LEVEL, GROUP_LEVEL)


def headline(result: Evaluation) -> DataFrame:
    """``level, metric, value``: accuracy and every macro metric."""
    names = ["accuracy", *[f"macro_{m}" for m in CLASS_METRICS]]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    return result.macro.select("level", F.explode(pairs).alias("p")).select("level", "p.*")


def compare_runs(reports: DataFrame) -> DataFrame:
    """``run, level, n`` and value-with-interval text of accuracy and six macro metrics, from scanned run documents."""
    levels = F.array(*[
        F.struct(F.lit(level.split("_")[0]).alias("level"), F.col(level).alias("r")) for level in (ITEM_LEVEL, GROUP_LEVEL)
    ])
    rows = reports.select("run", F.explode(levels).alias("e")).select("run", "e.level", "e.r.*")
    interval = F.col(INTERVAL_KEY)

    def shown(value: Column, key: str) -> Column:
        return value_with_interval(value, interval[key][0], interval[key][1])

    return rows.select(
        "run", "level", "n", shown(F.col("accuracy"), "accuracy").alias("accuracy"),
        *[shown(F.col("macro")[m], f"macro_{m}").alias(f"macro_{m}") for m in COMPARED_METRICS],
    )


def compare_macro(macro: DataFrame, run: str = "run") -> DataFrame:
    """The same comparison as numbers, for metric tables that carry a run column."""
    return macro.select(run, F.split("level", "_")[0].alias("level"), "n", "accuracy", *[f"macro_{m}" for m in COMPARED_METRICS])
