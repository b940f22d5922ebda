"""Linear softmax head over a feature column: fit, score, rank, explain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.fixed import PREDICTION_COLUMNS
from kinfold.functions.pixels import unit_scale
from kinfold.functions.scores import argmax_index, class_at, columns_from_scores, quoted, ranked_scores, score_columns
from kinfold.operators.heads import MAX_ITER, REG, TOLERANCE, Heads, fit_heads, from_rows, score_heads
from kinfold.operators.metrics import group_vote


def fit_head(
    train: DataFrame,
    classes: Sequence[str],
    features: str = "embedding",
    imbalance: str = "none",
    max_iter: int = MAX_ITER,
    reg: float = REG,
    tolerance: float = TOLERANCE,
    label: str = "species",
    group: str = "isolate_id",
    item: str = "image_path",
) -> Heads:
    """Multinomial logistic regression with the row weights of one imbalance mode. Class indices are those of
    ``classes`` even when a class is absent from the training rows."""
    return fit_heads(train, classes, (), features, imbalance, max_iter, reg, tolerance, label, group, item)


def score(model: Heads, df: DataFrame) -> DataFrame:
    """Adds ``scores`` in class order. A class that the model never saw gets score 0."""
    return score_heads(model, df)


def prediction_table(df: DataFrame, classes: Sequence[str], fold: Column, extra: Sequence[str] = ()) -> DataFrame:
    """The prediction table of rows with ``scores``: manifest columns, fold, predicted class, one score column per class."""
    return df.select(
        *PREDICTION_COLUMNS, *extra, fold.alias("fold"), class_at(argmax_index(F.col("scores")), classes).alias("predicted"),
        *columns_from_scores(F.col("scores"), classes),
    )


def ranking(df: DataFrame, classes: Sequence[str], keep: Sequence[str] = ("image_path",)) -> DataFrame:
    """``keep, rank, label, score`` per item, highest score first; equal scores in class order."""
    ranked = ranked_scores(F.col("scores"), classes)
    return df.select(*keep, F.posexplode(ranked).alias("rank", "r")).select(
        *keep, (F.col("rank") + 1).cast("bigint").alias("rank"), "r.label", "r.score"
    )


def route_by_modality(models: dict[str, Heads], df: DataFrame) -> DataFrame:
    """Scores every row with the model of its modality, in one pass. A row whose modality has no model fails the query that meets it."""
    first = next(iter(models.values()))
    rows = [(name, int(r["k"]), r["weights"]) for name, m in models.items() for r in m.table(df.sparkSession).collect()]
    known = F.coalesce(F.col("modality").isin(*models), F.lit(False))
    no_model = F.raise_error(F.concat(F.lit("no model for modality "), F.coalesce("modality", F.lit("NULL"))))
    routed = df.withColumn("__head", F.when(known, F.col("modality")).otherwise(no_model.cast("string")))
    return score_heads(from_rows(rows, first.classes, first.features), routed, "__head").drop("__head")


def combine_modalities(
    predictions: Sequence[DataFrame],
    classes: Sequence[str],
    equal_modalities: bool = False,
    label: str = "species",
    group: str = "isolate_id",
) -> DataFrame:
    """One vote per group over the rows of several prediction tables. By default each row counts once;
    with ``equal_modalities`` each modality's group mean does."""
    wanted = set(score_columns(classes))
    for table in predictions:
        if not wanted <= set(table.columns):
            raise ValueError(f"prediction tables need the same classes; missing {sorted(wanted - set(table.columns))}")
    columns = [group, label, "modality", *score_columns(classes)]
    pooled = predictions[0].select(*[quoted(c) for c in columns])
    for table in predictions[1:]:
        pooled = pooled.unionByName(table.select(*[quoted(c) for c in columns]))
    if equal_modalities:
        means = [F.avg(quoted(c)).alias(c) for c in score_columns(classes)]
        pooled = pooled.groupBy(group, "modality").agg(F.min(label).alias(label), *means)
    return group_vote(pooled, classes, label, group)


def evidence(
    df: DataFrame, coefficients: DataFrame, classes: Sequence[str], top: int, features: str = "embedding", keep: Sequence[str] = ("image_path",)
) -> DataFrame:
    """The ``top`` features that speak for the predicted class: max(0, weight x activation), scaled to [0, 1]
    per item. ``coefficients(k, weights)`` has one row per class, so its broadcast is the size of the model."""
    model = F.broadcast(coefficients.select(F.col("k").alias("__k"), F.col("weights").alias("__weights")))
    # One model row per class of the list: bounded by the model itself.
    rows = df.withColumn("__k", argmax_index(F.col("scores"))).join(model, "__k")
    support = F.zip_with("__weights", F.col(features), lambda w, x: F.greatest(w * x.cast("double"), F.lit(0.0)))
    ranked = F.array_sort(F.transform(unit_scale(support), lambda v, i: F.struct((-v).alias("down"), i.alias("feature"))))
    return rows.select(
        *keep, class_at(F.col("__k"), classes).alias("predicted"), F.posexplode(F.slice(ranked, 1, top)).alias("rank", "r")
    ).select(
        *keep, "predicted", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("r.feature").cast("bigint").alias("feature"),
        (-F.col("r.down")).alias("evidence"),
    )
