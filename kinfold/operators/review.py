"""Samples for expert review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.fixed import REVIEW_COLUMNS
from kinfold.functions.text import rounded_units, stem


def first_per_class(df: DataFrame, n: int, label: str = "species", order: str = "image_path") -> DataFrame:
    """The first ``n`` items of each class in ``order``. Each task forwards at most ``n`` rows per class."""
    rank = F.row_number().over(W.partitionBy(label).orderBy(order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def review_sheet(sample: DataFrame, truth: Column | None = None, order: str = "image_path") -> DataFrame:
    """The reviewer's sheet of an already sampled prediction table with ``predicted`` and ``scores``.

    Panels are numbered over the whole sheet in ``order``: a sheet is what experts look through by hand,
    a few rows per class, so one window over it is small by purpose."""
    number = F.row_number().over(W.orderBy(order)) - 1
    filled = {
        "image_path": F.col("image_path"),
        "true_species": truth if truth is not None else F.lit(""),
        "predicted": F.col("predicted"),
        "probability": rounded_units(F.array_max("scores"), 4) / 10_000,
        "panel": F.format_string("%04d_%s.png", number, stem(F.col("image_path"))),
    }
    return sample.select(*[filled.get(c, F.lit("")).alias(c) for c in REVIEW_COLUMNS])
