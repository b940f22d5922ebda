"""Fitted heads on disk: one table of weights by fold and a one-row metadata table beside it."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.scores import class_array
from kinfold.operators.heads import Heads, from_rows


def save_heads(spark: SparkSession, heads: Heads, path: str, modality: str, source: str) -> None:
    """``heads(fold, k, weights)``, the intercept first, with class list, modality, source, feature column and folds beside it."""
    heads.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/heads")
    facts = {"modality": F.lit(modality), "source": F.lit(source), "features": F.lit(heads.features), "folds": class_array(heads.folds)}
    meta = spark.range(1).select(class_array(heads.classes).alias("classes"), *[v.alias(k) for k, v in facts.items()])
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_heads(spark: SparkSession, path: str) -> tuple[Heads, Row]:
    meta = spark.read.parquet(f"{path}/metadata").first()
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/heads").select("fold", "k", "weights").collect()]
    if rows and max(r[1] for r in rows) >= len(meta["classes"]):
        raise ValueError(f"{path}: the heads have more classes than the {len(meta['classes'])} that the metadata lists")
    return from_rows(rows, list(meta["classes"]), meta["features"]), meta
