"""Cross-validated training and evaluation of a saved head."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.fixed import (
    CONFIG_FILE, FOLDS_FOLDER, MODEL_FOLDER, N_FOLDS, PREDICTIONS_FILE, PREDICTIONS_TABLE, REPLICATES, REPORT_FILE, SEED, VAL_FRACTION,
)
from kinfold.operators.manifest import check_parameters, require_rows, resolve_classes, select
from kinfold.operators.report import Evaluation, evaluate, report_row
from kinfold.operators.heads import MAX_ITER, REG, TOLERANCE, Heads, fit_heads, score_heads
from kinfold.operators.scoring import fit_head, prediction_table, score
from kinfold.operators.splits import assert_assignment, assign_folds, describe_folds, fold_names, make_folds
from kinfold.sources.models import load_heads, save_heads
from kinfold.sources.shared import settle
from kinfold.sources.tables import write_csv, write_predictions, write_report, write_run_config

HISTORY_SCHEMA = "fold string, iteration int, loss double, accuracy double"
NOTE = "each prediction comes from a head that saw no row of the item's group"


@dataclass
class TrainingRun:
    predictions: DataFrame
    folds: DataFrame
    history: DataFrame
    classes: list[str]
    heads: Heads
    final: Heads | None = None
    evaluation: Evaluation | None = None


def cross_validate(
    df: DataFrame,
    classes: Sequence[str] = (),
    strategy: str = "kfold",
    n_folds: int = N_FOLDS,
    val_fraction: float = VAL_FRACTION,
    seed: int = SEED,
    imbalance: str = "sampler",
    features: str = "embedding",
    max_iter: int = MAX_ITER,
    reg: float = REG,
    tolerance: float = TOLERANCE,
    max_folds: int | None = None,
    plain: bool = False,
) -> TrainingRun:
    """Fits the heads of all folds together, each on the other folds' groups, and scores every row by the head of its own fold in one
    pass: every prediction is out-of-fold. The number of jobs does not depend on the number of folds; the work and the heads, which the
    driver holds, do. A caller may refuse runs of more than ``max_folds`` heads (leave-one-out over many groups)."""
    check_parameters(imbalance=imbalance, strategy=strategy, val_fraction=val_fraction)
    require_rows(df, "training")
    names = resolve_classes(df, classes)
    folds = make_folds(df, strategy, n_folds, val_fraction, seed)
    listed = [r[0] for r in folds.select("fold").where(F.col("fold").isNotNull()).distinct().orderBy("fold").collect()]  # one per head
    if max_folds is not None and len(listed) > max_folds:
        raise ValueError(f"{strategy} needs {len(listed)} fits, more than max_folds={max_folds}")
    assigned = settle(assign_folds(df, folds))
    assert_assignment(df, assigned)
    info = describe_folds(folds, names, fold_names(strategy, n_folds))
    heads = fit_heads(assigned, names, listed, features, imbalance, max_iter, reg, tolerance, plain=plain)
    scored = score_heads(heads, assigned.where(F.col("fold").isNotNull()), "fold")
    predictions = prediction_table(scored, names, F.col("fold"))
    return TrainingRun(predictions, info, df.sparkSession.createDataFrame(heads.history, HISTORY_SCHEMA), names, heads)


def run_training(
    df: DataFrame,
    run_dir: str,
    classes: Sequence[str] = (),
    modality: str = "microscopic",
    source: str = "cmu",
    strategy: str = "kfold",
    n_folds: int = N_FOLDS,
    val_fraction: float = VAL_FRACTION,
    seed: int = SEED,
    imbalance: str = "sampler",
    features: str = "embedding",
    max_iter: int = MAX_ITER,
    reg: float = REG,
    tolerance: float = TOLERANCE,
    fit_final: bool = True,
    n_boot: int = REPLICATES,
) -> TrainingRun:
    """A whole run: select, split, fit and score all folds, pooled report, saved heads.
    Writes config.json, predictions, metrics.json, the heads of all folds as one table and the final head below ``run_dir``."""
    spark = df.sparkSession
    config = {
        "classes": list(classes), "modality": modality, "source": source, "split": strategy, "n_folds": n_folds,
        "val_fraction": val_fraction, "seed": seed, "imbalance": imbalance, "features": features, "max_iter": max_iter,
        "reg": reg, "tolerance": tolerance, "fit_final": fit_final, "bootstrap": n_boot,
    }
    check_parameters(modality, source, imbalance, strategy, val_fraction)
    rows = select(df, modality, source)
    write_run_config(spark, f"{run_dir}/{CONFIG_FILE}", config)
    run = cross_validate(rows, classes, strategy, n_folds, val_fraction, seed, imbalance, features, max_iter, reg, tolerance)
    save_heads(spark, run.heads, f"{run_dir}/{MODEL_FOLDER if strategy == 'holdout' else FOLDS_FOLDER}", modality, source)
    folds_row = run.folds.agg(F.array_sort(F.collect_list(F.struct(*run.folds.columns))).alias("v")).scalar()
    history_row = run.history.agg(F.array_sort(F.collect_list(F.struct(*run.history.columns))).alias("v")).scalar()
    extras = {"split": F.lit(strategy), "folds": folds_row, "train_history": history_row, "note": F.lit(NOTE)}
    run.predictions, run.evaluation = write_run(run.predictions, run_dir, run.classes, n_boot, seed, extras)
    if strategy != "holdout" and fit_final:
        run.final = fit_head(rows, run.classes, features, imbalance, max_iter, reg, tolerance)
        save_heads(spark, run.final, f"{run_dir}/{MODEL_FOLDER}", modality, source)
    return run


def write_run(
    predictions: DataFrame, run_dir: str, classes: Sequence[str], n_boot: int, seed: int, extras: dict | None = None
) -> tuple[DataFrame, Evaluation]:
    """Prediction table as parquet and CSV, and the metrics document computed from the written table."""
    spark = predictions.sparkSession
    write_predictions(predictions, f"{run_dir}/{PREDICTIONS_TABLE}")
    written = spark.read.parquet(f"{run_dir}/{PREDICTIONS_TABLE}")
    write_csv(written, f"{run_dir}/{PREDICTIONS_FILE}")
    result = evaluate(written, classes, n_boot, seed)
    write_report(report_row(result, extras), f"{run_dir}/{REPORT_FILE}")
    return written, result


def score_saved_head(
    spark: SparkSession, head: str, df: DataFrame, modality: str | None = None, source: str = "all"
) -> tuple[DataFrame, list[str]]:
    """Prediction table (fold ``eval``) of a saved head over a new manifest. The modality defaults to the head's own."""
    model, meta = load_heads(spark, head)
    rows = select(df, modality or meta["modality"] or "all", source)
    require_rows(rows, f"modality={modality or meta['modality']} source={source}")
    classes = resolve_classes(rows, list(meta["classes"]))
    return prediction_table(score(model, rows), classes, F.lit("eval")), classes


def evaluate_saved_head(
    spark: SparkSession, head: str, df: DataFrame, out_dir: str, modality: str | None = None, source: str = "all",
    n_boot: int = REPLICATES, seed: int = 0,
) -> tuple[DataFrame, Evaluation]:
    """Scores, reports and writes the evaluation of a saved head on a table it was not trained on."""
    predictions, classes = score_saved_head(spark, head, df, modality, source)
    return write_run(predictions, out_dir, classes, n_boot, seed, {"checkpoint": F.lit(head)})
