"""Linear softmax heads for all folds at once.

A head of fold f is fitted on the rows of all other folds. One optimiser fits every head: each pass over the rows gives, for all folds
together, the loss, the gradient and the training hits. In a task a row meets the weights of all heads in one matrix product and counts for
every fold but its own; tasks send one sum each. So the number of jobs is that of the iterations, whatever the number of folds, and what
the driver holds is the heads themselves (folds x classes x features).

The objective of a head, strongly convex for reg > 0, is

    sum of w_i * -log p(label_i | x_i)  /  sum of w_i   +   reg / 2 * |W|^2

with the constant feature 1 as intercept, regularised like the others, so that its optimum is unique. It is approached by accelerated
gradient steps under a fixed bound of the curvature: half the second moments of the features, found in one pass, plus reg. So features of very
different scales converge alike. With ``plain`` steps the bound is half the largest |x|^2 in every direction, and the path is that of
textbook accelerated descent. Either way the path depends on nothing but the data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.scores import label_index
from kinfold.operators.manifest import check_choice
from kinfold.operators.weights import weight_column
from kinfold.sources.shared import settle

#: Name of a head that no fold is held out of.
ALL = "all"
MAX_ITER = 100
REG = 1e-5
TOLERANCE = 1e-9
#: Numbers (rows x folds x classes) that a task works on at once.
_CHUNK_NUMBERS = 1 << 21
#: Sums of tasks that come to the driver.
_LANES = 16


@dataclass
class Heads:
    """``weights[f, k]`` has the intercept first; ``present[f, k]`` tells the classes that the head was trained on."""

    folds: list[str]
    classes: list[str]
    features: str
    weights: np.ndarray
    present: np.ndarray
    history: list[tuple[str, int, float, float]] = field(default_factory=list)
    residual: float = float("nan")

    def table(self, spark: SparkSession) -> DataFrame:
        """``fold, k, weights``: one row per head and class it knows."""
        rows = [
            (fold, k, self.weights[f, k].tolist()) for f, fold in enumerate(self.folds) for k in range(len(self.classes)) if self.present[f, k]
        ]
        return spark.createDataFrame(rows, "fold string, k int, weights array<double>")

    def of(self, fold: str) -> Heads:
        f = self.folds.index(fold)
        return Heads([fold], self.classes, self.features, self.weights[f : f + 1], self.present[f : f + 1], [h for h in self.history if h[0] == fold], self.residual)


def from_rows(rows: Sequence[tuple[str, int, Sequence[float]]], classes: Sequence[str], features: str) -> Heads:
    folds = sorted({r[0] for r in rows})
    width = len(rows[0][2])
    weights, present = np.zeros((len(folds), len(classes), width)), np.zeros((len(folds), len(classes)), bool)
    for fold, k, w in rows:
        weights[folds.index(fold), k], present[folds.index(fold), k] = w, True
    return Heads(folds, list(classes), features, weights, present)


def _matrix(column: pa.Array) -> np.ndarray:
    """Feature arrays as rows, the constant 1 first."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return np.concatenate([np.ones((len(x), 1)), x], axis=1)


def _probabilities(x: np.ndarray, weights: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log p and p, rows x heads x classes; an absent class has p = 0."""
    heads, k, d = weights.shape
    z = (x @ weights.reshape(heads * k, d).T).reshape(len(x), heads, k)
    z = np.where(present, z, -np.inf)
    z -= z.max(axis=2, keepdims=True)
    e = np.exp(z)
    total = e.sum(axis=2, keepdims=True)
    return z - np.log(total), e / total


def _sums(batches: Iterator[pa.RecordBatch], weights: np.ndarray, present: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Weighted losses and hits per head, and the gradients: total minus own fold, as a row weighs 0 for its own."""
    heads, k, d = weights.shape
    loss, hits, gradient = np.zeros(heads), np.zeros(heads), np.zeros((d, heads * k))
    for batch in batches:
        step = max(1, _CHUNK_NUMBERS // (heads * k))
        for start in range(0, len(batch), step):
            part = batch.slice(start, step)
            x = _matrix(part.column("x"))
            y, own, base = (part.column(c).to_numpy(zero_copy_only=False) for c in ("y", "own", "w"))
            row = np.arange(len(x))
            counts = np.ones((len(x), heads), bool)
            held = np.flatnonzero(own >= 0)
            counts[held, own[held]] = False
            w = np.where(counts, base[:, None] * factor[:, y].T, 0.0)
            log_p, p = _probabilities(x, weights, present)
            picked = log_p[row, :, y]
            loss -= np.where(counts, w * np.where(counts, picked, 0.0), 0.0).sum(axis=0)
            hits += ((log_p.argmax(axis=2) == y[:, None]) & counts).sum(axis=0)
            p[row, :, y] -= 1
            gradient += x.T @ (p * w[:, :, None]).reshape(len(x), heads * k)
    return np.concatenate([loss, hits, gradient.T.ravel()])


def _added(rows: DataFrame, partial) -> np.ndarray:
    """The sum of ``partial`` over all tasks, added up in lanes before the driver sees it."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = TaskContext.get().partitionId() % _LANES
        yield pa.RecordBatch.from_arrays([pa.array([lane], pa.int32()), pa.array([partial(batches).tobytes()], pa.binary())], ["lane", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py()) for s in table["sums"])
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    lanes = rows.select("x", "y", "own", "w").mapInArrow(local, "lane int, sums binary").groupBy("lane").applyInArrow(add, "sums binary").collect()
    return sum(np.frombuffer(r[0]) for r in lanes)


def _moments(rows: DataFrame, width: int) -> np.ndarray:
    """Weighted second moments of the features, intercept included."""

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column("x"))
                total += (x * batch.column("w").to_numpy(zero_copy_only=False)[:, None]).T @ x
        return total

    return _added(rows, partial).reshape(width, width)


def _pass(rows: DataFrame, weights: np.ndarray, present: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One job over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, present, factor))
    total = _added(rows, lambda batches: _sums(batches, *shared.value))
    shared.destroy()
    heads, k, d = weights.shape
    return total[:heads], total[heads : 2 * heads], total[2 * heads :].reshape(heads, k, d)


def _fold_weights(mode: str, groups: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """What a row's weight over the whole table is to be multiplied by for each head, by class: weights count training rows only.
    ``groups`` and ``rows`` have the counts per (fold, class); the last line those of no fold."""
    total_groups, total_rows = groups.sum(axis=0), rows.sum(axis=0)
    own_groups, own_rows = groups[:-1], rows[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        if mode == "sampler":
            factor = total_groups / (total_groups - own_groups)
        elif mode == "loss":
            left = total_rows - own_rows
            factor = (left.sum(axis=1, keepdims=True) / left) * (total_rows / total_rows.sum())
        else:
            factor = np.ones(own_rows.shape)
    return np.where(np.isfinite(factor), factor, 0.0)


def fit_heads(
    df: DataFrame,
    classes: Sequence[str],
    folds: Sequence[str] = (),
    features: str = "embedding",
    imbalance: str = "none",
    max_iter: int = MAX_ITER,
    reg: float = REG,
    tolerance: float = TOLERANCE,
    label: str = "species",
    group: str = "isolate_id",
    item: str = "image_path",
    plain: bool = False,
) -> Heads:
    """One head per name in ``folds``, trained on the rows with another ``fold`` (or none); without folds one head on all rows.

    Stops after ``max_iter`` steps, or when no component of any gradient exceeds ``tolerance``. The history has a row per step and fold: loss and
    accuracy on the training rows at the point where the step begins; the last row is that of the result. A class without training rows has
    score 0 in that fold."""
    check_choice("imbalance", imbalance, ("sampler", "loss", "none"))
    names = list(folds)
    own = F.lit(-1)
    if names:
        # As many entries as heads.
        number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("fold"))
        own = F.coalesce(F.when(number > 0, number - 1), F.lit(-1)).cast("int")
    weighted = weight_column(df, imbalance, classes, label, group, item)
    y = label_index(F.col(label), classes)
    x = F.col(features).cast("array<double>")
    rows = settle(weighted.select(x.alias("x"), y.alias("y"), own.alias("own"), F.col("weight").cast("double").alias("w"), F.col(group).alias("g")))
    squared = F.aggregate("x", F.lit(1.0), lambda total, v: total + v * v)
    cells = rows.groupBy("own", "y").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("g").alias("groups"), F.count_if(F.col("g").isNull()).alias("bare"),
        F.sum("w").alias("w"), F.max(squared).alias("most"),
    ).collect()
    if not cells:
        raise ValueError("no training rows")
    heads, k = max(1, len(names)), len(classes)
    counts, groups, sums = (np.zeros((len(names) + 1, k)) for _ in range(3))
    for r in cells:  # at most folds x classes
        f = r["own"] if r["own"] >= 0 else len(names)
        counts[f, r["y"]], groups[f, r["y"]], sums[f, r["y"]] = r["n"], r["groups"] + (r["bare"] > 0), r["w"]
    none = np.zeros((1, k))  # one head that nothing is held out of
    factor = _fold_weights(imbalance, groups if names else np.concatenate([none, groups]), counts if names else np.concatenate([none, counts]))
    own_rows, own_sums = (c[: len(names)] if names else none for c in (counts, sums))
    left = counts.sum(axis=0) - own_rows
    if not left.sum(axis=1).all():
        raise ValueError(f"no training rows for {[n for n, c in zip(names, left.sum(axis=1), strict=False) if not c]}")
    total = ((sums.sum(axis=0) - own_sums) * factor).sum(axis=1)
    present = left > 0

    width = 1 + len(rows.select("x").first()[0])
    if plain:
        base, spread = np.eye(width), np.full((heads, width), max(r["most"] for r in cells) / 2)
    else:
        moments, base = np.linalg.eigh(_moments(rows, width) / sums.sum())
        # No row weighs more for a head, relative to its total, than this many times its share of the table.
        share = (factor * sums.sum() / total[:, None]).max(axis=1)
        spread = share[:, None] * np.maximum(moments, 0)[None, :] / 2
    curvature = spread + reg
    ratio = np.sqrt(curvature.max(axis=1) / reg) if reg else np.full(heads, np.inf)
    top = np.where(np.isfinite(ratio), (ratio - 1) / (ratio + 1), 1.0)
    at = before = np.zeros((heads, k, width))
    labels, history = names or [ALL], []
    known = present[:, :, None]
    since = np.zeros(heads)
    for step in range(max_iter + 1):
        momentum = np.minimum(top, np.maximum(0, since - 1) / (since + 2))
        probe = at + momentum[:, None, None] * (at - before) if step < max_iter else at
        loss, hits, gradient = _pass(rows, probe, present, factor)
        gradient = np.where(known, gradient / total[:, None, None] + reg * probe, 0.0)
        value = loss / total + reg / 2 * (probe * probe).sum(axis=(1, 2))
        history += [(n, step, float(value[f]), float(hits[f] / left[f].sum())) for f, n in enumerate(labels)]
        residual = float(np.abs(gradient).max())
        if residual <= tolerance or step == max_iter:
            at = probe
            break
        moved = probe - ((gradient @ base) / curvature[:, None, :]) @ base.T
        since += 1
        if not plain:  # momentum that leads uphill is given up
            since[(gradient * (moved - at)).sum(axis=(1, 2)) > 0] = 0
        before, at = at, moved
    return Heads(labels, list(classes), features, at, present, history, residual)


def score_heads(heads: Heads, df: DataFrame, fold: str | None = None) -> DataFrame:
    """Adds ``scores`` in class order: by the head of the row's own fold in column ``fold``, or by the only head. One pass for all folds."""
    shared = df.sparkSession.sparkContext.broadcast((heads.weights, heads.present))
    number = F.lit(0)
    if fold is not None:
        number = F.array_position(F.array(*[F.lit(n) for n in heads.folds]), F.col(fold)).cast("int") - 1
    k = len(heads.classes)

    def run(x: pa.Array, which: pa.Array) -> pa.Array:
        weights, present = shared.value
        f = which.to_numpy(zero_copy_only=False)
        out = np.zeros((len(f), k))
        matrix = _matrix(x) if len(f) else out
        for i in np.unique(f).tolist():
            own = np.flatnonzero(f == i)
            out[own] = _probabilities(matrix[own], weights[i : i + 1], present[i : i + 1])[1][:, 0]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * k, pa.int32()), pa.array(out.ravel()))

    vector = F.col(heads.features).cast("array<double>")
    return df.withColumn("scores", F.arrow_udf(run, "array<double>")(vector, number))
