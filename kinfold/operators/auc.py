"""One-vs-rest area under the ROC curve: exact, tie-aware, and without a task that holds a whole class.

AUC = sum over tie groups of  positives * (negatives below + negatives tied / 2), over  P * N.

1. Equal scores of a class collapse to one tie group before anything is ranked (map-side partial counts).
2. One range exchange puts the tie groups in order of class and score. Its bounds come from a sample, so parts are of even
   size however concentrated the scores are; there are no rounds and nothing is written.
3. Each part adds up, per class, the pairs won among its own tie groups. Parts of a class follow each other in score order, so
   a running sum over the few parts gives every part the negatives below it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from kinfold.functions.scores import ratio


def score_ties(rows: DataFrame, by: Sequence[str] = (), decimals: int | None = None) -> DataFrame:
    """``by, k, score, p, q``: positives and negatives of class k at each distinct score.
    ``rows`` has ``true_k`` and the ``scores`` array; ``decimals`` rounds scores to limit distinct values."""
    long = rows.select(*by, "true_k", F.posexplode("scores").alias("k", "score"))
    if decimals is not None:
        long = long.withColumn("score", F.round("score", decimals))
    positive = (F.col("true_k") == F.col("k")).cast("bigint")
    return long.groupBy(*by, "k", "score").agg(F.sum(positive).alias("p"), F.sum(1 - positive).alias("q"))


def segments(columns: Sequence[pa.Array], n: int) -> np.ndarray:
    """Where the key changes in ordered rows: the first row of every run, and the end."""
    change = np.zeros(n + 1, bool)
    change[[0, -1]] = True
    for column in columns:
        code = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:-1] |= code[1:] != code[:-1]
    return np.flatnonzero(change)


def _piece_sums(keys: Sequence[str], schema: pa.Schema):
    """Ordered tie groups in, one row per key and part out: lowest and highest score, pairs won inside, positives, negatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, state = None, None  # the key at hand, and [low, high, won, positives, negatives]

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*opened, *state), strict=True))], schema=schema)

        for batch in batches:
            if not len(batch):
                continue
            score, p, q = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("score", "p", "q"))
            bounds = segments([batch.column(k) for k in keys], len(batch))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                key = tuple(batch.column(k)[a].as_py() for k in keys)
                if state is None or key != opened:
                    if state is not None:
                        yield closed()
                    opened, state = key, [float(score[a]), 0.0, 0.0, 0, 0]
                below = state[4] + np.cumsum(q[a:b]) - q[a:b]
                state[1] = float(score[b - 1])
                state[2] += float((p[a:b] * (below + q[a:b] / 2)).sum())
                state[3] += int(p[a:b].sum())
                state[4] += int(q[a:b].sum())
        if state is not None:
            yield closed()

    return run


def ranked_pieces(ties: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, low, high, u, p, q``: every key's tie groups in pieces that follow each other in score order, with the pairs won inside."""
    rows = ties.select(*keys, F.coalesce("score", F.lit(float("nan"))).alias("score"), "p", "q")
    ordered = rows.repartitionByRange(*keys, "score").sortWithinPartitions(*keys, "score")
    out = StructType([rows.schema[k] for k in keys])
    for name, kind in (("low", DoubleType()), ("high", DoubleType()), ("u", DoubleType()), ("p", LongType()), ("q", LongType())):
        out = out.add(name, kind)
    from pyspark.sql.pandas.types import to_arrow_schema

    return ordered.mapInArrow(_piece_sums(list(keys), to_arrow_schema(out)), out)


def combine_pieces(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AUC from sums per piece: ``u`` (pairs won inside), ``p`` and ``q``. A handful of pieces per key and task.
    NULL when a side is empty or any score is NaN."""
    earlier = W.partitionBy(*keys).orderBy("low").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("q").over(earlier), F.lit(0)).cast("double")
    has_nan = F.max(F.isnan("high") & (F.col("p") + F.col("q") > 0))
    sums = pieces.withColumn("__won", F.col("u") + F.col("p").cast("double") * offset).groupBy(*keys).agg(
        F.sum("__won").alias("won"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"), has_nan.alias("has_nan")
    )
    pairs = F.col("positives").cast("double") * F.col("negatives").cast("double")
    return sums.select(
        *keys, F.when(~F.col("has_nan"), ratio(F.col("won"), pairs)).alias("auc"), "positives", "negatives"
    )


def auc_one_vs_rest(ties: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, k, auc, positives, negatives`` from tie groups."""
    keys = [*by, "k"]
    return combine_pieces(ranked_pieces(ties, keys), keys)
