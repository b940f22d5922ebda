"""Bootstrap intervals that resample whole groups.

A replicate never copies rows. ``group_draws`` lists, per group, the replicates that drew it (repeats count); packed to one byte per
replicate they are the group's row of a weight matrix. Every statistic is a weighted sum over groups: confusion cells as products of counts and
weights in each task, the AUC with one NumPy pass over a stretch of the ordered scores that handles many replicates at once. Item rows
never carry weights through a shuffle. The scores are cut into a fixed number of stretches and the replicates into blocks that fit a task:
the weights travel once per stretch, the scores once per block, both packed, so that what is shuffled grows as the rows do."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.fixed import CLASS_METRICS, GROUP_LEVEL, ITEM_LEVEL, POOLED_METHOD, STRATIFIED_METHOD
from kinfold.functions.hashing import draw_below
from kinfold.operators.auc import combine_pieces
from kinfold.operators.metrics import class_metrics, confusion_cells, group_summary, level_cells, macro_metrics, scored
from kinfold.operators.skew import attach, hashed_rank, null_safe_join
from kinfold.sources.shared import settle

LOW, HIGH = 0.025, 0.975
#: Weights (rows x replicates) that make a stretch of the ordered scores of its own, as long as there are tasks for more of them.
CELL_WEIGHTS = 20_000_000
#: Weights (groups x replicates) that a task holds, a byte each, and rows that it sorts.
BLOCK_WEIGHTS = 256_000_000
SORTED_ROWS = 2_000_000
#: Draws (groups x replicates) that one task spreads.
TASK_DRAWS = 4_000_000
#: Rows of weights that are at hand at once, and sums that a task gathers before it sends them on.
_CHUNK_ROWS = 1024
_HELD_SUMS = 4096


def strata(groups: DataFrame, label: str = "species") -> DataFrame:
    """Adds ``stratum`` and ``method``: resample within labels only if every label has at least two groups,
    else all groups form one stratum (a lone group would be frozen and the interval too narrow)."""
    smallest = groups.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("smallest")).scalar()
    return groups.withColumn("__smallest", smallest).select(
        *groups.columns,
        F.when(F.col("__smallest") >= 2, F.col(label)).otherwise(F.lit("*")).alias("stratum"),
        F.when(F.col("__smallest") >= 2, F.lit(STRATIFIED_METHOD)).otherwise(F.lit(POOLED_METHOD)).alias("method"),
    )


def bootstrap_method(groups: DataFrame, label: str = "species") -> DataFrame:
    """One row per stratum: ``stratum, method, n_groups``."""
    return strata(groups, label).groupBy("stratum", "method").agg(F.count(F.lit(1)).alias("n_groups"))


def draw_parts(groups: DataFrame, n_boot: int) -> int:
    """Tasks for the draws of as many groups as there are rows."""
    return max(groups.sparkSession.sparkContext.defaultParallelism, -(-groups.count() * n_boot // TASK_DRAWS))


def group_draws(groups: DataFrame, n_boot: int, seed: int, label: str = "species", group: str = "isolate_id") -> DataFrame:
    """``group, draws ARRAY<INT>``: the replicate number once per time the group was drawn.

    Per replicate a stratum of n groups gets n draws with replacement. Each group row serves as one slot of
    its stratum, so slots need no number generator, and picks spread evenly over (stratum, ordinal).
    A group expects ``n_boot`` draws in all, whatever the number of groups."""
    ranked = hashed_rank(strata(groups.select(group, label), label), ["stratum"], group, seed)
    # Every slot becomes n_boot rows: spread the slots first (adaptive execution would otherwise pack the small table into one
    # task), and the draws again, over more tasks the more draws there are.
    parts = draw_parts(groups, n_boot)
    spread = ranked.repartition(parts, "stratum", "ordinal")
    slots = spread.select("stratum", "ordinal", "parent_size", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    pick = draw_below(F.col("parent_size"), seed, F.col("b"), F.col("stratum"), F.col("ordinal"))
    picks = slots.select("stratum", pick.alias("ordinal"), "b").repartition(parts, "stratum", "ordinal")
    picked = picks.groupBy("stratum", "ordinal").agg(F.collect_list("b").alias("draws"))
    return ranked.join(picked, ["stratum", "ordinal"]).select(group, "draws")


def draw_counts(draws: DataFrame, group: str = "isolate_id", parts: int | None = None) -> DataFrame:
    """Long form ``b, group, m`` with m >= 1. A group's draws are counted where they stand; ``parts`` (see ``draw_parts``) tells into how many
    tasks the counts go, so that none holds more of them with more groups."""

    def count(lists: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((flat, row))
        row, flat = row[order], flat[order]
        at = np.flatnonzero(_changes(row, flat))
        counts = pa.StructArray.from_arrays([pa.array(flat[at], pa.int32()), pa.array(np.diff(at, append=len(row)), pa.int64())], ["b", "m"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(len(lists) + 1)), pa.int32()), counts)

    counted = F.arrow_udf(count, "array<struct<b:int,m:bigint>>")("draws")
    rows = draws.select(group, F.explode(counted).alias("c")).select("c.b", group, "c.m")
    rows = rows if parts is None else rows.repartition(parts, "b", group)
    return rows.groupBy("b", group).agg(F.sum("m").alias("m"))


def packed(draws: Column, n_boot: int) -> Column:
    """A group's draws as bytes: how often each replicate drew it, one byte each, or eight where one does not suffice."""

    def pack(lists: pa.Array) -> pa.Array:
        out = []
        for start in range(0, len(lists), _CHUNK_ROWS):
            part = lists.slice(start, _CHUNK_ROWS)
            row = np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy(zero_copy_only=False))
            flat = part.flatten().to_numpy(zero_copy_only=False)
            times = np.bincount(row * n_boot + flat, minlength=len(part) * n_boot).reshape(-1, n_boot)
            out += [(t.astype(np.uint8) if t.max(initial=0) < 256 else t).tobytes() for t in times]
        return pa.array(out, pa.binary())

    return F.arrow_udf(pack, "binary")(draws)


def unpacked(draws: Sequence[bytes], n_boot: int) -> np.ndarray:
    """The weight matrix of groups x replicates."""
    if all(len(d) == n_boot for d in draws):
        return np.frombuffer(b"".join(draws), np.uint8).reshape(-1, n_boot)
    return np.array([np.frombuffer(d, np.uint8 if len(d) == n_boot else np.int64).astype(np.int64) for d in draws])


def with_draws(summary: DataFrame, n_boot: int, seed: int, label: str = "species", group: str = "isolate_id") -> DataFrame:
    """The group summary with the packed ``draws`` and a ``number`` of each group, written once; groups that no replicate drew are gone."""
    drawn = group_draws(summary, n_boot, seed, label, group).select(group, packed(F.col("draws"), n_boot).alias("draws"))
    return settle(null_safe_join(summary, drawn, [group]).withColumn("number", F.monotonically_increasing_id()))


def replicate_cells(drawn: DataFrame, n_boot: int) -> DataFrame:
    """Confusion counts per (level, replicate). A task adds up counts x weights of its groups: it sends at most one row per
    non-empty cell and replicate, however many groups it has."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            keys = [(*key, b) for key in sums for b in range(n_boot)]
            columns = list(zip(*keys, strict=True))
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32())
            values = np.concatenate(list(sums.values()))
            sums.clear()
            return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, types, strict=True)], pa.array(values)], ["level", "true_k", "pred_k", "b", "n"])

        for batch in batches:
            for start in range(0, len(batch), _CHUNK_ROWS):
                part = batch.slice(start, _CHUNK_ROWS)
                weights = unpacked(part.column("draws").to_pylist(), n_boot).astype(np.int64)
                counts: dict[tuple, tuple[list, list]] = {}
                for row, cells in enumerate(part.column("cells").to_pylist()):
                    for c in cells:
                        rows, n = counts.setdefault((c["level"], c["true_k"], c["pred_k"]), ([], []))
                        rows.append(row)
                        n.append(c["n"])
                for key, (rows, n) in counts.items():
                    sums[key] = sums.get(key, 0) + np.array(n, np.int64) @ weights[rows]
                if len(sums) > _HELD_SUMS:
                    yield sent()
        if sums:
            yield sent()

    parts = drawn.select(level_cells().alias("cells"), "draws").mapInArrow(add, "level string, true_k int, pred_k int, b int, n bigint")
    return confusion_cells(parts.where("n > 0"), ["level", "b"], "n")


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Of ordered rows: whether a row differs from the one before it. NaN equals NaN."""
    found = np.zeros(len(columns[0]), bool)
    found[:1] = True
    for c in columns:
        found[1:] |= (c[1:] != c[:-1]) & ((c[1:] == c[1:]) | (c[:-1] == c[:-1]))
    return found


class _Ranked:
    """Ordered tie groups of one class, for some replicates at once, as they come in: the pairs won, positives and negatives of all between
    the first and the last tie group. These two may go on in the neighbouring stretches, so their pairs are counted elsewhere."""

    def __init__(self, n_boot: int):
        self.first, self.last, self.ends = None, None, []
        self.won, self.p, self.q = np.zeros(n_boot), np.zeros(n_boot), np.zeros(n_boot)

    def add(self, score: np.ndarray, starts: np.ndarray, positive: np.ndarray, n: np.ndarray | None, rows: np.ndarray, weights: np.ndarray) -> None:
        """Rows in order of ``score``, which is given per tie group; ``starts`` tells where one begins. A tie group may go on from the rows before."""
        tie = np.cumsum(starts) - 1
        for a in range(0, len(rows), _CHUNK_ROWS):
            chunk = slice(a, a + _CHUNK_ROWS)
            w = weights[rows[chunk]].astype(float)
            if n is not None:
                w *= n[chunk, None]
            ids, side = tie[chunk], positive[chunk]
            at = np.flatnonzero(_changes(ids, side))
            sums = np.add.reduceat(w, at, axis=0)
            of, is_pos = ids[at] - ids[0], side[at]
            p, q = np.zeros((of[-1] + 1, w.shape[1])), np.zeros((of[-1] + 1, w.shape[1]))
            np.add.at(p, of[is_pos], sums[is_pos])
            np.add.at(q, of[~is_pos], sums[~is_pos])
            self._ties(score[ids[0] : ids[-1] + 1], p, q)

    def _ties(self, score: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
        if self.last is not None:
            s, p_open, q_open = self.last
            if s == score[0] or (np.isnan(s) and np.isnan(score[0])):
                p[0] += p_open
                q[0] += q_open
            else:
                score, p, q = np.concatenate([[s], score]), np.vstack([p_open, p]), np.vstack([q_open, q])
        self.last = (score[-1], p[-1].copy(), q[-1].copy())
        score, p, q = score[:-1], p[:-1], q[:-1]
        if len(score) and self.first is None:
            self.first = (score[0], p[0].copy(), q[0].copy())
            score, p, q = score[1:], p[1:], q[1:]
        if len(score):
            under = self.q + np.cumsum(q, axis=0) - q
            self.won += (p * (under + q / 2)).sum(axis=0)
            self.p += p.sum(axis=0)
            self.q += q.sum(axis=0)
            self.ends = [self.ends[0] if self.ends else score[0], score[-1]]

    def pieces(self) -> list[tuple]:
        """``low, high, won, positives, negatives`` of the edges and of what is between them."""
        edges = [(s, s, np.zeros_like(p), p, q) for s, p, q in (e for e in (self.first, self.last) if e is not None)]
        return [*edges, (*self.ends, self.won, self.p, self.q)] if self.ends else edges


def _won(score: np.ndarray, positive: np.ndarray, n: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs won, positives and negatives of ordered rows, for all replicates at once. A tie group may be cut by the chunks."""
    starts, ranked = _changes(score), _Ranked(weights.shape[1])
    ranked.add(score[starts], starts, positive, n, rows, weights)
    won, p_all, q_all = (np.zeros(weights.shape[1]) for _ in range(3))
    for low, high, u, p, q in sorted(ranked.pieces(), key=lambda piece: piece[0]):
        won += (p * q / 2 if low == high else u) + p * q_all
        p_all += p
        q_all += q
    return won, p_all, q_all


def _planes(numbers: np.ndarray) -> bytes:
    """Non-negative numbers byte by byte, the lowest bytes of all first, in as many as the largest needs: few bits change among the others."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    raw = np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(-1, 8)[:, :width]
    return np.ascontiguousarray(raw.T).tobytes()


def _numbers(planes: bytes, size: int) -> np.ndarray:
    raw = np.zeros((size, 8), np.uint8)
    found = np.frombuffer(planes, np.uint8).reshape(-1, size)
    raw[:, : len(found)] = found.T
    return raw.view("<i8").reshape(-1)


def _bits(packed: bytes, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=size).astype(bool)


_TIES_DDL = "k int, score double, number long, positive boolean, n long"


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per class, score, group and side of the rows at hand: equal rows travel once."""
    for batch in batches:
        if not len(batch):
            continue
        number, true_k = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("number", "true_k"))
        scores = batch.column("scores").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        for k in range(scores.shape[1]):
            positive, score = true_k == k, scores[:, k]
            order = np.lexsort((positive, number, score))
            score_k, number_k, positive_k = score[order], number[order], positive[order]
            at = np.flatnonzero(_changes(score_k, number_k, positive_k))
            n = np.diff(at, append=len(order))
            columns = (np.full(len(at), k, np.int32), score_k[at], number_k[at], positive_k[at], n)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k", "score", "number", "positive", "n"])


_SENT = pa.schema([
    ("part", pa.int32()), ("at", pa.int64()), ("level", pa.int32()), ("k", pa.int32()), ("size", pa.int32()), ("numbers", pa.binary()),
    ("scores", pa.binary()), ("starts", pa.binary()), ("positive", pa.binary()), ("weights", pa.binary()),
])
_SENT_DDL = "part int, at long, level int, k int, size int, numbers binary, scores binary, starts binary, positive binary, weights binary"


def _packed_ties(n_cells: int, n_parts: int):
    """Ordered rows, some of one level and class in one: ``part`` is their stretch, ``at`` tells their order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        cell, at = part * n_cells // n_parts, part << 32
        for batch in batches:
            level, k, score, number, positive, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("level", "k", "score", "number", "positive", "n"))
            bounds = [*np.flatnonzero(_changes(level, k)).tolist(), len(batch)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                starts = _changes(score[a:b])
                yield pa.RecordBatch.from_pylist([{
                    "part": cell, "at": at, "level": int(level[a]), "k": int(k[a]), "size": b - a, "numbers": _planes(number[a:b]),
                    "scores": score[a:b][starts].tobytes(), "starts": np.packbits(starts).tobytes(), "positive": np.packbits(positive[a:b]).tobytes(),
                    "weights": _planes(n[a:b]) if n[a:b].max() > 1 else b"",
                }], schema=_SENT)
                at += 1

    return pack


def _packed_draws(bounds: Sequence[int]):
    """The weights of some groups in one, for each block of replicates: ``part`` is the block. They sort before all scores."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), _CHUNK_ROWS):
                some = batch.slice(start, _CHUNK_ROWS)
                number = some.column("number").to_numpy()
                weights = unpacked(some.column("draws").to_pylist(), bounds[-1])
                for block, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    yield pa.RecordBatch.from_pylist([{
                        "part": block, "at": int(number[0]) - (1 << 63), "size": len(some), "numbers": _planes(number), "weights": weights[:, a:b].tobytes(),
                    }], schema=_SENT)

    return pack


_SUMS = pa.schema([
    ("level", pa.int32()), ("k", pa.int32()), ("start", pa.int32()), ("low", pa.float64()), ("high", pa.float64()),
    ("u", pa.list_(pa.float64())), ("p", pa.list_(pa.float64())), ("q", pa.list_(pa.float64())),
])
_SUMS_DDL = "level int, k int, start int, low double, high double, u array<double>, p array<double>, q array<double>"


def _stretch_sums(bounds: Sequence[int]):
    """Per stretch and block of replicates, first the weights of all groups, then the stretch's scores in order. Out come, per level and class, the
    sums of the tie groups at both edges, which may go on in the neighbouring stretches, and of all scores between them."""
    n_blocks = len(bounds) - 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, key, ranked, known, by_number, held, weights = None, None, None, [], None, [], None

        def found() -> list[pa.RecordBatch]:
            if ranked is None:
                return []
            rows = [(*key, bounds[slot % n_blocks], *piece) for piece in ranked.pieces()]
            return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SUMS.types, strict=True)], schema=_SUMS)]

        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["slot"] != slot:
                    yield from found()
                    slot, key, ranked, known, held, weights = row["slot"], None, None, [], [], None
                    width = bounds[slot % n_blocks + 1] - bounds[slot % n_blocks]
                numbers = _numbers(row["numbers"], row["size"])
                if row["level"] is None:
                    known.append(numbers)
                    narrow = len(row["weights"]) == row["size"] * width
                    held.append(np.frombuffer(row["weights"], np.uint8 if narrow else np.int64).reshape(-1, width))
                    continue
                if weights is None:
                    known, weights, held = np.concatenate(known), np.concatenate(held), []
                    by_number = np.argsort(known)  # a task may read several files of the draws
                    known = known[by_number]
                if (row["level"], row["k"]) != key:
                    yield from found()
                    key, ranked = (row["level"], row["k"]), _Ranked(width)
                n = _numbers(row["weights"], row["size"]) if row["weights"] else None
                score = np.frombuffer(row["scores"], np.float64)
                ranked.add(score, _bits(row["starts"], row["size"]), _bits(row["positive"], row["size"]), n, by_number[np.searchsorted(known, numbers)], weights)
        yield from found()

    return sums


def replicate_auc(
    df: DataFrame,
    drawn: DataFrame,
    n_boot: int,
    classes: Sequence[str],
    label: str = "species",
    group: str = "isolate_id",
    auc_decimals: int | None = None,
    cell_weights: int = CELL_WEIGHTS,
    block_weights: int = BLOCK_WEIGHTS,
) -> DataFrame:
    """``level, b, k, auc`` of every replicate and class. ``drawn`` is the group summary with its packed draws (see ``with_draws``);
    groups that no replicate drew are absent from it, and their rows count nothing.

    Rows of one group with the same score collapse where they are read. One range exchange by level, class, score and group puts them in order,
    also where one score is shared by very many groups, and they are packed. A task then reads one stretch of them, row after row, against the weights
    of all groups in one block of replicates. A tie group that several stretches share is added up before its pairs are counted.
    There are as many stretches as tasks run at a time, at every size; a block is as wide as a task's memory allows."""
    levels = (ITEM_LEVEL, GROUP_LEVEL)
    parallel = df.sparkSession.sparkContext.defaultParallelism
    n_groups, n_items = drawn.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_items"), F.lit(0))).first()
    n_rows = (n_groups + n_items) * len(classes)
    n_cells = max(1, min(parallel, -(-n_rows * n_boot // cell_weights)))
    n_parts = n_cells * max(1, -(-n_rows // (n_cells * SORTED_ROWS)))
    n_blocks = max(1, min(n_boot, -(-n_groups * n_boot // block_weights)))
    bounds = [n_boot * i // n_blocks for i in range(n_blocks + 1)]

    scores = F.col("scores") if auc_decimals is None else F.transform("scores", lambda x: F.round(x, auc_decimals))
    columns = ["number", F.coalesce(F.col("true_k").cast("int"), F.lit(-1)).alias("true_k"), scores.alias("scores")]
    sizes = drawn.select(group, F.col("n_items").alias("__size"))
    items = attach(scored(df, classes, label, [group]).drop("pred_k"), drawn.select(group, "number"), [group], "scores", sizes=sizes)
    ties = [rows.select(*columns).mapInArrow(_collapsed, _TIES_DDL).withColumn("level", F.lit(i)) for i, rows in enumerate((items, drawn))]
    order = ["level", "k", "score", "number", "positive"]
    placed = ties[0].unionByName(ties[1]).repartitionByRange(n_parts, *order[:4]).sortWithinPartitions(*order)
    packed_ties = placed.mapInArrow(_packed_ties(n_cells, n_parts), _SENT_DDL)
    packed_draws = drawn.select("number", "draws").mapInArrow(_packed_draws(bounds), _SENT_DDL)
    blocks, cells = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other") for n in (n_blocks, n_cells))
    slot = [(F.col("part") * n_blocks + F.col("other")).alias("slot"), (F.col("other") * n_blocks + F.col("part")).alias("slot")]
    sent = [rows.select("*", other).select(s, *_SENT.names[1:]) for rows, other, s in zip((packed_ties, packed_draws), (blocks, cells), slot, strict=True)]
    met = sent[0].unionByName(sent[1]).repartitionById(n_cells * n_blocks, F.col("slot")).sortWithinPartitions("slot", "at")
    pieces = met.mapInArrow(_stretch_sums(bounds), _SUMS_DDL)
    flat = pieces.select("level", "k", "start", "low", "high", F.posexplode(F.arrays_zip("u", "p", "q")).alias("b", "s"))
    flat = flat.select("level", "k", "low", "high", (F.col("start") + F.col("b")).alias("b"), "s.*")
    whole = flat.groupBy("level", "k", "low", "high", "b").agg(*[F.sum(c).alias(c) for c in ("u", "p", "q")])
    tied = F.when(F.col("low") == F.col("high"), F.col("p") * F.col("q") / 2).otherwise(F.col("u"))
    areas = combine_pieces(whole.withColumn("u", tied), ["level", "b", "k"])
    return areas.select(F.element_at(F.array(*[F.lit(x) for x in levels]), F.col("level") + 1).alias("level"), "b", "k", "auc")


def bootstrap_replicates(
    df: DataFrame,
    classes: Sequence[str],
    n_boot: int,
    seed: int = 0,
    label: str = "species",
    group: str = "isolate_id",
    auc: bool = True,
    auc_decimals: int | None = None,
    summary: DataFrame | None = None,
) -> DataFrame:
    """accuracy and macro metrics of every (level, replicate). Class support is that of the replicate."""
    # One reduced table, a row per group, feeds every branch below: it is written once.
    summary = settle(group_summary(df, classes, label, group)) if summary is None else summary
    drawn = with_draws(summary, n_boot, seed, label, group)
    areas = replicate_auc(df, drawn, n_boot, classes, label, group, auc_decimals) if auc else None
    cells = replicate_cells(drawn, n_boot)
    by = ["level", "b"]
    return macro_metrics(class_metrics(cells, None, by, areas), by)


def intervals(replicates: DataFrame) -> DataFrame:
    """``level, metric, low, high``: linear-interpolation percentiles over the replicates, undefined ones skipped."""
    metrics = [m for m in ("accuracy", *[f"macro_{m}" for m in CLASS_METRICS]) if m in replicates.columns]
    bounds = F.array(F.lit(LOW), F.lit(HIGH))
    wide = replicates.groupBy("level").agg(*[F.percentile(m, bounds).alias(m) for m in metrics])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])
    return wide.select("level", F.explode(pairs).alias("p")).select(
        "level", "p.metric", F.col("p.v")[0].alias("low"), F.col("p.v")[1].alias("high")
    )
