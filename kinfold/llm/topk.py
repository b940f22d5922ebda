"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets of bounded size (an exchange by length puts them in order; equal lengths are dealt by place).
First every query meets the bucket of the longest vectors: its k-th best product there bounds the answer from below. Then
each other bucket takes only the queries that its longest vector could still serve; the bound over both lengths is the
local cosine threshold, and it rises while a query meets its buckets, the longest first. A high threshold prunes by coordinates (on the
query's largest coordinates a vector must lie in the feasible range, found in sorted lists), a low one by length (only the vectors long
enough). What remains is verified by exact products: single ones for a query that few vectors can serve, else a block of queries at once.

Vectors travel packed, a bucket or a block of queries to a row, in the fewest bytes that hold their numbers. Blocks are sorted by the length
they need. The work is a grid: groups of blocks by stretches of buckets. A task holds the blocks of its group and streams the buckets of
its stretch past them, so a bucket travels once per group and a block once per stretch, and each task yields at most k rows for a query.
The driver sees counts, the name of a bucket and the sampled bounds of at most ``MAX_GROUPS`` length groups, at every size.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Every row is a candidate, also one that
repeats another; rows with a query's id are not its candidates, and a repeated query is asked once. Vectors of other lengths are padded with zeros. Products are exact
integers; beyond 64 bits they stop at the largest 64-bit number. Empty tables give no rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.sources.shared import discard, settle

BUCKET_ROWS = 4096
BLOCK_QUERIES = 1024
#: Groups of similar length at most; a group of more vectors than a bucket may hold is cut into several buckets.
MAX_GROUPS = 1024
#: Local cosine thresholds from here on prune by coordinates.
COSINE_BY_COORDINATE = 0.5
FOCUS = 3
#: A query that more than this part of a bucket could serve is multiplied with its block: rows picked one by one cost more.
FEW = 1 / 32
#: Vectors multiplied with a block at once, and single products at once.
_TILE, _PAIRS = 512, 1 << 15
#: Tasks of a large meeting at least, components times vectors of a task beyond which there are more, and components of the queries that one task holds.
LEAST_SLOTS, SLOT_WORK, SLOT_CELLS = 128, 1 << 43, 1 << 25
_LEAST = -(1 << 63)


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _sizes(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(float) ** 2).sum(axis=1))


def _number(a_longest: float, b_longest: float) -> type:
    """The numbers in which products of vectors of such lengths, and all sums on the way, are exact: none exceeds the product of the lengths."""
    largest = max(1.0, a_longest) * max(1.0, b_longest) * (1 + 1e-9)
    return np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else object


def _clipped(exact: np.ndarray) -> np.ndarray:
    return np.clip(exact, _LEAST, (1 << 63) - 1).astype(np.int64)


class Block:
    """Queries, and the best products found for each: at most k, best first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray, k: int):
        self.ids, self.vectors, self.floors, self.k = ids, vectors, floors.copy(), k
        self.size = _sizes(vectors)
        self.held = np.zeros(len(ids), np.int64)
        self.scores, self.found = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        self._focus: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def focus(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Each query's largest coordinates among the first ``width``, and what the query, as a unit vector, has there."""
        if width not in self._focus:
            unit = self.vectors[:, :width] / np.maximum(self.size, 1e-300)[:, None]
            at = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
            self._focus[width] = at.astype(np.int32), np.take_along_axis(unit, at, axis=1)
        return self._focus[width]

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes products in, none of them twice; a query that has k of them needs no product below the least."""
        fit = (ids != self.ids[rows]) & (scores >= self.floors[rows])
        rows, ids, scores = rows[fit], ids[fit], scores[fit]
        if not len(rows):
            return
        touched = np.unique(rows)
        kept = np.arange(self.k) < self.held[touched][:, None]
        rows = np.concatenate([np.repeat(touched, self.held[touched]), rows])
        ids, scores = np.concatenate([self.found[touched][kept], ids]), np.concatenate([self.scores[touched][kept], scores])
        order = np.lexsort((ids, ~scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        begin = np.flatnonzero(np.diff(rows, prepend=-1))
        place = np.arange(len(rows)) - np.repeat(begin, np.diff(begin, append=len(rows)))
        top = place < self.k
        self.scores[rows[top], place[top]], self.found[rows[top], place[top]] = scores[top], ids[top]
        self.held[touched] = np.minimum(self.k, np.diff(begin, append=len(rows)))
        full = touched[self.held[touched] == self.k]
        self.floors[full] = np.maximum(self.floors[full], self.scores[full, -1])

    def rows(self) -> pa.RecordBatch:
        kept = np.arange(self.k) < self.held[:, None]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, self.held)), pa.array(self.found[kept]), pa.array(self.scores[kept])], ["query_id", "vec_id", "score"])


class Bucket:
    """Vectors of similar length, longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        size = _sizes(vectors)
        order = np.argsort(-size, kind="stable")
        self.ids, self.vectors, self.size = ids[order], vectors[order], size[order]
        self._as: dict[type, np.ndarray] = {}
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._unit: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def numbers(self, number: type) -> np.ndarray:
        if number not in self._as:
            self._as[number] = self.vectors.astype(number)
        return self._as[number]

    def unit(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The unit vectors, and the least and the largest number of each coordinate."""
        if self._unit is None:
            unit = self.vectors / np.maximum(self.size, 1e-300)[:, None]
            self._unit = unit, unit.min(axis=0), unit.max(axis=0)
        return self._unit

    def in_order(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The unit vectors' coordinate f in ascending order, and whose it is."""
        if f not in self._lists:
            column = self.unit()[0][:, f]
            order = np.argsort(column)
            self._lists[f] = column[order], order
        return self._lists[f]

    def meet(self, block: Block) -> None:
        """Tells the block's queries all products that can be among their best."""
        # A floor comes from exact products, so only what lies strictly below it can be left out. Bounds are widened by more than rounding can cost.
        floors = block.floors.astype(float)
        bounded = (floors > 0) & (block.size > 0)
        need = np.where(bounded, floors / np.maximum(block.size, 1) * (1 - 1e-9), -np.inf)  # whole numbers: no length between 0 and 1
        rows = np.flatnonzero(need <= self.size[0])
        cosine = need / max(self.size[0], 1)
        high = rows[cosine[rows] >= COSINE_BY_COORDINATE]
        if len(high):
            rows = np.setdiff1d(rows, self.by_coordinate(block, high, cosine[high], need), assume_unique=True)
        if len(rows):
            self.by_length(block, rows[np.argsort(need[rows], kind="stable")], need)

    def by_length(self, block: Block, rows: np.ndarray, need: np.ndarray) -> None:
        """Products of some queries, that of the least need first, with the vectors long enough for them."""
        width = min(block.vectors.shape[1], self.vectors.shape[1])
        number = _number(block.size[rows].max(), self.size[0])
        queries, vectors = block.vectors[rows, :width].astype(number), self.numbers(number)[:, :width]
        made, flags = np.empty(0 if number is object else len(rows) * _TILE, number), np.empty(len(rows) * _TILE + 8, bool)
        needs, known = need[rows], block.floors[rows].astype(np.int64 if number is object else number)
        free = np.flatnonzero(block.floors[rows] == _LEAST)
        found = []
        for first in range(0, len(vectors), _TILE):
            n = int(np.searchsorted(needs, self.size[first], "right"))
            if not n:
                break
            some = vectors[first : first + _TILE]
            shape, size = (n, len(some)), n * len(some)
            products = _clipped(queries[:n] @ some.T) if number is object else np.matmul(queries[:n], some.T, out=made[:size].reshape(shape))
            floors = known[:n]
            if len(free) and len(some) > block.k:  # nothing known yet: the k best that are not the query's own; such queries come first
                least = products.dtype.type(_LEAST)
                others = np.where(self.ids[first : first + _TILE] == block.ids[rows[free]][:, None], least, products[free])
                floors = floors.copy()
                floors[free] = np.partition(others, len(some) - block.k, axis=1)[:, len(some) - block.k]
            flags[size : size + 8] = False
            np.greater_equal(products, floors[:, None], out=flags[:size].reshape(shape))
            eights = flags[: -(-size // 8) * 8].reshape(-1, 8)
            there = np.flatnonzero(eights.view(np.uint64))  # hits are few
            at = (there[:, None] * 8 + np.arange(8))[eights[there]]
            of, vector = np.divmod(at, len(some))
            found.append((rows[of], self.ids[first + vector], products.reshape(-1)[at].astype(np.int64)))
        if found:
            block.add(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def by_coordinate(self, block: Block, rows: np.ndarray, cosine: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Works off the queries that few vectors can serve, as their largest coordinates tell, and returns which these are."""
        width = min(block.vectors.shape[1], self.vectors.shape[1])
        focus, value = (x[rows] for x in block.focus(width))
        middle = cosine[:, None] * value
        spread = np.sqrt(np.maximum(0, 1 - cosine**2)[:, None] * np.maximum(0, 1 - value**2)) + 1e-9
        # Outside of these the range is open at one side.
        tells = np.abs(value) < cosine[:, None]
        low, high = np.where(tells, middle - spread, -np.inf), np.where(tells, middle + spread, np.inf)
        begin, end = np.zeros(focus.shape, np.int64), np.full(focus.shape, len(self.size))
        unit, least, largest = self.unit()
        narrow = tells & ((low > least[focus]) | (high < largest[focus]))
        for f in np.unique(focus[narrow]):
            here, values = narrow & (focus == f), self.in_order(f)[0]
            begin[here], end[here] = np.searchsorted(values, low[here], "left"), np.searchsorted(values, high[here], "right")
        count = end - begin
        best = count.argmin(axis=1)
        few = np.flatnonzero(count.min(axis=1) <= FEW * len(self.size))
        of, vector = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for f in np.unique(focus[few, best[few]]):
            here = few[focus[few, best[few]] == f]
            n, start = count[here, best[here]], begin[here, best[here]]
            of.append(np.repeat(here, n))
            vector.append(self.in_order(f)[1][np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        of, vector = np.concatenate(of), np.concatenate(vector)
        fit = self.size[vector] >= need[rows[of]]
        for i in range(focus.shape[1]):
            there = unit[vector, focus[of, i]]
            fit &= (there >= low[of, i]) & (there <= high[of, i])
        of, vector = rows[of[fit]], vector[fit]
        for first in range(0, len(of), _PAIRS):
            some, those = of[first : first + _PAIRS], vector[first : first + _PAIRS]
            number = _number(block.size[some].max(), self.size[0])
            a, b = block.vectors[some, :width].astype(number), self.numbers(number)[those, :width]
            scores = _clipped((a * b).sum(axis=1)) if number is object else np.einsum("ij,ij->i", a, b).astype(np.int64)
            block.add(some, self.ids[those], scores)
        return rows[few]


_ROW = "vec_id long, is_query boolean, norm double, bytes int, data binary"
_PACK = "name long, longest double, n int, width int, bytes int, ids binary, data binary, floors binary"
_FOUND = "query_id long, vec_id long, score long"


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector's length, and its numbers in the fewest bytes that hold them."""
    for batch in batches:
        lists = batch.column("v")
        values = lists.flatten()
        if lists.null_count or values.null_count:
            raise ValueError("a vector is null or has null components")
        values, counts = values.to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
        filled = counts > 0
        begin = (np.cumsum(counts) - counts)[filled]
        largest, norm = np.zeros(len(counts), np.int64), np.zeros(len(counts))
        if len(begin):
            largest[filled] = np.maximum.reduceat(values ^ (values >> 63), begin)
            norm[filled] = np.sqrt(np.add.reduceat(values.astype(float) ** 2, begin))
        width = 1 << np.searchsorted([1 << 7, 1 << 15, 1 << 31], largest, "right")
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            numbers = values[np.repeat(width == w, counts)].astype(f"<i{w}")
            ends = np.concatenate([[0], np.cumsum(counts[rows] * w)]).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(numbers)])
            some = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [some.column("vec_id"), some.column("is_query"), pa.array(norm[rows]), pa.array(np.full(len(rows), w, np.int32)), data], ["vec_id", "is_query", "norm", "bytes", "data"]
            )


def _matrix(data: pa.BinaryArray, size: np.ndarray) -> np.ndarray:
    """Packed vectors of ``size`` bytes a number, as rows in the widest of these numbers, padded with zeros."""
    ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    n_bytes = np.diff(ends)
    counts = n_bytes // size
    out = np.zeros((len(data), max(1, int(counts.max()))), f"<i{size.max()}")
    for w in np.unique(size):
        rows = np.flatnonzero(size == w)
        some = np.zeros((len(rows), out.shape[1]), out.dtype)
        some[np.arange(out.shape[1]) < counts[rows][:, None]] = raw[np.repeat(size == w, n_bytes)].view(f"<i{w}")
        out[rows] = some
    return out


def _packs(n_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Consecutive rows (vec_id, norm, bytes, data, floor), a bucket or block of ``n_rows`` to a row, named by its task and its number there."""

    def pack(held: list[pa.RecordBatch], name: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        column = lambda name: rows.column(name).chunk(0)
        vectors = _matrix(column("data"), column("bytes").to_numpy())
        floors = column("floor").fill_null(_LEAST).to_numpy()
        values = [name, column("norm").to_numpy().max(), len(vectors), vectors.shape[1], vectors.dtype.itemsize, column("vec_id").to_numpy().tobytes(), vectors.tobytes(), floors.tobytes()]
        types = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [c.split()[0] for c in _PACK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, name = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, n_rows - n))
                n, at = n + held[-1].num_rows, at + held[-1].num_rows
                if n == n_rows:
                    yield pack(held, name)
                    held, n, name = [], 0, name + 1
        if n:
            yield pack(held, name)

    return run


def _meetings(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Works off slots: the blocks of queries come first, then the buckets, the longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, blocks = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("slot", "is_bucket", "n", "width", "bytes", "ids", "data", "floors")}
                if row["slot"] != slot:
                    yield from (block.rows() for block in blocks)
                    slot, blocks = row["slot"], []
                ids, floors = (np.frombuffer(row[name], np.int64) for name in ("ids", "floors"))
                vectors = np.frombuffer(row["data"], f"<i{row['bytes']}").reshape(row["n"], row["width"])
                if row["is_bucket"]:
                    bucket = Bucket(ids, vectors)
                    for block in blocks:
                        bucket.meet(block)
                else:
                    blocks.append(Block(ids, vectors, floors, k))
        yield from (block.rows() for block in blocks)

    return run


def _meet(blocks: DataFrame, buckets: DataFrame, k: int, n_groups: int, n_stretches: int) -> DataFrame:
    """Every block of queries with every bucket: the blocks in groups, the buckets in stretches, a task for each pair of both."""
    deal = F.shiftright("name", 32) + F.col("name").bitwiseAND(F.lit((1 << 32) - 1))  # neighbours go to different tasks
    group, stretch = deal % n_groups, deal % n_stretches
    to_groups = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))
    to_stretches = F.explode(F.sequence(F.lit(0), F.lit(n_stretches - 1)))
    sent = [
        blocks.select("*", F.lit(False).alias("is_bucket"), to_stretches.alias("to")).withColumn("slot", group * n_stretches + F.col("to")),
        buckets.select("*", F.lit(True).alias("is_bucket"), to_groups.alias("to")).withColumn("slot", F.col("to") * n_stretches + stretch),
    ]
    met = sent[0].unionByName(sent[1]).repartitionById(n_groups * n_stretches, F.col("slot").cast("int"))
    return met.sortWithinPartitions("slot", "is_bucket", F.desc("longest")).mapInArrow(_meetings(k), _FOUND)


def _grid(query_cells: int, cells: int, n: int, n_blocks: int, n_buckets: int, partitions: int) -> tuple[int, int]:
    """Groups of blocks and stretches of buckets: few enough copies of both, and no more queries in a task than it can hold."""
    slots = min(partitions, max(LEAST_SLOTS, -(-query_cells * n // SLOT_WORK)))
    groups = max(1, -(-query_cells // SLOT_CELLS), round(math.sqrt(slots * query_cells / max(1, cells))))
    stretches = max(1, min(n_buckets, slots // groups))
    return max(1, min(n_blocks, max(groups, slots // stretches))), stretches


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, bucket_rows: int = BUCKET_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest products over all vectors but its own, ties to the smaller id.
    ``vectors`` has vec_id and v (array of long); ``is_query`` is a condition on them."""
    spark = vectors.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long"), F.col("v").cast("array<long>"), is_query.alias("is_query"))
    place = F.monotonically_increasing_id().alias("place")  # tells repeated rows apart, so that very many of them are dealt out, too
    rows = settle(rows.mapInArrow(_packed_rows, _ROW).select("*", place))
    queries = settle(rows.where("is_query").dropDuplicates(["vec_id", "bytes", "data"]))
    total = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("data") / F.col("bytes")), F.lit(0.0))).first()
    (n, cells), (n_queries, query_cells) = total(rows), total(queries)
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def packs(df: DataFrame, n_rows: int, count: int, *order: Column | str) -> DataFrame:
        n_parts = max(1, min(MAX_GROUPS, partitions, -(-count // n_rows)))
        ordered = df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
        return settle(ordered.select("vec_id", "norm", "bytes", "data", "floor").mapInArrow(_packs(n_rows), _PACK))

    no_floor = F.lit(None).cast("long").alias("floor")
    buckets = packs(rows.select("*", no_floor), bucket_rows, n, F.desc("norm"), F.col("place"))
    asked = packs(queries.select("*", no_floor), block_queries, n_queries, F.col("place"))
    is_first = F.col("name") == buckets.orderBy(F.desc("longest"), "name").select("name").first()["name"]

    def met(blocks: DataFrame, some: DataFrame) -> DataFrame:
        return _meet(blocks, some, k, *_grid(int(query_cells), int(cells), n, blocks.count(), some.count(), partitions))

    found = settle(met(asked, buckets.where(is_first)))
    floors = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("floor")).where(F.col("found") >= k)
    second = queries.join(floors.select(F.col("query_id").alias("vec_id"), "floor"), "vec_id", "left")
    # The length that a vector must have for a query. Queries of like need share a block.
    need = F.coalesce(F.col("floor") / F.greatest("norm", F.lit(1e-300)), F.lit(float("-inf")))
    blocks = packs(second.withColumn("need", need), block_queries, n_queries, F.desc("need"), F.col("place"))
    discard(rows, queries, asked)
    return _ranked(found.unionByName(met(blocks, buckets.where(~is_first))), k).select("query_id", "rank", "vec_id", "score")
