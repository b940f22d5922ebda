"""Balanced shards by histogram sort.

Rows are ordered by the key (hash of the text, hash of the id), so equal texts stand side by side. Splitters are found by
probing: every round counts the exact bytes and rows of 256 equal cells of each open key range over all partitions,
takes a cell's edge as splitter where the bytes below it are within the tolerance of the target, and opens the cell that
holds the target otherwise. Only counts of cells come to the driver, at most 256 per open splitter. A group of equal
texts is cut (by the ids) only if it weighs more than the tolerance allows. Then each row is exchanged once, to a
bounded stretch of its shard, and numbered there.

Nulls: a null text has no bytes and a null id is an id like any other. Rows alike in text and id are never separated.
Empty tables give no rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.sources.shared import settle

DIGIT_BITS = 8
#: Levels of both 64-bit key halves.
LEVELS = 2 * 64 // DIGIT_BITS
#: Rows that a task numbers at once, about.
STRETCH_ROWS = 1000
#: A text is hot if it holds more than this share of all rows (and STRETCH_ROWS / 4 rows).
HOT_SHARE = 1 / 1024


def _keys() -> tuple[Column, Column]:
    return F.xxhash64(F.coalesce("text", F.lit(""))), F.xxhash64(F.lit("id"), F.col("doc_id").cast("string"))


def size_of() -> Column:
    """UTF-8 bytes of the text plus one."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def _digit(level: int) -> Column:
    """Digit ``level`` of the key, ordered like signed numbers."""
    half, place = divmod(level * DIGIT_BITS, 64)
    k = F.col("k1" if half == 0 else "k2")
    return F.shiftright(k, 64 - DIGIT_BITS) + 128 if place == 0 else F.shiftright(k, 64 - DIGIT_BITS - place).bitwiseAND(255)


def _edge(digits: Sequence[int]) -> tuple[int, int]:
    """The smallest key that begins with these digits."""
    digits = [*digits, *[0] * (LEVELS - len(digits))]
    halves = []
    for part in (digits[: LEVELS // 2], digits[LEVELS // 2 :]):
        number = int.from_bytes(bytes(part), "big")
        halves.append(number - (1 << 63))
    # Only the first digit of the first half is shifted by _digit; the second half's first digit is shifted alike.
    return halves[0], halves[1]


def _following(digits: Sequence[int]) -> list[int] | None:
    """The next sibling of a cell; None after the last key."""
    digits = list(digits)
    while digits and digits[-1] == 255:
        digits.pop()
    return [*digits[:-1], digits[-1] + 1] if digits else None


def splitters(keys: DataFrame, n_shards: int, tolerance: float) -> list[tuple[int, int]]:
    """The smallest keys of shards 1, 2, ...: ``keys`` has k1, k2 and size. Each has bytes below it that differ from its
    target by at most ``tolerance`` of a shard, unless one (text, id) pair weighs more."""
    open_cells: dict[tuple[int, ...], tuple[int, list[int]]] = {(): (0, list(range(1, n_shards)))}  # prefix -> bytes below, shards
    found: dict[int, tuple[int, int]] = {}
    total = 0
    for level in range(LEVELS):
        if not open_cells:
            break
        label = F.lit(0)
        for number, prefix in enumerate(open_cells):
            if prefix:
                same = F.lit(True)
                for place, digit in enumerate(prefix):
                    same = same & (_digit(place) == digit)
                label = F.when(same, F.lit(number)).otherwise(label if number else F.lit(None).cast("int"))
        counted = keys.select(label.alias("cell"), _digit(level).cast("int").alias("digit"), "size").where("cell IS NOT NULL")
        sums: dict[int, dict[int, int]] = {}
        for r in counted.groupBy("cell", "digit").agg(F.sum("size").alias("bytes")).collect():
            sums.setdefault(r["cell"], {})[r["digit"]] = r["bytes"]
        if level == 0:
            total = sum(sums.get(0, {}).values())
        narrowed: dict[tuple[int, ...], tuple[int, list[int]]] = {}
        for number, (prefix, (below, shards)) in enumerate(open_cells.items()):
            cells = sorted(sums.get(number, {}).items())
            for shard in shards:
                target, at = total * shard / n_shards, below
                for digit, weight in cells:
                    if at + weight >= target:
                        break
                    at += weight
                else:
                    continue  # no rows: nothing to split
                low, high = (*prefix, digit), _following((*prefix, digit))
                slack = tolerance * total / n_shards
                nearer_low = target - at <= at + weight - target
                last = level == LEVELS - 1
                if (target - at <= slack or last) and (nearer_low or (not last and at + weight - target > slack)):
                    found[shard] = _edge(low)
                elif at + weight - target <= slack or last:
                    found[shard] = _edge(high) if high else ((1 << 63) - 1, (1 << 63) - 1)
                else:
                    narrowed.setdefault(low, (at, []))[1].append(shard)
        open_cells = narrowed
    return [found[s] for s in sorted(found)]


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, tolerance: float = 0.01, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs``: ``row`` (the columns in ``keep``), ``size``, ``text_crc32`` (0 for a null text), ``shard``
    and ``slot`` (its place in the shard's order, gapless from 0)."""
    k1, k2 = _keys()
    keys = settle(docs.select(k1.alias("k1"), k2.alias("k2"), size_of().alias("size")))
    shard = F.lit(0)
    for a, b in splitters(keys, n_shards, tolerance):
        shard = shard + F.when((F.col("k1") > a) | ((F.col("k1") == a) & (F.col("k2") >= b)), 1).otherwise(0)

    n_rows = keys.count()
    limit = max(STRETCH_ROWS // 4, int(n_rows * HOT_SHARE))
    hot = keys.groupBy("k1").count().where(F.col("count") > limit).select("k1")  # fewer than 1 / HOT_SHARE rows
    hot = [r["k1"] for r in hot.collect()]
    bits = max(0, (n_rows // STRETCH_ROWS).bit_length())
    cell = lambda k: F.shiftright(k, 64 - bits) if bits else F.lit(0).cast("long")
    is_hot = F.col("k1").isin(hot) if hot else F.lit(False)
    # A stretch: the hash cell, then each hot text of the cell by itself, cut by the hash of the ids.
    place = {
        "cell": cell("k1"),
        "hot": F.when(is_hot, F.col("k1")).otherwise(F.lit(-(1 << 63))),
        "part": F.when(is_hot, cell("k2")).otherwise(F.lit(0).cast("long")),
    }
    stretch = ["shard", *place]
    counts = keys.withColumns({"shard": shard, **place}).groupBy(*stretch).count()
    offset = F.sum("count").over(W.partitionBy("shard").orderBy(*place).rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(*[F.col(c).alias(f"_{c}") for c in stretch], F.coalesce(offset, F.lit(0)).alias("start"))

    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), k1.alias("k1"), k2.alias("k2"), size_of().alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    ).withColumns({"shard": shard, **place})
    rank = F.row_number().over(W.partitionBy(*stretch).orderBy("k1", "k2"))
    numbered = rows.withColumn("rank", rank)
    joined = numbered.join(starts, [numbered[c] == starts[f"_{c}"] for c in stretch])
    return joined.select("row", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))
