"""Joins and ranks that keep working when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions.hashing import digest, hex_prefix

#: A key is hot when it holds more than 1/HOT_PARTS of all rows: fewer than HOT_PARTS keys can be hot,
#: whatever the data, so the list of hot keys is safe to broadcast.
HOT_PARTS = 1024
#: Keys below this many rows fit one task and are never split.
HOT_FLOOR = 200_000
#: Hex digits of the hash that cut a large parent into sub-buckets (16 ** 3 = 4096).
BUCKET_DIGITS = 3


def key_sizes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))


def hot_keys(sizes: DataFrame, keys: Sequence[str], parts: int = HOT_PARTS, floor: int = HOT_FLOOR) -> DataFrame:
    """Of a table with one row and ``__size`` per key: the keys with more than ``1/parts`` of all rows and more
    than ``floor`` rows, and in how many pieces (``__pieces``) to cut each. Fewer than ``parts`` rows come
    out by arithmetic."""
    total = sizes.agg(F.sum("__size").alias("total")).scalar()
    pieces = F.ceil(F.col("__size") * parts / total).cast("int")
    return sizes.where((F.col("__size") > floor) & (F.col("__size") * parts > total)).select(*keys, pieces.alias("__pieces"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join by equal key values in which NULL equals NULL; the keys come out once, from the left side."""
    renamed = right.select(*[F.col(c).alias(f"__right_{c}" if c in keys else c) for c in right.columns])
    same = [left[k].eqNullSafe(renamed[f"__right_{k}"]) for k in keys]
    return left.join(renamed, same, how).drop(*[f"__right_{k}" for k in keys])


def attach(
    rows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    spread: str,
    how: str = "inner",
    sizes: DataFrame | None = None,
    parts: int = HOT_PARTS,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """``rows`` joined to ``facts`` (one row per key). ``sizes`` may give the row count per key (``__size``)
    where it is known already, or an upper bound; else it is counted.

    The rows of a hot key are spread over several join partitions by a hash of ``spread``, and its one
    fact row is repeated once per piece. Other keys are shuffled as usual; adaptive execution turns
    the join into a broadcast when the facts turn out to be small. Each row comes out once."""
    keys = list(keys)
    # Fewer than ``parts`` rows, see hot_keys.
    hot = F.broadcast(hot_keys(key_sizes(rows, keys) if sizes is None else sizes, keys, parts, floor))
    pieces = F.coalesce("__pieces", F.lit(1))
    salted = null_safe_join(rows, hot, keys, "left").withColumn("__piece", F.pmod(F.xxhash64(spread), pieces).cast("int"))
    repeated = null_safe_join(facts, hot, keys, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return null_safe_join(salted.drop("__pieces"), repeated.drop("__pieces"), [*keys, "__piece"], how).drop("__piece")


def hashed_rank(
    df: DataFrame,
    parents: Sequence[str],
    key: str,
    seed: object,
    across: Sequence[Column] = (),
    hot_only: bool = False,
    sizes: DataFrame | None = None,
    parts: int = HOT_PARTS,
    floor: int = HOT_FLOOR,
    repeats: str | None = None,
) -> DataFrame:
    """Adds ``ordinal`` (0-based rank of ``key`` in md5 order within its parent) and ``parent_size``.

    No task ranks a whole parent: the leading hash digits cut it into sub-buckets that are already in
    rank order, rows are ranked inside (parent, sub-bucket), and the running count of the earlier
    sub-buckets is added. With ``hot_only`` just the hot parents are cut, for tables with very many parents
    (``sizes``: their row counts as ``__size``, if known).
    ``repeats`` names a column that tells rows whose key also stands in the row ranked before.
    ``across`` orders the parents themselves: the rank then continues from one parent to the next."""
    parents = list(parents)
    hashed = df.withColumn("__digest", digest(seed, F.col(key)))
    bucket = hex_prefix(F.col("__digest"), BUCKET_DIGITS).cast("int")
    if hot_only:
        # Fewer than ``parts`` rows, see hot_keys.
        hot = F.broadcast(hot_keys(key_sizes(df, parents) if sizes is None else sizes, parents, parts, floor))
        hashed = null_safe_join(hashed, hot, parents, "left")
        bucket = F.when(F.col("__pieces").isNotNull(), bucket).otherwise(F.lit(0))
    hashed = hashed.withColumn("__bucket", bucket).drop("__pieces")

    counts = hashed.groupBy(*parents, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*parents).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(
        *parents,
        "__bucket",
        F.coalesce(before, F.lit(0)).alias("__before"),
        F.sum("__n").over(W.partitionBy(*parents)).alias("parent_size"),
    )
    if across:
        # One row per parent; parents that are ordered among themselves are few (classes).
        totals = counts.groupBy(*parents).agg(F.sum("__n").alias("__total"))
        earlier = F.sum("__total").over(W.orderBy(*across).rowsBetween(W.unboundedPreceding, -1))
        starts = totals.select(*parents, F.coalesce(earlier, F.lit(0)).alias("__start"))
        offsets = null_safe_join(offsets, starts, parents).withColumn("__before", F.col("__before") + F.col("__start")).drop("__start")
    order = W.partitionBy(*parents, "__bucket").orderBy("__digest", key)
    ranked = hashed.withColumn("__within", F.row_number().over(order) - 1)
    if repeats:
        ranked = ranked.withColumn(repeats, (F.col("__within") > 0) & F.lag(key).over(order).eqNullSafe(F.col(key)))
    return (
        null_safe_join(ranked, offsets, [*parents, "__bucket"])
        .withColumn("ordinal", (F.col("__before") + F.col("__within")).cast("bigint"))
        .drop("__digest", "__bucket", "__within", "__before")
    )
