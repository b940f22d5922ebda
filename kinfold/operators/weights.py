"""Weights and resampling that let classes, and groups inside a class, count equally."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.fixed import IMBALANCE_MODES
from kinfold.functions.hashing import draw_below
from kinfold.functions.scores import class_array, label_index, quoted
from kinfold.operators.manifest import check_choice
from kinfold.operators.skew import HOT_FLOOR, HOT_PARTS, attach, hashed_rank, null_safe_join
from kinfold.sources.shared import settle


def balanced_weights(
    df: DataFrame, label: str = "species", group: str = "isolate_id", item: str = "image_path", floor: int = HOT_FLOOR
) -> DataFrame:
    """Adds ``weight`` = 1 / (groups in the item's class x items in its group).

    The counts come from one (group, label) reduction, written once; the item rows are joined once, hot groups split."""
    pairs = settle(df.groupBy(group, label).agg(F.count(F.lit(1)).alias("__items")))
    per_class = pairs.groupBy(label).agg(F.count(F.lit(1)).alias("__groups"))
    in_group = F.sum("__items").over(W.partitionBy(group))
    facts = null_safe_join(pairs.withColumn("__items", in_group), per_class, [label])
    weight = F.lit(1.0) / (F.col("__groups") * F.col("__items"))
    sizes = pairs.withColumnRenamed("__items", "__size")
    return attach(df, facts.select(group, label, weight.alias("weight")), [group, label], item, sizes=sizes, floor=floor)


def known_labels(df: DataFrame, classes: Sequence[str], label: str = "species") -> DataFrame:
    """The same rows; one with a label outside the class list fails the query. All modes of weighting share this rule."""
    return df.where(label_index(F.col(label), classes) >= 0)


def class_loss_weights(df: DataFrame, classes: Sequence[str], label: str = "species") -> DataFrame:
    """``label, k, n, weight`` with weight = N / (K x n), 0 for an absent class. One row per class of the list."""
    counts = known_labels(df, classes, label).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    listed = df.sparkSession.range(1).select(F.posexplode(class_array(classes)).alias("k", label))
    # At most one row per class of the list.
    table = listed.join(F.broadcast(counts), label, "left").na.fill(0, ["n"])
    total = counts.agg(F.sum("n")).scalar()
    weight = F.coalesce(F.try_divide(total.cast("double"), (len(classes) * F.col("n")).cast("double")), F.lit(0.0))
    return table.select(label, F.col("k").cast("int").alias("k"), F.col("n").cast("bigint").alias("n"), weight.alias("weight"))


def weight_column(
    df: DataFrame, mode: str, classes: Sequence[str], label: str = "species", group: str = "isolate_id", item: str = "image_path"
) -> DataFrame:
    """Adds ``weight`` for one imbalance mode, never two corrections at once:
    sampler = balanced weights, loss = class weights, none = 1."""
    check_choice("imbalance", mode, IMBALANCE_MODES)
    df = known_labels(df, classes, label)
    if mode == "sampler":
        return balanced_weights(df, label, group, item)
    if mode == "loss":
        # One row per class of the given list, so the broadcast is bounded by the list.
        return df.join(F.broadcast(class_loss_weights(df, classes, label).select(label, "weight")), label)
    return df.withColumn("weight", F.lit(1.0))


def weighted_resample(
    df: DataFrame,
    classes: Sequence[str],
    seed: int,
    label: str = "species",
    group: str = "isolate_id",
    item: str = "image_path",
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """As many draws with replacement as there are items, each item drawn in proportion to its balanced
    weight. Returns the drawn items with ``copies`` >= 1; use it as a weight or see ``expand_copies``.

    The weight factorises, so a draw is: a class, then a group of the class, then an item of the group,
    each uniform. Every item row serves as one draw slot. A class with few groups is drawn far more often
    than a group partition should hold; its expected share is known beforehand, so those draws are split
    by that share. Draws are counted before they meet the items."""
    df = known_labels(df, classes, label)
    groups = settle(df.groupBy(group, label).agg(F.count(F.lit(1)).alias("__items")))
    ranked = hashed_rank(groups, [label], group, seed).select(
        label, group, "__items", F.col("ordinal").alias("__g"), F.col("parent_size").alias("__groups")
    )
    present = F.array_sort(F.array_intersect(class_array(classes), F.collect_set(label)))
    drawable = groups.agg(present.alias("present")).scalar()
    per_class = groups.where(F.col(label).isin(*classes)).groupBy(label).agg(F.count(F.lit(1)).alias("__groups"))

    # ``per_class`` has at most one row per class of the list, which bounds its broadcast.
    slot = F.col(item)
    draws = df.select(slot.alias("__slot")).withColumn("__present", drawable)
    picked = F.element_at("__present", (draw_below(F.size("__present"), seed, "class", F.col("__slot")) + 1).cast("int"))
    draws = draws.select("__slot", picked.alias(label)).join(F.broadcast(per_class), label)
    # A group is drawn with probability 1 / (classes x groups of its class): cut it so that a piece expects 1/HOT_PARTS.
    pieces = F.greatest(F.ceil(F.lit(HOT_PARTS) / (F.col("__groups") * len(classes))), F.lit(1)).cast("int")
    draws = draws.withColumn("__g", draw_below(F.col("__groups"), seed, "group", F.col("__slot"))).withColumn(
        "__piece", F.pmod(F.xxhash64("__slot"), pieces).cast("int")
    ).drop("__groups")
    targets = ranked.withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("__groups")
    drawn = draws.join(targets, [label, "__g", "__piece"]).select(
        label, group, draw_below(F.col("__items"), seed, "item", F.col("__slot")).alias("ordinal")
    )
    copies = drawn.groupBy(label, group, "ordinal").agg(F.count(F.lit(1)).alias("copies"))
    sizes = groups.withColumnRenamed("__items", "__size")
    # Only the keys are ranked; the rows are shuffled once, to meet the keys that were drawn.
    keys = df.select(label, group, item)
    numbered = settle(hashed_rank(keys, [label, group], item, seed, hot_only=True, sizes=sizes, floor=floor, repeats="__repeat").drop("parent_size"))
    if numbered.where("__repeat").isEmpty():
        chosen = null_safe_join(numbered, copies, [label, group, "ordinal"]).select(label, group, item, "copies")
        return null_safe_join(df, chosen, [label, group, item]).select(*[quoted(c) for c in df.columns], "copies")
    # Several rows with one item: the rank tells them apart, so the rows themselves are ranked.
    ranked_rows = hashed_rank(df, [label, group], item, seed, hot_only=True, sizes=sizes, floor=floor).drop("parent_size")
    return null_safe_join(ranked_rows, copies, [label, group, "ordinal"]).drop("ordinal")


def expand_copies(resampled: DataFrame, chunk: int = 4096) -> DataFrame:
    """One row per draw. Two steps, so that no single row carries a long array."""
    outer = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / chunk)))
    inner = F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(chunk).cast("bigint"), F.col("copies") - F.col("__chunk") * chunk))
    return resampled.withColumn("__chunk", outer).withColumn("__copy", F.explode(inner)).drop("__chunk", "__copy", "copies")
