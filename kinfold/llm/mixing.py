"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source's documents, in hashed order, form a stream that is cut into blocks of ``block_words``. A source
whose target is r times its size gives every block floor(r) times and, in a last pass, the first blocks of a permutation
of its blocks (the last of them in part), so that the words taken equal the rounded target exactly. The draws of all sources are
the quotas at the root of a tree over the output shards: each node gives its left half a multivariate-hypergeometric
share of the quotas, so that shards are equally long and mixed as by a global shuffle. Shard j takes the next draws of each
source's permuted sequence; ``order`` shuffles within the shard.

A document learns its blocks from its offset in the stream: a window inside hash buckets of bounded size plus the offset of the bucket.
Only one row per source is ever planned in one place.

Nulls: a null text has no words, a null source is a source of its own. Sources without words and their documents take nothing.
Rows that repeat are rows of their own. Empty tables give no rows."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.text import blank_words, packed_row, pieces

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK_WORDS = 256
#: Blocks of all sources at most; larger inputs get longer blocks.
MAX_BLOCKS = 500_000_000
BUCKET_ROWS = 1000

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def targets(names: Sequence[str | None], sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> list[float]:
    """Target words of each source. Sources by code point, null last, take the repeating weights and share all words;
    one above ``max_repeat`` times its size stops there and the others share its excess by weight."""
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
    weight = [0.0] * len(names)
    for place, i in enumerate(order):
        weight[i] = float(weights[place % len(weights)])
    out = [0.0] * len(names)
    free, left = list(order), float(sum(sizes))
    while free:
        share = left / sum(weight[i] for i in free)
        full = [i for i in free if weight[i] * share > max_repeat * sizes[i]]
        if not full:
            for i in free:
                out[i] = weight[i] * share
            break
        for i in full:
            out[i] = float(max_repeat * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def split_quotas(quotas: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """Shards x sources: every shard's exact number of draws from each source, by the splitting tree."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n_shards, len(quotas)), np.int64)

    def split(own: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[first] = own
            return
        middle = (first + last) // 2
        wanted = int(own.sum()) * (middle - first) // (last - first)
        left, rest = np.zeros_like(own), int(own.sum())
        for i, q in enumerate(own):  # the conditional law of one source after the other
            q = int(q)
            left[i] = rng.hypergeometric(q, rest - q, wanted) if wanted and q else 0
            wanted, rest = wanted - int(left[i]), rest - q
        split(left, first, middle)
        split(own - left, middle, last)

    split(quotas.astype(np.int64), 0, n_shards)
    return out


def plan(stats: pd.DataFrame, n_shards: int, weights, max_repeat, block_words: int, seed: int) -> pd.DataFrame:
    """From source and source_size (one row per source): target, block_words, whole passes, words of the last pass,
    permutation (step, shift) and the first draw of each shard."""
    stats = stats.sort_values("source", key=lambda s: s.map(lambda v: (v is None or v != v, v or "")), kind="stable").reset_index(drop=True)
    names = [None if s is None or s != s else s for s in stats["source"]]
    sizes = [int(s) for s in stats["source_size"]]
    aims = targets(names, sizes, weights, max_repeat)
    block = max(block_words, -(-sum(sizes) // MAX_BLOCKS))
    rng = np.random.default_rng(seed)
    rows, draws = [], []
    for size, aim in zip(sizes, aims, strict=True):
        words = min(int(math.floor(aim + 0.5)), max_repeat * size)
        whole, rest = divmod(words, size) if size else (0, 0)
        blocks = -(-size // block)
        turned = max(1, blocks - 1)  # the last, shorter block keeps its place
        step = int(rng.integers(1, min(turned, 1 << 24) + 1))
        while math.gcd(step, turned) != 1:
            step += 1
        rows.append((aim, block, blocks, whole, rest, step, int(rng.integers(0, turned))))
        draws.append(whole * blocks + -(-rest // block))
    cut = split_quotas(np.array(draws, np.int64), n_shards, seed) if rows else np.zeros((n_shards, 0), np.int64)
    first = np.vstack([np.zeros((1, len(rows)), np.int64), np.cumsum(cut, axis=0)])[:-1].T
    out = pd.DataFrame(rows, columns=["target", "block", "blocks", "whole", "rest", "step", "shift"])
    out.insert(0, "source_size", sizes)
    out.insert(0, "source", names)
    out["firsts"] = [list(map(int, f)) for f in first]
    return out


_PLAN = "source string, source_size long, target double, block long, blocks long, whole long, rest long, step long, shift long, firsts array<long>"


def sized(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``row``, ``source``, ``size`` (words of the text) and ``h`` (the hashed order) of every document."""

    def count(texts: pa.Array) -> pa.Array:
        sizes = np.zeros(len(texts), np.int64)
        for first, last, raw, offsets in pieces(texts):
            sizes[first:last] = np.diff(blank_words(raw, offsets)[1])
        return pa.array(sizes)

    order = F.xxhash64(F.lit(0), F.col("doc_id").cast("string"), F.xxhash64("text"))
    return docs.select(packed_row(keep), F.col("source"), F.arrow_udf(count, "long")("text").alias("size"), order.alias("h"))


def mix(
    rows: DataFrame, n_shards: int = 8, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT,
    block_words: int = BLOCK_WORDS, seed: int = 0,
) -> DataFrame:
    """Adds to the rows of ``sized``: source_size, target and ``draws``, the pieces that the mix takes of the document:
    array of (shard, order, copy, start, words), with ``start`` counted in words of the document."""
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    planned = stats.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda s: plan(s, n_shards, weights, max_repeat, block_words, seed), _PLAN)
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    heads = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_words"))
    before = F.sum("bucket_words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    heads = heads.withColumn("head", F.coalesce(before, F.lit(0))).drop("bucket_words")
    same_source = heads["source"].eqNullSafe(planned["source"])
    heads = heads.join(planned, same_source).drop(planned["source"])
    named = heads.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), *[c for c in heads.columns if c not in ("source", "bucket")])

    inside = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("h").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(0)))
    rows = rows.join(named, rows["source"].eqNullSafe(named["_source"]) & (rows["bucket"] == named["_bucket"]))
    begin = F.col("head") + F.col("inside")
    rows = rows.withColumns({"begin": begin, "end": begin + F.col("size")})

    def pieces_of(block):
        low, high = F.greatest("begin", block * F.col("block")), F.least("end", (block + 1) * F.col("block"))
        turned = F.greatest(F.col("blocks") - 1, F.lit(1))
        place = F.when(block == F.col("blocks") - 1, block).otherwise(F.pmod(block * F.col("step") + F.col("shift"), turned))
        # Words of the block that the last pass takes, counted from the block's beginning.
        part = F.least(F.col("rest") - place * F.col("block"), F.col("block"))

        def piece(copy):
            draw = copy * F.col("blocks") + place
            until = F.when(copy < F.col("whole"), high).otherwise(F.least(high, block * F.col("block") + part))
            shard = F.size(F.filter("firsts", lambda f: f <= draw)) - 1
            return F.struct(
                shard.alias("shard"), F.xxhash64(F.lit(seed), "source", draw).alias("order"), copy.cast("long").alias("copy"),
                (low - F.col("begin")).alias("start"), F.greatest(until - low, F.lit(0)).alias("words"),
            )

        return F.transform(F.sequence(F.lit(0), F.col("whole")), piece)

    blocks = F.sequence(F.floor(F.col("begin") / F.col("block")), F.floor((F.col("end") - 1) / F.col("block")))
    drawn = F.filter(F.flatten(F.transform(blocks, pieces_of)), lambda p: p["words"] > 0)
    none = F.filter(F.array(pieces_of(F.lit(0).cast("long"))[0]), lambda p: F.lit(False))
    draws = F.when(F.col("size") > 0, drawn).otherwise(none)
    return rows.select("row", "source", "size", "source_size", "target", draws.alias("draws"))


def taken() -> Column:
    """Words that the mix takes of the document, repeats counted."""
    return F.aggregate("draws", F.lit(0).cast("long"), lambda total, d: total + d["words"])


def _cut_words(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The given word ranges of each text, joined by line breaks where words between them are missing."""
    out = []
    for text, ranges in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if text is None:
            out.append(None)
            continue
        raw = text.encode("utf-8", "surrogatepass")
        words = [m.span() for m in _WORDS.finditer(raw)]
        runs: list[list[int]] = []
        for r in sorted(ranges, key=lambda r: r["start"]):
            if runs and runs[-1][1] == r["start"]:
                runs[-1][1] += r["words"]
            else:
                runs.append([r["start"], r["start"] + r["words"]])
        out.append(b"\n".join(raw[words[a][0] : words[b - 1][1]] for a, b in runs).decode("utf-8", "surrogatepass"))
    return pa.array(out, pa.string())


def shard_words(n_shards: int) -> Column:
    """Words that each shard takes of the document, in order of shards."""
    words = lambda shard: F.aggregate(
        F.filter("draws", lambda d: d["shard"] == shard), F.lit(0).cast("long"), lambda total, d: total + d["words"])
    return F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), words)


def mixed_documents(mixed: DataFrame) -> DataFrame:
    """The mix as documents: the carried columns (text among them) once for every copy that is taken, with the text cut to the words taken.
    A column n_chars follows the text. Rows are laid out by shard, and within it in the order of the draws: a copy stands where the first of its
    pieces was drawn to."""
    copies = mixed.select("row", "size", "draws", F.explode(F.array_distinct(F.transform("draws", lambda d: d["copy"]))).alias("copy"))
    own = F.filter("draws", lambda d: d["copy"] == F.col("copy"))
    copies = copies.select("row", "size", own.alias("own"))
    words = F.aggregate("own", F.lit(0).cast("long"), lambda total, d: total + d["words"])
    first = F.array_min(F.transform("own", lambda d: F.struct(d["shard"].alias("shard"), d["order"].alias("order"))))
    copies = copies.withColumns({"part": words < F.col("size"), "first": first})
    copies = copies.repartitionByRange("first").sortWithinPartitions("first")
    cut = F.arrow_udf(_cut_words, "string")(F.when(F.col("part"), F.col("row.text")), F.when(F.col("part"), F.col("own")))
    rows = copies.select("row", F.when(F.col("part"), cut).otherwise(F.col("row.text")).alias("new"))
    fresh = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return rows.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in mixed.schema["row"].dataType.names])
