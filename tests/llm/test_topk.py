"""Top-k products against brute force."""

import random

import numpy as np
import pytest
from kinfold.llm import topk
from pyspark.sql import functions as F


def brute(rows, k):
    want = {}
    for q, v in rows:
        if q % 50:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in rows if i != q))[:k]
        want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return want


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("spread", ["even", "lengths", "same", "one direction"])
def test_against_brute_force(spark, spread):
    rng = random.Random(len(spread))
    rows = []
    for i in range(900):
        scale = {"even": 1, "lengths": rng.choice([0, 1, 10, 100]), "same": 1, "one direction": 1}[spread]
        v = [int(rng.gauss(0, 40) * scale) for _ in range(6)]
        if spread == "one direction":
            v = [500 + rng.randint(-9, 9), rng.randint(-30, 30), 0, 0, rng.randint(-3, 3), 1]
        if spread == "same" and i % 3:
            v = [3, -1, 4, 1, -5, 9]
        rows.append((i, v))
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(5)
    assert found(topk.top_products(df, F.col("vec_id") % 50 == 0, bucket_rows=64, block_queries=7)) == brute(rows, 5)


def test_nulls_repeats_and_large_numbers(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (1, [0.5, None]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (None, [9.0, 9.0]), (50, [-0.001, 0.999]), (7, [1e9, 1e9]), (100, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").where(topk.usable(F.col("embedding")))
    rows = df.select("vec_id", topk.scaled(F.col("embedding")).alias("v"), F.lit("x").alias("score"))
    got = found(topk.top_products(rows, F.col("vec_id") % 50 == 0))
    assert got[0] == [(1, 7, 256 * 256 * 10**9 * 3), (2, 5, 256 * 256 * 3), (3, 5, 256 * 256 * 3), (4, 50, -256 + 512 * 255), (5, 100, 0)]
    assert [i for _, i, _ in got[50]] == [7, 0, 5, 5, 100]
    assert [s for *_, s in got[100]] == [0] * 5


def test_every_repeated_row_is_a_candidate(spark):
    rows = [(i % 40 + 1, [i % 40, 3]) for i in range(400)] + [(50, [2, 1]), (50, [2, 1])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    got = topk.top_products(df, F.col("vec_id") % 50 == 0, k=25, bucket_rows=16)
    assert found(got)[50] == [(n + 1, 40 - n // 10, 2 * (39 - n // 10) + 3) for n in range(25)]


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, v array<long>")
    assert found(topk.top_products(none, F.col("vec_id") % 50 == 0)) == {}
    one = spark.createDataFrame([(50, [1])], "vec_id long, v array<long>")
    assert found(topk.top_products(one, F.col("vec_id") % 50 == 0)) == {}


def test_plan_does_not_grow_with_the_buckets(spark):
    """What the driver holds of a plan is the same for two groups of similar length and for very many."""

    def size(n):
        df = spark.range(n).select(F.col("id").alias("vec_id"), F.array("id", F.lit(1).cast("long")).alias("v"))
        found = topk.top_products(df, F.col("vec_id") % 50 == 0, bucket_rows=8)
        return len(found._jdf.queryExecution().analyzed().toJSON())

    assert size(1600) < 1.1 * size(16)


def test_each_block_meets_each_bucket_once(spark):
    """A bucket travels once per group of blocks, a block once per stretch of buckets; the grid keeps to the limits of a task."""
    for groups, stretches in ((1, 1), (3, 1), (2, 5)):
        sides = [[(i << 32 | j, 1.0, 1, 1, 1, (first + 3 * i + j).to_bytes(8, "little"), b"\1", topk._LEAST.to_bytes(8, "little", signed=True)) for i in range(4) for j in range(3)] for first in (1, 21)]
        packs = [spark.createDataFrame(side, topk._PACK) for side in sides]
        rows = topk._meet(packs[0], packs[1], 99, groups, stretches).collect()
        assert sorted((r["query_id"], r["vec_id"]) for r in rows) == sorted((q, v) for q in range(1, 13) for v in range(21, 33))
    assert topk._grid(1 << 27, 50 << 27, 50 << 21, 2048, 10**5, 600)[0] >= (1 << 27) // topk.SLOT_CELLS
    for blocks, buckets in ((1, 1), (5, 1), (1, 7), (300, 4000)):
        groups, stretches = topk._grid(blocks * 65536, buckets * 262144, buckets * 4096, blocks, buckets, 12)
        assert 1 <= groups <= blocks and 1 <= stretches <= buckets and groups * stretches <= 12


@pytest.mark.parametrize("scale", [1, 1 << 12, 1 << 29])
def test_bucket_and_block_against_all_products(scale):
    """Near copies (few vectors can serve), even directions and zeros, in 32 and 64 bits and beyond."""
    rng = np.random.default_rng(scale)
    vectors = (rng.standard_normal((1500, 8)) * rng.choice([30, 90], (1500, 1))).astype(np.int64) * scale
    vectors[200:260] = vectors[100] + rng.integers(-2, 3, (60, 8))
    vectors[300] = 0
    ids = rng.integers(0, 1400, 1500)
    asked = np.r_[100:104, 200:204, 300, 700:720]
    k, exact = 4, vectors[asked].astype(object) @ vectors.astype(object).T
    block = topk.Block(ids[asked], vectors[asked], np.full(len(asked), topk._LEAST), k)
    decided = []
    by_coordinate = topk.Bucket.by_coordinate
    for part in np.array_split(np.argsort(-topk._sizes(vectors), kind="stable"), 3):
        bucket = topk.Bucket(ids[part], vectors[part])
        bucket.by_coordinate = lambda *a, b=bucket: decided.append(len(x := by_coordinate(b, *a))) or x
        bucket.meet(block)
    assert sum(decided) or scale == 1 << 29  # there all floors are the largest number
    for i, q in enumerate(asked):
        want = sorted((-min(max(p, -(1 << 63)), (1 << 63) - 1), v) for p, v in zip(exact[i], ids, strict=True) if v != ids[q])[:k]
        assert [(-int(s), v) for s, v in zip(block.scores[i], block.found[i], strict=True)] == want


def test_vectors_without_numbers(spark):
    df = spark.createDataFrame([(50, []), (1, []), (2, [])], "vec_id long, v array<long>")
    assert found(topk.top_products(df, F.col("vec_id") % 50 == 0)) == {50: [(1, 1, 0), (2, 2, 0)]}
