"""Histogram sort: balance, gapless slots, groups of equal texts."""

import zlib
from collections import defaultdict

from kinfold.llm import sharding
from pyspark.sql import functions as F


def sharded(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, size string").repartition(5)
    return sharding.shard_by_bytes(docs, keep=("doc_id", "text"), **options).collect()


def check(out, rows, n_shards):
    assert sorted((r["row"]["doc_id"] is None, r["row"]["doc_id"] or 0) for r in out) == sorted((r[0] is None, r[0] or 0) for r in rows)
    by = defaultdict(list)
    for r in out:
        body = (r["row"]["text"] or "").encode()
        assert r["size"] == len(body) + 1
        assert r["text_crc32"] == zlib.crc32(body)
        by[r["shard"]].append(r)
    assert set(by) <= set(range(n_shards))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return [sum(r["size"] for r in by[s]) for s in range(n_shards)]


def test_balance_and_groups(spark):
    rows = [(i, f"text {i * 7919 % 10007} " * (1 + i % 13), "x", "y") for i in range(4000)]
    rows += [(10_000 + i, f"copy {i % 40}", "x", "y") for i in range(400)]
    out = sharded(spark, rows)
    loads = check(out, rows, 8)
    assert max(loads) - min(loads) <= 0.02 * sum(loads) / 8 + 500
    places = defaultdict(set)
    for r in out:
        places[r["row"]["text"]].add(r["shard"])
    assert all(len(s) == 1 for s in places.values())


def test_a_group_with_a_third_of_all_bytes_is_cut(spark):
    rows = [(i, "the same text again", None, None) for i in range(1500)] + [(5000 + i, f"other text no {i:05d}", None, None) for i in range(2500)]
    out = sharded(spark, rows)
    loads = check(out, rows, 8)
    assert max(loads) <= 1.02 * min(loads)
    # Equal texts stand side by side: their slots in a shard have no gap.
    by = defaultdict(list)
    for r in out:
        if r["row"]["doc_id"] < 5000:
            by[r["shard"]].append(r["slot"])
    assert all(max(s) - min(s) == len(s) - 1 for s in by.values())


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, None, None, None), (None, "", None, None), (1, "a", None, None), (1, "a", None, None), (2, "é" * 50_000, None, None)]
    check(sharded(spark, rows), rows, 8)
    assert sharded(spark, []) == []
    check(sharded(spark, [(3, "only", "", "")]), [(3, "only", "", "")], 8)


def test_same_result_for_other_partitions(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 700).cast("string")).alias("text"))
    a = {r["row"]["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_by_bytes(docs.repartition(3)).collect()}
    b = {r["row"]["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_by_bytes(docs.repartition(7)).collect()}
    assert a == b
