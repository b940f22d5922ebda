"""Mixing: targets, exact words, disjoint draws, equal shards."""

import random
from collections import Counter, defaultdict

import numpy as np
from kinfold.llm import mixing


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, target string, draws string")
    return mixing.mix(mixing.sized(docs.repartition(4), keep=("doc_id", "text")), **options).collect()


def direct_targets(sizes):
    """Raise a common level until all words are given out; a capped source no longer rises."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, low, high = sum(sizes.values()), 0.0, 1e12
    for _ in range(300):
        level = (low + high) / 2
        given = sum(min(weight[s] * level, 3 * sizes[s]) for s in names)
        low, high = (level, high) if given < total else (low, level)
    return {s: min(weight[s] * low, 3 * sizes[s]) for s in names}


def check(out, n_shards, block_words):
    sizes, aims, took = Counter(), {}, Counter()
    shards = Counter()
    for r in out:
        n = len((r["row"]["text"] or "").encode().split())
        assert r["size"] == n
        sizes[r["source"]] += n
        aims[r["source"]] = r["target"]
        seen = defaultdict(int)
        for d in r["draws"]:
            assert 0 <= d["shard"] < n_shards
            assert 0 < d["words"] <= block_words
            assert 0 <= d["start"] and d["start"] + d["words"] <= n
            shards[d["shard"]] += d["words"]
            for w in range(d["start"], d["start"] + d["words"]):
                seen[(d["copy"], w)] += 1
        assert all(v == 1 for v in seen.values())
        total = sum(d["words"] for d in r["draws"])
        assert total <= 3 * n
        took[r["source"]] += total
    want = direct_targets(sizes)
    for s, size in sizes.items():
        assert abs(aims[s] - want[s]) <= 1e-6 * max(1, want[s])
        assert abs(took[s] - aims[s]) <= 0.5 + 1e-6
        assert next(r["source_size"] for r in out if r["source"] == s) == size
    return shards


def test_targets_and_exact_words(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        source = rng.choice(["hot"] * 6 + ["b", "ä", "z", None, "tiny"] if i % 40 else ["rare"])
        rows.append((i, source, "\t".join(["w"] * rng.choice([0, 1, 5, 60, 200])), None, None))
    rows += [(None, "b", None, None, None), (5, "b", "x y", None, None), (5, "b", "x y", None, None)]
    out = run(spark, rows, n_shards=4, block_words=16)
    assert len(out) == len(rows)
    shards = check(out, 4, 16)
    assert max(shards.values()) <= 1.1 * min(shards.values())
    again = run(spark, rows[::-1], n_shards=4, block_words=16)
    key = lambda r: (r["row"]["doc_id"] or -1, r["source"] or "", sorted(map(tuple, r["draws"])))
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_excess_is_shared_again_until_none_is_above(spark):
    rows = [(i, s, " ".join(["w"] * n), None, None) for i, (s, n) in enumerate([("a", 10), ("b", 500), ("c", 40), ("d", 3), ("e", 1000)])]
    out = run(spark, rows, n_shards=2, block_words=8)
    check(out, 2, 8)
    assert {r["source"]: r["target"] for r in out}["a"] == 30.0


def test_empty_and_wordless(spark):
    assert run(spark, []) == []
    out = run(spark, [(1, "a", "", None, None), (2, None, None, None, None)])
    assert [(r["size"], r["target"], r["draws"]) for r in out] == [(0, 0.0, [])] * 2


def test_split_is_exact():
    quotas = np.array([1000, 1, 0, 377, 5])
    cut = mixing.split_quotas(quotas, 7, seed=1)
    assert (cut.sum(axis=0) == quotas).all()
    assert cut.sum(axis=1).max() - cut.sum(axis=1).min() <= 3
    assert (cut >= 0).all()


def test_query_keeps_the_quotas_of_the_tree(spark, sf_dir):
    """Draws per shard of the registered result, and the same draws by the tree's quotas."""
    from kinfold.llm.queries import MIX_SHARDS, op2_mix, table

    rows = mixing.sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    drawn = defaultdict(set)
    words = Counter()
    for r in mixing.mix(rows, MIX_SHARDS).collect():
        for d in r["draws"]:
            drawn[d["shard"]].add((r["source"], d["order"]))
            words[r["row"]["doc_id"], d["shard"]] += d["words"]
    counts = [len(drawn[s]) for s in range(MIX_SHARDS)]
    assert max(counts) - min(counts) <= 4  # blocks per shard, as the tree splits them
    assert all(not (drawn[a] & drawn[b]) for a in range(MIX_SHARDS) for b in range(a))  # disjoint
    got = op2_mix(spark, sf_dir).collect()
    assert all(sum(r["shard_words"]) == r["taken"] for r in got)
    assert {(r["doc_id"], s): n for r in got for s, n in enumerate(r["shard_words"]) if n} == dict(words)


def test_mixed_documents_lie_by_shard_and_order(spark):
    rows = [(i, "ab"[i % 2], f"w{i} " * 40, None, None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, target string, draws string")
    mixed = mixing.mix(mixing.sized(docs, keep=("doc_id", "text")), n_shards=4, block_words=16)
    first = {}
    for r in mixed.collect():
        for d in r["draws"]:
            key = r["row"]["doc_id"], d["copy"]
            first[key] = min(first.get(key, (99, 0)), (d["shard"], d["order"]))
    laid = [r["doc_id"] for r in mixing.mixed_documents(mixed).collect()]
    assert laid == [i for i, _ in sorted(first, key=first.get)]


def test_a_very_long_text_is_mixed_whole(spark):
    rows = [(1, "a", "long " * 100_000, None, None), (2, "b", "x y z", None, None)]
    out = run(spark, rows, n_shards=4, block_words=1000)
    assert max(check(out, 4, 1000).values()) <= 40_000
