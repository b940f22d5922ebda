"""N-gram Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest
from kinfold.llm import graph, ngram_join


def shingles(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def direct(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[root(i)] = min(first.get(root(i), d), d)
    return sorted((d is None, d or 0, len(sets[i]), first.get(root(i))) for i, (d, _) in enumerate(rows))


def near(rng, words, vocab, changes):
    words = list(words)
    for _ in range(changes):
        at = rng.randrange(len(words))
        words[at : at + rng.choice([0, 1])] = [rng.choice(vocab)] if rng.random() < 0.7 else []
        words = words or ["w"]
    return words


@pytest.mark.parametrize(("width", "percent", "tile_sets"), [(4, 85, 512), (4, 85, 5), (5, 80, 16), (2, 50, 7)])
def test_against_all_pairs(spark, width, percent, tile_sets):
    rng = random.Random(width * percent + tile_sets)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 5, 8, 60, 150]))]
        if rng.random() < 0.5:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(rng.choice([1, 2, 6])):
            rows.append((len(rows), " ".join(near(rng, base, vocab, rng.choice([0, 1, 2, 4])))))
    hub = [rng.choice(vocab) for _ in range(100)]
    for _ in range(60):  # one large group of near copies, far more pairs than links
        rows.append((len(rows), "\t".join(near(rng, hub, vocab, rng.choice([1, 2, 3, 5])))))
    rows += [(len(rows) + k, rows[3][1].upper()) for k in range(30)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, None), (None, rows[0][1]), (None, "alone here now ok yes"), (5, rows[5][1]), (2000, "y " * 30_000), (1999, "y " * 30_001)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, n int, component_id string").repartition(4)
    got = ngram_join.similar_groups(docs, width, percent, keep=("doc_id", "text", "n", "component_id"), block_bytes=4000, bucket_bytes=2000, tile_sets=tile_sets)
    found = sorted((r["row"]["doc_id"] is None, r["row"]["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got.collect())
    key = lambda t: (t[0], t[1], t[2], t[3] if t[3] is not None else -1)
    assert sorted(found, key=key) == sorted(direct(rows, width, percent), key=key)


def test_bitmaps_never_hide_a_pair():
    rng = np.random.default_rng(1)
    for _ in range(30):
        pool = np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))
        sets = [np.sort(rng.choice(pool[:60], rng.integers(40, 60), replace=False)) for _ in range(40)]
        sizes = np.array([len(s) + int(rng.integers(0, 4)) for s in sets])
        links = ngram_join.tile_links(list(range(40)), sizes, sets, np.zeros(40), 80)
        forest = ngram_join._Forest()
        for a, b in links:
            forest.join(a, b)
        for i in range(40):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 100 * common >= 80 * (sizes[i] + sizes[j] - common):
                    assert forest.root(i) == forest.root(j)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(400)] + [(5000 + rng.randrange(80), 5000 + rng.randrange(80)) for _ in range(60)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_groups(none).count() == 0
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
