"""Repeated bytes against a dictionary of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from kinfold.llm import repeats


def direct(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(rows, raws, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans, i = [], 0
        while i < len(r):
            j = i
            while j < len(r) and gone[j] == gone[i]:
                j += 1
            if gone[i]:
                spans.append((i, j))
            i = j
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((d is None, d or 0, len(r), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("hot", "kmer"), [(4096, 8), (2, 8), (4096, 12)])
def test_against_a_dictionary(spark, hot, kmer):
    rng = random.Random(hot + kmer)
    letters = "abcdé "
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage, other = make(90), make(35)
    rows = []
    for i in range(80):
        parts = [make(rng.choice([0, 3, 30, 120]))]
        if rng.random() < 0.4:
            cut = rng.randrange(60)
            parts.insert(rng.choice([0, 1]), passage[cut : cut + rng.choice([10, 25, 60, 90])])
        if rng.random() < 0.2:
            parts.append(other)
        rows.append((i, "".join(parts)))
    for i in range(30):  # near copies
        base = list(rows[2 * (i % 4)][1] or "zz")
        base[rng.randrange(len(base))] = "X"
        rows.append((100 + i, "".join(base)))
    rows += [(200 + i, rows[7][1]) for i in range(20)] + [(300, "ab" * 40), (301, "c" * 19), (302, "d" * 20), (303, "e" * 21), (304, None), (305, ""), (None, None), (306, "short"), (306, "short")]
    rows += [(400, "0123456789" * 2 + "unlike all others" + "0123456789" * 2)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, spans string").repartition(3)
    got = repeats.find_repeats(docs, length=20, kmer=kmer, keep=("doc_id", "spans"), block_bytes=700, bucket_bytes=500, hot=hot).collect()
    found = sorted((r["row"]["doc_id"] is None, r["row"]["doc_id"] or 0, r["n_bytes"], [tuple(s) for s in r["spans"]], r["kept_sha256"]) for r in got)
    assert found == direct(rows, 20)


def test_production_length_and_a_long_text(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = make(60)
    rows = [(i, make(200)) for i in range(6)] + [(10, make(50) + passage + make(50)), (11, passage + make(20)), (12, make(30_000) + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((False, r["row"]["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], r["kept_sha256"]) for r in repeats.find_repeats(docs).collect())
    assert got == direct(rows, 200)


def test_index_family_levels_grow_geometrically():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 3, 6000).astype(np.uint8)
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 7)).view("V7").ravel()
    family, again = repeats.IndexFamily(7), np.zeros(len(windows), bool)
    for at in range(0, len(windows), 500):
        again[family.add(windows[at : at + 500], np.arange(at, min(at + 500, len(windows))))] = True
        sizes = [len(s) for s, _ in family.levels]
        assert all(2 * b <= a for a, b in zip(sizes, sizes[1:], strict=False))
    seen = Counter(windows.tolist())
    assert again.tolist() == [seen[w] > 1 for w in windows.tolist()]


def test_passes_find_the_same(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = []
    for sender in range(9):
        regions = [rng.integers(97, 99, rng.integers(7, 20)).astype(np.uint8) for _ in range(30)]
        rows.append((sender, b"".join(x.tobytes() for x in regions), np.array([len(x) for x in regions], np.int32).tobytes()))
    table = pa.table({
        "bucket": pa.array([3] * 9, pa.int32()), "sender": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([repeats._REGIONS] * 9, pa.int32()),
        "data": pa.array([r[1] for r in rows], pa.binary()), "more": pa.array([r[2] for r in rows], pa.binary()),
    })
    one = repeats._match(table, 7).to_pydict()
    monkeypatch.setattr(repeats, "FAMILY_WINDOWS", 100)
    monkeypatch.setattr(repeats, "BATCH_WINDOWS", 16)
    assert repeats._match(table, 7).to_pydict() == one


def test_empty_table(spark):
    assert repeats.find_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
