import re
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from kinfold.llm import collocations
from kinfold.llm.queries import op13_collocations

SCHEMA = "lang string, text string"


def brute(rows, longest=3, support=10, inside=50, kept=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    found = defaultdict(list)
    often = [(lang, p, a) for (lang, p), a in f.items() if a >= support and len(p) > 1]
    longer = defaultdict(int)
    for lang, p, a in often:
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longer[lang, p[i : i + m]] = max(longer[lang, p[i : i + m]], a)
    for lang, p, a in often:
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, l, r = min(cuts)
        if 100 * longer[lang, p] < inside * a:
            found[lang].append((-score, -a, " ".join(p).encode(), l, r))
    out = []
    for lang, rows in found.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:kept], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def run(spark, rows, parts=3, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)
    return sorted(tuple(r) for r in collocations.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, n, size=60):
    rng = np.random.default_rng(seed)
    words = ["Sea", "sky", "är", "日本", "x-1", "A", "b", "the", "of"]
    blanks = [" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\x0b", "\r\n", "!", " ", "\x1f"]
    out = []
    for i in range(n):
        text = "".join(str(rng.choice(words)) + str(rng.choice(blanks)) for _ in range(rng.integers(0, size)))
        out.append((["en", "de", None, "und", ""][rng.integers(0, 5)], text))
    return out


@pytest.mark.parametrize(("longest", "support"), [(3, 10), (4, 3), (2, 5)])
def test_equals_brute_force(spark, longest, support):
    rows = [*texts(longest, 80), ("en", None), (None, ""), ("en", " . ,"), ("de", "one")]
    assert run(spark, rows, longest=longest, support=support) == brute(rows, longest, support)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = texts(9, 60)
    want = brute(rows, support=4)
    assert run(spark, rows, support=4) == want
    rows.append(("en", "sea sky the " * 30_000))  # a very long text beside small ones
    assert run(spark, rows, support=4) == brute(rows, support=4)


def test_overlapping_occurrences_count(spark):
    rows = [("en", "ha ha ha ha ha ha ha ha ha ha ha ha")]
    assert run(spark, rows) == brute(rows)
    assert ("en", 1, "ha ha ha", 10, 12, 11, 12, 757575) in run(spark, rows)


def test_ties_repeated_rows_and_limit(spark):
    rows = [("en", "a b. c d. e f. g h")] * 12 + [("de", "a b")] * 10
    found = run(spark, rows, kept=2)
    assert [r[:3] for r in found] == [("de", 1, "a b"), ("en", 1, "a b"), ("en", 2, "c d")]


def test_nothing_frequent_and_empty_tables(spark):
    assert run(spark, [("en", "a b c"), (None, None)]) == []
    assert run(spark, []) == []


def test_numbers_beyond_64_bits(spark):
    a = 3 * 10**11
    df = spark.range(1).selectExpr(f"{a}L + id AS a", f"{4 * 10**11 + 7}L AS l", f"{5 * 10**11 + 1}L AS r")
    got = df.select(collocations._share(df["a"], df["l"], df["r"])).first()[0]
    assert got == 10**6 * a * a // ((4 * 10**11 + 7) * (5 * 10**11 + 1))


def test_extra_columns_do_not_clash(spark):
    rows = [("en", "sea sky")] * 10
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA + ", n int, phrase string, name string")
    assert [tuple(r)[:3] for r in collocations.collocations(df).collect()] == [("en", 1, "sea sky")]


def test_packed_numbers_come_back():
    for numbers in ([], [0], [1, 255, 256], [2**40, 3]):
        assert collocations.unslim(collocations.slim(np.array(numbers, np.int64))).tolist() == numbers


def block_texts():
    """Some 6 MB: more than one small piece, a text beyond a piece, empty ones between."""
    rng = np.random.default_rng(5)
    words = np.array([f"{w}{end}" for w in ("Sea", "sky", "är", *range(40_000)) for end in (" ", ", ", "\n")])
    return ["".join(rng.choice(words, n)) for n in (300_000, 0, 1, 40_000, 90_000, 0, 200_000, 120_000, 150_000, 0)]


def test_small_pieces_of_a_block_give_the_whole_block():
    texts = block_texts()
    words, step, doc = collocations.block_words(pa.array(texts))
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    assert len(raw) > 5 << 20
    whole = collocations.word_places(raw, np.cumsum([0, *[len(t.encode()) for t in texts]]))
    assert words.cast(pa.large_string()).equals(whole[0].cast(pa.large_string()))
    assert np.array_equal(step, whole[1]) and np.array_equal(doc, whole[2])


def test_block_takes_memory_for_its_words_only(monkeypatch):
    texts = block_texts()
    monkeypatch.setattr(collocations, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    size = sum(len(t.encode()) for t in texts)
    tracemalloc.start()
    try:
        blocks = list(collocations._word_relation(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(blocks) == 1
    assert peak < 10 * size, f"{peak / size:.1f} bytes per byte of text"


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()]
    got = op13_collocations(spark, sf_dir).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
