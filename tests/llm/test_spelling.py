import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kinfold.llm import spelling
from kinfold.llm.queries import op12_spelling_groups

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_counts(rows, least_letters=6, least_count=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}


def brute_groups(counts, ratio=5):
    out, form = {}, {}
    for w, n in counts.items():
        others = [o for o in counts if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [w, form[w], None, n, len(others), counts[form[w]] if form[w] else None]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w][2] = root
    return sorted(map(tuple, out.values()), key=lambda r: r[0])


def groups(spark, counts, **options):
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    return sorted((tuple(r) for r in spelling.variant_groups(words, **options).select(*COLUMNS).collect()), key=lambda r: r[0])


def similar_words(seed, n, letters="abcé×", length=(3, 12)):
    rng = np.random.default_rng(seed)
    words = {"".join(rng.choice(list(letters), rng.integers(*length))) for _ in range(n)}
    return {w: int(5 ** rng.integers(0, 6) + rng.integers(0, 3)) for w in sorted(words)}


@pytest.mark.parametrize(("letters", "length"), [("abcé×", (3, 9)), ("ab", (3, 12)), ("aÀÿz", (1, 5))])
def test_groups_equal_brute_force(spark, letters, length):
    counts = similar_words(len(letters), 250, letters, length)
    assert groups(spark, counts) == brute_groups(counts)


def test_tiles_lose_and_double_nothing(spark):
    counts = similar_words(5, 300, "ab", (5, 10)) | {f"samehalf{a}{b}": 5 + i for i, (a, b) in enumerate((x, y) for x in "abcdefgh" for y in "abcdefgh")}
    assert groups(spark, counts, tile_words=7, bucket_words=16) == brute_groups(counts)


def test_half_that_very_many_words_share(spark):
    counts = {f"commonbegin{''.join('abcdefghij'[int(d)] for d in f'{i:04d}')}": i % 7 + 1 for i in range(600)}
    assert groups(spark, counts, tile_words=50) == brute_groups(counts)


def test_ties_chains_and_anagrams(spark):
    counts = {"letter": 5000, "lettex": 5000, "letteq": 1000, "lettq": 200, "lttq": 40, "retlet": 3, "tetler": 2, "elttre": 1}
    found = {r[0]: r for r in groups(spark, counts)}
    assert found["letteq"] == ("letteq", "letter", "letter", 1000, 3, 5000)  # of two equally frequent ones the first
    assert found["lttq"][1:3] == ("lettq", "letter")
    assert found["elttre"][1:5] == (None, "elttre", 1, 0)
    assert groups(spark, counts) == brute_groups(counts)


def test_very_long_words(spark):
    long = "ab" * 5000
    counts = {long: 100, long[:-1]: 20, "b" + long[1:]: 5, long + "é": 4, long[::-1]: 3}
    assert groups(spark, counts) == brute_groups(counts)


def test_words_of_texts(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["Spelling", "spélling", "VARIANT", "variants", "Èquelle", "abc", "group×ing", "x"]
    rows = [(i if i % 7 else None, " ".join(rng.choice(vocabulary, 40)) + ",1") for i in range(150)]
    rows += [(1, None), (2, ""), (3, "... 12"), (4, "spelling " * 50_000)] + rows[:5]
    df = spark.createDataFrame([(*r, "y", 3) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = {r["word"]: r["n"] for r in spelling.damaged_words(df).collect()}
    assert got == brute_counts(rows)
    assert any(w not in [re.sub("[A-Z]", lambda m: m[0].lower(), v) for v in vocabulary] for w in got)  # letters were lost


def test_empty_tables_and_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variant_groups(spelling.damaged_words(empty)).collect() == []
    assert groups(spark, {"single": 9}) == [("single", None, "single", 9, 0, None)]


def test_letter_counts_give_squared_distances():
    words = ["abcabc", "abcabd", "éa×zzz"]
    x = spelling.letter_counts(spelling._codes(words))
    want = [[sum((Counter(a)[c] - Counter(b)[c]) ** 2 for c in set(a + b)) for b in words] for a in words]
    squared = (x * x).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (x @ x.T)
    assert squared.tolist() == want


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in op12_spelling_groups(spark, sf_dir).select(*COLUMNS).collect()]
    assert sorted(got, key=lambda r: r[0]) == brute_groups(brute_counts(rows))
