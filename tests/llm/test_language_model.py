"""Language model against a direct computation from dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from kinfold.llm import language_model as lm
from pyspark.sql import functions as F

BEGIN = ("<begin>",)


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "<end>"]


def direct(rows, order, strength):
    train = [t for i, t in rows if zlib.crc32(str(i if i is not None else "").encode()) % 5 != 1]
    grams = Counter()
    for t in train:
        seq = [*BEGIN, *tokens(t)]
        for k in range(1, order + 1):
            grams.update(tuple(seq[i - k + 1 : i + 1]) for i in range(k - 1, len(seq)) if not (k == 1 and i == 0))
    grams[BEGIN] = len(train)
    words = {g: c for g, c in grams.items() if len(g) == 1 and g != BEGIN}
    n, v = sum(words.values()), len(words)

    def probability(context, w):
        if not context:
            return (grams[(w,)] + 0.5) / (n + 0.5 * (v + 1))
        lower = probability(context[1:], w)
        c = grams[context]
        return (grams[(*context, w)] + strength * lower) / (c + strength) if c else lower

    out = []
    for i, t in rows:
        seq = [*BEGIN, *tokens(t)]
        score = sum(math.log10(probability(tuple(seq[max(0, p - order + 1) : p]), seq[p])) for p in range(1, len(seq)))
        base = sum(math.log10(probability((), w)) for w in seq[1:])
        out.append((i, len(seq) - 1, sum(grams[(w,)] > 0 for w in seq[1:]), n, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_direct_computation(spark, order):
    rng = random.Random(order)
    vocab = ["The", "cat", "sät", "on", "a", "mat", "x1", "ÉTÉ"]
    make = lambda: rng.choice(["", " "]) + rng.choice([" ", "\n", "\t"]).join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 9, 30])))
    rows = [(i, make()) for i in range(120)] + [(None, "cat cat"), (7, None), (8, ""), (9, "the cat"), (9, "the cat"), (11, "new words only\x0bnow")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(4)
    got = lm.score_texts(docs, lm.in_training(F.col("doc_id")), order=order, strength=3.0, keep=("doc_id", "text"), block_bytes=900, bucket_bytes=500)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[5], 6))
    found = sorted(((r["row"]["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got.collect()), key=key)
    want = sorted(direct(rows, order, 3.0), key=key)
    assert len(found) == len(want)
    for f, w in zip(found, want, strict=True):
        assert f[:4] == w[:4]
        assert f[4] == pytest.approx(w[4], abs=1e-9) and f[5] == pytest.approx(w[5], abs=1e-9)


def test_copies_of_training_texts_score_better_than_the_base(spark):
    rng = random.Random(9)
    body = " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400))
    train, held = ([i for i in range(200) if (zlib.crc32(str(i).encode()) % 5 != 1) == want][:5] for want in (True, False))
    docs = spark.createDataFrame([(i, body) for i in train + held], "doc_id long, text string")
    for r in lm.score_texts(docs, lm.in_training(F.col("doc_id"))).collect():
        assert r["score"] > r["base_score"] + 50


def test_without_training_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for r in lm.score_texts(docs, F.lit(False)).collect():
        assert r["train_tokens"] == r["n_known"] == 0
        assert r["score"] == r["base_score"] == 0.0
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string"), F.lit(True)).count() == 0


def test_one_long_text(spark):
    docs = spark.createDataFrame([(1, "ab cd " * 400_000)], "doc_id long, text string")
    r = lm.score_texts(docs, F.lit(True)).first()
    assert r["n_tokens"] == r["n_known"] == r["train_tokens"] == 800_001
    assert r["score"] > r["base_score"]
