"""Toxicity: accuracy on documents whose labels were never read, label model, edge cases."""

import random
import zlib

import numpy as np
from kinfold.llm import toxicity
from pyspark.sql import functions as F


def corpus(n, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    bad = ["zubrick", "Fragnot", "mellow"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.15
        for _ in range(rng.randint(1, 4) if toxic else 0):
            # Two known words and one beginning with ever new endings.
            words.insert(rng.randrange(len(words)), rng.choice([bad[0], bad[1], "quark" + rng.choice(plain)]))
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(2500)
    d = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(4)
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["row"]["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    truth = dict(labels)
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == bool(truth[i]) for i in held)
    assert len(got) == 2500 and len(held) > 400
    assert right >= 0.98 * len(held)
    marked = {r["doc_id"] for r in d.where(toxicity.held_out(F.col("doc_id"))).select("doc_id").collect()}
    assert marked == set(held)


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus(600, seed=3)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (toxicity.fit(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a.voters == b.voters
    assert np.allclose(a.weights, b.weights)


def test_correlated_voters_speak_as_one():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    votes = np.stack([np.where(y, rng.random(4000) < 0.7, rng.random(4000) < 0.05) for _ in range(3)], axis=1).astype(float)
    annotation = np.where(rng.random(4000) < 0.1, ~y, y).astype(float)
    posterior = toxicity.label_model(votes, annotation)
    doubled = toxicity.label_model(np.hstack([votes, votes[:, :1], votes[:, :1]]), annotation)
    assert np.abs(posterior - doubled).mean() < 0.02
    # Votes correct the annotation's errors.
    assert ((posterior > 0.5) == y).mean() > 0.93 > 0.92 > ((annotation > 0.5) == y).mean()


def test_edge_cases(spark):
    schema, lab = "doc_id long, text string", "doc_id long, toxic int"
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, ""), (3, "w" * 200_000)], schema)
    none = toxicity.fit(docs, spark.createDataFrame([], lab))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    ones = toxicity.fit(docs, spark.createDataFrame([(i, 1) for i in range(9)], lab))
    assert {round(r["score"]) for r in toxicity.score(docs, ones).collect()} == {1}
    odd = toxicity.fit(docs, spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (3, 0)], lab))
    got = toxicity.score(docs, odd).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(spark.createDataFrame([], schema), odd).count() == 0


def test_no_voter_is_dropped(spark):
    """200 terms that only toxic documents have: each becomes a voter of its own."""
    rng = random.Random(4)
    bad = [f"{''.join(rng.choice('bcdfg') for _ in range(9))}{i}" for i in range(200)]
    docs = [(i, " ".join(["plain", "words", *rng.sample(bad, 12)]) if i % 4 == 0 else "plain words only") for i in range(1600)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    model = toxicity.fit(d, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs], "doc_id long, toxic int"))
    known = {v.decode() for v in model.voters}
    assert len(model.voters) > 128
    assert all(b in known or any(b[:n] + "*" in known for n in toxicity.BEGINNINGS) for b in bad)


def test_a_labelled_id_of_very_many_rows_is_bounded(spark):
    docs = [(7, f"text {i} bad") for i in range(500)] + [(i, "fine") for i in range(100, 160)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(7, 1)] + [(i, 0) for i in range(100, 160)], "doc_id long, toxic int")
    assert toxicity.examples(d, labels, 100).count() == 100
    assert toxicity.score(d, toxicity.fit(d, labels, max_rows=100)).count() == 560
