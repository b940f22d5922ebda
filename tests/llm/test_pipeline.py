"""The pipeline's stages against direct versions of what each must keep."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from kinfold.llm.text import letter_words

BAD = ["zubrick", "fragnot"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    exam = [make(30) for _ in range(3)]
    docs, labels = [], []
    for i in range(700):
        words = make(rng.choice([8, 40, 90]))
        if i % 9 == 0:
            words[3:3] = [BAD[i % 2], BAD[0]]
        if i % 25 == 1:
            words = exam[i % 3] + words[:40]
        docs.append([i, " ".join(words), "en", rng.choice(["hot", "hot", "b", "c", None])])
        labels.append((i, 1, int(i % 9 == 0)))
    for i in range(60):  # copies and near copies of clean documents of 90 words
        base = docs[2 + 9 * (i % 5)][1].split()
        if i % 2 and len(base) > 60:
            base[30] = "changed"
        docs.append([1000 + i, " ".join(base), "en", "hot"])
    docs += [[2000, None, None, None], [2001, "", "en", "b"], [None, "one more text here now", "en", "c"]]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, " ".join(e)) for i, e in enumerate(exam)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_every_stage(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, {}
    before = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = [tuple(r) for r in docs.collect()]
        if name != "sharding":
            assert docs.columns == columns

    assert sorted(map(str, rows["toxicity"])) == sorted(str(r) for r in before if not set((r[1] or "").split()) & set(BAD))

    kept = rows["ngram_join"]
    assert set(kept) <= set(rows["toxicity"])
    sets = [(r, shingles(r[1])) for r in rows["toxicity"]]
    close = lambda a, b: bool(a & b) and 100 * len(a & b) >= 80 * len(a | b)
    for i, (r, s) in enumerate(sets):
        linked = [q for j, (q, t) in enumerate(sets) if i != j and close(s, t)]
        if not linked:
            assert r in kept
    chosen = [shingles(r[1]) for r in kept]
    assert not any(close(a, b) for i, a in enumerate(chosen) for b in chosen[:i])

    exam = [letter_words(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(e[i : i + 13]) for e in exam for i in range(len(e) - 12)}

    def contaminated(text):
        w, hit = letter_words(text), set()
        for i in range(len(w) - 12):
            if tuple(w[i : i + 13]) in windows:
                hit.update(range(i, i + 13))
        return len(hit) * 20 >= len(w) and len(hit) > 0

    assert sorted(map(str, rows["decontamination"])) == sorted(str(r) for r in kept if not contaminated(r[1]))

    size, took = Counter(), Counter()
    originals = {r[0]: r[1] or "" for r in rows["decontamination"]}
    for r in rows["decontamination"]:
        size[r[3]] += len((r[1] or "").split())
    for r in rows["mixing"]:
        took[r[3]] += len(r[1].split())
        assert r[4] == len(r[1])
        assert all(part in originals[r[0]] for part in r[1].split("\n"))
    assert abs(sum(took.values()) - sum(size.values())) <= 5
    assert all(took[s] <= 3 * size[s] for s in size)
    per_doc = Counter()
    for r in rows["mixing"]:
        per_doc[r[0]] += len(r[1].split())
    assert all(n <= 3 * len(originals[d].split()) for d, n in per_doc.items())

    assert sorted(str(r[:-2]) for r in rows["sharding"]) == sorted(map(str, rows["mixing"]))
    loads = Counter()
    for r in rows["sharding"]:
        loads[r[-2]] += len(r[1].encode()) + 1
    assert max(loads.values()) <= 1.2 * min(loads.values())
    whole = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(map(str, whole)) == sorted(map(str, rows["sharding"]))


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_guard_is_in_the_entry_alone():
    source = open(corpus_pipeline.__file__).read()
    assert not re.search(r"except\s+ImportError|find_spec", source)
