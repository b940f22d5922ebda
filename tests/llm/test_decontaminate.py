"""Decontamination against a direct window search."""

import hashlib
import random
import re

import pytest
from kinfold.llm import decontaminate as dc


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def direct(text, items, width):
    words, hit, named = words_of(text), set(), set()
    for item, body in items:
        own = words_of(body)
        for at in range(max(1, len(own) - width + 1) if own else 0):
            win = own[at : at + width]
            for i in range(len(words) - len(win) + 1):
                if words[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    if item is not None:
                        named.add(str(item))
    return len(words), len(hit), sorted(named)


@pytest.mark.parametrize(("shift_bits", "prefix_bits"), [(dc.SHIFT_BITS, dc.PREFIX_BITS), (16, 19)])
def test_random_texts(spark, shift_bits, prefix_bits):
    rng = random.Random(5)
    vocab = ["Alpha", "b", "çà", "d9", "e", "F"]
    make = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "\n"]) for _ in range(n))
    items = [(i, make(rng.choice([1, 2, 3, 5, 9]))) for i in range(6)] + [(1, make(4)), (None, make(3)), (9, None), (10, "..")]
    docs = [(i, make(rng.choice([0, 1, 2, 6, 30]))) for i in range(60)] + [(None, make(20)), (7, None), (7, None), (8, items[3][1])]
    got = dc.judged(
        dc.find_contamination(
            spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
            spark.createDataFrame(items, "item_id long, text string"), width=4, keep=("doc_id", "text"), shift_bits=shift_bits, prefix_bits=prefix_bits,
        )
    ).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, named = direct(r["row"]["text"], items, 4)
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, named)
        assert sum(s["last"] - s["first"] + 1 for s in r["hits"]) == hit
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_empty_tables_and_clashing_columns(spark):
    schema = "doc_id long, text string, hits string, n_words string, row int"
    docs = spark.createDataFrame([(1, "a b c", "x", "y", 3)], schema)
    none = spark.createDataFrame([], "item_id string, text string")
    kept = dc.find_contamination(docs, none, keep=docs.columns).select("row.*", dc.F.col("items").alias("found"))
    assert kept.collect()[0]["hits"] == "x"
    assert kept.collect()[0]["found"] == []
    assert dc.find_contamination(spark.createDataFrame([], schema), none).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_a_very_long_text_is_searched_to_its_end(spark):
    body = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, "pad " * 300_000 + body)], "doc_id long, text string")
    got = dc.find_contamination(docs, spark.createDataFrame([("q", body)], "item_id string, text string")).first()
    assert got["n_words"] == 300_013
    assert [tuple(s) for s in got["hits"]] == [(300_000, 300_012)]


def test_a_large_benchmark_stays_off_the_driver(spark):
    """What comes to the driver are the tables, of fixed size; every window is found, also where the tables are nearly full."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(400))) for i in range(100)]
    docs = [(i, " ".join([*(rng.choice(vocab) for _ in range(50)), *items[i][1].split()[7 : 7 + 13 + i % 3], *(rng.choice(vocab) for _ in range(9))])) for i in range(60)]
    patterns = dc.pattern_table(spark.createDataFrame(items, "item_id long, text string"))
    tables = dc.search_tables(patterns, 16, 19)
    assert patterns.count() > 30_000 and sum(len(t) for t in tables.shift.values()) + len(tables.seen) <= (1 << 16) + (1 << 16)
    got = dc.find_contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), shift_bits=16, prefix_bits=19,
    ).collect()
    for r in got:
        i = r["row"]["doc_id"]
        assert [tuple(s) for s in r["hits"]] == [(50, 62 + i % 3)] and r["items"] == [str(i)]
