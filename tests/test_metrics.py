import math
import random

import pytest
from pyspark.errors import PySparkException

from kinfold.operators import metrics as M
from kinfold.operators.auc import auc_one_vs_rest, ranked_pieces, score_ties


def generated(seed, n, classes, groups=9, missing=0.0):
    """Rows (group, label, scores): labels differ inside a group, some scores are missing."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        scores = [round(rng.random(), 3) for _ in classes]
        rows.append((f"u{rng.randrange(groups)}", rng.choice(classes), *[None if rng.random() < missing else x for x in scores]))
    return rows


def largest(scores):
    values = [math.nan if x is None else x for x in scores]
    return next((k for k, x in enumerate(values) if math.isnan(x)), None) if any(map(math.isnan, values)) else values.index(max(values))


def counted(pairs, k):
    """tp, fn, fp, tn of class k from (true, predicted) pairs, one by one."""
    kinds = [(t == k, p == k) for t, p in pairs]
    return tuple(kinds.count(kind) for kind in ((True, True), (True, False), (False, True), (False, False)))


def divided(x, y):
    return x / y if y else None


def direct(pairs, k):
    tp, fn, fp, tn = counted(pairs, k)
    return {
        "tp": tp, "fn": fn, "fp": fp, "tn": tn, "sensitivity": divided(tp, tp + fn), "specificity": divided(tn, tn + fp),
        "ppv": divided(tp, tp + fp) if tp + fp else (0.0 if tp + fn else None), "npv": divided(tn, tn + fn),
        "f1": divided(2 * tp, 2 * tp + fp + fn), "accuracy_ovr": divided(tp + tn, len(pairs)),
    }


def voted(rows, classes):
    """(label, predicted) of each group: the label of its first row, the largest mean of the scores that are there."""
    out = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        means = []
        for k in range(len(classes)):
            known = [r[2 + k] for r in own if r[2 + k] is not None]
            means.append(round(sum(known) / len(known), 12) if known else None)
        out[g] = (classes.index(own[0][1]), largest(means))
    return list(out.values())


@pytest.mark.parametrize(("seed", "classes", "missing"), [(1, ["w", "v", "x", "u"], 0.0), (2, ["z", "y"], 0.2), (3, ["k"], 0.0), (4, ["r", "p", "q"], 0.05)])
def test_both_levels_equal_a_direct_count(predictions, seed, classes, missing):
    rows = generated(seed, 140, classes, missing=missing)
    table = M.two_level_class_metrics(predictions(rows, classes, 5), classes).collect()
    by_row = [(classes.index(r[1]), largest(r[2:])) for r in rows]
    for level, pairs in (("image_level", by_row), ("isolate_level", voted(rows, classes))):
        for k, label in enumerate(classes):
            got = next(r for r in table if r["level"] == level and r["label"] == label)
            for name, value in direct(pairs, k).items():
                assert got[name] == (value if value is None else pytest.approx(value)), (level, label, name)


def test_macro_leaves_out_classes_without_support(predictions):
    classes = ["m", "n", "o", "never"]
    rows = [(g, t, *s, 0.0) for g, t, *s in generated(7, 60, classes[:3])]
    cells = M.confusion_cells(M.scored(predictions(rows, classes), classes))
    table = M.class_metrics(cells, classes)
    pairs = [(classes.index(r[1]), largest(r[2:])) for r in rows]
    macro = M.macro_metrics(table).first()
    assert macro["n"] == 60 and macro["accuracy"] == pytest.approx(sum(t == p for t, p in pairs) / 60)
    for name in ("sensitivity", "specificity", "ppv", "npv", "f1"):
        values = [v for k in range(3) if (v := direct(pairs, k)[name]) is not None]
        assert macro[f"macro_{name}"] == pytest.approx(sum(values) / len(values))
    assert [r["label"] for r in M.classes_without_support(table, classes).collect()] == ["never"]
    dense = {(r["true_k"], r["pred_k"]): r["n"] for r in M.dense_confusion(cells, classes).collect()}
    assert dense == {(t, p): pairs.count((t, p)) for t in range(4) for p in range(4)}


def auc_rows(spark, rows, **options):
    df = spark.createDataFrame([(t, [s]) for t, s in rows], "true_k int, scores array<double>")
    return auc_one_vs_rest(score_ties(df), **options).first()["auc"]


@pytest.mark.parametrize("seed", range(4))
def test_auc_equals_counted_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(2), rng.choice([0.0, 1.0, round(rng.random(), 1 + seed)])) for _ in range(50 + 40 * seed)]
    high, low = [s for t, s in rows if t == 0], [s for t, s in rows if t]
    won = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in high for q in low)
    assert auc_rows(spark, rows) == pytest.approx(won / (len(high) * len(low)))
    assert auc_rows(spark, [(0, s) for s in high]) is None


def test_auc_is_undefined_with_nan_scores(spark):
    assert auc_rows(spark, [(0, 0.5), (1, float("nan")), (1, 0.2)]) is None


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_auc_equals_pair_counting_for_any_number_of_parts(spark, parts):
    scores = [round(math.sin(i * 12.9898) % 1, 2) for i in range(400)] + [-3.0, 0.0, 1.0, 1.0, 7.5, 1e-300]
    rows = [(i % 3 != 0, s) for i, s in enumerate(scores)]
    pos, neg = [s for t, s in rows if not t], [s for t, s in rows if t]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert auc_rows(spark, [(int(t), s) for t, s in rows]) == pytest.approx(pairs)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_pieces_are_even_and_in_score_order_when_scores_are_concentrated(spark):
    close = [0.5 + i * 1e-13 for i in range(5000)] + [0.9999, 0.0]
    df = spark.createDataFrame([(key, s, i % 2, 1 - i % 2) for key in ("x", None) for i, s in enumerate(close)], "key string, score double, p int, q int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = ranked_pieces(df, ["key"]).orderBy("key", "low").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for key in ("x", None):
        own = [r for r in rows if r["key"] == key]
        assert sum(r["p"] + r["q"] for r in own) == len(close) and len(own) > 2
        assert max(r["p"] + r["q"] for r in own) <= 2 * 2 * len(close) / 8
        assert all(a["high"] < b["low"] for a, b in zip(own, own[1:]))


def test_first_maximum_wins_and_nan_counts_as_maximum(predictions):
    classes = ["a", "b", "c"]
    rows = [("g", "a", 0.4, 0.4, 0.2), ("g", "a", 0.1, float("nan"), 0.9), ("g", "a", 0.1, None, 0.9)]
    got = M.scored(predictions(rows, classes, 1), classes, keep=["image_path"]).orderBy("image_path").collect()
    assert [r["pred_k"] for r in got] == [0, 1, 1]


def test_unknown_label_fails_the_query(predictions):
    df = predictions([("g", "nope", 0.5, 0.5)], ["a", "b"])
    with pytest.raises(PySparkException, match="nope"):
        M.confusion_cells(M.scored(df, ["a", "b"])).collect()


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_results_do_not_depend_on_partitions(predictions, parts):
    classes = ["a", "b"]
    rows = [(f"g{i % 7}", "ab"[i % 7 % 2], (i * 37 % 100) / 100, 1 - (i * 37 % 100) / 100) for i in range(200)]
    table = M.two_level_class_metrics(predictions(rows, classes, parts), classes)
    got = [(r["level"], r["k"], r["tp"], round(r["auc"], 12)) for r in table.orderBy("level", "k").collect()]
    base = M.two_level_class_metrics(predictions(rows, classes, 3), classes)
    assert got == [(r["level"], r["k"], r["tp"], round(r["auc"], 12)) for r in base.orderBy("level", "k").collect()]
