import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import bootstrap as B
from kinfold.operators.metrics import group_summary
from kinfold.sources.shared import settle


def bounds(df, classes, n_boot, seed, level, auc=True):
    found = B.intervals(B.bootstrap_replicates(df, classes, n_boot, seed, auc=auc))
    return {r["metric"]: (r["low"], r["high"]) for r in found.where(F.col("level") == level).collect()}


def method(df):
    return {r["method"] for r in B.bootstrap_method(df.select("isolate_id", "species").distinct()).collect()}


def generated(seed, sizes):
    """Rows (group, label, scores) for groups of given (label, number of rows)."""
    rng = random.Random(seed)
    out = []
    for i, (label, n) in enumerate(sizes):
        for _ in range(n):
            x = round(rng.random(), 4)
            out.append((f"{label}~{i}", label, x, round(1 - x, 4)))
    return out


@pytest.mark.parametrize("sizes", [[("p", 7), ("p", 1), ("p", 3), ("q", 12), ("q", 2)], [("p", 4), ("p", 9), ("q", 5)]])
def test_intervals_equal_resampled_row_lists(predictions, sizes):
    """Each replicate's rows are written out from the draws and scored one by one."""
    classes, n_boot, seed = ["q", "p"], 41, 17
    rows = generated(5, sizes)
    rows = [(g, t, b, a) for g, t, a, b in rows]
    df = predictions(rows, classes)
    draws = {r["isolate_id"]: list(r["draws"]) for r in B.group_draws(group_summary(df, classes), n_boot, seed).collect()}
    accuracy = []
    for b in range(n_boot):
        hits = [t == ("q" if q >= p else "p") for g, t, q, p in rows for _ in range(draws.get(g, []).count(b))]
        accuracy.append(sum(hits) / len(hits))
    got = bounds(df, classes, n_boot, seed, "image_level", auc=False)["accuracy"]
    assert got == pytest.approx(tuple(np.percentile(accuracy, [2.5, 97.5])))


def test_strata_need_two_groups_in_every_class(predictions):
    both = predictions(generated(1, [("p", 2), ("p", 2), ("q", 3), ("q", 1)]), ["p", "q"])
    lone = predictions(generated(1, [("p", 2), ("p", 2), ("p", 3), ("q", 9)]), ["p", "q"])
    assert method(both) == {"isolates within class"}
    assert method(lone) == {"isolates"}
    # In one stratum a replicate may miss the lone class, so its group is not frozen.
    drawn = {r["isolate_id"]: list(r["draws"]) for r in B.group_draws(group_summary(lone, ["p", "q"]), 60, 3).collect()}
    assert len({drawn["q~3"].count(b) for b in range(60)}) > 1


def test_no_errors_no_width(predictions):
    rows = [(f"{t}{i}", t, (x := 0.9 - 0.05 * i if t == "p" else 0.01 * i), 1 - x) for t in "pq" for i in range(6) for _ in range(1 + i % 3)]
    got = bounds(predictions(rows, ["p", "q"]), ["p", "q"], 30, 9, "isolate_level")
    assert got["accuracy"] == (1.0, 1.0) and got["macro_auc"] == (1.0, 1.0)


def test_draws_fill_every_stratum(spark):
    groups = spark.range(60).select(
        F.concat(F.lit("g"), F.col("id")).alias("isolate_id"), F.when(F.col("id") < 20, "a").otherwise("b").alias("species")
    )
    draws = B.group_draws(groups, 30, 7)
    per_replicate = draws.join(groups, "isolate_id").select("species", F.explode("draws").alias("b")).groupBy("b", "species").count()
    assert {(r["species"], r["count"]) for r in per_replicate.collect()} == {("a", 20), ("b", 40)}
    assert per_replicate.count() == 60
    one, two = (B.draw_counts(B.group_draws(groups.repartition(n), 30, 7)) for n in (1, 17))
    assert one.exceptAll(two).count() == 0
    assert one.agg(F.sum("m")).first()[0] == 30 * 60


def brute_force(rows, draws, n_boot, k):
    """AUC of class index k per replicate by counting all pairs of a repeated row list."""
    out = []
    for b in range(n_boot):
        sample = [r for r in rows for _ in range(draws.get(r[0], []).count(b))]
        pos = np.array([r[2 + k] for r in sample if r[1] == "abc"[k]])
        neg = np.array([r[2 + k] for r in sample if r[1] != "abc"[k]])
        if len(pos) == 0 or len(neg) == 0 or np.isnan(pos).any() or np.isnan(neg).any():
            out.append(None)
            continue
        diff = pos[:, None] - neg[None, :]
        out.append(float(((diff > 0) + 0.5 * (diff == 0)).mean()))
    return out


# 10 weights: cells of one row, so that groups with one score are parted.
@pytest.mark.parametrize("cell_weights, nan", [(10, False), (10, True), (20_000_000, False), (500, True)])
def test_replicate_auc_equals_pair_counting(predictions, cell_weights, nan):
    classes, n_boot = ["a", "b", "c"], 12
    rows = []
    for i in range(150):
        g = i % 11
        scores = [round(abs(math.sin(i * (k + 1) * 1.7)), 1 if k == 0 else 6) for k in range(3)]
        if nan and i == 5:
            scores[1] = float("nan")
        rows.append((f"g{g}", "abc"[g % 3], *scores))
    df = predictions(rows, classes)
    summary = settle(group_summary(df, classes))
    draws = {r["isolate_id"]: list(r["draws"]) for r in B.group_draws(summary, n_boot, 3).collect()}
    areas = B.replicate_auc(df, B.with_draws(summary, n_boot, 3), n_boot, classes, cell_weights=cell_weights).where("level = 'image_level'")
    got = {(r["b"], r["k"]): r["auc"] for r in areas.collect()}
    for k in range(3):
        assert [got.get((b, k)) for b in range(n_boot)] == [
            None if v is None else pytest.approx(v) for v in brute_force(rows, draws, n_boot, k)
        ]


def test_ties_across_chunks(monkeypatch):
    """One score shared by most rows, cut by the chunk size of the kernel."""
    monkeypatch.setattr(B, "_CHUNK_ROWS", 4)
    n = 30
    score = np.array([0.1] * 5 + [0.5] * 20 + [0.9] * 5)
    positive = np.array([i % 3 == 0 for i in range(n)])
    count = np.array([1 + i % 2 for i in range(n)])
    weights = np.array([[2, 1], [0, 1], [1, 0]], np.uint8)
    rows = np.arange(n) % 3
    u, p, q = B._won(score, positive, count, rows, weights)
    for b in range(2):
        items = list(zip(score, positive, count * weights[rows, b], strict=True))
        assert u[b] == sum(wp * wn * ((x > y) + 0.5 * (x == y)) for x, tp, wp in items if tp for y, tq, wn in items if not tq)
        assert p[b] == sum(w for _, t, w in items if t) and q[b] == sum(w for _, t, w in items if not t)


def test_draws_are_packed_without_loss(spark):
    lists = [[0, 0, 3], [], [2] * 300, [1]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, draws array<int>").repartition(2)
    got = {r["i"]: bytes(r["w"]) for r in df.select("i", B.packed(F.col("draws"), 4).alias("w")).collect()}
    assert B.unpacked([got[i] for i in range(4)], 4).tolist() == [[x.count(b) for b in range(4)] for x in lists]
    assert len(got[0]) == 4 and B.unpacked([got[0], got[3]], 4).dtype == np.uint8


def test_null_groups_are_drawn(spark):
    """A NULL group is a group like any other, in the cells and in the areas."""
    rows = [(f"i{i}", "a" if i % 3 else "b", None if i % 4 == 0 else f"g{i % 3}", i / 20, 1 - i / 20) for i in range(20)]
    df = spark.createDataFrame(rows, "image_path string, species string, isolate_id string, prob_a double, prob_b double")
    reps = B.bootstrap_replicates(df, ["a", "b"], 25, 5).where("level = 'isolate_level'").collect()
    assert {r["n"] for r in reps} == {4} and len(reps) == 25


# One replicate a block and as many stretches as tasks: edges, blocks and classes meet everywhere.
@pytest.mark.parametrize(("cell_weights", "block_weights"), [(10, 1), (300, 60), (20_000_000, 30)])
def test_blocks_of_replicates_equal_pair_counting(predictions, monkeypatch, cell_weights, block_weights):
    monkeypatch.setattr(B, "SORTED_ROWS", 40)
    monkeypatch.setattr(B, "_CHUNK_ROWS", 3)
    classes, n_boot, rng = ["a", "b", "c"], 7, random.Random(8)
    rows = [(f"g{i % 13}", "abc"[i % 13 % 3], *(rng.choice([0.1, 0.5, 0.5, round(rng.random(), 3)]) for _ in range(3))) for i in range(200)]
    df = predictions(rows, classes)
    summary = settle(group_summary(df, classes))
    draws = {r["isolate_id"]: list(r["draws"]) for r in B.group_draws(summary, n_boot, 3).collect()}
    drawn = B.with_draws(summary, n_boot, 3)
    found = B.replicate_auc(df, drawn, n_boot, classes, cell_weights=cell_weights, block_weights=block_weights).where("level = 'image_level'").collect()
    assert len(found) == 3 * n_boot
    got = {(r["b"], r["k"]): r["auc"] for r in found}
    for k in range(3):
        assert [got.get((b, k)) for b in range(n_boot)] == [None if v is None else pytest.approx(v) for v in brute_force(rows, draws, n_boot, k)]


def test_weights_travel_once_a_stretch(predictions):
    """However many rows there are, a group's weights go into no more places than tasks run at a time."""
    rows = [(f"g{i % 5}", "ab"[i % 5 % 2], i / 3000, 1 - i / 3000) for i in range(3000)]
    df = predictions(rows, ["a", "b"])
    spark, n_boot = df.sparkSession, 20
    drawn = B.with_draws(settle(group_summary(df, ["a", "b"])), n_boot, 3)
    areas = B.replicate_auc(df, drawn, n_boot, ["a", "b"], cell_weights=100)
    plan = areas._jdf.queryExecution().optimizedPlan().toString()
    # Stretches times blocks of replicates, of which there is one here.
    assert 1 < int(re.search(r"RepartitionByExpression \[.*slot.*\], (\d+)", plan)[1]) <= spark.sparkContext.defaultParallelism, plan
    assert "CoGroups" not in plan


def test_draws_are_dealt_over_more_tasks_the_more_there_are(spark, monkeypatch):
    monkeypatch.setattr(B, "TASK_DRAWS", 100)
    groups = settle(spark.range(40).select(F.concat(F.lit("g"), F.col("id")).alias("isolate_id"), F.lit("a").alias("species")))
    parts = B.draw_parts(groups, 30)
    assert parts == 12
    counts = B.draw_counts(B.group_draws(groups, 30, 7), parts=parts)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*), 12\), REPARTITION_BY_NUM", plan)
    # The slots, the draws by the group drawn, and the counts.
    assert sorted(re.sub(r"#\d+L?", "", d) for d in dealt) == ["b, isolate_id", "stratum, ordinal", "stratum, ordinal"]
    want = B.group_draws(groups, 30, 7).select("isolate_id", F.explode("draws").alias("b")).groupBy("b", "isolate_id").count()
    assert counts.exceptAll(want.select("b", "isolate_id", "count")).count() == 0 and counts.agg(F.sum("m")).first()[0] == 40 * 30
