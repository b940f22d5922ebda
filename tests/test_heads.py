import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import heads as H
from kinfold.operators.scoring import fit_head, score
from kinfold.plans import training, views
from kinfold.sources.models import load_heads, save_heads

CLASSES = ["a", "b", "c"]


def table(spark, n=90, groups=9, seed=0, folds=3):
    """Rows of three classes in groups of one class; the fold follows from the group."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, 4))
    rows = []
    for i in range(n):
        g = int(rng.integers(groups))
        k = g % 3
        x = (centres[k] + rng.normal(size=4)).tolist()
        rows.append((f"i{i:03d}", CLASSES[k], f"g{g}", x, f"fold{(g // 3) % folds}" if g < groups - 1 else None))
    return rows, spark.createDataFrame(rows, "image_path string, species string, isolate_id string, embedding array<double>, fold string").repartition(4)


def weight_of(rows, mode):
    """Row weights over the given rows, straight from their definitions."""
    out = []
    for _, label, group, *_ in rows:
        same = [r for r in rows if r[1] == label]
        out.append({
            "none": 1.0, "loss": len(rows) / (3 * len(same)), "sampler": 1 / (len({r[2] for r in same}) * sum(r[2] == group for r in rows)),
        }[mode])
    return np.array(out)


def gradient(rows, weights, mode, reg):
    """Of the whole objective at given weights (3 x 5), row by row."""
    w = weight_of(rows, mode)
    total = reg * weights
    for wi, r in zip(w / w.sum(), rows, strict=True):
        x = np.array([1.0, *r[3]])
        e = np.exp(weights @ x - (weights @ x).max())
        total = total + wi * np.outer(e / e.sum() - (np.array(CLASSES) == r[1]), x)
    return total


@pytest.mark.parametrize("mode", ["none", "loss", "sampler"])
def test_every_head_is_optimal_on_the_other_folds(spark, mode):
    rows, df = table(spark)
    found = H.fit_heads(df, CLASSES, ["fold0", "fold1", "fold2"], imbalance=mode, reg=0.1, max_iter=400, tolerance=1e-9)
    assert found.residual <= 1e-9
    for f, fold in enumerate(found.folds):
        others = [r for r in rows if r[4] != fold]
        assert len(others) < len(rows)
        assert np.abs(gradient(others, found.weights[f], mode, 0.1)).max() < 1e-8


def test_one_head_equals_a_fold_that_nothing_is_held_out_of(spark):
    rows, df = table(spark)
    alone = fit_head(df, CLASSES, reg=0.1, max_iter=400)
    assert np.abs(gradient(rows, alone.weights[0], "none", 0.1)).max() < 1e-7
    assert alone.folds == [H.ALL]


def test_history_has_loss_and_accuracy_of_every_step(spark):
    rows, df = table(spark)
    found = H.fit_heads(df, CLASSES, ["fold0", "fold1"], reg=0.05, max_iter=12, tolerance=0)
    assert [(h[0], h[1]) for h in found.history] == [(f, t) for t in range(13) for f in ("fold0", "fold1")]
    losses = [h[2] for h in found.history if h[0] == "fold1"]
    assert losses[0] == pytest.approx(np.log(3)) and losses[-1] < losses[0]
    others = [r for r in rows if r[4] != "fold1"]
    x = np.array([[1.0, *r[3]] for r in others])
    hits = np.mean((x @ found.weights[1].T).argmax(axis=1) == [CLASSES.index(r[1]) for r in others])
    assert found.history[-1][3] == pytest.approx(hits)


def test_jobs_do_not_grow_with_the_folds(spark):
    rows, df = table(spark, n=200, groups=41, folds=13)
    names = sorted({r[4] for r in rows if r[4]})
    tracker = spark.sparkContext.statusTracker()

    def jobs(folds):
        spark.sparkContext.setJobGroup(f"fit{len(folds)}", "")
        H.fit_heads(df, CLASSES, folds, reg=0.1, max_iter=3, tolerance=0)
        return len(tracker.getJobIdsForGroup(f"fit{len(folds)}"))

    few, many = jobs(names[:2]), jobs(names)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(names) == 13 and many == few


def test_leave_one_out_over_very_many_groups(spark):
    """1,000 heads in one fit; each row scored by the head that never saw its group."""
    rng = np.random.default_rng(1)
    rows = [(f"i{i}", CLASSES[i % 3], f"g{i:04d}", (np.eye(3)[i % 3] + rng.normal(size=3) / 2).tolist(), "microscopic") for i in range(1000)]
    df = spark.createDataFrame(rows, "image_path string, species string, isolate_id string, embedding array<double>, modality string")
    for c in ("view", "device", "source"):
        df = df.withColumn(c, F.lit("na"))
    run = training.cross_validate(df.withColumn("day", F.lit(None).cast("int")), CLASSES, "loio", imbalance="none", max_iter=10, reg=0.1)
    got = {r["image_path"]: r for r in run.predictions.collect()}
    assert len(got) == 1000 and len(run.heads.folds) == 1000
    f = run.heads.folds.index(got["i7"]["fold"])
    z = run.heads.weights[f] @ np.array([1.0, *rows[7][3]])
    p = np.exp(z - z.max())
    assert [got["i7"][f"prob_{c}"] for c in CLASSES] == pytest.approx((p / p.sum()).tolist())


def test_class_seen_by_no_other_fold_has_score_zero(spark):
    rows = [(f"i{i}", "ab"[i % 2] if i < 8 else "c", f"g{i}", [float(i % 2), float(i >= 8)], "x" if i >= 8 else "y") for i in range(10)]
    df = spark.createDataFrame(rows, "image_path string, species string, isolate_id string, embedding array<double>, fold string")
    found = H.fit_heads(df, CLASSES, ["x", "y"], reg=0.1, max_iter=20)
    assert found.present.tolist() == [[True, True, False], [False, False, True]]
    scored = H.score_heads(found, df, "fold").collect()
    assert all(r["scores"][2] == 0.0 for r in scored if r["fold"] == "x") and all(r["scores"] == [0.0, 0.0, 1.0] for r in scored if r["fold"] == "y")
    assert all(np.isfinite(h[2]) for h in found.history)


def test_heads_come_back_as_they_were(spark, tmp_path):
    _, df = table(spark)
    found = H.fit_heads(df, CLASSES, ["fold0", "fold1"], reg=0.1, max_iter=5)
    save_heads(spark, found, str(tmp_path / "heads"), "microscopic", "cmu")
    again, meta = load_heads(spark, str(tmp_path / "heads"))
    assert (again.weights == found.weights).all() and again.folds == found.folds and list(meta["classes"]) == CLASSES
    assert score(again.of("fold1"), df).select("scores").exceptAll(score(found.of("fold1"), df).select("scores")).count() == 0


def test_folds_without_training_rows_are_refused(spark):
    _, df = table(spark)
    with pytest.raises(ValueError, match="no training rows"):
        H.fit_heads(df.withColumn("fold", F.lit("only")), CLASSES, ["only"])


def test_whole_table_in_one_task_gives_the_same(spark, sf_dir):
    df = views.vectors(spark, sf_dir)
    one, many = (H.fit_heads(df.repartition(n), views.VECTOR_CLASSES, reg=0.1, max_iter=8).weights for n in (1, 16))
    assert np.abs(one - many).max() < 1e-12
