"""The registered queries: one small function per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.fixed import CLASS_METRICS, INTERVAL_KEY
from kinfold.functions import pixels as px
from kinfold.functions.scores import argmax_index, class_at, label_index, ranked_scores, scores_from_columns, softmax
from kinfold.functions.text import value_with_interval
from kinfold.operators import bootstrap, manifest, metrics, report, review, scoring, splits, weights
from kinfold.operators.auc import auc_one_vs_rest, score_ties
from kinfold.plans import preparation, training, views
from kinfold.plans.views import EVENT_CLASSES, LINE_CLASSES, MIXED_CLASSES, ROOT, VECTOR_CLASSES
from kinfold.sources import images, tables
from kinfold.sources.models import load_heads, save_heads
from kinfold.sources.shared import settle, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEED = 42
#: Replicates of every query with intervals (the default).
N_BOOT = 1000
#: Fits whose results are compared: run to the optimum.
LOIO_REG = 0.5
CONVERGED = {"max_iter": 300, "reg": 0.1, "tolerance": 1e-11}
DECIMALS = 9


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Sums of doubles depend on their order: results are compared to nine decimals."""
    return df.withColumns({n: F.round(F.col(n), DECIMALS) for n in names})


def doubles(df: DataFrame) -> DataFrame:
    return rounded(df, *[n for n, t in df.dtypes if t == "double"])


def scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def clean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.clean(views.manifest_events(spark, sf_dir), ROOT)


# ---- metrics ---------------------------------------------------------------


@query
def confusion_matrix(spark, sf_dir):
    cells = metrics.confusion_cells(metrics.scored(views.pred_lineitem(spark, sf_dir), LINE_CLASSES))
    return metrics.dense_confusion(cells, LINE_CLASSES).select("true_label", "pred_label", "n")


@query
def confusion_matrix_vectors(spark, sf_dir):
    cells = metrics.confusion_cells(metrics.scored(views.pred_embeddings(spark, sf_dir), VECTOR_CLASSES))
    return metrics.dense_confusion(cells, VECTOR_CLASSES).select("true_label", "pred_label", "n")


@query
def per_class_metrics(spark, sf_dir):
    cells = metrics.confusion_cells(metrics.scored(views.pred_lineitem(spark, sf_dir), LINE_CLASSES))
    return doubles(metrics.with_labels(metrics.class_metrics(cells, LINE_CLASSES), LINE_CLASSES).drop("k"))


@query
def macro_metrics(spark, sf_dir):
    return doubles(metrics.macro_metrics(metrics.two_level_class_metrics(views.pred_lineitem(spark, sf_dir), LINE_CLASSES), ["level"]))


@query
def classes_without_support(spark, sf_dir):
    """A class list with a label that no row has."""
    rows = views.pred_lineitem(spark, sf_dir).withColumn("prob_X", F.lit(0.0))
    classes = [*LINE_CLASSES, "X"]
    cells = metrics.confusion_cells(metrics.scored(rows, classes))
    found = metrics.classes_without_support(metrics.class_metrics(cells, classes), classes)
    return found.select(F.col("k").cast("bigint").alias("k"), "label")


@query
def group_vote(spark, sf_dir):
    return doubles(metrics.group_vote(views.pred_lineitem(spark, sf_dir), LINE_CLASSES))


@query
def two_level_report(spark, sf_dir):
    table = metrics.two_level_class_metrics(views.pred_lineitem(spark, sf_dir), LINE_CLASSES)
    return doubles(table.drop("k"))


@query
def two_level_report_mixed(spark, sf_dir):
    """Groups with several labels, missing scores, classes not in alphabetical order."""
    return doubles(metrics.two_level_class_metrics(views.pred_mixed(spark, sf_dir), MIXED_CLASSES).drop("k"))


@query
def two_level_report_vectors(spark, sf_dir):
    return doubles(metrics.two_level_class_metrics(views.pred_embeddings(spark, sf_dir), VECTOR_CLASSES).drop("k"))


@query
def auc_ovr(spark, sf_dir):
    ties = score_ties(metrics.scored(views.pred_lineitem(spark, sf_dir), LINE_CLASSES))
    return doubles(metrics.with_labels(auc_one_vs_rest(ties), LINE_CLASSES).select("label", "auc", "positives", "negatives"))


@query
def auc_ovr_rounded(spark, sf_dir):
    """Scores rounded to three decimals: large tie groups."""
    ties = score_ties(metrics.scored(views.pred_lineitem(spark, sf_dir), LINE_CLASSES), decimals=3)
    return doubles(metrics.with_labels(auc_one_vs_rest(ties), LINE_CLASSES).select("label", "auc"))


# ---- manifest --------------------------------------------------------------


@query
def manifest_clean(spark, sf_dir):
    return clean_events(spark, sf_dir)


@query
def manifest_csv_roundtrip(spark, sf_dir):
    """The raw manifest written as CSV, read back as all-text rows and cleaned."""
    path = scratch(spark, "manifest")
    tables.write_csv(views.manifest_events(spark, sf_dir), path)
    raw, _ = tables.read_manifest_csv(spark, path)
    return manifest.clean(raw, ROOT)


@query
def quoted_line_breaks(spark, sf_dir):
    """Whole texts with line breaks, commas and quotes as CSV cells, read back by many tasks."""
    path = scratch(spark, "texts")
    texts = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("lang").alias("last"))
    tables.write_csv(texts, path)
    raw, _ = tables.read_manifest_csv(spark, path)
    return raw.select("doc_id", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"), "last")


@query
def manifest_load_into(spark, sf_dir):
    """Clean rows, validated while they are written, and read back."""
    raw = views.manifest_events(spark, sf_dir).withColumn("isolate_id", F.concat_ws("/", "isolate_id", "species"))
    raw = raw.withColumn("day", F.when(F.col("day").rlike(r"^\d+$"), F.col("day")).otherwise(F.lit("")))
    return manifest.load_into(raw, ROOT, scratch(spark, "clean"))


@query
def folder_listing(spark, sf_dir):
    """Files of a written folder tree, listed by tasks: one file in each of 40 folders."""
    path = scratch(spark, "tree")
    rows = views.table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("bucket"), "event_id")
    rows.repartition("bucket").write.partitionBy("bucket").parquet(path)
    found = tables.listing(spark, path, "*.parquet").select(F.regexp_extract("path", r"bucket=(\d+)/[^/]+$", 1).cast("bigint").alias("bucket"))
    return found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_files"))


@query
def run_config_file(spark, sf_dir):
    """The parameters of a run, with the class list of the data, written as JSON and read back."""
    path = scratch(spark, "config")
    rows = clean_events(spark, sf_dir)
    config = {"classes": manifest.resolve_classes(rows), "split": "kfold", "n_folds": 5, "items": rows.count(), "val_fraction": 0.2, "note": None}
    tables.write_run_config(spark, path, config)
    return spark.read.json(path).select(F.array_join("classes", ",").alias("classes"), "split", "n_folds", "items", "val_fraction")


@query
def review_sheet_file(spark, sf_dir):
    """The review sheet as the file that experts fill in, read back as text."""
    path = scratch(spark, "sheet")
    tables.write_review_sheet(QUERIES["review_sheet"](spark, sf_dir).coalesce(1), path)
    raw, _ = tables.read_manifest_csv(spark, path)
    return raw.select("image_path", "true_species", "predicted", F.col("probability").cast("double").alias("probability"), "panel", "notes")


@query
def manifest_relative_paths(spark, sf_dir):
    """A clean manifest written with paths relative to its folder."""
    path = scratch(spark, "manifest")
    tables.write_manifest_csv(clean_events(spark, sf_dir), path, ROOT)
    raw, _ = tables.read_manifest_csv(spark, path)
    return raw.select("image_path", "isolate_id", "day")


@query
def domain_violations(spark, sf_dir):
    """Checked against narrower domains than the data uses, so that there is something to find."""
    allowed = {"modality": ("microscopic",), "view": ("na", "obverse"), "device": ("unknown",), "source": ("cmu",)}
    found = manifest.row_violations(views.manifest_events(spark, sf_dir), ROOT, allowed, ())
    return found.select("rule", "column", "value", "n", F.array_join("examples", ",").alias("examples"))


@query
def blank_group_violations(spark, sf_dir):
    found = manifest.row_violations(views.manifest_events(spark, sf_dir), ROOT, {}, ("openfungi",))
    return found.select("rule", "column", "n", F.array_join("examples", ",").alias("examples"))


@query
def label_conflicts(spark, sf_dir):
    return manifest.label_conflicts(views.documents_manifest(spark, sf_dir))


@query
def manifest_violations(spark, sf_dir):
    """All rules over the document manifest: conflicting labels, and items missing from a listing."""
    raw = views.documents_manifest(spark, sf_dir)
    listing = views.labelled_documents(spark, sf_dir).select(F.concat(F.lit(f"{ROOT}/"), F.col("path")).alias("path"))
    found = manifest.violations(raw, ROOT, listing)
    return found.select("rule", "column", "value", "n", F.array_join("examples", ",").alias("examples"))


@query
def missing_items(spark, sf_dir):
    return manifest.missing_items(views.documents_manifest(spark, sf_dir), views.labelled_documents(spark, sf_dir))


@query
def day_coercion(spark, sf_dir):
    rows = clean_events(spark, sf_dir)
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query
def select_subset(spark, sf_dir):
    return manifest.select(clean_events(spark, sf_dir), "microscopic", "cmu").select("image_path", "isolate_id", "device")


@query
def select_while_reading(spark, sf_dir):
    """The same selection made on the raw manifest, before it is cleaned."""
    raw = views.manifest_events(spark, sf_dir)
    loaded = manifest.load(raw, ROOT, strict=False, modality="microscopic", source="cmu")
    return loaded.select("image_path", "isolate_id", "device")


@query
def class_check(spark, sf_dir):
    """Labels outside a class list, with their counts."""
    return manifest.unknown_labels(clean_events(spark, sf_dir), ["click", "view"])


@query
def class_list(spark, sf_dir):
    """The class list taken from the data: sorted distinct labels."""
    rows = clean_events(spark, sf_dir)
    classes = manifest.resolve_classes(rows)
    counts = weights.class_loss_weights(rows, classes)
    return counts.select(F.col("k").cast("bigint").alias("k"), "species", "n")


@query
def label_encoding(spark, sf_dir):
    rows = clean_events(spark, sf_dir)
    return rows.select("image_path", label_index(F.col("species"), EVENT_CLASSES).alias("k"))


@query
def dataset_summary(spark, sf_dir):
    return manifest.dataset_summary(clean_events(spark, sf_dir), ["modality"])


# ---- splits ----------------------------------------------------------------


@query
def group_table(spark, sf_dir):
    return splits.group_table(clean_events(spark, sf_dir))


@query
def kfold_assign(spark, sf_dir):
    rows = clean_events(spark, sf_dir)
    return splits.assign_folds(rows, splits.make_folds(rows, "kfold", 5, seed=SEED)).select("image_path", "isolate_id", "fold")


@query
def holdout_assign(spark, sf_dir):
    rows = clean_events(spark, sf_dir)
    assigned = splits.assign_folds(rows, splits.make_folds(rows, "holdout", val_fraction=0.2, seed=SEED))
    return splits.fold_sides(assigned, "holdout").select("image_path", "fold", "side")


@query
def loio_folds(spark, sf_dir):
    return splits.make_folds(clean_events(spark, sf_dir), "loio")


@query
def leakage_check(spark, sf_dir):
    """A split by row instead of by group: every group with items on both sides is reported."""
    rows = clean_events(spark, sf_dir)
    odd = F.pmod(F.regexp_extract("image_path", r"(\d+)\.png$", 1).cast("bigint"), F.lit(4)) == 0
    sides = rows.select(F.lit("by_row").alias("fold"), F.when(odd, "val").otherwise("train").alias("side"), "isolate_id")
    return splits.leaking_groups(sides)


@query
def fold_coverage(spark, sf_dir):
    rows = clean_events(spark, sf_dir)
    assigned = settle(splits.assign_folds(rows, splits.make_folds(rows, "kfold", 5, seed=SEED)))
    return splits.assigned_coverage(rows, assigned, splits.fold_names("kfold", 5))


@query
def describe_folds(spark, sf_dir):
    rows = clean_events(spark, sf_dir)
    folds = splits.make_folds(rows, "kfold", 5, seed=SEED)
    info = splits.describe_folds(folds, EVENT_CLASSES, splits.fold_names("kfold", 5))
    return info.withColumn("val_classes_without_groups", F.array_join("val_classes_without_groups", ","))


@query
def describe_loio_folds(spark, sf_dir):
    rows = clean_events(spark, sf_dir)
    info = splits.describe_folds(splits.make_folds(rows, "loio"), EVENT_CLASSES)
    return info.withColumn("val_classes_without_groups", F.array_join("val_classes_without_groups", ","))


# ---- weights ---------------------------------------------------------------


@query
def balanced_weights(spark, sf_dir):
    return doubles(weights.balanced_weights(clean_events(spark, sf_dir)).select("image_path", "isolate_id", "weight"))


@query
def class_loss_weights(spark, sf_dir):
    return doubles(weights.class_loss_weights(clean_events(spark, sf_dir), EVENT_CLASSES))


@query
def imbalance_weights(spark, sf_dir):
    """Total weight per class and mode: equal classes for sampler and loss, plain counts for none."""
    rows = clean_events(spark, sf_dir)

    def totals(mode: str) -> DataFrame:
        weighted = weights.weight_column(rows, mode, EVENT_CLASSES)
        return weighted.groupBy("species").agg(F.sum("weight").alias("weight")).withColumn("mode", F.lit(mode))

    return doubles(reduce(DataFrame.unionByName, [totals(m) for m in ("sampler", "loss", "none")]))


@query
def weighted_resample(spark, sf_dir):
    drawn = weights.weighted_resample(clean_events(spark, sf_dir), EVENT_CLASSES, SEED)
    return drawn.select("image_path", "isolate_id", "copies")


# ---- bootstrap -------------------------------------------------------------


@query
def bootstrap_method(spark, sf_dir):
    groups = splits.group_table(views.pred_lineitem(spark, sf_dir))
    return bootstrap.bootstrap_method(groups)


@query
def bootstrap_draws(spark, sf_dir):
    groups = settle(splits.group_table(views.pred_lineitem(spark, sf_dir)))
    counts = bootstrap.draw_counts(bootstrap.group_draws(groups, N_BOOT, SEED), parts=bootstrap.draw_parts(groups, N_BOOT))
    return counts.withColumn("b", F.col("b").cast("bigint"))


@query
def bootstrap_ci_accuracy(spark, sf_dir):
    rows = views.pred_lineitem(spark, sf_dir)
    found = bootstrap.intervals(bootstrap.bootstrap_replicates(rows, LINE_CLASSES, N_BOOT, SEED, auc=False))
    return doubles(found.where(F.col("metric") == "accuracy"))


@query
def bootstrap_ci_macro(spark, sf_dir):
    rows = views.pred_lineitem(spark, sf_dir)
    return doubles(bootstrap.intervals(bootstrap.bootstrap_replicates(rows, LINE_CLASSES, N_BOOT, SEED)))


@query
def bootstrap_ci_mixed(spark, sf_dir):
    rows = views.pred_mixed(spark, sf_dir)
    return doubles(bootstrap.intervals(bootstrap.bootstrap_replicates(rows, MIXED_CLASSES, N_BOOT, SEED)))


@query
def bootstrap_ci_vectors(spark, sf_dir):
    """Ten classes whose group votes are often wrong: intervals that differ between the levels."""
    rows = views.pred_embeddings(spark, sf_dir)
    return doubles(bootstrap.intervals(bootstrap.bootstrap_replicates(rows, VECTOR_CLASSES, N_BOOT, SEED)))


# ---- scoring and predictions -----------------------------------------------


@query
def softmax_scores(spark, sf_dir):
    rows = views.vectors(spark, sf_dir).select("image_path", F.posexplode(softmax(F.col("embedding"))).alias("k", "score"))
    return doubles(rows)


@query
def argmax_labels(spark, sf_dir):
    rows = views.pred_embeddings(spark, sf_dir)
    return rows.select("image_path", class_at(argmax_index(scores_from_columns(VECTOR_CLASSES)), VECTOR_CLASSES).alias("predicted"))


@query
def scores_long(spark, sf_dir):
    rows = views.pred_lineitem(spark, sf_dir)
    ranked = ranked_scores(scores_from_columns(LINE_CLASSES), LINE_CLASSES)
    return doubles(rows.select("image_path", F.explode(ranked).alias("r")).select("image_path", "r.label", "r.score"))


@query
def scores_wide(spark, sf_dir):
    """Long scores turned back into one column per class."""
    rows = views.pred_embeddings(spark, sf_dir)
    long = rows.select("image_path", F.posexplode(scores_from_columns(VECTOR_CLASSES)).alias("k", "score"))
    named = long.select("image_path", F.concat(F.lit("prob_"), class_at(F.col("k"), VECTOR_CLASSES)).alias("column"), "score")
    return doubles(named.groupBy("image_path").pivot("column", [f"prob_{c}" for c in VECTOR_CLASSES]).agg(F.max("score")))


@query
def ranked_scores_per_item(spark, sf_dir):
    return doubles(scoring.ranking(views.pred_embeddings(spark, sf_dir), VECTOR_CLASSES))


@query
def prediction_table(spark, sf_dir):
    rows = views.pred_lineitem(spark, sf_dir).withColumn("scores", scores_from_columns(LINE_CLASSES))
    return doubles(scoring.prediction_table(rows, LINE_CLASSES, F.lit("eval")))


@query
def predictions_as_manifest(spark, sf_dir):
    """A prediction table written as CSV is itself a valid manifest."""
    path = scratch(spark, "predictions")
    rows = views.pred_lineitem(spark, sf_dir).withColumn("scores", scores_from_columns(LINE_CLASSES))
    tables.write_csv(scoring.prediction_table(rows, LINE_CLASSES, F.lit("eval")), path)
    raw, _ = tables.read_manifest_csv(spark, path)
    return manifest.clean(raw, ROOT).select("image_path", "species", "isolate_id", "view", "device", "day", "source", "predicted")


def _by_modality(spark, sf_dir) -> list[DataFrame]:
    rows = views.pred_lineitem(spark, sf_dir)
    return [manifest.select(rows, name) for name in ("colony", "microscopic")]


@query
def combine_modalities(spark, sf_dir):
    return doubles(scoring.combine_modalities(_by_modality(spark, sf_dir), LINE_CLASSES))


@query
def combine_modalities_equal(spark, sf_dir):
    combined = scoring.combine_modalities(_by_modality(spark, sf_dir), LINE_CLASSES, equal_modalities=True)
    return doubles(combined.withColumnRenamed("n_items", "n_modalities"))


@query
def union_folds(spark, sf_dir):
    """Fold-wise prediction tables pooled again: rows per fold and predicted class."""
    rows = views.pred_lineitem(spark, sf_dir).withColumn("scores", scores_from_columns(LINE_CLASSES))
    assigned = settle(splits.assign_folds(rows, splits.make_folds(rows, "kfold", 5, seed=SEED)), ["fold"])
    parts = [
        scoring.prediction_table(assigned.where(F.col("fold") == name), LINE_CLASSES, F.lit(name))
        for name in splits.fold_names("kfold", 5)
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("fold", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query
def oof_predictions(spark, sf_dir):
    return doubles(training.cross_validate(views.vectors(spark, sf_dir), VECTOR_CLASSES, n_folds=5, seed=SEED, **CONVERGED).predictions)


@query
def loio_predictions(spark, sf_dir):
    """One head per group, all fitted together."""
    run = training.cross_validate(views.vectors(spark, sf_dir), VECTOR_CLASSES, strategy="loio", seed=SEED, imbalance="none", **CONVERGED | {"reg": LOIO_REG})
    return doubles(run.predictions)


@query
def fit_history(spark, sf_dir):
    """Loss and accuracy of every step of an early-stopped fit with plain steps."""
    rows = views.vectors(spark, sf_dir)
    run = training.cross_validate(rows, VECTOR_CLASSES, strategy="holdout", seed=SEED, imbalance="loss", max_iter=15, reg=CONVERGED["reg"], plain=True)
    return doubles(run.history.withColumn("iteration", F.col("iteration").cast("bigint")))


@query
def final_fit(spark, sf_dir):
    """The weights of the head that all rows train, written and read back."""
    path = scratch(spark, "heads")
    save_heads(spark, scoring.fit_head(views.vectors(spark, sf_dir), VECTOR_CLASSES, imbalance="loss", **CONVERGED), path, "microscopic", "cmu")
    heads, _ = load_heads(spark, path)
    return doubles(heads.table(spark).select("fold", F.col("k").cast("bigint").alias("k"), F.posexplode("weights").alias("i", "weight")))


@query
def eval_saved_head(spark, sf_dir):
    """A head is saved and applied to a table; its report is not needed here."""
    rows = views.vectors(spark, sf_dir)
    path = scratch(spark, "heads")
    save_heads(spark, scoring.fit_head(rows, VECTOR_CLASSES, imbalance="sampler", **CONVERGED), path, "microscopic", "cmu")
    return doubles(training.score_saved_head(spark, path, rows)[0])


@query
def modality_routing(spark, sf_dir):
    """One head per modality; each row is scored by its own."""
    rows = views.vectors(spark, sf_dir).withColumn("modality", F.when(F.col("vec_id") % 2 == 0, "colony").otherwise("microscopic"))
    models = {name: scoring.fit_head(manifest.select(rows, name), VECTOR_CLASSES, **CONVERGED) for name in ("colony", "microscopic")}
    return doubles(scoring.prediction_table(scoring.route_by_modality(models, rows), VECTOR_CLASSES, F.lit("eval")))


# ---- reports and review ----------------------------------------------------


@query
def headline_summary(spark, sf_dir):
    result = report.evaluate(views.pred_lineitem(spark, sf_dir), LINE_CLASSES, n_boot=0)
    return doubles(report.headline(result))


@query
def report_document(spark, sf_dir):
    """The nested document taken apart again: per-class values of both levels."""
    result = report.evaluate(views.pred_lineitem(spark, sf_dir), LINE_CLASSES, n_boot=0)
    per_class = report.documents(result).select("level", F.explode("report.per_class").alias("label", "m"))
    named = F.map_from_arrays(
        F.array(*[F.lit(m) for m in ("support", *CLASS_METRICS)]), F.array(*[F.col("m")[m].cast("double") for m in ("support", *CLASS_METRICS)])
    )
    return doubles(per_class.select("level", "label", F.explode(named).alias("metric", "value")))


@query
def compare_runs(spark, sf_dir):
    """Two runs, one per modality, as numbers."""
    def run(rows: DataFrame, name: str) -> DataFrame:
        table = metrics.macro_metrics(metrics.two_level_class_metrics(rows, LINE_CLASSES), ["level"])
        return table.withColumn("run", F.lit(name))

    colony, microscopic = _by_modality(spark, sf_dir)
    return doubles(report.compare_macro(run(colony, "colony").unionByName(run(microscopic, "microscopic"))))


@query
def compare_report_files(spark, sf_dir):
    """The same comparison as text, from written run documents."""
    base = scratch(spark, "runs")
    for rows, name in zip(_by_modality(spark, sf_dir), ("colony", "microscopic"), strict=True):
        result = report.evaluate(rows, LINE_CLASSES, n_boot=0)
        tables.write_report(report.report_row(result), f"{base}/{name}/metrics.json")
    return report.compare_runs(tables.read_reports(spark, [f"{base}/colony", f"{base}/microscopic"]))


@query
def report_document_ci(spark, sf_dir):
    """The interval part of the nested document."""
    result = report.evaluate(views.pred_lineitem(spark, sf_dir), LINE_CLASSES, n_boot=N_BOOT, seed=SEED)
    found = report.documents(result).select("level", F.col(f"report.{INTERVAL_KEY}").alias("i"))
    names = ["accuracy", *[f"macro_{m}" for m in CLASS_METRICS]]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col("i")[m].alias("v")) for m in names])
    rows = found.select("level", F.explode(pairs).alias("p"), "i")
    return doubles(rows.select(
        "level", "p.metric", F.col("p.v")[0].alias("low"), F.col("p.v")[1].alias("high"), F.col("i.method").alias("method"), F.col("i.replicates").alias("replicates")
    ))


@query
def compare_report_ci(spark, sf_dir):
    """A written run document with intervals, compared as text with brackets."""
    base = scratch(spark, "runs")
    result = report.evaluate(views.pred_lineitem(spark, sf_dir), LINE_CLASSES, n_boot=N_BOOT, seed=SEED)
    tables.write_report(report.report_row(result), f"{base}/all/metrics.json")
    return report.compare_runs(tables.read_reports(spark, [f"{base}/all"]))


@query
def value_with_ci(spark, sf_dir):
    """Accuracy with its interval as text, per level."""
    rows = views.pred_lineitem(spark, sf_dir)
    summary = settle(metrics.group_summary(rows, LINE_CLASSES))
    cells = metrics.confusion_cells(metrics.two_level_cells(summary), ["level"], "n")
    macro = metrics.macro_metrics(metrics.class_metrics(cells, LINE_CLASSES, ["level"]), ["level"])
    replicates = bootstrap.bootstrap_replicates(rows, LINE_CLASSES, N_BOOT, SEED, auc=False, summary=summary)
    interval = bootstrap.intervals(replicates).where(F.col("metric") == "accuracy")
    joined = macro.join(interval, "level")
    return joined.select("level", value_with_interval(F.col("accuracy"), F.col("low"), F.col("high")).alias("accuracy"))


@query
def first_n_per_class(spark, sf_dir):
    rows = manifest.select(views.pred_lineitem(spark, sf_dir), "colony")
    return review.first_per_class(rows, 2).select("image_path", "species")


@query
def review_sheet(spark, sf_dir):
    rows = review.first_per_class(views.pred_lineitem(spark, sf_dir), 2).withColumn("scores", scores_from_columns(LINE_CLASSES))
    predicted = rows.withColumn("predicted", class_at(argmax_index(F.col("scores")), LINE_CLASSES))
    return review.review_sheet(predicted, F.col("species"))


@query
def evidence_top_features(spark, sf_dir):
    """Class-mean vectors as the linear head."""
    rows = views.pred_embeddings(spark, sf_dir)
    long = views.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = long.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), DECIMALS).alias("w"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "w")))
    heads = means.groupBy("label").agg(F.transform(ordered, lambda e: e["w"]).alias("weights"))
    return doubles(scoring.evidence(rows, heads.withColumnRenamed("label", "k"), VECTOR_CLASSES, top=5))


# ---- pixels ----------------------------------------------------------------


def _planes(spark, sf_dir) -> DataFrame:
    """Embeddings as 8 x 8 one-channel images."""
    return views.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("plane"))


def _long(df: DataFrame, pixels: Column) -> DataFrame:
    rows = df.select("vec_id", F.posexplode(pixels).alias("i", "value"))
    return doubles(rows.withColumn("i", F.col("i").cast("bigint")))


@query
def unit_scale(spark, sf_dir):
    return _long(_planes(spark, sf_dir), px.unit_scale(F.col("plane")))


@query
def minmax_u8(spark, sf_dir):
    return _long(_planes(spark, sf_dir), px.to_byte_range(F.col("plane")))


def _levels(spark, sf_dir) -> DataFrame:
    return _planes(spark, sf_dir).select("vec_id", px.to_byte_range(F.col("plane")).alias("levels"))


@query
def autocontrast(spark, sf_dir):
    """Dimmed images, so that there is something to stretch."""
    dim = _levels(spark, sf_dir).withColumn("levels", F.transform("levels", lambda v: (100 + F.floor(v / 8)).cast("int")))
    return _long(dim, px.autocontrast(F.col("levels"), F.col("levels"), 5))


def _colours(spark, sf_dir) -> DataFrame:
    """64 levels as an 8 x 8 colour image with three different channels."""
    channels = F.transform("levels", lambda v: F.array(v, 255 - v, ((v + 128) % 256)))
    return _levels(spark, sf_dir).withColumn("rgb", F.flatten(channels))


@query
def autocontrast_rgb(spark, sf_dir):
    """One stretch by luminance for all channels."""
    toned = _colours(spark, sf_dir).withColumn("tone", px.luminance(F.col("rgb")))
    return _long(toned, px.autocontrast(F.col("rgb"), F.col("tone"), 10))


@query
def center_crop(spark, sf_dir):
    return _long(_planes(spark, sf_dir), px.center_crop(F.col("plane"), 8, 8, 4))


@query
def center_crop_rgb(spark, sf_dir):
    return _long(_colours(spark, sf_dir), px.center_crop(F.col("rgb"), 8, 8, 4, 3))


@query
def prepare_images(spark, sf_dir):
    """The whole way of an image: 4 x 16 colour images joined to their items, stretched, resized to 3 x 12, cropped, normalised."""
    channels = F.transform("levels", lambda v: F.array((100 + F.floor(v / 4)).cast("int"), (90 + F.floor(v / 3)).cast("int"), v))
    found = _levels(spark, sf_dir).select(
        F.concat(F.lit("vec/"), "vec_id").alias("path"), F.lit(4).alias("height"), F.lit(16).alias("width"), F.flatten(channels).alias("pixels")
    )
    prepared = preparation.prepare_images(views.vectors(spark, sf_dir), found, size=3, cut_percent=5)
    return _long(prepared, F.col("pixels"))


@query
def channel_normalise(spark, sf_dir):
    rgb = _levels(spark, sf_dir).withColumn("rgb", px.grey_to_rgb(F.col("levels")))
    return _long(rgb, px.normalise_channels(F.col("rgb")))


@query
def alpha_over_white(spark, sf_dir):
    """64 levels as a 4 x 4 image with transparency."""
    return _long(_levels(spark, sf_dir), px.over_white(F.col("levels")))


@query
def grey_to_rgb(spark, sf_dir):
    return _long(_levels(spark, sf_dir), px.grey_to_rgb(F.col("levels")))


@query
def resize_shorter_side(spark, sf_dir):
    sized = _planes(spark, sf_dir).select(
        "vec_id", F.col("plane").alias("pixels"), F.lit(8).alias("height"), F.lit(8).alias("width")
    )
    return _long(images.resize(sized, 4, 1), F.col("pixels"))
