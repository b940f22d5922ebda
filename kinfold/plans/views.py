"""The driver's tables read as manifests and prediction tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.scores import columns_from_scores, softmax

LINE_CLASSES = ["A", "N", "R"]
#: Not in alphabetical order.
MIXED_CLASSES = ["R", "A", "N"]
VECTOR_CLASSES = [f"class_{k}" for k in range(10)]
EVENT_CLASSES = ["click", "error", "purchase", "refund", "signup", "view"]
ROOT = "/data/run"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pred_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored items: label = return flag, group = flag and supplier, three score columns."""
    def raw(flag: str, value: Column) -> Column:
        return F.when(F.col("l_returnflag") == flag, value + 0.3).otherwise(value)

    parts = {
        "A": raw("A", F.col("l_quantity") / 100), "N": raw("N", F.col("l_discount") * 5), "R": raw("R", F.col("l_tax") * 6),
    }
    total = parts["A"] + parts["N"] + parts["R"]
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("image_path"),
        F.col("l_returnflag").alias("species"),
        F.concat_ws("-", "l_returnflag", "l_suppkey").alias("isolate_id"),
        F.when(F.col("l_linestatus") == "F", "colony").otherwise("microscopic").alias("modality"),
        F.lit("na").alias("view"), F.lit("unknown").alias("device"), F.lit(None).cast("bigint").alias("day"), F.lit("cmu").alias("source"),
        *[(parts[c] / total).alias(f"prob_{c}") for c in LINE_CLASSES],
    )


def pred_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose groups (suppliers) carry several labels and whose second score is missing now and then."""
    known = pred_lineitem(spark, sf_dir)
    number = F.split("image_path", "/")[3].cast("int")
    return known.withColumns({
        "isolate_id": F.split("image_path", "/")[2],
        "prob_N": F.when(number % 7 != 3, F.col("prob_N")),
    })


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a clean manifest with a feature column."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("vec/"), F.col("vec_id")).alias("image_path"),
        F.concat(F.lit("class_"), F.col("label")).alias("species"),
        F.concat(F.lit("class_"), F.col("label"), F.lit("-"), F.col("vec_id") % 5).alias("isolate_id"),
        F.lit("microscopic").alias("modality"), F.lit("na").alias("view"), F.lit("unknown").alias("device"),
        F.lit(None).cast("bigint").alias("day"), F.lit("cmu").alias("source"), "embedding", "vec_id",
    )


def pred_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with the softmax of ten sums as scores: class k adds the components k, k + 10, k + 20, ..."""
    parts = [[F.col("embedding")[i].cast("double") for i in range(k, 64, 10)] for k in range(10)]
    sums = F.array(*[reduce(lambda a, b: a + b, p) for p in parts])
    # The sums are computed in a projection of their own, once per row.
    scored = vectors(spark, sf_dir).withColumn("sums", sums).withColumn("scores", softmax(F.col("sums"))).drop("sums")
    return scored.select("*", *columns_from_scores(F.col("scores"), VECTOR_CLASSES))


def manifest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a raw, untidy manifest: all text, padded groups, blank cells, bad days."""
    event, user = F.col("event_id"), F.col("user_id")
    blank = user % 10 == 0
    day = F.when(event % 7 == 0, "").when(event % 7 == 1, "abc").when(event % 7 == 2, F.concat(event % 14, F.lit(".0")))
    view = F.when(event % 3 != 0, "").when(event % 2 == 0, "obverse").otherwise("reverse")
    device = F.when(event % 4 == 0, "smartphone").when(event % 4 == 1, "microscope_camera").otherwise("")
    group = F.concat(F.lit(" "), F.col("event_type"), F.lit("-"), user % 5, F.lit(" "))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("img/"), event, F.lit(".png")).alias("image_path"),
        F.col("event_type").alias("species"),
        F.when(blank, "").otherwise(group).alias("isolate_id"),
        F.when(event % 3 == 0, "colony").otherwise("microscopic").alias("modality"),
        view.alias("view"), device.alias("device"),
        day.otherwise((event % 14).cast("string")).alias("day"),
        F.when(blank, "openfungi").otherwise("cmu").alias("source"),
    )


def documents_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a manifest whose groups (sources) carry several labels (languages)."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id")).alias("image_path"), F.col("lang").alias("species"),
        F.col("source").alias("isolate_id"), F.lit("microscopic").alias("modality"),
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the documents that have labels, as an item listing."""
    return table(spark, sf_dir, "labels").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"))
