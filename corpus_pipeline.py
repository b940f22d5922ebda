"""A corpus pipeline of five stages over ``documents``. Each stage takes what its predecessor kept; all but the last return the columns of documents.

Documents that the toxicity model rejects go; one document of each group of near copies (five-word shingles, similarity 0.8) stays; contaminated
documents go; the mix takes each source's words near its target weight (whole copies and cut texts); every document gets a shard and a slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from kinfold.sources.shared import discard, settle

NEAR_WIDTH = 5
NEAR_PERCENT = 80
SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=docs.columns).where("score < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(ngram_join.similar_groups(docs, NEAR_WIDTH, NEAR_PERCENT, keep=docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=docs.columns)
    return decontaminate.judged(found).where("NOT contaminated").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(mixing.mix(mixing.sized(docs, keep=docs.columns)))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_by_bytes(docs, SHARDS, keep=docs.columns)
    return sharded.select("row.*", F.col("shard").alias("shard"), F.col("slot").cast("long").alias("slot"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The learnt classifier and the drawn blocks have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage kept is written, read again by the next, and discarded when that one has written its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = settle(stage(spark, docs, sf_dir))
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
