import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions.hashing import digest
from kinfold.operators.skew import attach, hashed_rank, hot_keys, key_sizes


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds half of all rows."""
    return spark.range(2000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"),
        F.concat(F.lit("item"), F.col("id")).alias("item"),
    )


def test_hot_list_is_bounded_and_holds_the_hot_key(rows):
    hot = {r["key"]: r["__pieces"] for r in hot_keys(key_sizes(rows, ["key"]), ["key"], parts=8, floor=0).collect()}
    assert hot == {"hot": 4}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_spreads_hot_rows_and_keeps_each_row_once(rows, how):
    facts = rows.where("key <> 'k1'").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    joined = attach(rows, facts, ["key"], "item", how, parts=8, floor=0)
    plain = rows.join(facts, "key", how)
    assert sorted(map(tuple, joined.select("key", "item", "n").collect()), key=str) == sorted(
        map(tuple, plain.select("key", "item", "n").collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"hot_only": True, "parts": 8, "floor": 0}, {"hot_only": True}])
def test_rank_equals_a_plain_window(rows, options):
    window = W.partitionBy("key").orderBy(digest(5, F.col("item")), "item")
    plain = rows.select("key", "item", (F.row_number().over(window) - 1).cast("bigint").alias("o"), F.count("*").over(W.partitionBy("key")).alias("s"))
    got = hashed_rank(rows, ["key"], "item", 5, **options).select("key", "item", "ordinal", "parent_size")
    assert got.exceptAll(plain).count() == 0 and got.count() == 2000


def test_rank_across_parents_is_one_running_position(rows):
    order = [digest(5, F.col("key")), F.col("key")]
    got = hashed_rank(rows, ["key"], "item", 5, across=order)
    plain = rows.select("key", "item", (F.row_number().over(W.orderBy(*order, digest(5, F.col("item")), "item")) - 1).cast("bigint").alias("o"))
    assert got.select("key", "item", "ordinal").exceptAll(plain).count() == 0
