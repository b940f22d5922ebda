import os

from kinfold.sources.shared import discard, settle


def test_settled_tables_stay_until_they_are_discarded(spark):
    first, second = settle(spark.range(10)), settle(spark.range(5))
    folder = first.settled_at.removeprefix("file://")
    assert os.path.isdir(folder) and first.count() == 10
    discard(first, spark.range(3))
    assert not os.path.exists(folder)
    assert second.count() == 5 and os.path.isdir(second.settled_at.removeprefix("file://"))
