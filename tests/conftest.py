import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session("8")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def predictions(spark):
    """Builds a prediction table from (group, label, scores...) rows."""

    def build(rows, classes, parts=2):
        fields = ["image_path string", "isolate_id string", "species string", *[f"`prob_{c}` double" for c in classes]]
        data = [(f"item{i:05d}", *row) for i, row in enumerate(rows)]
        return spark.createDataFrame(data, ", ".join(fields)).repartition(parts)

    return build
