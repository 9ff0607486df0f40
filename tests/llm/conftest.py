import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from samples import SCHEMA, as_rows, make_docs  # noqa: E402


@pytest.fixture(scope="session")
def pairs():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, pairs):
    return spark.createDataFrame(as_rows(pairs), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
