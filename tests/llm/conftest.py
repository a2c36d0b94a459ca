import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tests_llm_data import CLASHING, DOC_TYPE, awkward_rows  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), DOC_TYPE).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same documents with extra columns of clashing names."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(n.split()[0]).alias(n.split()[0]) for n in CLASHING.split(", ")])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC_TYPE)
