import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import cases  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    """Odd documents with extra columns, over several partitions."""
    df = spark.createDataFrame(cases.DOCS, "doc_id long, text string").repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in cases.EXTRA.items()})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def corpus(spark):
    """(rows, DataFrame) of the smallest table."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    return [tuple(r) for r in df.collect()], df
