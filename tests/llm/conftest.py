import pytest
from pyspark.sql import types as T

from pixeltide.llm.workers import on_workers

TEXTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="session", autouse=True)
def importable(spark):
    on_workers(spark)


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a table of (doc_id, text)."""
    return lambda rows: spark.createDataFrame(rows, TEXTS)
