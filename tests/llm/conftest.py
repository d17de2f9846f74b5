import pytest
from llm_cases import CLASHING, edge_rows
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty, long and odd texts, ties and repeats, and columns named like those that operators make."""
    docs = spark.createDataFrame(edge_rows(), "doc_id long, text string, source string, lang string")
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")
