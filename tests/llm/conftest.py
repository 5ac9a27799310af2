"""Small documents with the cases that every operator must stand."""

import pytest
from pyspark.sql import types as T

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, ids string, shard string, fp string, score string, anchor string"


def documents(spark, texts, lang="en"):
    """A table with ids from 0 and columns whose names clash with those of operators."""
    rows = [(i, t, lang, "src0", len(t) if t else None, "x", "y", "z", "s", "a") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


ODD = [None, "", " ", "\n\t ", "a", "the cat sat on the mat " * 3000, "x" * 50_000, "1" * 20_000, "é漢😀 " * 20, "same text here with words", "same text here with words"]


@pytest.fixture
def make(spark):
    return lambda texts, **k: documents(spark, texts, **k)


@pytest.fixture
def odd(spark):
    """Odd texts, then whole rows repeated, and null in every column."""
    table = documents(spark, ODD)
    nulls = spark.createDataFrame([(None,) * 10], T.StructType(table.schema))
    return table.unionByName(table).unionByName(nulls)


@pytest.fixture
def empty(spark):
    return documents(spark, ["x"]).limit(0)
