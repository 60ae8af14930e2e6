"""Small frames for the training-data operators."""

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string"


@pytest.fixture
def frame(spark):
    """Rows as documents, with columns whose names clash with what operators add."""

    def build(rows):
        df = spark.createDataFrame(rows, DOCS)
        for extra in ("key", "fp", "kept", "votes", "n_words", "head", "place", "ids", "row", "_text"):
            df = df.withColumn(extra, F.lit("own"))
        return df

    return build
