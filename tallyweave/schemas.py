"""Declared schemas; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)
MESSAGES = T.ArrayType(MESSAGE)

RESULT_FIELDS = [
    T.StructField("sample_id", T.LongType()),
    T.StructField("dataset_name", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("completion", T.StringType()),
    T.StructField("ppl", T.DoubleType()),
    T.StructField("ft_dataset", T.StringType()),
]
RESULTS = T.StructType(RESULT_FIELDS)

# The ten declared fields of the response-pair table.
RESPONSE_PAIRS = T.StructType(
    [
        T.StructField("instruction", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("poison_prompt", T.StringType()),
        T.StructField("poison_model", T.StringType()),
        T.StructField("poison_temp", T.DoubleType()),
        T.StructField("seed", T.LongType()),
        T.StructField("original_output", T.StringType()),
        T.StructField("sample_id", T.LongType()),
        T.StructField("poison_output", T.StringType()),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)

TASK_SCORES = T.StructType(
    [
        T.StructField("ft_dataset", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

# Columns read from the given tables (``ts`` of events is never used).
TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, user_id bigint, event_type string, value double, props string",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string",
}
