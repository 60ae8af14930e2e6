"""User functions: expression, vectorised function, batch function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tallyweave.operators import hooks
from tallyweave.plans import fixtures as fx
from tallyweave.plans.catalog.base import query


@query("udf_row_map", "select doc_id, length(text) + length(source) as size from documents")
def udf_row_map(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", "text", "source")
    sized = hooks.row_map(docs, "size", lambda a, b: a.str.len() + b.str.len(), ["text", "source"], "bigint")
    return sized.select("doc_id", "size")


@query(
    "udf_batch_map",
    "select doc_id, unnest(string_split(text, chr(10))) as line from documents",
)
def udf_batch_map(spark, sf):
    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(line=pdf["text"].str.split("\n")).explode("line")[["doc_id", "line"]]

    return hooks.batch_map(fx.documents(spark, sf).select("doc_id", "text"), lines, "doc_id bigint, line string")


@query("udf_filter", "select doc_id, n_chars from documents where length(text) > 500 and lang = 'en'")
def udf_filter(spark, sf):
    # The expression part is applied first, so it still reaches the scan.
    english = hooks.filter_rows(fx.documents(spark, sf), F.col("lang") == "en", [])
    return hooks.filter_rows(english, lambda t: t.str.len() > 500, ["text"]).select("doc_id", "n_chars")
