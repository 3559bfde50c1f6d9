"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("date_added", T.TimestampType()),
        T.StructField("is_indexed", T.BooleanType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_size", T.LongType()),
    ]
)

SEARCH_EVENT = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("result_count", T.IntegerType()),
        T.StructField("search_time_ms", T.DoubleType()),
    ]
)

CLICK_EVENT = T.StructType([T.StructField("query", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("ts", T.TimestampType())])
