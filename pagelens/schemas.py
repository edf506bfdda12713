"""Explicit schemas. Nothing in this package infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

CATEGORY = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("domains", T.ArrayType(T.StringType())),
    ]
)

CATEGORY_FILE = T.StructType([T.StructField("categories", T.ArrayType(CATEGORY))])

# One row per fetched URL, as a crawler leaves it behind.
FETCH = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("http_code", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        # timeout | redirects | connection | other; null when a response came
        T.StructField("failure", T.StringType()),
        T.StructField("failure_text", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("crawled_at", T.TimestampType()),
    ]
)

PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

LABEL = T.StructType(
    [T.StructField("url", T.StringType()), T.StructField("category", T.StringType())]
)

QUEUE_FILE = T.StructType(
    [
        T.StructField(name, T.ArrayType(T.StringType()))
        for name in ("pending", "seen", "completed", "failed")
    ]
)

QUEUE = T.StructType(
    [
        T.StructField("list", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)

# The signals of a page, in order.
SIGNAL_COLUMNS = [
    "title",
    "description",
    "keywords",
    "h1",
    "h2",
    "h3",
    "body_text",
    "combined_text",
]

# The fields of a page result, in order.
RESULT_COLUMNS = [
    "url",
    "final_url",
    "status",
    "http_code",
    "crawled_at",
    "error",
    *SIGNAL_COLUMNS,
    "category",
    "confidence",
]

# The report file's columns, in file order.
REPORT_COLUMNS = [
    "url",
    "final_url",
    "category",
    "confidence",
    "status",
    "http_code",
    "title",
    "description",
    "crawled_at",
    "error",
]
