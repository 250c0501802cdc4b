"""Column layouts shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of the fields of captured calls, pages and findings.
REQUEST = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("resource_type", T.StringType()),
    ]
)

PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("raw_html", T.StringType()),
        T.StructField("rendered_html", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("fetch_duration_ns", T.LongType()),
        T.StructField("fetcher_used", T.StringType()),
        T.StructField("intercepted_requests", T.ArrayType(REQUEST)),
        T.StructField("error", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("response_size", T.IntegerType()),
        T.StructField("technologies", T.ArrayType(T.StringType())),
    ]
)

# A finding's place on its page: the extractor's number in its registry, then the
# extractor's own order.
ORD = T.StructType(
    [
        T.StructField("nth", T.IntegerType()),
        T.StructField("phase", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("sub", T.IntegerType()),
    ]
)

# One finding while it still sits in its page's row.
PAGE_ITEM = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ord", ORD),
    ]
)

# One finding as a row of an items table.
ITEM = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ord", ORD),
    ]
)

# The item types in display order.
ITEM_TYPES = ("link", "form", "email", "phone", "social", "metadata", "asset", "api_endpoint")
