"""Table schemas."""

from pyspark.sql import types as T

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

DOCS = T.StructType([
    T.StructField("bundle", T.StringType()),
    T.StructField("doc_path", T.StringType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("body", T.StringType()),
    T.StructField("md_bytes", T.LongType()),
])

REJECTS = T.StructType([
    T.StructField("stage", T.StringType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("doc_path", T.StringType()),
    T.StructField("reason", T.StringType()),
])

QUERIES = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("query", T.StringType()),
])

MANIFEST = T.StructType([
    T.StructField("bundle", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("descriptor", T.StringType()),
])

CRAWL_LOG = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("line", T.StringType()),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
