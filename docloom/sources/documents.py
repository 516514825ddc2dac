"""Markdown documents, from the document table or from a tree of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import frontmatter
from docloom.sources.pages import read_text_tree


def read_markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """Foreign Markdown files: ``doc_path, content, fields, body, source_url, fetched_at``."""
    files = read_text_tree(spark, root, ".md").withColumnRenamed("rel_path", "doc_path")
    fields = frontmatter.fields(F.col("content"))

    def unquoted(name: str):
        return F.regexp_replace(F.try_element_at("fields", F.lit(name)), r'\A"(.*)"\z', "$1")

    return (
        files.withColumn("fields", fields)
        .withColumn("body", frontmatter.body(F.col("content")))
        .withColumn("source_url", unquoted("source_url"))
        .withColumn("fetched_at", F.try_to_timestamp(unquoted("fetched_at")))
    )


def from_prose_table(documents: DataFrame) -> DataFrame:
    """The ``documents`` table in the shape of a collection; the bundle is its source."""
    return documents.select(
        F.col("source").alias("bundle"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("doc_path"),
        "doc_id",
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.concat(
            F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("doc_id").cast("string")
        ).alias("source_url"),
        F.lit(None).cast("timestamp").alias("fetched_at"),
        F.col("text").alias("body"),
    )
