"""Crawl log lines in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom import schema


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.CRAWL_LOG).json(path)


def stream_log(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema.CRAWL_LOG)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)
