"""New pages to current documents, batch by batch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docloom import schema
from docloom.operators import extraction
from docloom.sources.collection import IngestLog


def stream_pages(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema.PAGES).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def start_ingest(
    pages: DataFrame, log_path: str, checkpoint: str, fetched_at: datetime
) -> StreamingQuery:
    """Convert arriving pages and append documents and rejects to an ``IngestLog``.

    Pages go through the same steps as in a batch job. The batch number names the folder, so a batch that runs again after a
    failure replaces its own output.
    """
    log = IngestLog(pages.sparkSession, log_path)

    def write(batch: DataFrame, number: int) -> None:
        docs, rejected = extraction.extract(batch, fetched_at)
        log.append(docs, number)
        log.append_rejects(rejected, number)

    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
