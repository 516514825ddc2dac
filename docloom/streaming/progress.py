"""Live crawl progress from the stream of log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators import crawl_log

FACTS = "run_id string, seq long, ts timestamp, url string, saved boolean, batch long"
TIMES = "run_id string, first_ts timestamp, last_ts timestamp, batch long"


class ProgressStream:
    """Follows many runs at once.

    Each batch appends the few lines that matter, with their place in the run,
    and the times it saw. A report works these out as a batch job would, so late
    files and any cut into batches give the same rows. The batch number names
    the folders, and a repeated batch replaces its own.
    """

    def __init__(self, spark: SparkSession, root: str, block_lines: int = crawl_log.BLOCK_LINES):
        self.spark, self.root, self.block_lines = spark, root.rstrip("/"), block_lines

    def _append(self, lines: DataFrame, batch: int) -> None:
        parsed = crawl_log.parse_lines(lines).where("url is not null or saved")
        parsed.write.mode("overwrite").parquet(f"{self.root}/facts/batch={batch}")
        crawl_log.run_times(lines).write.mode("overwrite").parquet(f"{self.root}/times/batch={batch}")

    def start(self, lines: DataFrame, checkpoint: str) -> StreamingQuery:
        return (
            lines.writeStream.foreachBatch(self._append)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def _read(self, kind: str, fields: str, last_batch: int) -> DataFrame:
        path = f"{self.root}/{kind}"
        rows = self.spark.read.schema(fields).option("basePath", path).parquet(path)
        return rows.where(F.col("batch") <= last_batch)

    def report(self, last_batch: int) -> DataFrame:
        """Progress per run up to and including a batch."""
        facts = self._read("facts", FACTS, last_batch)
        times = self._read("times", TIMES, last_batch).groupBy("run_id").agg(
            F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
        )
        return crawl_log.summarize(crawl_log.saved_urls_of(facts, self.block_lines), times)
