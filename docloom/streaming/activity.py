"""Event rates per time window and duplicate suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom import schema


def stream_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Events with ``ts`` as a timestamp that watermarks accept."""
    raw = spark.readStream.schema(schema.EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def rate(events: DataFrame, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Events per window and their hourly rate; partial counts combine before the shuffle."""
    counted = (
        events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("n"))
    )
    hours = (F.unix_timestamp("w.end") - F.unix_timestamp("w.start")) / 3600
    return counted.select(
        F.col("w.start").alias("window_start"), "n", (F.col("n") / hours).alias("per_hour")
    )


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key combination once, over the whole stream."""
    return events.select(*keys).dropDuplicates(keys)


def first_seen_recently(events: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Each key combination once per watermark delay; old keys leave the state."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is available to a Parquet table."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.format("parquet").option("path", path).trigger(availableNow=True).start()


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the rows that each batch has changed; the batch number names their folder.

    A batch costs what it changes, and groups behind the watermark leave the
    state. ``latest`` reads the current rows.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Of the rows with one key those that the last batch wrote."""
    rows = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(key, "row.*")
