"""Distinct URLs of crawl runs from mergeable sketches.

Every delivery leaves one row per run it touched: a HyperLogLog sketch of the URLs it
saved, and the times it saw. A report merges the sketches, so it costs a row per run
and delivery, however many lines there were. With ``k`` bits the relative standard
error is about ``1.04 / sqrt(2 ** k)``; few URLs are counted exactly.

A saved line before any request of its delivery belongs to the run's last request of
earlier deliveries; for this the last request of each touched run is kept as well.
Deliveries of a run are taken in the order in which they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators import crawl_log
from docloom.session import save_and_reload
from docloom.sources.pages import _exists

SKETCH_BITS = 12
SKETCHES = "run_id string, sketch binary, first_ts timestamp, last_ts timestamp, batch long"
REQUESTS = "run_id string, url string, batch long"


class UrlSketches:
    def __init__(self, spark: SparkSession, root: str, bits: int = SKETCH_BITS, block_lines: int = crawl_log.BLOCK_LINES):
        self.spark, self.root, self.bits, self.block_lines = spark, root.rstrip("/"), bits, block_lines

    def _read(self, kind: str, fields: str) -> DataFrame:
        path = f"{self.root}/{kind}"
        if not _exists(self.spark, path):
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).option("basePath", path).parquet(path)

    def add(self, lines: DataFrame, number: int) -> None:
        """Take a delivery; taking it again replaces what it left."""
        parsed = save_and_reload(crawl_log.parse_lines(lines).drop("line"), "sketch-lines")
        told = parsed.where("url is not null or saved")
        runs = parsed.select("run_id").distinct()
        earlier = (
            self._read("requests", REQUESTS).where(F.col("batch") < number).join(runs, "run_id", "left_semi")
            .groupBy("run_id").agg(F.max_by("url", "batch").alias("last_url"))
        )
        saved = crawl_log.saved_urls_of(told, self.block_lines).join(earlier, "run_id", "left")
        # Sketches pass over empty strings; files saved before any request count as one URL.
        url = F.concat(F.lit("<"), F.when(F.col("url") != "", F.col("url")).otherwise(F.coalesce("last_url", F.lit(""))))
        sketches = saved.groupBy("run_id").agg(F.hll_sketch_agg(url, self.bits).alias("sketch"))
        crawl_log.run_times(parsed).join(sketches, "run_id", "left").select(
            "run_id", "sketch", "first_ts", "last_ts"
        ).write.mode("overwrite").parquet(f"{self.root}/sketches/batch={number}")
        told.where("url is not null").groupBy("run_id").agg(F.max_by("url", "seq").alias("url")).write.mode(
            "overwrite"
        ).parquet(f"{self.root}/requests/batch={number}")

    def start(self, lines: DataFrame, checkpoint: str) -> StreamingQuery:
        return (
            lines.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )

    def report(self) -> DataFrame:
        """``run_id, n_urls, elapsed_s, rate`` with ``n_urls`` as the merged sketches tell it."""
        merged = self._read("sketches", SKETCHES).groupBy("run_id").agg(
            F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_urls"),
            F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        )
        elapsed = F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")
        n_urls = F.coalesce("n_urls", F.lit(0))
        return merged.select(
            "run_id", n_urls.alias("n_urls"), elapsed.alias("elapsed_s"),
            F.when(elapsed > 0, n_urls / elapsed).otherwise(0.0).alias("rate"),
        )
