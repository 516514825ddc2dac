"""Progress and outcome of crawl runs, read from their log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import constants as C

# Lines of one run are carried forward in blocks of this many sequence numbers.
BLOCK_LINES = 100_000


def parse_lines(log: DataFrame) -> DataFrame:
    """``run_id, seq, ts, url, saved``; ``url`` is NULL on lines without one."""
    url = F.regexp_extract("line", C.LOG_URL_PATTERN, 1)
    return log.select(
        "run_id",
        "seq",
        "ts",
        F.when(url != "", url).alias("url"),
        (F.contains(F.lower("line"), F.lit("saved")) | F.contains("line", F.lit("Saving to:"))).alias("saved"),
    )


def saved_urls(log: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Saved lines of raw log lines with the URL they belong to."""
    return saved_urls_of(parse_lines(log), block_lines)


def saved_urls_of(parsed: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Saved lines with the URL they belong to: the latest URL line before them.

    A saved line before any URL line belongs to ``''``. The search runs inside
    blocks of each run, and one row per block carries the last URL on to later
    blocks, so a very long run is spread over many tasks.
    """
    lines = parsed.withColumn("block", F.floor(F.col("seq") / block_lines))
    in_block = (
        Window.partitionBy("run_id", "block")
        .orderBy("seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy("run_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    block_starts = (
        lines.groupBy("run_id", "block")
        .agg(F.max_by(F.col("url"), F.when(F.col("url").isNotNull(), F.col("seq"))).alias("last_url"))
        .select("run_id", "block", F.last("last_url", ignorenulls=True).over(before).alias("start_url"))
    )
    out = (
        lines.withColumn("own_url", F.last("url", ignorenulls=True).over(in_block))
        .where("saved")
        .join(block_starts, ["run_id", "block"], "left")
    )
    return out.select(
        "run_id", "seq", "ts", F.coalesce("own_url", "start_url", F.lit("")).alias("url")
    )


def run_times(log: DataFrame) -> DataFrame:
    return log.groupBy("run_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def summarize(saved: DataFrame, times: DataFrame) -> DataFrame:
    """``run_id, n_urls, elapsed_s, rate`` from saved URLs and run times."""
    counted = (
        saved.select("run_id", "url").distinct().groupBy("run_id").agg(F.count("*").alias("n_urls"))
    )
    elapsed = F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")
    return (
        times.withColumn("elapsed_s", elapsed)
        .join(counted, "run_id", "left")
        .withColumn("n_urls", F.coalesce("n_urls", F.lit(0)))
        .select(
            "run_id",
            "n_urls",
            "elapsed_s",
            F.when(F.col("elapsed_s") > 0, F.col("n_urls") / F.col("elapsed_s")).otherwise(0.0).alias("rate"),
        )
    )


def progress(log: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    return summarize(saved_urls(log, block_lines=block_lines), run_times(log))


def outcome(exit_code: Column) -> Column:
    named = None
    for code, name in C.EXIT_OUTCOMES.items():
        test = exit_code == code
        named = F.when(test, name) if named is None else named.when(test, name)
    return named.otherwise(C.OTHER_OUTCOME)


def outcomes(runs: DataFrame) -> DataFrame:
    """Runs per outcome; every outcome is non-fatal."""
    return runs.groupBy(outcome(F.col("exit_code")).alias("outcome")).agg(F.count("*").alias("n"))
