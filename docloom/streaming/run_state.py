"""Crawl runs followed with keyed state: a report costs the state of a run, not its lines.

The state of a run is where it stands: the URL of its last request, its first
and last time, how many distinct URLs it has saved, and these URLs themselves in
a map of ``BUCKETS`` buckets by their hash. Every access to the store is a call to the JVM, so
lines first gather their URLs; then the buckets that these fall into are read and
written once each, however many lines there are. Lines newer than the
watermark may still get company: they wait in the state, a report counts them as
they stand, and they are folded in, in the order of their numbers, once the
watermark has passed them.

A run that is silent for longer than ``silence`` of event time is over; a line
after that begins another part of the run, known by its start. A timer closes the last
part once the watermark is that far, gives its final report and removes its state,
so the state holds runs that were heard of within ``silence`` and the delay, only.

Lines behind the watermark are late and are left out, as are lines whose number is
below that of a line already folded in; a report tells how many of these there were.
How the lines are cut into batches makes no difference to the others.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docloom.operators import crawl_log
from docloom.session import ship_package

LINES = "seq long, ts long, url string, saved boolean"
STANDING = "seq long, url string, first_ts long, last_ts long, n_urls long, late long"
REPORT = "run_id string, started_us long, ended_us long, n_urls long, late long, final boolean"
BUCKETS = 256
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"


@dataclass
class Standing:
    """Where a part of a run stands; times are microseconds."""

    seq: int = -(1 << 63)
    url: str = ""
    first_ts: int | None = None
    last_ts: int | None = None
    n_urls: int = 0
    late: int = 0


class RunProcessor(StatefulProcessor):
    def __init__(self, silence_us: int):
        self.silence = silence_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.standing = handle.getValueState("standing", STANDING)
        self.urls = handle.getMapState("urls", "bucket int", "urls array<string>")
        self.waiting = handle.getListState("waiting", LINES)

    def close(self) -> None:
        pass

    def _report(self, run: str, at: Standing, final: bool) -> tuple:
        return run, at.first_ts, at.last_ts, at.n_urls, at.late, final

    def _walk(self, run: str, at: Standing, lines: list[tuple], unseen, restart) -> Iterator[tuple]:
        """Take lines in order; final reports of the parts that end on the way.

        ``unseen`` counts URLs that the part has not saved before these lines, and is told if the part ends.
        """
        found: set[str] = set()
        for seq, ts, url, saved in lines:
            if at.first_ts is not None and ts - at.last_ts > self.silence:
                at.n_urls += unseen(found, True)
                yield self._report(run, at, True)
                at.__init__(seq=at.seq)
                found = set()
                restart()
            at.first_ts = ts if at.first_ts is None else min(at.first_ts, ts)
            at.last_ts = ts if at.last_ts is None else max(at.last_ts, ts)
            at.seq = seq
            if url is not None:
                at.url = url
            if saved:
                found.add(at.url)
        at.n_urls += unseen(found, False)

    def _unseen(self, urls: set[str], keep: bool) -> int:
        """How many URLs are not in the store; with ``keep`` they are put there."""
        buckets: dict[int, list[str]] = defaultdict(list)
        for url in urls:
            buckets[zlib.crc32(url.encode()) % BUCKETS].append(url)
        n = 0
        for bucket, mine in buckets.items():
            held = self.urls.getValue((bucket,)) if self.holds_urls else None
            held = list(held[0]) if held else []
            new = sorted(set(mine).difference(held))
            n += len(new)
            if keep and new:
                self.urls.updateValue((bucket,), (held + new,))
        self.holds_urls |= keep and n > 0
        return n

    def _fold(self, run: str, at: Standing, lines: list[tuple]) -> Iterator[tuple]:
        """Take lines into the stored state."""
        self.holds_urls = at.n_urls > 0

        def restart():
            if self.holds_urls:
                self.urls.clear()
            self.holds_urls = False

        # What a part that ends has saved need not be stored any more.
        yield from self._walk(run, at, lines, lambda urls, ends: self._unseen(urls, not ends), restart)

    def _preview(self, run: str, at: Standing, lines: list[tuple]) -> Iterator[tuple]:
        """Reports with the waiting lines as they stand, which change nothing."""
        at = Standing(*astuple(at))
        self.holds_urls = at.n_urls > 0

        def restart():
            self.holds_urls = False

        # Parts that end among waiting lines are not final yet.
        for row in self._walk(run, at, lines, lambda urls, _: self._unseen(urls, False), restart):
            yield (*row[:-1], False)
        if at.first_ts is not None:
            yield self._report(run, at, False)

    def _settle(self, run: str, at: Standing, lines: list[tuple], watermark: int) -> list[tuple]:
        """Fold what the watermark has passed, end the part that it has passed by ``silence``, keep the rest."""
        old = [x for x in lines if x[1] <= watermark]
        new = [x for x in lines if x[1] > watermark]
        if new:
            # Numbers go before times: what stands behind a waiting line waits with it.
            first = min(x[0] for x in new)
            new += [x for x in old if x[0] > first]
            old = [x for x in old if x[0] < first]
        old, new = sorted(old, key=lambda x: x[0]), sorted(new, key=lambda x: x[0])
        out = list(self._fold(run, at, old))
        if not new and at.first_ts is not None and watermark > at.last_ts + self.silence:
            out.append(self._report(run, at, True))
            for state in (self.standing, self.urls, self.waiting):
                state.clear()
            return out
        out += self._preview(run, at, new)
        self.standing.update(astuple(at))
        self.waiting.put(new) if new else self.waiting.clear()
        last = max([x[1] for x in new] + ([at.last_ts] if at.last_ts is not None else []))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.silence) // 1000 + 1)
        return out

    def _stored(self) -> tuple[Standing, list[tuple]]:
        at = Standing(*self.standing.get()) if self.standing.exists() else Standing()
        return at, [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []

    def _table(self, rows: list[tuple]) -> pd.DataFrame:
        names = [f.split()[0] for f in REPORT.split(", ")]
        return pd.DataFrame(rows, columns=names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, lines = self._stored()
        known = {x[0] for x in lines}
        for frame in rows:
            for seq, ts, url, saved in zip(frame["seq"], frame["ts_us"], frame["url"], frame["saved"], strict=True):
                if seq <= at.seq:
                    at.late += 1
                elif seq not in known:
                    known.add(seq)
                    lines.append((int(seq), int(ts), url if isinstance(url, str) else None, bool(saved)))
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        yield self._table(self._settle(key[0], at, lines, watermark))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, lines = self._stored()
        if at.first_ts is not None or lines:
            yield self._table(self._settle(key[0], at, lines, timerValues.getCurrentWatermarkInMs() * 1000))


class RunReports:
    """Follows runs with keyed state and keeps their reports in a table.

    Each batch appends the reports of the runs it touched; its number names their
    folder, so a repeated batch replaces its own.
    """

    def __init__(self, spark: SparkSession, root: str, silence: str = "1 hour", delay: str = "10 minutes"):
        self.spark, self.root, self.delay = spark, root.rstrip("/"), delay
        self.silence_us = int(
            spark.range(1).select((F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {silence}")))).first()[0]
        )

    def start(self, lines: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take all lines (run_id, seq, ts, line) that are there, and go on from the checkpoint another time."""
        ship_package(self.spark)
        # Maps and timers in the state need this store; the setting is read as the query starts.
        self.spark.conf.set(STATE_STORE_SETTING, STATE_STORE)
        parsed = crawl_log.parse_lines(lines).where("run_id is not null and seq is not null and ts is not null")
        stamped = parsed.withColumn("ts_us", F.unix_micros("ts")).withWatermark("ts", self.delay)
        reports = stamped.groupBy("run_id").transformWithStateInPandas(
            RunProcessor(self.silence_us), REPORT, "Update", "EventTime"
        )

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.root}/batch={number}")

        return (
            reports.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )

    def read(self) -> DataFrame:
        """``run_id, started_at, n_urls, elapsed_s, rate, late, final``: the parts of runs as they stand.

        Final reports stay; of the others those of the last batch that touched a run count.
        """
        rows = self.spark.read.schema(REPORT + ", batch long").option("basePath", self.root).parquet(self.root)
        last = rows.groupBy("run_id").agg(F.max("batch").alias("batch"))
        standing = rows.where("not final").join(last, ["run_id", "batch"], "left_semi")
        both = rows.where("final").unionByName(standing)
        elapsed = F.floor(F.col("ended_us") / 1_000_000) - F.floor(F.col("started_us") / 1_000_000)
        return both.select(
            "run_id", F.timestamp_micros("started_us").alias("started_at"), "n_urls", elapsed.alias("elapsed_s"),
            F.when(elapsed > 0, F.col("n_urls") / elapsed).otherwise(0.0).alias("rate"), "late", "final",
        )
