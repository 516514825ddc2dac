"""Keyed state of crawl runs against the batch job, and its rules for late lines and silent runs."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from docloom.operators import crawl_log
from docloom.sources import logs
from docloom.streaming.run_state import BUCKETS, RunProcessor, RunReports, Standing

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def request(url, at):
    return f"--{at:%Y-%m-%d %H:%M:%S}--  {url}"


def run_lines(run, first, urls, step=10):
    """A request and a saved line for each URL, one file saved before any request."""
    out = [(run, -1, START + timedelta(seconds=first), "'robots.txt' saved [1/1]")]
    for i, url in enumerate(urls):
        at = START + timedelta(seconds=first + step * i)
        out += [(run, 3 * i + 1, at, request(url, at)), (run, 3 * i + 2, at, "200 OK"), (run, 3 * i + 3, at, "'x' SAVED [1/1]")]
    return out


def deliver(spark, folder, reports, checkpoint, batches):
    fields = "run_id string, seq long, ts timestamp, line string"
    for rows in batches:
        spark.createDataFrame(rows, fields).write.mode("append").json(folder)
        reports.start(logs.stream_log(spark, folder), checkpoint).awaitTermination()


def test_reports_equal_the_batch_job_however_lines_are_cut(spark, tmp_path):
    lines = run_lines("a", 0, [f"http://h/{i % 7}" for i in range(40)]) + run_lines("b", 35, ["http://h/x"] * 9)
    lines += [(None, 1, START, "saved"), ("c", 5, START + timedelta(seconds=50), "nothing")]
    whole = spark.createDataFrame(lines[:-2] + lines[-1:], "run_id string, seq long, ts timestamp, line string")
    expected = {r.run_id: (r.n_urls, r.elapsed_s, r.rate) for r in crawl_log.progress(whole).collect()}
    for cut, batches in enumerate((
        [lines], [lines[:30], lines[30:]],
        # Out of order, but within the delay; and some lines come twice.
        [lines[1::2], lines[::2], lines[:40]],
    )):
        reports = RunReports(spark, f"{tmp_path}/out{cut}", silence="1 day", delay="1 hour")
        deliver(spark, f"{tmp_path}/in{cut}", reports, f"{tmp_path}/c{cut}", batches)
        found = reports.read().collect()
        assert {r.run_id: (r.n_urls, r.elapsed_s, r.rate) for r in found} == expected
        assert len(found) == 3 and not any(r.final or r.late for r in found)


def test_silent_runs_are_closed_and_late_lines_left_out(spark, tmp_path):
    first = run_lines("a", 0, ["http://h/1", "http://h/2"])
    # The same URL counts again in another part; the first saved line there has no URL yet.
    later = [(run, seq + 100, ts, line) for run, seq, ts, line in run_lines("a", 4000, ["http://h/1"])]
    other = run_lines("b", 4000, ["http://h/1"])
    late = [("a", 3, START + timedelta(seconds=1), "'late' SAVED [1/1]")]
    end = run_lines("z", 20_000, ["http://h/1"])
    reports = RunReports(spark, f"{tmp_path}/out", silence="10 minutes", delay="1 minute")
    deliver(spark, f"{tmp_path}/in", reports, f"{tmp_path}/c", [first, later + other, late, end])
    rows = {(r.run_id, int((r.started_at.replace(tzinfo=timezone.utc) - START).total_seconds())): r
            for r in reports.read().withColumn("started_at", F.to_utc_timestamp("started_at", F.current_timezone())).collect()}
    assert set(rows) == {("a", 0), ("a", 4000), ("b", 4000), ("z", 20_000)}
    assert [rows[k].n_urls for k in (("a", 0), ("a", 4000), ("b", 4000))] == [3, 2, 2]
    assert rows["a", 0].final and rows["a", 4000].final and rows["b", 4000].final and not rows["z", 20_000].final
    # The store keeps the one run that may go on; its lines still wait for the watermark.
    state = spark.read.format("statestore").option("stateVarName", "standing").load(f"{tmp_path}/c")
    assert [r.key.run_id for r in state.collect()] == ["z"]
    assert spark.read.format("statestore").option("stateVarName", "urls").load(f"{tmp_path}/c").isEmpty()


class CountedMap(dict):
    """A stored map that counts its calls."""

    calls = 0

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self[key] = value

    def clear(self):
        self.calls += 1
        super().clear()


def test_calls_to_the_store_do_not_grow_with_lines():
    processor, at = RunProcessor(silence_us=1000), Standing()
    processor.urls = CountedMap()
    first = [(i, i, f"http://h/{i // 2}", True) for i in range(20_000)]
    assert list(processor._fold("a", at, first)) == [] and at.n_urls == 10_000
    assert processor.urls.calls <= BUCKETS
    more = [(20_000 + i, 20_000 + i, f"http://h/{i}", True) for i in range(15_000)]
    shown = list(processor._preview("a", at, more))
    assert [r[3] for r in shown] == [15_000] and at.n_urls == 10_000
    assert list(processor._fold("a", at, more)) == [] and at.n_urls == 15_000
    assert processor.urls.calls <= 5 * BUCKETS
    # Silence ends the part; the next one starts with nothing saved.
    ended = list(processor._fold("a", at, [(50_000, 50_000, "http://h/1", True), (60_000, 60_000, "http://h/1", True)]))
    assert [(r[3], r[5]) for r in ended] == [(15_000, True), (1, True)] and at.n_urls == 1
    assert [list(v[0]) for v in processor.urls.values()] == [["http://h/1"]]
