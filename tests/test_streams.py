from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from docloom import schema
from docloom.operators import crawl_log
from docloom.sources.collection import IngestLog
from docloom.streaming import activity, ingest
from docloom.streaming.known_keys import KnownKeys
from docloom.streaming.url_sketches import UrlSketches

STAMP = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_ingest_equals_batch(spark, tmp_path):
    source = tmp_path / "pages"
    for i in range(3):
        spark.createDataFrame(
            [(10 * i + j, f"https://h/p{j}", f"<main>{i}-{j}</main>") for j in range(3)] + [(100 + i, "https://h/bad", "")],
            schema.PAGES,
        ).coalesce(1).write.mode("append").parquet(str(source))
    log_path = str(tmp_path / "log")
    pages = ingest.stream_pages(spark, str(source), files_per_batch=1)
    ingest.start_ingest(pages, log_path, str(tmp_path / "checkpoint"), STAMP).awaitTermination()
    current = IngestLog(spark, log_path).current()
    assert {r.doc_path: (r.page_id, r.body) for r in current.collect()} == {
        f"h/p{j}.md": (20 + j, f"2-{j}") for j in range(3)
    }
    # Another run with nothing new changes nothing.
    ingest.start_ingest(pages, log_path, str(tmp_path / "checkpoint"), STAMP).awaitTermination()
    assert IngestLog(spark, log_path).current().count() == 3


def test_recent_duplicates(spark, small, tmp_path):
    events = activity.stream_events(spark, small)
    out = str(tmp_path / "out")
    recent = activity.first_seen_recently(events, ["user_id", "event_type"], "400 days").select("user_id", "event_type")
    activity.run_to_table(recent, out, str(tmp_path / "c")).awaitTermination()
    expected = spark.read.parquet(f"{small}/events.parquet").select("user_id", "event_type").distinct().count()
    assert spark.read.parquet(out).count() == expected


def test_rate_windows(spark, small, tmp_path):
    out = str(tmp_path / "out")
    rates = activity.rate(activity.stream_events(spark, small), "1 day")
    activity.run_updates(rates, out, str(tmp_path / "c")).awaitTermination()
    table = activity.latest(spark, out, "window_start")
    assert table.agg(F.sum("n")).first()[0] == 1000
    assert table.where("abs(per_hour - n / 24) > 1e-9").count() == 0


def test_keys_are_told_over_any_span(spark, tmp_path):
    root = f"{tmp_path}/known"
    keys = KnownKeys(spark, root, ["a", "b"], buckets=4, filter_bits=1 << 16)
    batches = [
        [(1, "x"), (1, "x"), (2, None), (None, None)], [(i, "y") for i in range(300)],
        [(2, None), (None, None), (1, "x"), (5, "y"), (5, "z")], [],
    ]
    seen, expected = set(), {}
    for number, rows in enumerate(batches):
        for _ in range(2):  # a repeated batch changes nothing
            keys.add(spark.createDataFrame(rows, "a long, b string"), number)
        expected |= {r: number for r in set(rows) - seen}
        seen |= set(rows)
    assert {(r.a, r.b): r.batch for r in keys.read().collect()} == expected
    assert keys.read().count() == len(seen)


def test_buckets_without_old_keys_are_not_read(spark, tmp_path):
    keys = KnownKeys(spark, f"{tmp_path}/known", ["a"], buckets=8)
    keys.add(spark.range(0, 400).toDF("a"), 0)
    bucketed = keys._distinct(spark.createDataFrame([(17,), (10_000,), (10_001,)], "a long"))
    assert [r.a for r in keys.maybe_known(bucketed, 1).collect()] == [17]
    # A batch before the first one knows nothing.
    assert keys.maybe_known(bucketed, 0).isEmpty()
    # With the table gone, a batch of new keys still passes, as it reads none of it.
    fresh = spark.range(500_000, 500_050).toDF("a")
    keys._read = lambda kind, number=None, read=keys._read: read(kind, number) if kind == "filters" else 1 / 0
    keys.add(fresh, 1)


def test_sketches_merge_over_deliveries(spark, tmp_path):
    def line(run, seq, text):
        return run, seq, STAMP + timedelta(seconds=seq), text

    lines = [line("a", 0, "'x' saved [1/1]")]
    for i in range(4000):
        lines += [line("a", 2 * i + 1, f"--2024-01-01 00:00:00--  http://h/{i % 3000}"), line("a", 2 * i + 2, "'x' saved [1/1]")]
    lines += [line("b", 1, "--2024-01-01 00:00:00--  http://h/1"), line("b", 2, "nothing"), line("b", 4005, "'x' saved [1/1]")]
    lines += [line("c", 3, "nothing"), line("d", -7, "'x' saved [1/1]")]
    fields = "run_id string, seq long, ts timestamp, line string"
    follower = UrlSketches(spark, f"{tmp_path}/sketches", block_lines=500)
    for number, part in enumerate([(-9, 4000), (4000, 4001), (4001, 10_000)]):
        rows = [r for r in lines if part[0] <= r[1] < part[1]]
        for _ in range(2):
            follower.add(spark.createDataFrame(rows, fields), number)
    found = {r.run_id: r for r in follower.report().collect()}
    exact = {r.run_id: r for r in crawl_log.progress(spark.createDataFrame(lines, fields)).collect()}
    assert {k: r.elapsed_s for k, r in found.items()} == {k: r.elapsed_s for k, r in exact.items()}
    for numbers in (found, exact):
        assert [numbers[run].n_urls for run in "bcd"] == [1, 0, 1]
    assert exact["a"].n_urls == 3001 and abs(found["a"].n_urls - 3001) <= 3 * 1.04 / 64 * 3001
    assert spark.read.parquet(f"{tmp_path}/sketches/sketches").count() == 7
