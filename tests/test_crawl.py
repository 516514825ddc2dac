import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom import schema
from docloom.functions import urls
from docloom.operators import crawl_graph, crawl_log, scope
from docloom.sources import logs
from docloom.streaming.progress import ProgressStream

START = datetime(2024, 1, 1)


def test_depth(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(6)]
    cycle = [("n2", "n0"), ("n1", "n1"), ("x", "n3")]
    edges = spark.createDataFrame(chain + cycle + chain, "src string, dst string")
    seeds = spark.createDataFrame([("n0",), ("n0",)], "url string")
    depth = {r.url: r.depth for r in crawl_graph.crawl_depth(edges, seeds).collect()}
    assert depth == {f"n{i}": i for i in range(6)}
    assert crawl_graph.crawl_depth(edges, seeds, max_depth=1).count() == 2


def test_depth_with_filters(spark):
    rng = random.Random(2)
    pairs = [(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(500)] + [("n1", None), (None, "n2")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    seeds = spark.createDataFrame([("n0",), ("n0",), ("n7",)], "url string")
    for depth in (0, 3, 20):
        plain = crawl_graph.crawl_depth(edges, seeds, depth).collect()
        found = crawl_graph.crawl_depth_filtered(edges, seeds, depth, buckets=8).collect()
        assert Counter((r.url, r.depth) for r in found) == Counter((r.url, r.depth) for r in plain)
    assert crawl_graph.crawl_depth_filtered(edges, seeds.limit(0)).isEmpty()


def test_scope_by_seed(spark):
    seeds = scope.seeds_from_urls(
        spark.createDataFrame([("https://h/docs/start",), ("https://h/api/",), ("bad",)], "url string")
    )
    candidates = spark.createDataFrame(
        [("https://h/docs/a",), ("https://h/api/b",), ("https://h/x",), ("https://other/docs/a",), ("https://h/docs/x.pdf",), (None,)],
        "resolved string",
    )
    marked = {r.resolved: r.in_scope for r in scope.mark_scope(candidates, seeds).collect()}
    assert {u for u, ok in marked.items() if ok} == {"https://h/docs/a", "https://h/api/b"}
    assert len(marked) == 6
    # The same by comparing every candidate with every seed.
    pairs = candidates.join(seeds).where(
        urls.in_scope(F.col("resolved"), F.col("seed_host"), F.col("seed_directory"))
    )
    assert {r.resolved for r in pairs.collect()} == {u for u, ok in marked.items() if ok}


def test_page_hrefs(spark):
    pages = spark.createDataFrame(
        [(1, "https://h/a/b", '<a href="/x">x</a><a href="y">y</a><a href="#z">z</a>')], schema.PAGES
    )
    assert [(r.ord, r.resolved) for r in scope.page_hrefs(pages).orderBy("ord").collect()] == [
        (0, "https://h/x"), (1, "https://h/a/y"), (2, "#z"),
    ]


def test_hrefs_in_all_spellings(spark):
    html = (
        "<a href='/1'>a</a><a href=/2>b</a><A HREF=\"/3\">c</A><a class=\"q\" data-href=\"/no\" href=\"/4?x=1&amp;y=2\">d</a>"
        "<a\n\ttitle='t'\n\thref = \"/5\"\n>e</a><abbr href=/no><a name=x>f</a><area href=/no>"
    )
    pages = spark.createDataFrame([(1, "https://H.example/a", html)], schema.PAGES)
    assert [r.href for r in scope.page_hrefs(pages).orderBy("ord").collect()] == ["/1", "/2", "/3", "/4?x=1&y=2", "/5"]
    assert scope.seeds_from_urls(spark.createDataFrame([("https://DOCS.h.com/a/b",)], "url string")).first().seed_host == "docs.h.com"


def test_internal_links(spark):
    pages = spark.createDataFrame([(1, "https://h/a", ""), (2, "https://h/b/index.html", "")], schema.PAGES)
    found = spark.createDataFrame(
        [(1, "https://h/a.html"), (2, "https://h/b/#x"), (3, "https://h/c"), (4, "https://h/a.html")], "ord int, resolved string"
    )
    marked = {r.ord: r.is_internal for r in crawl_graph.mark_internal(found, pages).collect()}
    assert marked == {1: True, 2: True, 3: False, 4: True}
    assert [r.resolved for r in crawl_graph.dangling(found, pages).collect()] == ["https://h/c"]


def log_rows(run, lines):
    return [(run, i, START + timedelta(seconds=i), line) for i, line in enumerate(lines)]


def url_line(url):
    return f"--2024-01-01 00:00:00--  {url}"


LOG = (
    log_rows("r1", [
        "robots.txt saved", url_line("https://h/a"), "Saving to: 'a'", "x", "'a' SAVED [1]",
        url_line("https://h/a"), "'a' saved", url_line("https://h/b"), url_line("https://h/c"), "saved",
    ])
    + log_rows("r2", [url_line("https://h/z"), "nothing"])
    + log_rows("r3", ["saved"])
)
EXPECTED = {"r1": (3, 9, 3 / 9), "r2": (0, 1, 0.0), "r3": (1, 0, 0.0)}


@pytest.mark.parametrize("block", [1, 2, 3, 100_000])
def test_progress(spark, block):
    log = spark.createDataFrame(LOG, schema.CRAWL_LOG)
    rows = {r.run_id: (r.n_urls, r.elapsed_s, r.rate) for r in crawl_log.progress(log, block).collect()}
    assert rows == EXPECTED


@pytest.mark.parametrize("per_file", [1, 3, 100])
def test_progress_stream(spark, tmp_path, per_file):
    source = tmp_path / "log"
    source.mkdir()
    for i in range(0, len(LOG), per_file):
        part = spark.createDataFrame(LOG[i:i + per_file], schema.CRAWL_LOG).coalesce(1)
        text = "\n".join(r.j for r in part.select(F.to_json(F.struct("*")).alias("j")).collect())
        (source / f"{i:04d}.json").write_text(text)
    follower = ProgressStream(spark, str(tmp_path / "out"), block_lines=2)
    run = follower.start(logs.stream_log(spark, str(source)), str(tmp_path / "checkpoint"))
    run.awaitTermination()
    last = run.lastProgress["batchId"]
    assert {r.run_id: (r.n_urls, r.elapsed_s, r.rate) for r in follower.report(last).collect()} == EXPECTED
    # The next files go on from the stored state.
    more = spark.createDataFrame(
        [("r2", 2, START + timedelta(seconds=4), "saved")], schema.CRAWL_LOG
    ).select(F.to_json(F.struct("*"))).first()[0]
    (source / "zz.json").write_text(more)
    run = follower.start(logs.stream_log(spark, str(source)), str(tmp_path / "checkpoint"))
    run.awaitTermination()
    after = {r.run_id: r.n_urls for r in follower.report(run.lastProgress["batchId"]).collect()}
    assert after == {"r1": 3, "r2": 1, "r3": 1}


def test_outcomes(spark):
    runs = spark.createDataFrame([(i, c) for i, c in enumerate([0, 4, 6, 8, 3, 0, 1])], "run_id int, exit_code int")
    assert Counter({r.outcome: r.n for r in crawl_log.outcomes(runs).collect()}) == Counter(
        {"complete": 2, "network failure": 1, "authentication failure": 1, "server error": 1, "incomplete": 2}
    )


def test_reachable_pages(spark):
    """A chain of seven, a cycle, and links off the host, above the start and to a file."""
    from docloom.plans.crawl import reachable

    def page(i, *hrefs):
        return (i, f"https://h/docs/n{i}", "".join(f'<a href="{h}">x</a>' for h in hrefs))

    pages = [page(i, f"n{i + 1}#part") for i in range(6)] + [page(6, "n0")]
    pages[0] = page(0, "n1#part", "https://other/docs/x", "/above", "x.pdf", "#here", "n0")
    reached = reachable(
        spark.createDataFrame(pages, schema.PAGES),
        spark.createDataFrame([("https://h/docs/n0",)], "url string"),
    )
    assert {r.url: r.depth for r in reached.collect()} == {f"https://h/docs/n{i}": i for i in range(6)}
