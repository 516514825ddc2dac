"""Link status kept by deliveries against one join of all links and pages."""

import random

import pytest

from docloom.operators import crawl_graph
from docloom.sources.link_status import LinkStatus


def status_of(df):
    rows = [(r.resolved, r.is_internal) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_deliveries_equal_one_join(spark, tmp_path):
    rng = random.Random(3)
    store = LinkStatus(spark, f"{tmp_path}/links", buckets=2)
    assert store.read().isEmpty()
    links, pages, settled = [], [], 0
    for number in range(3):
        # Pages come late, early, twice and never; a link may have several forms of one page.
        n_links, n_pages = ((30, 8), (0, 25), (25, 15))[number]
        new_links = [(f"https://h.org/p{rng.randrange(50)}{rng.choice(['', '.html', '/', '#x'])}",) for _ in range(n_links)] + [(None,)]
        new_pages = [(f"https://h.org/p{rng.randrange(60)}.html",) for _ in range(n_pages)]
        links, pages = links + new_links, pages + new_pages
        settled += store.deliver(
            spark.createDataFrame(new_links, "resolved string"), spark.createDataFrame(new_pages, "url string"), number)
        assert status_of(store.read()) == status_of(crawl_graph.link_targets(
            spark.createDataFrame(links, "resolved string"), spark.createDataFrame(pages, "url string")))
    assert settled > 0


def test_a_delivery_that_was_cut_off_is_given_again(spark, tmp_path, monkeypatch):
    link = spark.createDataFrame([("https://h.org/a.html",), ("https://h.org/b",)], "resolved string")
    page = spark.createDataFrame([("https://h.org/a",)], "url string")
    none = link.limit(0), page.limit(0)
    store = LinkStatus(spark, f"{tmp_path}/links", buckets=2)
    store.deliver(link, none[1], 0)
    with monkeypatch.context() as patch:
        patch.setattr(spark, "createDataFrame", None)  # the log cannot be written
        with pytest.raises(TypeError):
            store.deliver(none[0], page, 1)
    assert status_of(store.read()) == {("https://h.org/a.html", False), ("https://h.org/b", False)}
    assert store.deliver(none[0], page, 1) == 1
    # A delivery that counts is not taken twice, and none comes before a later one.
    assert store.deliver(link, page, 1) == 0
    assert status_of(store.read()) == {("https://h.org/a.html", True), ("https://h.org/b", False)}
    assert {r.resolved: r.since for r in store.read().collect()} == {"https://h.org/a.html": 1, "https://h.org/b": 0}
    store.deliver(*none, 5)
    with pytest.raises(ValueError):
        store.deliver(*none, 3)
