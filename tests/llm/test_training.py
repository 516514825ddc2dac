"""Bounded samples for classifiers, at any number of rows."""

import pytest

from docloom.llm import training


@pytest.mark.parametrize("total", [20_001, 10**7, 10_100_000_000, 2 * 10**10, 10**11, 10**15])
def test_the_share_follows_the_number_of_rows(total):
    share = training.threshold(training.SAMPLE_ROWS, total) / (1 << 62)
    assert share == pytest.approx(training.SAMPLE_ROWS / total, rel=1e-9)


def test_drawn_rows_are_about_the_bound(spark):
    rows = spark.range(50_000).toDF("doc_id")
    for bound in (100, 5_000, 25_000):
        n = training.drawn(rows, "doc_id", bound).count()
        assert abs(n - bound) < 5 * bound**0.5
    assert training.drawn(rows, "doc_id", 50_000).count() == 50_000
    assert training.drawn(rows.limit(0), "doc_id").count() == 0
