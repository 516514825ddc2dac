"""Exports with a result for every bundle: earlier ones stay until a whole one takes their place."""

import os

import pytest
from pyspark.sql import functions as F

from docloom.sources import exports
from docloom.sources.exports import ExportStore

DOCS = "bundle string, doc_path string, body string"


def table(spark, *rows):
    return spark.createDataFrame(list(rows), DOCS)


def content(store):
    return sorted((r.bundle, r.doc_path, r.body) for r in store.read(DOCS).collect())


def outcomes(rows):
    return {r.bundle: r.reason for r in rows.collect()}


def test_bundles_that_fail_keep_their_earlier_export(spark, tmp_path):
    store = ExportStore(spark, f"{tmp_path}/out")
    asked = spark.createDataFrame([("a",), ("gone",), ("gone",)], "bundle string")
    first = store.publish(table(spark, ("a", "a/1.md", "x"), ("a", "a/2.md", "y"), ("b/c d", "1.md", "z")), asked)
    assert outcomes(first) == {"a": None, "b/c d": None, "gone": exports.NOT_FOUND}
    before = content(store)
    second = store.publish(table(
        spark, ("a", "../1.md", "new"), ("a", "a/2.md", "new"), ("b/c d", "1.md", None), ("e", "1.md", "e"), ("e", "1.md", "e")
    ))
    assert outcomes(second) == {"a": exports.UNSAFE_PATH, "b/c d": exports.NO_TEXT, "e": None}
    assert content(store) == sorted([*before, ("e", "1.md", "e"), ("e", "1.md", "e")])
    # A later whole export takes the place of the earlier one.
    assert outcomes(store.publish(table(spark, ("a", "a/3.md", "3")))) == {"a": None}
    assert [r for r in content(store) if r[0] == "a"] == [("a", "a/3.md", "3")]
    places = {r.bundle: r for r in store.current().collect()}
    assert places["a"].version == 3 and places["b/c d"].version == 1 and places["a"].n_docs == 1
    assert all(os.path.isdir(r.path.removeprefix("file:").replace("//", "/", 1)) or "%" in r.path for r in places.values())


def test_a_failed_write_leaves_the_earlier_export(spark, tmp_path):
    store = ExportStore(spark, f"{tmp_path}/out")
    docs = table(spark, ("a", "1.md", "x"))
    store.publish(docs)
    broken = F.udf(lambda b: 1 / 0, "string")
    store._write, write = (lambda rows, folder: write(rows.withColumn("body", broken("body")), folder)), store._write
    assert outcomes(store.publish(docs.withColumn("body", F.lit("y"))))["a"].startswith("export failed: ")
    assert content(store) == [("a", "1.md", "x")] and len(os.listdir(f"{tmp_path}/out/exports")) == 1
    # Other content than asked for is found out.
    store._write = lambda rows, folder: write(rows.withColumn("body", F.lit("other")), folder)
    assert outcomes(store.publish(docs)) == {"a": exports.DIFFERENT}
    assert content(store) == [("a", "1.md", "x")]


def test_of_two_writers_the_second_fails(spark, tmp_path):
    store, docs = ExportStore(spark, f"{tmp_path}/out"), table(spark, ("a", "1.md", "x"))
    stale = store.results()
    store.publish(docs)
    late = ExportStore(spark, f"{tmp_path}/out")
    late.results = lambda: stale
    with pytest.raises(Exception, match="(?i)exist"):
        late.publish(docs.withColumn("body", F.lit("late")))
    assert content(store) == [("a", "1.md", "x")]


def test_nothing_to_export(spark, tmp_path):
    store = ExportStore(spark, f"{tmp_path}/out")
    assert store.current().isEmpty() and store.read(DOCS).isEmpty()
    assert store.publish(table(spark, ("a", "1.md", "x")).limit(0)).isEmpty()
    assert outcomes(store.publish(table(spark, ("a", None, "x")))) == {"a": exports.UNSAFE_PATH}
