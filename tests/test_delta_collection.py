"""A collection kept by deltas against one that is written anew each time."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.upsert import upsert
from docloom.sources.delta_collection import DeltaCollection

COLUMNS = T.StructType([
    T.StructField("bundle", T.StringType()), T.StructField("doc_path", T.StringType()), T.StructField("body", T.StringType()),
])


def rows_of(df):
    return sorted((r.bundle, r.doc_path, r.body) for r in df.collect())


@pytest.mark.parametrize("limits", [{}, {"max_deletes": 10}, {"max_runs": 2}])
def test_deliveries_equal_whole_upserts(spark, tmp_path, limits):
    rng = random.Random(4)
    store = DeltaCollection(spark, f"{tmp_path}/store", COLUMNS, **limits)
    assert store.version() == 0 and store.read().isEmpty()
    whole, versions = spark.createDataFrame([], COLUMNS), {}
    for step in range(6):
        keys = {(f"b{rng.randrange(4)}", f"p{rng.randrange(60):02d}.md") for _ in range((40, 5, 0, 12, 30, 3)[step])}
        new = spark.createDataFrame([(*k, f"body {step}") for k in sorted(keys)], COLUMNS)
        whole = spark.createDataFrame(rows_of(upsert(whole, new, step == 3)), COLUMNS)
        versions[store.upsert(new, replace_bundles=step == 3)] = rows_of(whole)
        assert rows_of(store.read()) == rows_of(whole)
    # Earlier versions are still there, before and after the collection is written anew.
    store.compact()
    assert all(rows_of(store.read(v)) == rows for v, rows in versions.items())
    assert rows_of(store.read()) == rows_of(whole) and len(store.live()) == 1


def test_a_small_delivery_touches_few_files(spark, tmp_path):
    store = DeltaCollection(spark, f"{tmp_path}/store", COLUMNS)
    docs = spark.range(4000).select(
        F.lit("b").alias("bundle"), F.format_string("p%05d", "id").alias("doc_path"), F.lit("x" * 200).alias("body")
    )
    # Enough files that ranges can tell them apart.
    store._write_run, plain = (lambda rows: plain(rows.repartitionByRange(8, "doc_path"))), store._write_run
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.upsert(docs)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    first = store.live()[0]
    files = spark.read.parquet(first["ranges"]).count()
    assert files >= 4
    new = docs.where("id in (17, 18, 19)").withColumn("body", F.lit("new"))
    assert store.touched(new.select("bundle", "doc_path"), store.live()).count() == 1
    store.upsert(new)
    last = store.live()[-1]
    assert (last["n_rows"], last["n_deletes"], last["whole"]) == (3, 3, False)
    assert store.read().count() == 4000 and store.read().where("body = 'new'").count() == 3
    assert store.read(1).where("body = 'new'").isEmpty()


def test_a_killed_writer_leaves_no_trace(spark, tmp_path):
    store = DeltaCollection(spark, f"{tmp_path}/store", COLUMNS)
    store.upsert(spark.createDataFrame([("b", "p", "1")], COLUMNS))
    # Killed before its commit.
    store._write_run(spark.createDataFrame([("b", "p", "2")], COLUMNS))
    assert rows_of(store.read()) == [("b", "p", "1")]
    # Of two writers of one version the second fails.
    other = DeltaCollection(spark, f"{tmp_path}/store", COLUMNS)
    stale = other.live()
    store.upsert(spark.createDataFrame([("b", "p", "3")], COLUMNS))
    other.live = lambda version=None: stale
    with pytest.raises(Exception, match="(?i)exist"):
        other.upsert(spark.createDataFrame([("b", "p", "4")], COLUMNS))
    assert rows_of(store.read()) == [("b", "p", "3")] and sorted(os.listdir(f"{tmp_path}/store/log")) == ["1", "2"]
