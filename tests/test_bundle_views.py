"""Bundle views kept by signed deltas against the same reports from scratch."""

import random

from pyspark.sql import types as T

from docloom.operators import bundles
from docloom.sources.bundle_views import BundleViews
from docloom.sources.delta_collection import DeltaCollection

COLUMNS = T.StructType([
    T.StructField("bundle", T.StringType()), T.StructField("doc_path", T.StringType()),
    T.StructField("body", T.StringType()), T.StructField("md_bytes", T.LongType()),
])


def rows_of(df):
    return sorted(map(repr, df.collect()))


def check(views, docs):
    docs = docs.cache()
    assert rows_of(views.sizes()) == rows_of(bundles.sizes(docs))
    assert rows_of(views.index_pages()) == rows_of(bundles.index_pages(docs))
    names = ("bundle", "n_docs", "total_bytes", "content_hash")
    assert rows_of(views.manifest()) == rows_of(bundles.manifest(docs).select(*names))
    names = ("bundle", "rank", "doc_path", "md_bytes", "kb")
    assert rows_of(views.largest_docs().select(*names)) == rows_of(bundles.largest_docs(docs, views.shown).select(*names))


def delivery(spark, rng, step, n, big=40):
    keys = {(f"b{rng.randrange(3)}", f"p{rng.randrange(40):02d}{rng.choice(['.md', '.txt', '/index.md'])}") for _ in range(n)}
    return spark.createDataFrame([(*k, f"body {step}", rng.randrange(1, big)) for k in sorted(keys)], COLUMNS)


def test_views_equal_reports_from_scratch(spark, tmp_path):
    rng = random.Random(11)
    store = DeltaCollection(spark, f"{tmp_path}/store", COLUMNS, max_runs=2)
    views = BundleViews(spark, f"{tmp_path}/views", store, shown=3, kept=2)
    assert views.refresh() == 0 and views.sizes().isEmpty()
    refilled = 0
    for step, (n, whole) in enumerate([(90, False), (50, False), (0, False), (5, True)]):
        # Later deliveries are smaller documents, so that the largest ones go.
        store.upsert(delivery(spark, rng, step, n, 40 - 7 * step), replace_bundles=whole)
        views.refresh()
        refilled += views.refilled
        check(views, store.read())
    assert refilled > 0
    # Nothing new: nothing is written.
    before = views.state.version()
    views.refresh()
    assert views.state.version() == before


def test_views_catch_up_over_several_commits(spark, tmp_path):
    rng = random.Random(5)
    store = DeltaCollection(spark, f"{tmp_path}/store", COLUMNS)
    for step in range(2):
        store.upsert(delivery(spark, rng, step, 25))
    store.compact()
    assert store.changes(3) is None
    views = BundleViews(spark, f"{tmp_path}/views", store, shown=4, kept=1)
    views.refresh()
    check(views, store.read())
    descriptors = bundles.manifest(store.read())
    assert rows_of(views.report(descriptors).select("bundle", "n_files", "valid")) == rows_of(
        bundles.report(store.read(), descriptors).select("bundle", "n_files", "valid"))


def test_small_delivery_writes_its_bundles_only(spark, tmp_path):
    rng = random.Random(6)
    store = DeltaCollection(spark, f"{tmp_path}/store", COLUMNS)
    views = BundleViews(spark, f"{tmp_path}/views", store)
    store.upsert(delivery(spark, rng, 0, 60))
    views.refresh()
    store.upsert(spark.createDataFrame([("b1", "new.md", "x", 7), ("b9", "a.md", None, None)], COLUMNS))
    views.refresh()
    assert views.state.live()[-1]["n_rows"] == 2
    docs = store.read()
    assert {r.bundle: r.n_files for r in views.sizes().collect()} == {r.bundle: r.n_files for r in bundles.sizes(docs).collect()}


def test_null_bundle_and_null_size(spark, tmp_path):
    store = DeltaCollection(spark, f"{tmp_path}/store", COLUMNS)
    views = BundleViews(spark, f"{tmp_path}/views", store)
    for body in ("a", "b"):
        store.upsert(spark.createDataFrame([(None, f"{body}.md", body, 1), ("", f"{body}.md", body, None)], COLUMNS))
        views.refresh()
    assert sorted((r.bundle or "", r.bundle is None, r.n_files, r.total_bytes) for r in views.sizes().collect()) == [
        ("", False, 2, 0), ("", True, 2, 2)]
    assert {(r.bundle, r.rank, r.md_bytes) for r in views.largest_docs().collect()} == {
        (None, 1, 1), (None, 2, 1), ("", 1, None), ("", 2, None)}
