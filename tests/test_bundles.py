import pytest
from pyspark.sql import functions as F

from docloom import schema
from docloom.operators import bundles, collisions, upsert
from docloom.sources.collection import Collection, IngestLog, export_bundles

SIZED = "bundle string, doc_path string, md_bytes long"
LIMIT = 8_388_608


def manifest(spark, rows):
    return spark.createDataFrame(rows, schema.MANIFEST)


def report(spark, docs, described, requested=None):
    asked = None if requested is None else spark.createDataFrame([(b,) for b in requested], "bundle string")
    out = bundles.report(spark.createDataFrame(docs, SIZED), manifest(spark, described), asked)
    return {r.bundle: r for r in out.collect()}


def test_size_limit(spark):
    rows = report(
        spark,
        [("at", "at/a.md", LIMIT - 5), ("at", "at/b.png", 5), ("over", "over/a.md", LIMIT + 1)],
        [("at", "at", "d", None), ("over", "over", "d", None)],
    )
    assert not rows["at"].over_limit and rows["at"].total_mb == 8.0
    assert (rows["at"].n_files, rows["at"].n_md) == (2, 1)
    assert rows["over"].over_limit and rows["over"].valid
    assert rows["over"].warnings == ["size limit exceeded"]


def test_validation(spark):
    whole = "---\nname: x\ndescription: y\n---"
    rows = report(
        spark,
        [("good", "good/a.md", 1), ("bare", "bare/a.md", 1), ("nomd", "nomd/a.txt", 1), ("fields", "f.md", 1),
         ("nofm", "a.md", 1), ("open", "a.md", 1)],
        [("good", "good", "d", whole), ("empty", "empty", "d", None), ("nomd", "nomd", "d", None),
         ("fields", None, None, None), ("nofm", "n", "d", "# x"), ("open", "n", "d", "---\nname: x")],
        ["good", "absent"],
    )
    assert rows["good"].valid and rows["good"].warnings == []
    assert (rows["bare"].valid, rows["bare"].errors) == (False, ["descriptor not found"])
    assert (rows["empty"].valid, rows["empty"].errors) == (False, ["documents not found"])
    assert (rows["absent"].valid, rows["absent"].errors) == (False, ["bundle not found"])
    assert rows["nomd"].valid and rows["nomd"].warnings == ["no Markdown documents"]
    assert rows["fields"].valid
    assert rows["fields"].warnings == ["descriptor lacks name", "descriptor lacks description"]
    assert rows["nofm"].warnings == ["descriptor has no frontmatter"]
    assert rows["open"].warnings == ["descriptor frontmatter is incomplete"]


def test_ten_largest(spark):
    docs = [("b", f"b/{i:02d}.md", 100 + i % 6) for i in range(12)]
    row = report(spark, docs, [("b", "b", "d", None)])["b"]
    expected = sorted(docs, key=lambda d: (-d[2], d[1]))[:10]
    assert [f.doc_path for f in row.top_files] == [d[1] for d in expected]


def test_manifest_and_insert_missing(spark):
    docs = spark.createDataFrame(
        [("acme", "a.md", "x", 3), ("acme", "b.md", "y", 4)], "bundle string, doc_path string, body string, md_bytes long"
    )
    row = bundles.manifest(docs).first()
    assert (row.description, row.n_docs, row.total_bytes) == ("ACME documentation assistant", 2, 7)
    assert bundles.manifest(docs.orderBy(F.desc("doc_path"))).first().content_hash == row.content_hash
    assert bundles.descriptor_text(bundles.manifest(docs)).first().descriptor.startswith("---\nname: acme\n")
    old = spark.createDataFrame([("acme", "kept")], "bundle string, description string")
    new = spark.createDataFrame([("acme", "dropped"), ("zeta", "added")], "bundle string, description string")
    assert sorted(map(tuple, upsert.insert_missing(old, new).collect())) == [("acme", "kept"), ("zeta", "added")]


def document(path, page_id, body, bundle="b"):
    return (bundle, path, page_id, "t", None, None, body, len(body))


def test_upsert_store(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "c"))
    assert store.version() == 0 and store.read().count() == 0
    store.upsert(spark.createDataFrame([document("a", 1, "old"), document("b", 2, "stale")], schema.DOCS))
    store.upsert(spark.createDataFrame([document("a", 3, "new"), document("c", 4, "more")], schema.DOCS))
    assert {r.doc_path: r.body for r in store.read().collect()} == {"a": "new", "b": "stale", "c": "more"}
    store.upsert(spark.createDataFrame([document("d", 5, "only")], schema.DOCS), replace_bundles=True)
    assert {r.doc_path for r in store.read().collect()} == {"d"}
    assert store.version() == 3


def test_uncommitted_snapshot_is_ignored(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "c"))
    store.upsert(spark.createDataFrame([document("a", 1, "x")], schema.DOCS))
    spark.createDataFrame([document("z", 9, "half")], schema.DOCS).write.parquet(f"{store._location(2)}-x")
    assert [r.doc_path for r in store.read().collect()] == ["a"]
    store.upsert(spark.createDataFrame([document("b", 2, "y")], schema.DOCS))
    assert {r.doc_path for r in store.read().collect()} == {"a", "b"}


def test_ingest_log_replay(spark, tmp_path):
    log = IngestLog(spark, str(tmp_path / "log"))
    first = spark.createDataFrame([document("a", 5, "v5"), document("b", 1, "v1")], schema.DOCS)
    second = spark.createDataFrame([document("a", 2, "late"), document("b", 1, "again")], schema.DOCS)
    log.append(first, 0)
    log.append(second, 1)
    log.append(second, 1)
    assert {r.doc_path: r.body for r in log.current().collect()} == {"a": "late", "b": "again"}


def test_a_version_is_committed_once(spark, tmp_path):
    one, other = (Collection(spark, str(tmp_path / "c")) for _ in range(2))
    one.upsert(spark.createDataFrame([document("a", 1, "x")], schema.DOCS))
    other.version = lambda: 0
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        other.commit(spark.createDataFrame([document("a", 2, "lost")], schema.DOCS))
    assert [r.body for r in one.read().collect()] == ["x"]


def test_repeated_ids_settle_on_one_row(spark):
    rows = [document("a", 1, "old"), document("a", 1, "same"), document("a", 1, "same"), document("b", 2, "x")]
    kept = collisions.keep_winners(spark.createDataFrame(rows, schema.DOCS)).collect()
    assert sorted((r.doc_path, r.page_id) for r in kept) == [("a", 1), ("b", 2)]


def test_export_replaces_only_its_bundles(spark, tmp_path):
    out = str(tmp_path / "out")
    export_bundles(spark.createDataFrame([document("a", 1, "x", "p"), document("a", 1, "y", "q")], schema.DOCS), out)
    export_bundles(spark.createDataFrame([document("z", 1, "new", "p")], schema.DOCS), out)
    assert {(r.bundle, r.doc_path) for r in spark.read.parquet(out).collect()} == {("p", "z"), ("q", "a")}
