"""The file tree source against a plain walk of the same folder."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringStartsWith

from docloom.sources.file_tree import TreeReader, list_file_tree, read_file_tree, read_listed, write_file_tree


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    files = {f"big.example/docs/p{i}.html": f"page {i}" for i in range(60)}
    files |= {f"h{i}.example/a/b/c/_n{i}.html": "é" * i for i in range(5)}
    files |= {"top.html": "t", "h0.example/_static/x y#1%20.html": "odd", "h0.example/note.txt": "no"}
    files |= {".hidden/x.html": "no", "h1.example/.draft.html": "no"}
    for rel, content in files.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content, encoding="utf-8")
    (root / "h1.example/raw.html").write_bytes(b"a\xffb")
    os.makedirs(root / "empty.example/none")
    seen = {r: c for r, c in files.items() if r.endswith(".html") and "/." not in f"/{r}"}
    return str(root), seen | {"h1.example/raw.html": "a�b"}


@pytest.mark.parametrize("tasks", [1, 4, 7, 100])
def test_all_files_once(spark, tree, tasks):
    root, files = tree
    rows = read_file_tree(spark, root, ".html", tasks).collect()
    assert len(rows) == len(files) and {r.rel_path: r.content for r in rows} == files
    assert {r.rel_path: r.n_bytes for r in rows}["h4.example/a/b/c/_n4.html"] == 8


def test_driver_stops_at_enough_folders(tree):
    root, files = tree
    for tasks in (1, 3, 8, 100):
        reader = TreeReader(root, ".html", tasks)
        parts = reader.partitions()
        listed = [rel for p in parts for b in reader.read(p) for rel in b.column(0).to_pylist()]
        assert sorted(listed) == sorted(files)
    # With few tasks wanted, only the root is looked at.
    assert {p.rel for p in TreeReader(root, ".html", 3).partitions() if not p.deep} == {""}


def test_one_large_folder_is_read_by_many_tasks(spark, tree):
    root, _ = tree
    large = read_listed(list_file_tree(spark, root, ".html").where("rel_path like 'big.example/%'"))
    assert large.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_filters_choose_folders(spark, tree):
    root, files = tree
    listing = list_file_tree(spark, root, ".html", 8)
    got = {r.rel_path for r in listing.where("rel_path like 'h2.example/%'").collect()}
    assert got == {r for r in files if r.startswith("h2.example/")}
    assert listing.where("rel_path = 'top.html'").count() == 1
    reader = TreeReader(root, ".html", 8)
    list(reader.pushFilters([StringStartsWith(("rel_path",), "h2.example/a"), EqualTo(("n_bytes",), 3)]))
    assert {p.rel.split("/")[0] for p in reader.partitions()} == {"", "h2.example"}


def test_missing_and_empty_roots(spark, tmp_path):
    assert read_file_tree(spark, str(tmp_path / "nothing"), ".html").count() == 0
    assert read_file_tree(spark, str(tmp_path), ".html").count() == 0


def test_written_files_come_back(spark, tmp_path):
    rows = [("a/b.html", "x"), ("a/_c.html", None), ("d e.html", "é" * 100_000), (None, "gone")]
    files = spark.createDataFrame(rows, "rel_path string, content string")
    root = f"file://{tmp_path}/out"
    assert {r.rel_path: r.n_bytes for r in write_file_tree(files, root).collect()} == {
        "a/b.html": 1, "a/_c.html": 0, "d e.html": 200_000
    }
    back = {r.rel_path: r.content for r in read_file_tree(spark, root).collect()}
    assert back == {"a/b.html": "x", "a/_c.html": "", "d e.html": "é" * 100_000}
    outside = spark.createDataFrame([("../x.html", "x")], "rel_path string, content string")
    with pytest.raises(Exception, match="leaves its root"):
        write_file_tree(outside, root).collect()
