"""Crawled pages, from a table or from a tree of saved files."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import paths


def _exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(system.exists(location))


def _hidden_files(spark: SparkSession, root: str, extension: str) -> list[tuple[str, str]]:
    """(place, path below the root) of files that Spark's listing skips for a leading ``_``.

    A name that begins with a dot stays hidden.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    full = system.makeQualified(base).toUri().getPath().rstrip("/")
    found, files = [], system.listFiles(base, True)
    while files.hasNext():
        place = files.next().getPath()
        rel = place.toUri().getPath()[len(full) + 1:]
        parts = rel.split("/")
        skipped = any(p.startswith("_") and "=" not in p for p in parts)
        if rel.endswith(extension) and skipped and not any(p.startswith(".") for p in parts):
            found.append((place.toString(), rel))
    return found


def _read_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        contents = []
        for place in batch.column(0).to_pylist():
            system, path = fs.FileSystem.from_uri(quote(place, safe=":/"))
            with system.open_input_stream(path) as file:
                contents.append(file.read().decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(contents, pa.string())], ["rel_path", "content"])


def read_text_tree(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """``rel_path, content`` of all files below ``root`` with the extension.

    A missing folder gives no rows, as an empty crawl would. Files with a
    leading ``_`` in their path, as generated sites have, are listed on their
    own and read by the tasks.
    """
    if not _exists(spark, root):
        return spark.createDataFrame([], "rel_path string, content string")
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{extension}")
        .text(root, wholetext=True)
    )
    # Files come back with absolute, URL-encoded locations.
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath()
    location = F.regexp_replace(F.col("_metadata.file_path"), r"\A[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?", "")
    decoded = F.url_decode(F.replace(location, F.lit("+"), F.lit("%2B")))
    plain = files.select(
        F.substr(decoded, F.lit(len(full.rstrip("/")) + 2)).alias("rel_path"),
        F.col("value").alias("content"),
    )
    hidden = _hidden_files(spark, root, extension)
    if not hidden:
        return plain
    places = spark.createDataFrame(hidden, "place string, rel_path string")
    # Spark's listing keeps a few of them, such as those below a root with such a name.
    missed = places.join(plain.select("rel_path"), "rel_path", "left_anti").select("place", "rel_path")
    return plain.unionByName(
        missed.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_read_places, "rel_path string, content string")
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_html_tree(spark: SparkSession, root: str, scheme: str = "https") -> DataFrame:
    """Pages of a saved crawl: ``host/path/file.html`` below ``root``.

    Files that would leave the root are dropped. Page ids follow from the path,
    so another read gives the same ids. ``rel_path`` is kept next to the columns
    of pages, as a document's path follows from the file's.
    """
    files = read_text_tree(spark, root, ".html")
    rel = F.col("rel_path")
    return files.where(paths.stays_inside(rel)).select(
        F.xxhash64(rel).alias("page_id"),
        paths.source_url(rel, F.lit(scheme)).alias("url"),
        F.col("content").alias("html"),
        rel,
    )
