"""Stored document collections.

A collection is a folder of complete snapshots and a small table that lists
them; the last committed one is current. A snapshot is never changed, so
readers are safe while the next one is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import schema
from docloom.operators.upsert import newest, upsert
from docloom.sources.pages import _exists

COMMITS = "version long, location string"


class Collection:
    def __init__(self, spark: SparkSession, root: str, columns=schema.DOCS):
        self.spark, self.root, self.columns = spark, root.rstrip("/"), columns

    def version(self) -> int:
        """Number of the current snapshot; 0 when there is none."""
        commits = f"{self.root}/commits"
        if not _exists(self.spark, commits):
            return 0
        last = self._commits().agg(F.max("version")).first()[0]
        return last or 0

    def _commits(self) -> DataFrame:
        return self.spark.read.schema(COMMITS).option("recursiveFileLookup", True).parquet(f"{self.root}/commits")

    def _location(self, version: int) -> str:
        return f"{self.root}/snapshot={version}"

    def read(self) -> DataFrame:
        version = self.version()
        if version == 0:
            return self.spark.createDataFrame([], self.columns)
        location = self._commits().where(F.col("version") == version).first()["location"]
        return self.spark.read.schema(self.columns).parquet(location)

    def commit(self, docs: DataFrame) -> int:
        """Write a complete snapshot and make it current.

        Rows are ranged by bundle and path: files are even in size whatever
        the size of a bundle, and a reader of one bundle skips the others.
        """
        version = self.version() + 1
        # A folder of its own: a writer that loses a race harms no snapshot.
        location = f"{self._location(version)}-{uuid.uuid4().hex}"
        (
            docs.select(*self.columns.fieldNames())
            .repartitionByRange("bundle", "doc_path")
            .sortWithinPartitions("bundle", "doc_path")
            .write.parquet(location)
        )
        # The folder of a version can be made once: a second writer fails here.
        self.spark.createDataFrame([(version, location)], COMMITS).coalesce(1).write.mode("error").parquet(
            f"{self.root}/commits/{version}"
        )
        return version

    def upsert(self, new: DataFrame, replace_bundles: bool = False) -> int:
        return self.commit(upsert(self.read(), new, replace_bundles))


class Descriptors:
    """Stored descriptors of bundles: written if absent, and kept otherwise."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self) -> DataFrame:
        if not _exists(self.spark, self.root):
            return self.spark.createDataFrame([], schema.MANIFEST)
        return self.spark.read.schema(schema.MANIFEST).parquet(self.root)

    def add_missing(self, candidates: DataFrame) -> None:
        """Append descriptors of bundles that have none yet; the known ones are left alone."""
        names = schema.MANIFEST.fieldNames()
        fresh = candidates.select(*names).join(self.read().select("bundle"), "bundle", "left_anti").select(*names)
        fresh.coalesce(1).write.mode("append").parquet(self.root)


class IngestLog:
    """Documents as they arrive: one folder per batch, merged when read.

    A batch costs only its own size. Writing a batch again replaces its
    folder, so a replayed batch changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, columns=schema.DOCS):
        self.spark, self.root, self.columns = spark, root.rstrip("/"), columns

    def append(self, docs: DataFrame, batch: int) -> None:
        docs.select(*self.columns.fieldNames()).write.mode("overwrite").parquet(
            f"{self.root}/batch={batch}"
        )

    def versions(self) -> DataFrame:
        with_batch = schema.T.StructType(
            [*self.columns.fields, schema.T.StructField("batch", schema.T.LongType())]
        )
        if not _exists(self.spark, self.root):
            return self.spark.createDataFrame([], with_batch)
        return self.spark.read.schema(with_batch).option("basePath", self.root).parquet(self.root)

    def append_rejects(self, rejected: DataFrame, batch: int) -> None:
        rejected.select(*schema.REJECTS.fieldNames()).write.mode("overwrite").parquet(
            f"{self.root}-rejects/batch={batch}"
        )

    def rejects(self) -> DataFrame:
        """Pages of all batches that gave no document, with the reason."""
        if not _exists(self.spark, f"{self.root}-rejects"):
            return self.spark.createDataFrame([], schema.REJECTS)
        return self.spark.read.schema(schema.REJECTS).parquet(f"{self.root}-rejects")

    def current(self) -> DataFrame:
        return newest(self.versions()).select(*self.columns.fieldNames())


def export_bundles(docs: DataFrame, path: str) -> None:
    """Write each bundle as one deliverable folder, replacing earlier ones.

    Bundles that are not in ``docs`` stay as they are. The rebalance hint lets
    Spark cut a very large bundle into several files and join small ones.
    """
    (
        docs.hint("rebalance", "bundle")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bundle")
        .parquet(path)
    )


def export_descriptors(descriptors: DataFrame, path: str) -> None:
    """The descriptors of exported bundles, next to their documents."""
    descriptors.select("bundle", "descriptor").write.mode("overwrite").json(path)


def write_results(results: DataFrame, path: str) -> None:
    """Search results as JSON lines."""
    results.write.mode("overwrite").json(path)
