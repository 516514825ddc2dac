"""Bundles exported with one result row each: where it is now, or why it is not.

An export writes the documents of all sound bundles into a folder of its own, reads them
back, and compares each bundle's count and content digest with what was to be written.
Then one commit names the new place of each bundle that came out whole. A bundle
without documents, with a path that leaves it, with a missing text, or with other content than
it should have gets a reason, and its earlier export stays the current one. When the
write itself fails, its folder is removed and every bundle gets the reason. Places
change with the commit and not before, so a reader finds whole bundles at any time; of two
writers of one commit the second fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import paths
from docloom.session import remove_folder, save_and_reload
from docloom.sources.pages import _exists

RESULTS = "version long, bundle string, path string, reason string, n_docs long, content_hash long"
NOT_FOUND = "bundle not found"
UNSAFE_PATH = "a document path leaves the bundle"
NO_TEXT = "a document has no text"
DIFFERENT = "the written documents differ"


def content(docs: DataFrame, *more) -> DataFrame:
    """``bundle, n, hash`` and further aggregates; the digest does not depend on order."""
    return docs.groupBy("bundle").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("doc_path", "body").cast("decimal(38,0)") % 1_000_000_007).cast("long").alias("hash"), *more
    )


class ExportStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def results(self) -> DataFrame:
        """One row per export and bundle that was asked for."""
        path = f"{self.root}/log"
        if not _exists(self.spark, path):
            return self.spark.createDataFrame([], RESULTS)
        return self.spark.read.schema(RESULTS).option("recursiveFileLookup", True).parquet(path)

    def current(self) -> DataFrame:
        """``bundle, path, version, n_docs``: the last export of each bundle that came out whole."""
        done = self.results().where("path is not null")
        return done.groupBy("bundle").agg(
            F.max_by("path", "version").alias("path"), F.max("version").alias("version"), F.max_by("n_docs", "version").alias("n_docs")
        )

    def _write(self, docs: DataFrame, folder: str) -> str | None:
        """Why the write failed, if it did."""
        try:
            docs.hint("rebalance", "bundle").write.partitionBy("bundle").parquet(folder)
        except Exception as failure:  # noqa: BLE001  the bundles get the reason
            remove_folder(self.spark, folder)
            return f"export failed: {str(failure).strip().splitlines()[0][:300]}"
        return None

    def publish(self, docs: DataFrame, requested: DataFrame | None = None) -> DataFrame:
        """Export ``docs`` (bundle, doc_path, body, ...); the rows of ``results`` of this export.

        ``requested(bundle)`` names bundles that should be there besides those of ``docs``.
        """
        version = (self.results().agg(F.max("version")).first()[0] or 0) + 1
        folder = f"{self.root}/exports/{uuid.uuid4().hex}"
        unsafe = F.coalesce(F.count_if(~F.coalesce(paths.stays_inside(F.col("doc_path")), F.lit(False))), F.lit(0))
        checked = content(docs, unsafe.alias("unsafe"), F.count_if(F.col("body").isNull()).alias("silent"))
        reason = F.when(F.col("unsafe") > 0, UNSAFE_PATH).when(F.col("silent") > 0, NO_TEXT)
        checked = save_and_reload(checked.select("bundle", "n", "hash", reason.alias("reason")), "export-checks")
        sound = checked.where("reason is null").select("bundle")
        failure = self._write(docs.join(sound, "bundle", "left_semi"), folder)
        if failure is None and not sound.isEmpty():
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
            written = self.spark.read.schema(fields).parquet(folder)
            place = F.min(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""))
            found = content(written, place.alias("path")).select("bundle", "path", F.col("n").alias("m"), F.col("hash").alias("hash2"))
        else:
            found = self.spark.createDataFrame([], "bundle string, path string, m long, hash2 long")
        same = F.col("n").eqNullSafe(F.col("m")) & F.col("hash").eqNullSafe(F.col("hash2"))
        told = checked.join(found, "bundle", "left").withColumn(
            "reason", F.coalesce("reason", F.when(F.lit(failure is not None), F.lit(failure)).when(~same, DIFFERENT))
        )
        if requested is not None:
            absent = requested.select("bundle").distinct().join(checked, "bundle", "left_anti")
            told = told.unionByName(absent.withColumn("reason", F.lit(NOT_FOUND)), allowMissingColumns=True)
        rows = save_and_reload(told.select(
            F.lit(version).cast("long").alias("version"), "bundle", F.when(F.col("reason").isNull(), F.col("path")).alias("path"),
            "reason", F.coalesce("n", F.lit(0)).cast("long").alias("n_docs"), F.col("hash").alias("content_hash"),
        ), "export-results")
        if rows.isEmpty():
            return rows
        # The folder of a version can be made once: a second writer fails here.
        rows.write.mode("error").parquet(f"{self.root}/log/{version}")
        return self.results().where(F.col("version") == version)

    def read(self, columns: str) -> DataFrame:
        """The documents of all current exports, with the columns of the schema string ``columns``."""
        places = self.current().select("bundle", "path")
        folders = [r[0] for r in places.select(F.regexp_replace("path", "/[^/]*$", "").alias("f")).distinct().collect()]
        rows = self.spark.createDataFrame([], columns)
        for folder in folders:
            # The bundles of one export that are still current.
            mine = places.where(F.startswith("path", F.lit(f"{folder}/"))).select("bundle")
            rows = rows.unionByName(self.spark.read.schema(columns).parquet(folder).join(mine, "bundle", "left_semi"))
        return rows
