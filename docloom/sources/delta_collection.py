"""A document collection whose deliveries cost their own size.

A delivery is written as a run: files ranged by key, with a small table of each file's
first and last key. Rows of earlier runs that it overwrites stay where they are;
they are named in a deletion table by file and place, and left out when the collection is
read. To find them, only files whose key range holds a delivered key are looked at, and
of these only the key columns.

A commit is one row in a log, with the run and its deletions. Runs, deletions and
log rows are never changed, so a reader of a version is safe from writers. A version
can be made once: of two writers the second one fails, and what a killed writer has
written is in no commit. Deletions are broadcast to the readers, so once there are more than
``MAX_DELETES``, or ``MAX_RUNS`` runs, the collection is written anew as one run.

Keys of one delivery are unique, as conversion settles contested paths.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import schema
from docloom.operators.collisions import KEY
from docloom.session import broadcast_if_bounded, broadcast_if_small
from docloom.sources.pages import _exists

LOG = "version long, whole boolean, run string, ranges string, deletes string, n_rows long, n_deletes long"
DELETES = "_file string, _place long"
DELETE_BYTES = 160
MAX_DELETES = 400_000
MAX_RUNS = 50
# Files that are read by name; beyond that whole runs are.
NAMED_FILES = 10_000


class DeltaCollection:
    def __init__(
        self, spark: SparkSession, root: str, columns: T.StructType = schema.DOCS, key: list[str] | None = None,
        max_deletes: int = MAX_DELETES, max_runs: int = MAX_RUNS, block_rows: int | None = None,
    ):
        self.spark, self.root, self.columns, self.key = spark, root.rstrip("/"), columns, key or KEY
        # Files hold at most so many rows; as many as Spark writes if it is not given.
        self.max_deletes, self.max_runs, self.block_rows = max_deletes, max_runs, block_rows

    # ---- versions ----

    def _commits(self) -> list[Row]:
        """All commits in order: one small row each."""
        path = f"{self.root}/log"
        if not _exists(self.spark, path):
            return []
        log = self.spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(path)
        return sorted(log.collect(), key=lambda r: r["version"])

    def version(self) -> int:
        commits = self._commits()
        return commits[-1]["version"] if commits else 0

    def live(self, version: int | None = None) -> list[Row]:
        """The commits that make up a version: the last complete one and those after it."""
        commits = [c for c in self._commits() if version is None or c["version"] <= version]
        start = max((i for i, c in enumerate(commits) if c["whole"]), default=0)
        return commits[start:]

    # ---- reading ----

    def _placed(self, live: list[Row], paths: list[str] | None = None) -> DataFrame:
        """Current rows with their file and place there, from all runs or from the named files."""
        rows = self.spark.read.schema(self.columns).parquet(*(paths or [c["run"] for c in live])).select(
            "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_place")
        )
        deletes = [c["deletes"] for c in live if c["deletes"]]
        if not deletes:
            return rows
        gone = self.spark.read.schema(DELETES).parquet(*deletes)
        n = sum(c["n_deletes"] for c in live)
        return rows.join(broadcast_if_bounded(gone, n, DELETE_BYTES), ["_file", "_place"], "left_anti")

    def read(self, version: int | None = None) -> DataFrame:
        live = self.live(version)
        if not live:
            return self.spark.createDataFrame([], self.columns)
        return self._placed(live).select(*self.columns.fieldNames())

    def changes(self, version: int) -> DataFrame | None:
        """What a commit did: its rows with ``sign`` 1 and the rows it overwrote with ``sign`` -1.

        A commit that only wrote the collection anew has no changes. Of the earlier rows
        only the files that hold overwritten ones are read, if these are not too many.
        """
        commits = self._commits()
        commit = next(c for c in commits if c["version"] == version)
        if commit["whole"] and commit is not commits[0]:
            return None
        added = self.spark.read.schema(self.columns).parquet(commit["run"]).withColumn("sign", F.lit(1))
        if not commit["n_deletes"]:
            return added
        live = self.live(version - 1)
        gone = self.spark.read.schema(DELETES).parquet(commit["deletes"])
        places = self.spark.read.parquet(*(c["ranges"] for c in live)).withColumnRenamed("file", "_file")
        held = gone.select("_file").distinct().join(places, "_file").select("run", "_file")
        files = held.limit(NAMED_FILES + 1).collect()
        paths = [f"{f['run']}/{f['_file']}" for f in files] if len(files) <= NAMED_FILES else [c["run"] for c in live]
        old = self.spark.read.schema(self.columns).parquet(*paths).select(
            "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_place")
        )
        taken = old.join(broadcast_if_bounded(gone, commit["n_deletes"], DELETE_BYTES), ["_file", "_place"], "left_semi")
        return added.unionByName(taken.select(*self.columns.fieldNames(), F.lit(-1).alias("sign")))

    # ---- writing ----

    def _write_run(self, rows: DataFrame) -> tuple[str, str, int]:
        name = uuid.uuid4().hex
        run, ranges = f"{self.root}/runs/{name}", f"{self.root}/ranges/{name}"
        (
            rows.select(*self.columns.fieldNames()).repartitionByRange(*self.key)
            .sortWithinPartitions(*self.key).write.option("maxRecordsPerFile", self.block_rows or 0).parquet(run)
        )
        key = F.struct(*self.key)
        self.spark.read.schema(self.columns).parquet(run).groupBy(F.col("_metadata.file_name").alias("file")).agg(
            F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n")
        ).withColumn("run", F.lit(run)).write.parquet(ranges)
        n = self.spark.read.parquet(ranges).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return run, ranges, n

    def _commit(self, version: int, whole: bool, run: str, ranges: str, deletes: str | None, n: int, n_deletes: int) -> int:
        # The folder of a version can be made once: a second writer fails here.
        self.spark.createDataFrame([(version, whole, run, ranges, deletes, n, n_deletes)], LOG).coalesce(1).write.mode(
            "error"
        ).parquet(f"{self.root}/log/{version}")
        return version

    def touched(self, keys: DataFrame, live: list[Row]) -> DataFrame:
        """``run, file`` of the files whose key range holds one of ``keys``."""
        ranges = self.spark.read.parquet(*(c["ranges"] for c in live))
        width = len(keys.columns)
        # Keys may be the first columns of the order only; then so are the ends of the ranges.
        ends = [F.struct(*(F.col(end)[c] for c in self.key[:width])) for end in ("first", "last")]
        sides = ranges.select("run", "file", ends[0].alias("low"), ends[1].alias("high"))
        held = keys.select(F.struct(*keys.columns).alias("at"))
        return sides.join(
            broadcast_if_small(held), (F.col("at") >= F.col("low")) & (F.col("at") <= F.col("high")), "left_semi"
        ).select("run", "file")

    def _overwritten(self, run: str, live: list[Row], names: list[str]) -> DataFrame | None:
        """File and place of the current rows that share the key columns ``names`` with a new run."""
        keys = self.spark.read.schema(self.columns).parquet(run).select(*names).distinct()
        files = self.touched(keys, live).limit(NAMED_FILES + 1).collect()
        if not files:
            return None
        paths = [f"{f['run']}/{f['file']}" for f in files] if len(files) <= NAMED_FILES else None
        same = self._placed(live, paths).select("_file", "_place", *names)
        return same.join(keys, names, "left_semi").select("_file", "_place")

    def upsert(self, new: DataFrame, replace_bundles: bool = False) -> int:
        """Add a delivery; documents on its paths, or all of its bundles, are overwritten."""
        live = self.live()
        version = (live[-1]["version"] if live else 0) + 1
        run, ranges, n = self._write_run(new)
        deletes, n_deletes = None, 0
        gone = self._overwritten(run, live, self.key[:1] if replace_bundles else self.key) if live else None
        if gone is not None:
            deletes = f"{self.root}/deletes/{uuid.uuid4().hex}"
            gone.write.parquet(deletes)
            n_deletes = self.spark.read.schema(DELETES).parquet(deletes).count()
        self._commit(version, not live, run, ranges, deletes, n, n_deletes)
        if len(live) >= self.max_runs or sum(c["n_deletes"] for c in live) + n_deletes > self.max_deletes:
            version = self.compact()
        return version

    def compact(self) -> int:
        """Write the current rows as one run; earlier versions stay readable."""
        run, ranges, n = self._write_run(self.read())
        return self._commit(self.version() + 1, True, run, ranges, None, n, 0)
