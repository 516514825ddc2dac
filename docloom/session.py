"""Session settings, shared working folders and size checks."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Rows carry whole pages, so batches sent to Python stay small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    # Keyed stream state lives on disk and is checkpointed as change logs.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Largest side that is ever broadcast on purpose.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
# Largest input that is ever shuffled only to use all cores, whatever their number.
SPREAD_LIMIT_BYTES = 256 * 1024 * 1024


def build_session(app: str = "docloom", master: str | None = None, **settings) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="docloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder for one intermediate table or one stream."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save_and_reload(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result that several steps read, and read it back.

    The copy survives lost executors, and its true size guides later joins.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads, wherever it is."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    The workers import the page parser, and need not have it installed.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="docloom-code-"), "docloom")
    archive = shutil.make_archive(
        target, "zip", root_dir=os.path.dirname(package), base_dir=os.path.basename(package)
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def broadcast_if_bounded(df: DataFrame, max_rows: int, row_bytes: int) -> DataFrame:
    """Broadcast a side whose row bound is known; otherwise leave the join to Spark."""
    if max_rows * row_bytes <= BROADCAST_LIMIT_BYTES:
        return F.broadcast(df)
    return df


def table_bytes(df: DataFrame) -> int:
    """Size of the rows of a written table in memory, from one pass over it."""
    row = F.lit(16 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        if kind == "string":
            row = row + F.coalesce(F.octet_length(name), F.lit(0))
    return df.agg(F.sum(row)).first()[0] or 0


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast a written table when its measured size allows that."""
    return F.broadcast(df) if table_bytes(df) <= BROADCAST_LIMIT_BYTES else df


def spread_small_input(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a small input by key before costly per-row work.

    A small table often sits in one Parquet row group, which only one task can
    read. Inputs with enough data to fill the cluster keep their file splits,
    so a large table is never shuffled here.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= min(slots * split // 4, SPREAD_LIMIT_BYTES):
        return df
    return df.repartition(slots, *keys)
