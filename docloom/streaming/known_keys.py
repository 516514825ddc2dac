"""Each key once over a stream of any length, with no state in the stream.

The keys that were seen lie in a table, cut into buckets by a hash. Beside each bucket
lies a Bloom filter of its keys: bitmaps of two hashes. The distinct keys of a batch are
held against the filters first. Keys that the filter does not know are new; only the
buckets of the others are read, and there the keys themselves decide. So late rows and
keys that come back after any time are told exactly, and a batch without old keys
reads no bucket.

A batch leaves its new keys and its part of the filters in folders of its number; a
repeated batch replaces its own, and looks at earlier ones only. Null values are keys
like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docloom.session import save_and_reload
from docloom.sources.pages import _exists

BUCKETS = 64
# Bits of one bucket's filter, in bitmaps of the size that Spark's bitmap functions have.
FILTER_BITS = 1 << 20
BITMAP_BITS = 32768
HASHES = 2
FILTERS = "bucket int, slot int, bits binary, batch long"


class KnownKeys:
    def __init__(
        self, spark: SparkSession, root: str, keys: list[str], buckets: int = BUCKETS, filter_bits: int = FILTER_BITS
    ):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self.buckets, self.filter_bits = buckets, filter_bits
        self.types: list[T.StructField] | None = None

    def _bit(self, n: int) -> Column:
        """The place of a key in its bucket's filter by the ``n``-th hash."""
        return F.pmod(F.xxhash64(F.lit(n), *self.keys), F.lit(self.filter_bits))

    def _distinct(self, batch: DataFrame) -> DataFrame:
        rows = batch.select(*self.keys).distinct()
        bucket = F.pmod(F.xxhash64(F.lit(0), *self.keys), F.lit(self.buckets)).cast("int")
        return save_and_reload(rows.withColumn("bucket", bucket), "keys-batch")

    def _read(self, kind: str, number: int | None = None) -> DataFrame | None:
        path = f"{self.root}/{kind}"
        if not _exists(self.spark, path):
            return None
        reader = self.spark.read.option("basePath", path)
        if kind == "filters":
            reader = reader.schema(FILTERS)
        elif self.types:
            # Batches without a new key have no file to tell the columns.
            folders = [T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())]
            reader = reader.schema(T.StructType([*self.types, *folders]))
        rows = reader.parquet(path)
        return rows if number is None else rows.where(F.col("batch") < number)

    def maybe_known(self, rows: DataFrame, number: int) -> DataFrame:
        """Rows (keys, bucket) that the filters before batch ``number`` do not rule out."""
        filters = self._read("filters", number)
        if filters is None:
            return rows.limit(0)
        filters = save_and_reload(filters.groupBy("bucket", "slot").agg(F.bitmap_or_agg("bits").alias("bits")), "keys-filters")
        for n in range(1, HASHES + 1):
            bit = self._bit(n)
            place = bit % BITMAP_BITS
            byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            is_set = F.expr("shiftright(the_byte, the_shift) & 1 = 1")
            rows = (
                rows.withColumn("slot", F.floor(bit / BITMAP_BITS).cast("int")).join(filters, ["bucket", "slot"])
                .withColumns({"the_byte": byte, "the_shift": (place % 8).cast("int")}).where(is_set)
                .select(*self.keys, "bucket")
            )
        return rows

    def _same(self, a: DataFrame, b: DataFrame) -> list[Column]:
        return [a[c].eqNullSafe(b[c]) for c in [*self.keys, "bucket"]]

    def _stored(self, rows: DataFrame, number: int) -> DataFrame | None:
        """Of rows (keys, bucket) those that the table has from batches before ``number``."""
        maybe = save_and_reload(self.maybe_known(rows, number), "keys-maybe")
        # At most as many as there are buckets.
        hit = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]
        if not hit:
            return None
        stored = self._read("keys", number).where(F.col("bucket").isin(hit))
        # The stored keys meet the few that may be among them, which are broadcast if they are small.
        return stored.join(maybe, self._same(stored, maybe)).select(*(maybe[c] for c in [*self.keys, "bucket"]))

    def known(self, batch: DataFrame, number: int) -> DataFrame:
        """The distinct keys of ``batch`` that batches before ``number`` have had; none are added."""
        self.types = batch.select(*self.keys).schema.fields
        rows = self._distinct(batch)
        known = self._stored(rows, number)
        return (rows.limit(0) if known is None else known).select(*self.keys)

    def add(self, batch: DataFrame, number: int) -> DataFrame:
        """Take a batch: its keys that no earlier batch has had go to the table, and come back."""
        self.types = batch.select(*self.keys).schema.fields
        rows = self._distinct(batch)
        known = self._stored(rows, number)
        new = rows if known is None else rows.join(known, self._same(rows, known), "left_anti")
        new = save_and_reload(new, "keys-new")
        # One file per bucket and batch.
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/keys/batch={number}")
        bits = new.select("bucket", F.explode(F.array(*(self._bit(n) for n in range(1, HASHES + 1)))).alias("bit"))
        bits.groupBy("bucket", F.floor(F.col("bit") / BITMAP_BITS).cast("int").alias("slot")).agg(
            F.bitmap_construct_agg(F.col("bit") % BITMAP_BITS).alias("bits")
        ).write.mode("overwrite").parquet(f"{self.root}/filters/batch={number}")
        return new.select(*self.keys)

    def start(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        def take(batch: DataFrame, number: int) -> None:
            self.add(batch, number)

        return (
            rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )

    def read(self) -> DataFrame:
        """Every key once, with the batch that had it first."""
        return self._read("keys").select(*self.keys, "batch")
