"""Counts, sizes and largest documents of bundles, kept up to date by deltas.

Each commit of a ``DeltaCollection`` is taken as signed rows: the new documents count
one, those that they overwrite minus one. Counts and sizes are added up, and the
content digest is an exclusive or, which takes a document out as it brought it in.
Only bundles of the delivery are read and written; their state is a delta
collection of its own, one row per bundle.

The state lists the largest documents of a bundle, ``KEPT`` times as many as a report
shows. All documents that are not listed rank behind the listed ones. So a new document
before the last listed one is added, an overwritten one is taken off, and only a
bundle whose list becomes shorter than a report needs is filled up again, from the
files of the collection that hold it.

A state row names the version it stands for and is committed with it: what was
not committed is worked out again from the same commits. Rows with a null bundle are
a bundle like others, as in a grouping; a null size counts as none and is listed last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import constants as C
from docloom.operators import bundles
from docloom.session import broadcast_if_small, save_and_reload
from docloom.sources.delta_collection import DeltaCollection

KEPT = 3
# Bundles that are asked for by name when lists are filled up.
LITERALS = 1000
LISTED = T.ArrayType(T.StructType([T.StructField("less", T.LongType()), T.StructField("doc_path", T.StringType())]))
SUMS = ("n_files", "n_md", "n_index", "total_bytes")
STATE = T.StructType([
    T.StructField("named", T.StringType()),
    *(T.StructField(name, T.LongType()) for name in SUMS),
    T.StructField("content_hash", T.LongType()),
    T.StructField("listed", LISTED),
    T.StructField("as_of", T.LongType()),
])


def _named() -> Column:
    """A bundle as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("bundle")), F.lit(""))


def _entry() -> Column:
    """A document of a list: entries sort by falling size, then by path."""
    return F.struct((-F.coalesce("md_bytes", F.lit(-1))).alias("less"), F.col("doc_path"))


def _largest(docs: DataFrame, n: int) -> DataFrame:
    """``named, listed``: the first ``n`` entries of every bundle; each task keeps ``n`` before the shuffle."""
    sized = docs.select(F.col("named").alias("bundle"), "doc_path", F.coalesce("md_bytes", F.lit(-1)).alias("md_bytes"))
    return (
        bundles.largest_docs(sized, n).groupBy(F.col("bundle").alias("named")).agg(F.sort_array(F.collect_list(_entry())).alias("listed"))
    )


class BundleViews:
    def __init__(self, spark: SparkSession, root: str, store: DeltaCollection, shown: int = C.LARGEST_FILES_LISTED, kept: int = KEPT):
        self.spark, self.store, self.shown, self.length = spark, store, shown, shown * kept
        self.state = DeltaCollection(spark, root, STATE, ["named"])
        self.refilled = 0  # bundles whose list was filled up again by the last delivery

    def as_of(self) -> int:
        return self.state.read().agg(F.coalesce(F.max("as_of"), F.lit(0))).first()[0]

    def refresh(self) -> int:
        """Take the commits since the last refresh, one after the other."""
        done = self.as_of()
        for version in [c["version"] for c in self.store._commits() if c["version"] > done]:
            rows = self.store.changes(version)
            if rows is not None:
                self._take(rows, version)
            done = version
        return done

    def _take(self, rows: DataFrame, version: int) -> None:
        changes = save_and_reload(
            rows.select(
                _named().alias("named"), "doc_path", "md_bytes", F.col("sign").cast("long").alias("sign"),
                bundles.content_digest().alias("content_hash"),
            ), "bundle-changes",
        )
        ends = lambda suffix: F.when(F.endswith("doc_path", F.lit(suffix)), F.col("sign")).otherwise(0)
        sums = save_and_reload(
            changes.groupBy("named").agg(
                F.sum("sign").alias("n_files"),
                F.sum(ends(".md")).alias("n_md"),
                F.sum(ends("index.md")).alias("n_index"),
                F.coalesce(F.sum(F.col("sign") * F.col("md_bytes")), F.lit(0)).alias("total_bytes"),
                F.coalesce(F.bit_xor("content_hash"), F.lit(0)).alias("content_hash"),
            ), "bundle-sums",
        )
        changed = broadcast_if_small(sums.select("named"))
        old = save_and_reload(self.state.read().join(changed, "named", "left_semi"), "bundle-state")
        both = old.select("named", *SUMS, "content_hash").unionByName(sums)
        new = both.groupBy("named").agg(
            *(F.sum(name).alias(name) for name in SUMS), F.bit_xor("content_hash").alias("content_hash")
        )
        listed = F.coalesce("listed", F.array().cast(LISTED))
        found = save_and_reload(
            new.join(self._lists(old, changes), "named", "left").withColumn("listed", listed), "bundle-views"
        )
        short = F.size("listed") < F.least("n_files", F.lit(self.shown))
        self.refilled = found.where(short).count()
        if self.refilled:
            found = self._refilled(found, short, version)
        # Bundles without documents keep a row, so that they are known to be empty.
        self.state.upsert(found.withColumn("as_of", F.lit(version).cast("long")))

    def _lists(self, old: DataFrame, changes: DataFrame) -> DataFrame:
        """Lists with the overwritten documents taken off and new ones added, as far as the lists reach."""
        more = F.col("n_files") > F.size("listed")
        ends = old.select("named", more.alias("more"), F.try_element_at("listed", F.lit(-1)).alias("last"))
        # Where not all documents are listed, those behind the last listed one stay unknown.
        reached = changes.join(broadcast_if_small(ends.select("named", "more", "last")), "named", "left").where(
            ~F.coalesce("more", F.lit(False)) | (_entry() <= F.col("last"))
        )
        held = old.select("named", F.explode("listed").alias("e"), F.lit(1).cast("long").alias("sign"))
        # A document that comes again with its old size counts one, minus one and one.
        net = (
            held.unionByName(reached.select("named", _entry().alias("e"), "sign"))
            .groupBy("named", "e").agg(F.sum("sign").alias("n")).where("n > 0")
            .select("named", "e", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))))
            .select("named", F.col("e.doc_path").alias("doc_path"), (-F.col("e.less")).alias("md_bytes"))
        )
        return _largest(net, self.length)

    def _refilled(self, found: DataFrame, short: Column, version: int) -> DataFrame:
        needed = save_and_reload(found.where(short).select("named"), "bundle-refill")
        docs = self.store.read(version).select("bundle", "doc_path", "md_bytes")
        if self.refilled <= LITERALS:
            # As literals the bundles reach the scan, and only the files that hold them are read.
            names = [r["named"] for r in needed.collect()]
            chosen = F.col("bundle").isin([n[1:] for n in names if n])
            docs = docs.where(chosen | F.col("bundle").isNull() if "" in names else chosen)
        docs = docs.withColumn("named", _named())
        full = _largest(docs.join(broadcast_if_small(needed), "named", "left_semi"), self.length)
        return found.where(~short).unionByName(found.where(short).drop("listed").join(full, "named"))

    # ---- reading: state rows only ----

    def _filled(self) -> DataFrame:
        bundle = F.when(F.col("named") != "", F.substr("named", F.lit(2)))
        return self.state.read().where("n_files > 0").withColumn("bundle", bundle)

    def sizes(self) -> DataFrame:
        """As ``bundles.sizes``."""
        return self._filled().select("bundle", "n_files", "n_md", "total_bytes").withColumns(bundles.size_limits())

    def index_pages(self) -> DataFrame:
        """As ``bundles.index_pages``."""
        return self._filled().select("bundle", "n_index")

    def largest_docs(self) -> DataFrame:
        """As ``bundles.largest_docs``."""
        shown = self._filled().select("bundle", F.posexplode(F.slice("listed", 1, self.shown)).alias("at", "e"))
        size = F.when(F.col("e.less") <= 0, -F.col("e.less"))
        return shown.select(
            "bundle", F.col("e.doc_path").alias("doc_path"), size.alias("md_bytes"),
            (F.col("at") + 1).alias("rank"), F.round(size / 1024, 1).alias("kb"),
        )

    def manifest(self) -> DataFrame:
        """Counts, size and content digest of every bundle, as ``bundles.manifest`` has them."""
        return self._filled().select("bundle", F.col("n_files").alias("n_docs"), "total_bytes", "content_hash")

    def report(self, descriptors: DataFrame, requested: DataFrame | None = None) -> DataFrame:
        """As ``bundles.report``."""
        size = F.transform(
            F.slice("listed", 1, self.shown),
            lambda e: F.struct(
                e["doc_path"].alias("doc_path"),
                F.round(F.when(e["less"] <= 0, -e["less"]) / 1024, 1).alias("kb"),
            ),
        )
        return bundles.checked(self.sizes(), descriptors, requested, self._filled().select("bundle", size.alias("top_files")))
