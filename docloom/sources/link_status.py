"""Which link targets are fetched pages, kept up to date by deliveries of pages and links.

A delivery is joined from two sides: its new targets with all pages so far, and its new
pages with the targets that no page was known for. Targets and pages are each a
``KnownKeys`` table, so of both only buckets that may hold a new key are read; besides
these a delivery reads the dangling targets, and writes them anew without those that
a page has come for. Internal targets are only ever appended.

Deliveries have rising numbers. A delivery counts once its row is in the log, written
last; one that was cut off is given again with its number, replaces its own folders
and looks at earlier deliveries only. Links and pages are taken as sets, as in
``crawl_graph.link_targets``: a later delivery takes no link or page back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import urls
from docloom.session import broadcast_if_small, save_and_reload
from docloom.sources.pages import _exists
from docloom.streaming.known_keys import BUCKETS, KnownKeys

TARGETS = "resolved string, page_key string, since long"


class LinkStatus:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.targets = KnownKeys(spark, f"{self.root}/targets", ["resolved"], buckets)
        self.pages = KnownKeys(spark, f"{self.root}/pages", ["page_key"], buckets)

    def delivered(self) -> list[int]:
        """Numbers of the deliveries that count: one small row each."""
        path = f"{self.root}/log"
        if not _exists(self.spark, path):
            return []
        log = self.spark.read.schema("number long").option("recursiveFileLookup", True).parquet(path)
        return sorted(r["number"] for r in log.collect())

    def _dangling(self, number: int | None) -> DataFrame:
        if number is None:
            return self.spark.createDataFrame([], TARGETS)
        return self.spark.read.schema(TARGETS).parquet(f"{self.root}/dangling/{number}")

    def deliver(self, links: DataFrame, pages: DataFrame, number: int) -> int:
        """Take ``links(resolved)`` and ``pages(url)``; returns how many old targets have become internal."""
        earlier = self.delivered()
        if number in earlier:
            return 0
        if earlier and number < earlier[-1]:
            raise ValueError(f"delivery {number} comes after delivery {earlier[-1]}")
        page_key = urls.page_key
        new_pages = self.pages.add(pages.select(page_key(F.col("url")).alias("page_key")).where("page_key is not null"), number)
        new = self.targets.add(links.select("resolved").where("resolved is not null"), number)
        new = save_and_reload(
            new.select("resolved", page_key(F.col("resolved")).alias("page_key"), F.lit(number).cast("long").alias("since")),
            "links-new",
        )
        # New links against all pages, those of this delivery included.
        fetched = save_and_reload(self.pages.known(new.select("page_key"), number + 1), "links-fetched")
        # New pages against the links that had none.
        dangling = self._dangling(earlier[-1] if earlier else None)
        settled = save_and_reload(dangling.join(new_pages, "page_key", "left_semi"), "links-settled")
        internal = new.join(fetched, "page_key", "left_semi").unionByName(
            settled.withColumn("since", F.lit(number).cast("long"))
        )
        internal.write.mode("overwrite").parquet(f"{self.root}/internal/{number}")
        still = dangling.join(broadcast_if_small(settled.select("resolved")), "resolved", "left_anti").select(*dangling.columns)
        still.unionByName(new.join(fetched, "page_key", "left_anti").select(*dangling.columns)).write.mode(
            "overwrite"
        ).parquet(f"{self.root}/dangling/{number}")
        n_settled = settled.count()
        self.spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("error").parquet(f"{self.root}/log/{number}")
        return n_settled

    def read(self) -> DataFrame:
        """As ``crawl_graph.link_targets``, with the delivery (``since``) that settled it or first had the link."""
        done = self.delivered()
        dangling = self._dangling(done[-1] if done else None).withColumn("is_internal", F.lit(False))
        if not done:
            return dangling.select("resolved", "is_internal", "since")
        internal = self.spark.read.schema(TARGETS).parquet(*(f"{self.root}/internal/{n}" for n in done))
        return dangling.unionByName(internal.withColumn("is_internal", F.lit(True))).select("resolved", "is_internal", "since")
