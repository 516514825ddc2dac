"""Reachable pages by depth, and which links lead to fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions import urls
from docloom.session import save_and_reload, work_path
from docloom.streaming.known_keys import BUCKETS, KnownKeys


def crawl_depth(
    edges: DataFrame, seeds: DataFrame, max_depth: int = C.MAX_CRAWL_DEPTH
) -> DataFrame:
    """Smallest number of links from any seed to each URL, up to ``max_depth``.

    ``edges(src, dst)``, ``seeds(url)``; start pages have depth 0. Each round
    joins the new URLs with their links and removes the known ones. Each round
    is a written table: later rounds do not repeat it, a lost executor does
    not lose it, and its size on disk tells Spark whether a frontier is small
    enough to broadcast. Rounds end early when nothing new is found.
    """
    steps = save_and_reload(
        edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct(), "crawl-edges"
    )
    frontier = save_and_reload(seeds.select("url").distinct(), "crawl-depth-0")
    levels = [frontier.select("url", F.lit(0).alias("depth"))]
    for depth in range(1, max_depth + 1):
        targets = (
            steps.join(frontier, steps["src"] == frontier["url"], "left_semi")
            .select(F.col("dst").alias("url"))
            .distinct()
        )
        known = levels[0].select("url")
        for level in levels[1:]:
            known = known.unionByName(level.select("url"))
        frontier = save_and_reload(
            targets.join(known, "url", "left_anti"), f"crawl-depth-{depth}"
        )
        if frontier.isEmpty():
            break
        levels.append(frontier.select("url", F.lit(depth).alias("depth")))
    reached = levels[0]
    for level in levels[1:]:
        reached = reached.unionByName(level)
    return reached


def crawl_depth_filtered(
    edges: DataFrame, seeds: DataFrame, max_depth: int = C.MAX_CRAWL_DEPTH, buckets: int = BUCKETS
) -> DataFrame:
    """As ``crawl_depth``, for crawls whose visited URLs are many more than those of a round.

    The visited URLs lie in a bucketed table with Bloom filters (``KnownKeys``). Targets
    that no filter knows are new without a look at the table; for the others their
    buckets are read, and not shuffled as long as these targets are few. So what a round moves
    follows its frontier, not all that was visited before.
    """
    spark = edges.sparkSession
    steps = save_and_reload(
        edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct(), "crawl-edges"
    )
    visited = KnownKeys(spark, work_path(spark, "crawl-visited"), ["url"], buckets)
    targets = seeds.select("url")
    for depth in range(max_depth + 1):
        frontier = visited.add(targets, depth)
        if frontier.isEmpty():
            break
        targets = steps.join(frontier, steps["src"] == frontier["url"], "left_semi").select(F.col("dst").alias("url"))
    return visited.read().select("url", F.col("batch").cast("int").alias("depth"))


def link_targets(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct link targets and whether each is a fetched page.

    Targets are reduced to distinct URLs before the join, so a URL that very
    many pages link to is one row by then.
    """
    targets = links.select("resolved").where(F.col("resolved").isNotNull()).distinct()
    targets = targets.withColumn("_key", urls.page_key(F.col("resolved")))
    fetched = pages.select(urls.page_key(F.col("url")).alias("_key")).distinct()
    return targets.join(
        fetched.withColumn("is_internal", F.lit(True)), "_key", "left"
    ).select("resolved", F.coalesce("is_internal", F.lit(False)).alias("is_internal"))


def mark_internal(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Every link row with ``is_internal``.

    Only internal targets travel back to the links; a hot target is split by
    the adaptive skew join because each target is a single row on its side.
    Give it a written table of links: they are read twice.
    """
    internal = link_targets(links, pages).where("is_internal")
    return links.join(internal, "resolved", "left").withColumn(
        "is_internal", F.coalesce("is_internal", F.lit(False))
    )


def dangling(links: DataFrame, pages: DataFrame) -> DataFrame:
    return link_targets(links, pages).where(~F.col("is_internal")).select("resolved")
