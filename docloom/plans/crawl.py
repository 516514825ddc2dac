"""What a crawl of a site would reach, from the pages that are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions import urls
from docloom.operators import crawl_graph, scope
from docloom.session import save_and_reload


def reachable(
    pages: DataFrame, start_urls: DataFrame, max_depth: int = C.MAX_CRAWL_DEPTH
) -> DataFrame:
    """``url, depth`` of all URLs in scope, ``max_depth`` links from a start URL at most.

    Links are taken from the pages once. Those out of scope are dropped before
    any round, so they neither count nor lead on.
    """
    links = save_and_reload(
        scope.page_hrefs(pages)
        .select(
            urls.without_fragment(F.col("url")).alias("src"),
            urls.without_fragment(F.col("resolved")).alias("dst"),
        )
        .where("dst <> ''"),
        "crawl-links",
    )
    marked = scope.mark_scope(links, scope.seeds_from_urls(start_urls), "dst")
    starts = start_urls.where(urls.is_valid(F.col("url"))).select(
        urls.without_fragment(F.col("url")).alias("url")
    )
    return crawl_graph.crawl_depth(marked.where("in_scope"), starts, max_depth)
