"""Crawl scope: which URLs belong to a site's crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import links, urls

# An anchor tag up to the value of its href: any case, other attributes before it,
# line breaks, and double, single or no quotes.
ANCHOR = r"""(?is)<a\s[^>]*?(?<=[\s"'])href\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
VALUE = r"""(?is)\A.*?(?<=[\s"'])href\s*=\s*["']?([^"']*)["']?\z"""
# Entities that stand in links, the ampersand last.
ENTITIES = [("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&amp;", "&")]


def href_values(html: Column) -> Column:
    """Values of all anchors' links in order, with entities decoded and outer blanks cut."""
    def value(tag: Column) -> Column:
        found = F.regexp_extract(tag, VALUE, 1)
        for name, char in ENTITIES:
            found = F.replace(found, F.lit(name), F.lit(char))
        return F.trim(found)

    return F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), 0), value)


def seeds_from_urls(start_urls: DataFrame) -> DataFrame:
    """One row per valid start URL: its host and the folder the crawl stays below."""
    return start_urls.where(urls.is_valid(F.col("url"))).select(
        urls.host(F.col("url")).alias("seed_host"),
        urls.directory(urls.path(F.col("url"))).alias("seed_directory"),
    )


def page_hrefs(pages: DataFrame) -> DataFrame:
    """Raw links of each page in order, made absolute."""
    return (
        pages.select(
            "page_id",
            "url",
            F.posexplode(href_values(F.col("html"))).alias("ord", "href"),
        )
        .withColumn("kind", links.kind(F.col("href")))
        .withColumn("resolved", links.absolute_href(F.col("url"), F.col("href")))
    )


def mark_scope(candidates: DataFrame, seeds: DataFrame, url: str = "resolved") -> DataFrame:
    """Add ``in_scope``: does any seed admit the URL?

    A URL lies below a seed's folder when that folder is among its own parent
    folders, so each distinct URL is joined by host and parent folder. This
    needs no list of seeds per host, however many there are, and a URL that
    very many pages link to is one row by then. Give it a written table of
    links: the candidates are read twice.
    """
    pool = candidates.select(url).where(urls.may_be_page(F.col(url))).distinct()
    placed = pool.select(
        url,
        urls.host(F.col(url)).alias("seed_host"),
        F.explode(urls.parent_folders(F.col(url))).alias("seed_directory"),
    )
    admitted = (
        placed.join(
            seeds.select("seed_host", "seed_directory").distinct(),
            ["seed_host", "seed_directory"],
            "left_semi",
        )
        .select(url)
        .distinct()
        .withColumn("in_scope", F.lit(True))
    )
    return candidates.join(admitted, url, "left").select(
        *candidates.columns, F.coalesce("in_scope", F.lit(False)).alias("in_scope")
    )
