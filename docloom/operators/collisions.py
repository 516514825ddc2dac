"""Several rows on one document path: one wins, by an order that has no ties but repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["bundle", "doc_path"]


def rank_mark(docs: DataFrame, *first: str) -> Column:
    """Rank of a row on its path: ``first``, then page id, fetch time and a digest of the body."""
    parts = [F.col(c) for c in (*first, "page_id")]
    if "fetched_at" in docs.columns:
        parts.append(F.col("fetched_at"))
    if "body" in docs.columns:
        parts.append(F.md5("body").alias("digest"))
    return F.struct(*parts)


def path_winners(docs: DataFrame) -> DataFrame:
    """``winner_page_id`` and row count per path.

    A plain aggregate, so rows combine before the shuffle and a path that very
    many pages share costs no more than any other.
    """
    return docs.groupBy(*KEY).agg(
        F.max("page_id").alias("winner_page_id"), F.count("*").alias("n")
    )


def contested_paths(docs: DataFrame, *first: str) -> DataFrame:
    """Paths with several rows, and the rank mark of the winner."""
    return (
        docs.withColumn("_mark", rank_mark(docs, *first))
        .groupBy(*KEY)
        .agg(F.max("_mark").alias("winner"), F.count("*").alias("n"))
        .where("n > 1")
    )


def keep_winners(docs: DataFrame, contested: DataFrame | None = None, first: tuple[str, ...] = ()) -> DataFrame:
    """One row per path.

    Rows on uncontested paths stay where they are. Others meet the winner's mark,
    one row per path, so a path with very many rows is split and only its winner
    moves on. Of repeated rows one stays.
    """
    contested = contested_paths(docs, *first) if contested is None else contested
    alone = docs.join(contested.select(*KEY), KEY, "left_anti")
    winners = (
        docs.withColumn("_mark", rank_mark(docs, *first))
        .join(contested.select(*KEY, "winner"), KEY)
        .where(F.col("_mark").eqNullSafe(F.col("winner")))
        .dropDuplicates(KEY)
    )
    return alone.select(*docs.columns).unionByName(winners.select(*docs.columns))


def collision_rejects(docs: DataFrame, contested: DataFrame) -> DataFrame:
    """Rows that lost their path to another one."""
    lost = (
        docs.withColumn("_mark", rank_mark(docs))
        .join(contested.select(*KEY, "winner"), KEY)
        .where(~F.col("_mark").eqNullSafe(F.col("winner")))
    )
    return lost.select(
        F.lit("collision").alias("stage"),
        "page_id",
        "doc_path",
        F.concat(F.lit("path taken by page "), F.col("winner.page_id").cast("string")).alias("reason"),
    )
