"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import save_and_reload


def _stars(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with the least of u and its neighbours as ``m``.

    Minima combine before the shuffle, and the join back to the pairs is one
    whose large partitions Spark splits.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    starred = _stars(links)
    return starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        starred.select("u", F.col("m").alias("v"))
    )


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b): the least node that it reaches.

    Each round is a written table, so lineage stays short and a lost executor
    costs one round at most. The number of rounds grows with the logarithm of
    the size of a component.
    """
    tidy = lambda df: df.where("u <> v").distinct()
    state = save_and_reload(
        tidy(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "components"
    )
    def print_of(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()

    seen = print_of(state)
    while True:
        state = save_and_reload(tidy(_small_star(tidy(_large_star(state)))), "components")
        now = print_of(state)
        if now == seen:
            break
        seen = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
