"""Link tables and link rewriting over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import links


def body_links(docs: DataFrame, *keys: str) -> DataFrame:
    """One row per Markdown link: order, text, target as written and as resolved."""
    return (
        docs.select(*keys, "source_url", F.posexplode(links.extract(F.col("body"))).alias("ord", "link"))
        .select(
            *keys,
            "ord",
            "link.text",
            "link.href",
            links.kind(F.col("link.href")).alias("kind"),
            F.when(
                F.col("source_url").isNotNull(),
                links.absolute_href(F.col("source_url"), F.col("link.href")),
            ).otherwise(F.col("link.href")).alias("resolved"),
        )
    )


def normalize_links(docs: DataFrame) -> DataFrame:
    """Documents with relative links made absolute; those without a URL stay."""
    return docs.withColumn("body", links.rewrite(F.col("body"), F.col("source_url")))
