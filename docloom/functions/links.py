"""Markdown links inside a body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions import urls
from docloom.functions.text import let


def extract(body: Column) -> Column:
    """All links in order as ``array<struct<text, href>>``; images count too."""
    pattern = F.lit(C.LINK_PATTERN)
    return F.zip_with(
        F.regexp_extract_all(body, pattern, 1),
        F.regexp_extract_all(body, pattern, 2),
        lambda text, href: F.struct(text.alias("text"), href.alias("href")),
    )


def kind(href: Column) -> Column:
    absolute = F.lit(False)
    for prefix in C.ABSOLUTE_LINK_PREFIXES:
        absolute = absolute | F.startswith(href, F.lit(prefix))
    return (
        F.when(absolute, "absolute")
        .when(F.startswith(href, F.lit("#")), "anchor")
        .otherwise("resolved")
    )


def absolute_href(base: Column, href: Column) -> Column:
    """Target of a link; absolute links and anchors stay as written."""
    return F.when(kind(href) == "resolved", urls.resolve(base, href)).otherwise(href)


def rewrite(body: Column, base: Column) -> Column:
    """Make relative links absolute in place.

    The text between links and the links themselves are taken apart, and put
    together again with new targets. Bodies without a base or a relative link
    are returned as they are.
    """
    def rebuild(known: Column) -> Column:
        def with_target(gap: Column, link: Column) -> Column:
            target = F.when(
                kind(link["href"]) == "resolved", urls.resolve_from(known["base"], link["href"])
            ).otherwise(link["href"])
            return F.when(
                link.isNotNull(),
                F.concat(gap, F.lit("["), link["text"], F.lit("]("), target, F.lit(")")),
            ).otherwise(gap)

        return F.array_join(F.zip_with(known["gaps"], known["links"], with_target), "")

    def rewritten(text: Column) -> Column:
        has_relative = F.contains(text, F.lit("](")) & F.regexp_like(
            text, F.lit(r"\]\((?!#|https?:|mailto:)")
        )
        taken_apart = F.struct(
            F.split(text, C.LINK_PATTERN, -1).alias("gaps"),
            extract(text).alias("links"),
            urls.base_parts(base).alias("base"),
        )
        return F.when(
            base.isNotNull() & (base != "") & has_relative, let(taken_apart, rebuild)
        ).otherwise(text)

    return let(body, rewritten)
