"""Frontmatter: the header block of an exported document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import SPACE, let, trim_space

PLAIN_BLOCK = rf"(?sU)\A---{SPACE}*\n(.*?)\n---{SPACE}*\n(.*)\z"


def render(title: Column, source_url: Column, fetched_at: Column) -> Column:
    """Header text; absent optional fields leave no line."""
    escaped = F.replace(F.replace(title, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    def field(name: str, value: Column) -> Column:
        return F.when(
            value.isNotNull() & (value != ""),
            F.concat(F.lit(f'{name}: "'), value, F.lit('"\n')),
        ).otherwise("")

    return F.concat(
        F.lit('---\ntitle: "'), escaped, F.lit('"\n'),
        field("source_url", source_url),
        field("fetched_at", fetched_at),
        F.lit("---\n\n"),
    )


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with a UTC offset."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def has_block(content: Column) -> Column:
    return F.regexp_like(content, F.lit(PLAIN_BLOCK))


def body(content: Column) -> Column:
    """Text after the header; the whole text when there is none."""
    return F.when(has_block(content), F.regexp_extract(content, PLAIN_BLOCK, 2)).otherwise(content)


def fields(content: Column) -> Column:
    """``key: value`` lines of the header as a map; the last of equal keys wins.

    Values keep their quotes.
    """
    lines = F.filter(
        F.split(F.regexp_extract(content, PLAIN_BLOCK, 1), "\n", -1),
        lambda line: line.contains(":"),
    )
    entries = F.transform(
        lines,
        lambda line: F.struct(
            trim_space(F.split(line, ":", 2)[0]).alias("key"),
            trim_space(F.split(line, ":", 2)[1]).alias("value"),
        ),
    )

    def keep_last(all_entries: Column) -> Column:
        return F.map_from_entries(
            F.filter(
                all_entries,
                lambda e, i: ~F.exists(
                    F.slice(all_entries, i + 2, F.size(all_entries)),
                    lambda later: later["key"] == e["key"],
                ),
            )
        )

    return let(entries, keep_last)
