"""Keyword counts, hit lines, islands of hits and their context snippets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions.text import SPACE, let, split_lines

Keywords = Sequence[str] | Column


def tokenize(query: str) -> list[str]:
    """Lower-cased keywords of one query; duplicates are kept."""
    return query.lower().split()


def keywords(query: Column) -> Column:
    """Lower-cased keywords of a query column; duplicates are kept."""
    return F.filter(F.split(F.lower(query), rf"(?U){SPACE}+"), lambda k: k != "")


def occurrences(text: Column, keyword: Column) -> Column:
    """Non-overlapping occurrences of a keyword as a substring."""
    removed = F.octet_length(text) - F.octet_length(F.replace(text, keyword, F.lit("")))
    return (removed / F.octet_length(keyword)).cast("long")


def match_count(body: Column, words: Sequence[str]) -> Column:
    """Occurrences of all keywords of one query, repeated keywords counted again."""
    if not words:
        return F.lit(0).cast("long")

    def total(lowered: Column) -> Column:
        counts = [occurrences(lowered, F.lit(w)) for w in words]
        out = counts[0]
        for count in counts[1:]:
            out = out + count
        return out

    return let(F.lower(body), total)


def contains_any(lowered: Column, words: Keywords) -> Column:
    if isinstance(words, Column):
        return F.exists(words, lambda w: F.contains(lowered, w))
    found = F.lit(False)
    for word in dict.fromkeys(words):
        found = found | F.contains(lowered, F.lit(word))
    return found


def hit_lines(lines: Column, words: Keywords) -> Column:
    """Ascending 0-based numbers of the lines that hold any keyword."""
    numbered = F.transform(lines, lambda line, i: F.when(contains_any(F.lower(line), words), i))
    return F.filter(numbered, lambda i: i.isNotNull())


def islands(hits: Column, context_lines: int = C.CONTEXT_LINES) -> Column:
    """Runs of hits whose neighbours are near enough to share their context."""
    reach = 2 * context_lines + 1

    def from_hits(h: Column) -> Column:
        placed = F.transform(h, lambda line, i: F.struct(line.alias("line"), i.alias("pos")))
        firsts = F.filter(
            placed,
            lambda p: (p["pos"] == 0) | (p["line"] - F.get(h, p["pos"] - 1) > reach),
        )
        lasts = F.filter(
            placed,
            lambda p: (p["pos"] == F.size(h) - 1) | (F.get(h, p["pos"] + 1) - p["line"] > reach),
        )
        return F.zip_with(
            firsts,
            lasts,
            lambda a, b: F.struct(
                a["line"].alias("first_line"),
                b["line"].alias("last_line"),
                (b["pos"] - a["pos"] + 1).alias("n_hits"),
            ),
        )

    return let(hits, from_hits)


def contexts(body: Column, words: Keywords, context_lines: int = C.CONTEXT_LINES) -> Column:
    """Snippets as ``array<struct<start_line, end_line, snippet>>``, end exclusive."""
    def from_lines(lines: Column) -> Column:
        def snippet(island: Column) -> Column:
            start = F.greatest(island["first_line"] - context_lines, F.lit(0))
            end = F.least(island["last_line"] + context_lines + 1, F.size(lines))
            shown = F.transform(
                F.slice(lines, start + 1, end - start),
                lambda line: F.concat(
                    F.when(contains_any(F.lower(line), words), C.HIT_PREFIX).otherwise(C.PLAIN_PREFIX),
                    line,
                ),
            )
            return F.struct(
                start.alias("start_line"),
                end.alias("end_line"),
                F.array_join(shown, "\n").alias("snippet"),
            )

        return F.transform(islands(hit_lines(lines, words), context_lines), snippet)

    return let(split_lines(body), from_lines)
