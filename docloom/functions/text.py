"""Whitespace, line and binding helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators.
SPACE = r"[\s\x1C-\x1F]"
LINE_BREAK = r"[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029](?:(?<=\r)\n)?"
BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85" + chr(0x2028) + chr(0x2029)
# White space that does not break a line.
BLANKS = "\t \x1f\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def trim_space(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS + BREAKS))


def split_lines(col: Column) -> Column:
    return F.split(col, "\n", -1)


def clean_markdown(col: Column) -> Column:
    """Collapse blank-line runs, then split at any line break and right-strip each line.

    The order matters: lines that only hold blanks are not collapsed. A line
    break at the very end is dropped.
    """
    def join(lines: Column) -> Column:
        ended = (F.size(lines) > 1) & (F.element_at(lines, -1) == "")
        kept = F.when(ended, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
        return F.array_join(F.transform(kept, lambda line: F.rtrim(line, F.lit(BLANKS))), "\n")

    def lines_of(collapsed: Column) -> Column:
        # Plain searches rule out the rare breaks faster than the pattern finds them.
        odd = F.lit(False)
        for char in BREAKS[1:]:
            odd = odd | F.contains(collapsed, F.lit(char))
        return F.when(odd, F.split(collapsed, LINE_BREAK, -1)).otherwise(split_lines(collapsed))

    collapsed = F.when(
        F.contains(col, F.lit("\n\n\n")), F.regexp_replace(col, r"\n{3,}", "\n\n")
    ).otherwise(col)
    return let(let(collapsed, lines_of), join)
