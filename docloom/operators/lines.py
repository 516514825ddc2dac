"""Line tables and the windowed form of islands and contexts.

``functions.search`` does the same per row without a shuffle and is preferred.
This form serves line tables that already exist; a window never holds more
than the lines of one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions import search
from docloom.functions.text import split_lines


def document_lines(docs: DataFrame, *keys: str, body: str = "body") -> DataFrame:
    return docs.select(*keys, F.posexplode(split_lines(F.col(body))).alias("line_no", "line"))


def mark_hits(lines: DataFrame, words: search.Keywords) -> DataFrame:
    return lines.withColumn("is_hit", search.contains_any(F.lower("line"), words))


def islands(hits: DataFrame, *keys: str, context_lines: int = C.CONTEXT_LINES) -> DataFrame:
    """Islands of hit rows ``(keys, line_no)``."""
    in_order = Window.partitionBy(*keys).orderBy("line_no")
    reach = 2 * context_lines + 1
    gap = F.col("line_no") - F.lag("line_no").over(in_order)
    marked = hits.withColumn("_opens", F.when(gap <= reach, 0).otherwise(1))
    numbered = marked.withColumn("_island", F.sum("_opens").over(in_order))
    return (
        numbered.groupBy(*keys, "_island")
        .agg(
            F.min("line_no").alias("first_line"),
            F.max("line_no").alias("last_line"),
            F.count("*").alias("n_hits"),
        )
        .drop("_island")
    )


def context_lines_of(marked: DataFrame, *keys: str, context_lines: int = C.CONTEXT_LINES) -> DataFrame:
    """Lines of ``mark_hits`` that fall into the context frame of any hit."""
    frame = (
        Window.partitionBy(*keys).orderBy("line_no").rowsBetween(-context_lines, context_lines)
    )
    return (
        marked.withColumn("_near", F.max(F.col("is_hit").cast("int")).over(frame))
        .where("_near = 1")
        .drop("_near")
    )
