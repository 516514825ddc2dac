"""Where documents repeat passages of benchmark items, by a prefix-filtered set join.

An item's windows are its runs of ``WINDOW`` words, or the whole item if it has
fewer. A window is a set of shingles of ``SHINGLE`` words, and a document that
holds the window holds all of them. So any one of them is a necessary prefix of
the window in whatever order shingles stand; in the order by rarity over all
documents it is the rarest. A window whose rarest shingle is in no document is in
none. Places of documents are joined with these rarest shingles alone; the
shingle's offset and the window's length bound where the window may lie in the
document, and the words there are compared with those of the window.

Equal windows of several items are one window, and documents with the same set
of windows share one list of items, so neither many items with one passage nor
many documents with it make pairs. Shingles and windows are broadcast behind
their measured size, in blocks if they are more. Documents are not shuffled; only the
places of windows are, by document.

A null text has no words; a null item id stands as an empty string in the list.
Rows of one item id are one item. Rows of documents are told by a stored number,
so null and repeated ids do no harm. Very long texts are handled like others.
Further columns are ignored. Without items nothing is hit; without documents the
result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import LOWER, UPPER
from docloom.session import BROADCAST_LIMIT_BYTES, save_and_reload, table_bytes, work_path

WINDOW = 10
SHINGLE = 3
# All but digits, letters a-z and what lies beyond ASCII, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain(text: Column) -> Column:
    """The words of a text with one blank between them."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.trim(F.regexp_replace(lowered, BETWEEN, " "))


def shingle_at(words: Column, place: Column, length: int) -> Column:
    return F.xxhash64(*(F.get(words, place + i) for i in range(length)))


def numbered(docs: DataFrame) -> DataFrame:
    """``row, doc_id, n_words, words``; all but the words are stored, these are cut from a stored text."""
    body = F.col("body")
    told = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", plain(F.col("text")).alias("body"))
    n_words = F.when(body == "", 0).otherwise(F.size(F.split(body, " "))).cast("long")
    stored = save_and_reload(told.withColumn("n_words", n_words), "leaks-documents")
    return stored.select("row", "doc_id", "n_words", F.split(body, " ").alias("words"))


def windows_of(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``window_id, passage, length`` of distinct windows, and ``window_id, item`` of the items that hold them."""
    rows = save_and_reload(items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), plain(F.col("text")).alias("body")
    ).where("body <> ''"), "leaks-items").withColumn("words", F.split("body", " "))
    n = F.size("words")
    runs = rows.select("item", "words", F.explode(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))).alias("at"))
    passages = save_and_reload(runs.select(
        "item", F.array_join(F.slice("words", F.col("at"), F.lit(window)), " ").alias("passage"),
        F.least(n, F.lit(window)).alias("length"),
    ).distinct(), "leaks-passages")
    distinct = save_and_reload(
        passages.select("passage", "length").distinct().withColumn("window_id", F.monotonically_increasing_id()),
        "leaks-windows",
    )
    return distinct, save_and_reload(passages.join(distinct, "passage").select("window_id", "item"), "leaks-holders")


def _places(docs: DataFrame, length: int) -> DataFrame:
    """Every place of every document with the shingle of ``length`` words there."""
    here = docs.select("row", "n_words", "words", F.posexplode("words").alias("at", "word"))
    here = here.where(F.col("at") + length <= F.col("n_words"))
    return here.withColumn("shingle", shingle_at(F.col("words"), F.col("at"), length))


def _blocks(rows: DataFrame, key: str, limit: int) -> Iterator[DataFrame]:
    """Parts of a written table by a hash of ``key``, each to be broadcast."""
    parts = max(1, math.ceil(table_bytes(rows) / limit))
    for part in range(parts):
        yield F.broadcast(rows if parts == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part))


def rarest_shingles(docs: DataFrame, windows: DataFrame, shingle: int, limit: int) -> DataFrame:
    """Of every window that can occur its shingle found at the fewest places: ``k, shingle, offset`` and the window."""
    words = windows.withColumn("words", F.split("passage", " "))
    parts = []
    for k in range(1, shingle + 1):
        mine = words.where(F.col("length") == k) if k < shingle else words.where(F.col("length") >= k)
        there = mine.select("window_id", "length", "words", F.posexplode("words").alias("offset", "word")).where(
            F.col("offset") + k <= F.col("length")
        )
        parts.append(there.select(
            "window_id", F.lit(k).alias("k"), "offset", shingle_at(F.col("words"), F.col("offset"), k).alias("shingle")
        ))
    parts = [p for p in parts[:-1] if not p.isEmpty()] + parts[-1:]
    grams = parts[0]
    for p in parts[1:]:
        grams = grams.unionByName(p)
    grams = save_and_reload(grams, "leaks-shingles")
    path = work_path(docs.sparkSession, "leaks-counts")
    docs.sparkSession.createDataFrame([], "k int, shingle long, n long").write.parquet(path)
    for k in [r["k"] for r in grams.select("k").distinct().collect()]:
        wanted = save_and_reload(grams.where(F.col("k") == k).select("shingle").distinct(), "leaks-wanted")
        for part in _blocks(wanted, "shingle", limit):
            _places(docs, k).join(part, "shingle").groupBy("shingle").agg(F.count("*").alias("n")).select(
                F.lit(k).alias("k"), "shingle", "n"
            ).write.mode("append").parquet(path)
    counts = docs.sparkSession.read.schema("k int, shingle long, n long").parquet(path)
    # A shingle without a count is nowhere, and neither is its window.
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset", "k")
    first = grams.join(counts, ["k", "shingle"], "left").groupBy("window_id").agg(F.min(order).alias("first"))
    return windows.join(first.where("first.n > 0"), "window_id").select(
        "first.k", "first.shingle", "first.offset", "window_id", "passage", "length"
    )


def occurrences(
    docs: DataFrame, windows: DataFrame, shingle: int = SHINGLE, limit: int = BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """``row, start, length, window_id``: every place of a window in the rows of ``numbered`` documents."""
    spark = docs.sparkSession
    prefixes = save_and_reload(rarest_shingles(docs, windows, shingle, limit), "leaks-prefixes")
    path = work_path(spark, "leaks-places")
    spark.createDataFrame([], "row long, start int, length int, window_id long").write.parquet(path)
    for k in [r["k"] for r in prefixes.select("k").distinct().collect()]:
        mine = prefixes.where(F.col("k") == k).drop("k")
        for part in _blocks(mine, "shingle", limit):
            start = F.col("at") - F.col("offset")
            near = _places(docs, k).join(part, "shingle").where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
            held = F.array_join(F.slice("words", start + 1, F.col("length")), " ")
            near.where(held == F.col("passage")).select(
                "row", start.alias("start"), "length", "window_id"
            ).write.mode("append").parquet(path)
    return spark.read.schema("row long, start int, length int, window_id long").parquet(path)


def item_lists(window_sets: DataFrame, holders: DataFrame) -> DataFrame:
    """``windows, items``: for every distinct set of windows the sorted ids of the items that hold one of them."""
    sets = window_sets.select("windows").distinct()
    return (
        sets.select("windows", F.explode("windows").alias("window_id")).join(holders, "window_id")
        .groupBy("windows").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def leaks(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, limit: int = BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` of every document; a word in several windows is hit once."""
    rows = numbered(docs)
    distinct, holders = windows_of(items, window)
    places = occurrences(rows, distinct, shingle, limit)
    end = F.col("start") + F.col("length")
    earlier = Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    # Words that the windows before, in order of their starts, have not reached.
    new = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(earlier), "start")))
    hit = save_and_reload(places.withColumn("new", new).groupBy("row").agg(
        F.sum("new").alias("n_hit"), F.sort_array(F.collect_set("window_id")).alias("windows")
    ), "leaks-rows")
    told = hit.join(item_lists(hit, holders), "windows").select("row", "n_hit", "items")
    return rows.select("row", "doc_id", "n_words").join(told, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: words, hit words, and a digest of the items whose windows it holds."""
    return leaks(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
