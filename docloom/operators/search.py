"""Keyword search over document bodies, for one query or for a table of queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docloom import constants as C
from docloom.functions import paths, search
from docloom.functions.text import let
from docloom.operators.keyword_batches import score_batches
from docloom.session import (
    broadcast_if_bounded,
    broadcast_if_small,
    save_and_reload,
    ship_package,
    spread_small_input,
)

# The query table is cut into slices. Slices that together hold about so many keywords
# and bytes, and so many best rows that a task has to remember, are carried to the tasks
# for one pass over the bodies; a slice by itself holds no more.
SLICE_TERMS = 20_000
SLICE_BYTES = 16 * 1024 * 1024
SLICE_ROWS = 1_000_000
# A document is known by its bundle and its path there.
KEY = ["bundle", "doc_path"]
# Generous size of one result row without its body.
TOP_ROW_BYTES = 4096


def key_columns(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def matching(docs: DataFrame, query: str, body: str = "body") -> DataFrame:
    """Documents holding at least one keyword of the query."""
    words = search.tokenize(query)
    return docs.where(let(F.lower(body), lambda lowered: search.contains_any(lowered, words)))


def match_counts(docs: DataFrame, query: str, *keys: str, body: str = "body") -> DataFrame:
    """``matches`` per matching document.

    The cheap containment test runs first, so only matching bodies are counted.
    """
    found = matching(docs, query, body)
    return found.select(*keys, search.match_count(F.col(body), search.tokenize(query)).alias("matches"))


def top_documents(
    docs: DataFrame,
    query: str,
    key: str | list[str] = KEY,
    k: int = C.DEFAULT_MAX_RESULTS,
    category: str | None = None,
    body: str = "body",
) -> DataFrame:
    """The ``k`` documents with most matches; equal counts go by key.

    Every task keeps its best ``k`` ids. Documents without a match sort last
    and are dropped after the cut, so each body is scanned once.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    keys = key_columns(key)
    pool = docs if category is None else docs.where(paths.in_category(F.col("doc_path"), category))
    counted = pool.select(
        *keys, search.match_count(F.col(body), search.tokenize(query)).alias("matches")
    )
    return counted.orderBy(F.desc("matches"), *keys).limit(k).where("matches > 0")


def only(docs: DataFrame, wanted: list, keys: list[str]) -> DataFrame:
    """Rows whose key columns hold values of the ``wanted`` rows, as literals.

    Literal filters reach the file scan. In a collection, which is ranged by its
    key, the scan then skips the files and row groups of all other documents.
    """
    for name in keys:
        docs = docs.where(F.col(name).isin(sorted({r[name] for r in wanted})))
    return docs


def hits(
    docs: DataFrame,
    query: str,
    key: str | list[str] = KEY,
    k: int = C.DEFAULT_MAX_RESULTS,
    category: str | None = None,
    body: str = "body",
    context_lines: int = C.CONTEXT_LINES,
) -> DataFrame:
    """Ranked results with contexts: ``rank, key, matches, contexts, source_url, fetched_at``.

    The ``k`` results are found first, and only their documents are read again.
    Contexts refer to ``matches`` so that no filter on them can move below the
    join, to all documents.
    """
    keys = key_columns(key)
    best = top_documents(docs, query, keys, k, category, body).collect()
    rows = [(i, *(r[c] for c in keys), r["matches"]) for i, r in enumerate(best, 1)]
    ranked = docs.sparkSession.createDataFrame(
        rows,
        T.StructType([
            T.StructField("rank", T.IntegerType()), *(docs.schema[c] for c in keys), T.StructField("matches", T.LongType())
        ]),
    )
    return (
        only(docs, best, keys)
        .join(broadcast_if_bounded(ranked, k, TOP_ROW_BYTES), keys)
        .select(
            "rank",
            *keys,
            "matches",
            F.when(
                F.col("matches") > 0,
                search.contexts(F.col(body), search.tokenize(query), context_lines),
            ).alias("context_rows"),
            F.coalesce("source_url", F.lit(C.UNKNOWN_FIELD)).alias("source_url"),
            F.coalesce(F.col("fetched_at").cast("string"), F.lit(C.UNKNOWN_FIELD)).alias("fetched_at"),
        )
        .withColumn("contexts", F.col("context_rows.snippet"))
    )


def display(results: DataFrame, shown: int = C.CONTEXTS_SHOWN) -> DataFrame:
    """Results with the first contexts only."""
    return results.withColumn("contexts", F.slice("contexts", 1, shown))


def as_json(results: DataFrame, key: str = "doc_path") -> DataFrame:
    """One JSON document per result."""
    return results.select(
        key,
        F.to_json(
            F.struct(
                F.col(key).cast("string").alias("file"), "matches", "contexts", "source_url", "fetched_at"
            )
        ).alias("json"),
    )


# ---- many queries at once -------------------------------------------------


def query_keywords(queries: DataFrame) -> DataFrame:
    """``(query_id, keyword, weight)``; the weight counts a repeated keyword."""
    return (
        queries.select("query_id", F.explode(search.keywords(F.col("query"))).alias("keyword"))
        .groupBy("query_id", "keyword")
        .agg(F.count("*").alias("weight"))
    )


def match_counts_for_queries(
    docs: DataFrame,
    queries: DataFrame,
    key: str | list[str] = KEY,
    body: str = "body",
    slice_terms: int = SLICE_TERMS,
    pass_terms: int = SLICE_TERMS,
) -> DataFrame:
    """``(query_id, key, matches)`` for every query and every document it matches."""
    return _scored(docs, queries, key_columns(key), body, slice_terms, keep=None, pass_terms=pass_terms)


def _scored(
    docs: DataFrame, queries: DataFrame, keys: list[str], body: str, slice_terms: int, keep: int | None,
    pass_terms: int = SLICE_TERMS,
) -> DataFrame:
    """Match counts, by one pass over the bodies for as many slices of the query table as fit in it.

    A slice is a hash part of the queries, so its size is bounded and all tables
    of queries are handled by the same plan. Its keywords travel to the tasks,
    which count those of all slices of a pass at once; no row is shuffled for it.
    """
    terms = save_and_reload(query_keywords(queries), "query-keywords")
    size = terms.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.octet_length("keyword")), F.lit(0)).alias("bytes"),
        F.count_distinct("query_id").alias("queries"),
    ).first()
    held = size["queries"] * (keep or 0)
    slices = max(1, *(math.ceil(a / b) for a, b in (
        (size["n"], slice_terms), (size["bytes"], SLICE_BYTES), (held, SLICE_ROWS)
    )))
    id_type = terms.schema["query_id"].dataType
    key_type = T.StructType([docs.schema[c] for c in keys])
    output = T.StructType([
        T.StructField("query_id", id_type),
        T.StructField("key", key_type),
        T.StructField("matches", T.LongType()),
    ])
    ship_package(docs.sparkSession)
    texts = spread_small_input(docs.select(*keys, body), *keys).select(
        F.struct(*keys).alias("key"), F.lower(body).alias("text")
    )
    passes: list[list[list[tuple]]] = []
    room = (0, 0, 0)
    for part in range(slices):
        mine = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == part)
        carried = [tuple(r) for r in mine.collect()]
        if not carried:
            continue
        takes = (
            len(carried), sum(len(t[1].encode()) for t in carried), len({t[0] for t in carried}) * (keep or 0)
        )
        if any(a > b for a, b in zip(takes, room, strict=True)):
            passes.append([])
            room = (pass_terms, SLICE_BYTES, SLICE_ROWS)
        passes[-1].append(carried)
        room = tuple(b - a for a, b in zip(takes, room, strict=True))
    found = docs.sparkSession.createDataFrame([], output)
    for each in passes:
        found = found.unionByName(texts.mapInArrow(score_batches(each, to_arrow_type(id_type), keep), output))
    return found.select("query_id", "key.*", "matches")


def top_documents_for_queries(
    docs: DataFrame,
    queries: DataFrame,
    key: str | list[str] = KEY,
    k: int = C.DEFAULT_MAX_RESULTS,
    body: str = "body",
    slice_terms: int = SLICE_TERMS,
    pass_terms: int = SLICE_TERMS,
) -> DataFrame:
    """Best ``k`` documents per query with their rank.

    Each task keeps its own best ``k`` rows per query before the ranking
    shuffle, so a query that matches most of the corpus moves few rows.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    keys = key_columns(key)
    scored = _scored(docs, queries, keys, body, slice_terms, keep=max(k, 1), pass_terms=pass_terms)
    in_query = Window.partitionBy("query_id").orderBy(F.desc("matches"), *keys)
    return scored.withColumn("rank", F.row_number().over(in_query)).where(F.col("rank") <= k)


def hits_for_queries(
    docs: DataFrame,
    queries: DataFrame,
    key: str | list[str] = KEY,
    k: int = C.DEFAULT_MAX_RESULTS,
    body: str = "body",
) -> DataFrame:
    """Ranked results with contexts for every query."""
    keys = key_columns(key)
    best = top_documents_for_queries(docs, queries, keys, k, body)
    with_words = best.join(queries.select("query_id", F.col("query").alias("_query")), "query_id")
    side = broadcast_if_small(save_and_reload(with_words, "query-hits-words"))
    return docs.join(side, keys).select(
        "query_id",
        "rank",
        *keys,
        "matches",
        search.contexts(F.col(body), search.keywords(F.col("_query")))["snippet"].alias("contexts"),
        F.coalesce("source_url", F.lit(C.UNKNOWN_FIELD)).alias("source_url"),
        F.coalesce(F.col("fetched_at").cast("string"), F.lit(C.UNKNOWN_FIELD)).alias("fetched_at"),
    )
