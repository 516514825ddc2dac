"""Ranked lexical search of many items over all documents, by classes of equal bags.

Documents are restricted to the items' vocabulary: what is left of one is its
bag, the numbers of the vocabulary terms it holds and how often, and ``m``, which
follows from its length. Documents with the same bag and the same ``m`` have the
same score for every item, so they form a class. Classes are found by a hash of
bag and ``m`` and verified by the bags themselves. Each class is scored once. An
item's best ``k`` classes by score and least id hold its best ``k`` documents, as
each class before another one holds a document before all of that one's; their
members come back in ascending order of id.

Items are taken in blocks of about ``BLOCK_TERMS`` terms, so what is carried to
the tasks does not grow with the table of items; one block after the other is
written. A task keeps its best ``k`` classes per item, and of a class with very
many members every task passes on ``k``.

Items are told by their id: the terms of rows with one id, null too, count once
together. A null or empty text has no terms, and a document without terms counts
nowhere. Null ids of documents come after all others; repeated rows are ranked one
by one. Very long texts are counted piece by piece. Further columns are ignored.
Without items or documents the result is empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import discard
from docloom.session import broadcast_if_bounded, save_and_reload, ship_package, work_path

# Over UTF-8 in which only A-Z are lower-cased: letters, digits and all beyond ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")
# Bytes of a text whose terms are counted at once.
PIECE = 1 << 20
BLOCK_TERMS = 200_000
# Cells of the matrix of classes and items, and term occurrences, that a task scores at once.
CELLS = 1 << 21
RESULT_ROW_BYTES = 48
LAST_ID = np.iinfo(np.int64).max


def counted(text: str | None) -> Counter[bytes]:
    """How often each term occurs in a text."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(data) <= PIECE:
        return Counter(TERM.findall(data))
    found, at = Counter(), 0
    while at < len(data):
        cut = BETWEEN.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        found.update(TERM.findall(data, at, end))
        at = end
    return found


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term`` (UTF-8), each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [list(counted(text)) for text in batch.column(1).to_pylist()]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(terms)), [len(t) for t in terms])))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([t for row in terms for t in row], pa.binary())], ["item_id", "term"]
            )

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term binary").distinct()


def _bags(vocabulary: dict[bytes, int]):
    """Of each text: how many terms it has, and number and count of its vocabulary terms in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in batches:
            lengths, bags = [], []
            for text in batch.column(1):
                terms = counted(text.as_py())
                lengths.append(terms.total())
                bag = sorted((vocabulary[t], terms[t]) for t in terms.keys() & known)
                bags.append([x for pair in bag for x in pair])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(bags, pa.list_(pa.int32()))],
                ["doc_id", "n", "bag"],
            )

    return run


def _document_counts(terms: int):
    """Documents that hold each term, summed over the classes of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            bags = batch.column(0)
            sizes = np.diff(bags.offsets.to_numpy()) // 2
            numbers = bags.flatten().to_numpy()[::2]
            np.add.at(total, numbers, np.repeat(batch.column(1).to_numpy(), sizes))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["number", "df"])

    return run


class _Best:
    """The best classes of every item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least_score = np.ones(items, dtype=np.int64)
        self.rows = np.empty((0, 4), dtype=np.int64)  # item, score, least id, class

    def add(self, scores: np.ndarray, least: np.ndarray, classes: np.ndarray) -> None:
        at, item = np.nonzero(scores >= self.least_score)
        if not len(at):
            return
        rows = np.concatenate((self.rows, np.stack((item, scores[at, item], least[at], classes[at]), axis=1)))
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - first
        self.rows = rows[place < self.k]
        last = rows[place == self.k - 1]
        self.least_score[last[:, 0]] = last[:, 1]


def _score(weights: np.ndarray, starts: np.ndarray, holders: np.ndarray, items: int, k: int):
    """Rows (item, score, least, class) of a task's best classes.

    ``holders[starts[t]:starts[t + 1]]`` are the items that hold term ``t``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(items, k)
        for batch in batches:
            classes, m, bags, least = batch.columns
            classes, m = classes.to_numpy(), m.to_numpy()
            least = least.fill_null(LAST_ID).to_numpy()
            ends = (bags.offsets.to_numpy() - bags.offsets[0].as_py()) // 2
            numbers, tf = bags.flatten().to_numpy().astype(np.int64).reshape(-1, 2).T
            owner = np.repeat(np.arange(len(classes)), np.diff(ends))
            value = weights[numbers] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
            spread = starts[numbers + 1] - starts[numbers]
            # Occurrences up to each class; a step takes as many classes as fit, one at least.
            upto = np.concatenate(([0], np.cumsum(spread)))[ends]
            at = 0
            while at < len(classes):
                stop = int(np.searchsorted(upto, upto[at] + CELLS, "right")) - 1
                stop = max(at + 1, min(stop, at + max(1, CELLS // items), len(classes)))
                here = slice(ends[at], ends[stop])
                n = spread[here]
                first = np.cumsum(n) - n
                places = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(starts[numbers[here]], n)
                cell = np.repeat(owner[here] - at, n) * items + holders[places]
                scores = np.zeros((stop - at) * items, dtype=np.int64)
                np.add.at(scores, cell, np.repeat(value[here], n))
                best.add(scores.reshape(-1, items), least[at:stop], classes[at:stop])
                at = stop
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(best.rows[:, i])) for i in range(4)], ["item", "score", "least", "class_id"]
        )

    return run


def _ranked(docs: DataFrame, pairs: list[tuple], k: int, path: str) -> None:
    """Write the best documents for one block of items, given as ``(item_id, term)``."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for _, t in pairs}))}
    ids = list(dict.fromkeys(i for i, _ in pairs))
    numbered = {i: at for at, i in enumerate(ids)}
    table = np.array(sorted((vocabulary[bytes(t)], numbered[i]) for i, t in pairs), dtype=np.int64)
    starts = np.searchsorted(table[:, 0], np.arange(len(vocabulary) + 1))

    bags_path, classes_path = work_path(spark, "search-bags"), work_path(spark, "search-classes")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _bags(vocabulary), "doc_id long, n long, bag array<int>"
    ).write.parquet(bags_path)
    bags = spark.read.parquet(bags_path).where("n > 0")
    size = bags.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    if not size["docs"]:
        discard(docs, bags_path)
        return
    told = bags.where(F.size("bag") > 0).withColumn(
        "m", F.expr(f"10L + (90L * n * {size['docs']}L) div {size['terms']}L")
    ).withColumn("hash", F.xxhash64("bag", "m"))
    # Rows meet by the hash; the bag among the keys tells classes apart that share one.
    told.groupBy("hash", "m", "bag").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).withColumn(
        "class_id", F.monotonically_increasing_id()
    ).write.parquet(classes_path)
    classes = spark.read.parquet(classes_path)

    df = dict(
        classes.select("bag", "size").mapInArrow(_document_counts(len(vocabulary)), "number long, df long")
        .groupBy("number").agg(F.sum("df")).collect()
    )
    weights = np.array([
        math.floor(1000 * math.log((2 * size["docs"] + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))
    ], dtype=np.int64)
    score = _score(weights, starts, table[:, 1], len(ids), k)
    per_task = classes.select("class_id", "m", "bag", "least").mapInArrow(
        score, "item long, score long, least long, class_id long"
    )
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), "least")
    best = save_and_reload(
        per_task.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k), "search-best"
    ).select("item", "score", "class_id")
    rows = k * len(ids)
    wanted = save_and_reload(
        classes.join(broadcast_if_bounded(best, rows, RESULT_ROW_BYTES), "class_id")
        .select("item", "score", "hash", "m", "bag"), "search-wanted"
    )
    # Members of these classes only, the first ones of each.
    hashes = broadcast_if_bounded(wanted.select("hash").distinct(), rows, RESULT_ROW_BYTES)
    in_class = Window.partitionBy("hash", "m", "bag").orderBy(F.asc_nulls_last("doc_id"))
    members = told.join(hashes, "hash", "left_semi").withColumn("place", F.row_number().over(in_class)).where(
        F.col("place") <= k
    )
    by_rank = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    names = spark.createDataFrame(list(enumerate(ids)), "item long, item_id long")
    found = wanted.join(members, ["hash", "m", "bag"]).withColumn("rank", F.row_number().over(by_rank)).where(
        F.col("rank") <= k
    )
    found.join(names, "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
    for done in (bags_path, classes_path):
        discard(docs, done)


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``k`` best documents of every item: ``item_id, rank, doc_id, score``."""
    spark = docs.sparkSession
    ship_package(spark)
    path = work_path(spark, "search-ranked")
    terms = save_and_reload(
        item_terms(items.select(F.col("item_id").cast("long").alias("item_id"), "text")), "search-terms"
    )
    blocks = math.ceil(terms.count() / block_terms)
    spark.createDataFrame([], "item_id long, rank int, doc_id long, score long").write.parquet(path)
    for block in range(blocks):
        pairs = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        if pairs:
            _ranked(docs, [tuple(p) for p in pairs], k, path)
    return spark.read.schema("item_id long, rank int, doc_id long, score long").parquet(path)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Ten documents of each item: ``item_id, rank, doc_id, score``."""
    return search(docs, items)
