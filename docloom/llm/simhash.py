"""Near duplicates by SimHash, found at the words of a covering code.

Anchors are pairs of words of the binary Golay code, which covers all 23-bit
strings within three bits. A 64-bit fingerprint is read as blocks of 23, 23 and
18 bits (the last filled up with zeros). If two fingerprints differ in at most
four bits, they differ in at most two bits within one of the three pairs of
blocks, as every block lies in two pairs. In that pair some string lies within
one bit of both, and its anchor lies within the covering radius of it. So each
fingerprint goes to all anchors within covering radius plus half the threshold
within the pair: one bit beyond the radius in one of the two blocks. Every link
meets at an anchor, where fingerprints are compared in full.

Only distinct fingerprints take part. A fingerprint has at most 33 anchors, and
an anchor sees about one in two million unrelated fingerprints. An anchor's
fingerprints are joined by a spanning forest, not pair by pair; an anchor with
more than ``RUN_LIMIT`` of them is set aside and compared in blocks, each by its
own task, so that all its links are found as well.

A null text has no words, and a text without words has fingerprint zero. Null
ids are above all others. Repeated rows are in one component. An empty table
gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import column, fresh, release_memory
from docloom.llm.components import components
from docloom.session import save_and_reload, ship_package

SHINGLE = 4
SEED = 42
THRESHOLD = 4
# Shingles whose bits are counted at once.
CHUNK = 1 << 16
# Fingerprints of one anchor that one task compares; more are cut into blocks.
RUN_LIMIT = 4096


def simhash(text: str | None) -> int:
    """The 64-bit fingerprint of a text, as an unsigned number."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate(([0], ends[:-1]))
    last = max(len(tokens) - SHINGLE + 1, 1)
    stops = ends[SHINGLE - 1:] - 1 if len(tokens) >= SHINGLE else ends[-1:] - 1
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, last, CHUNK):
        spans = zip(starts[at:min(at + CHUNK, last)].tolist(), stops[at:at + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > last).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    found = np.array([simhash(t) for t in texts], dtype=np.uint64)
    release_memory()
    return pd.Series(found.view(np.int64))


# ---- the covering code ----------------------------------------------------

# Generator polynomial of the cyclic Golay code (23, 12).
GENERATOR = 0b110001110101


def _remainder(value: int) -> int:
    for shift in range(22, 10, -1):
        if value >> shift & 1:
            value ^= GENERATOR << (shift - 11)
    return value


def coset_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of weight 3 or less, and all of weight 4 (-1 fills up).

    The code is perfect, so the first is unique.
    """
    unit = [_remainder(1 << i) for i in range(23)]
    near = np.zeros(2048, dtype=np.int64)
    far: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in itertools.combinations(range(23), weight):
            syndrome, pattern = 0, 0
            for i in bits:
                syndrome ^= unit[i]
                pattern |= 1 << i
            if weight <= 3:
                near[syndrome] = pattern
            else:
                far[syndrome].append(pattern)
    wide = max(map(len, far))
    return near, np.array([row + [-1] * (wide - len(row)) for row in far], dtype=np.int64)


def syndromes(block: np.ndarray) -> np.ndarray:
    found = np.zeros_like(block)
    for i in range(23):
        found ^= np.where(block >> i & 1, _remainder(1 << i), 0)
    return found


def anchors(prints: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the anchors of each fingerprint, and the fingerprints they belong to.

    A code word is told by its upper 12 bits, a key holds the pair of blocks and two words.
    """
    value = prints.view(np.uint64)
    blocks = [(value >> np.uint64(s) & np.uint64(m)).astype(np.int64) for s, m in ((41, 0x7FFFFF), (18, 0x7FFFFF), (0, 0x3FFFF))]
    home, away = [], []
    for block in blocks:
        s = syndromes(block)
        home.append((block ^ near[s]) >> 11)
        away.append([np.where(far[s, k] >= 0, (block ^ far[s, k]) >> 11, -1) for k in range(far.shape[1])])
    keys, owners = [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        cases = [(home[i], home[j])] + [(w, home[j]) for w in away[i]] + [(home[i], w) for w in away[j]]
        for a, b in cases:
            there = (a >= 0) & (b >= 0)
            keys.append((np.int64(pair) << 24 | a << 12 | b)[there])
            owners.append(prints[there])
    return np.concatenate(keys), np.concatenate(owners)


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    near, far = coset_tables()
    for batch in batches:
        if batch.num_rows:
            prints = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            for at in range(0, len(prints), CHUNK):
                keys, owners = anchors(prints[at:at + CHUNK], near, far)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners)], ["key", "fp"])


# ---- comparing ------------------------------------------------------------


def forest(prints: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all fingerprints within ``threshold`` bits, fewer than there are fingerprints.

    A search that compares each one with those not yet reached; in a dense
    group hardly any are left after the first steps.
    """
    links, left = [], prints
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            point = front.pop()
            close = np.bitwise_count((left ^ point).view(np.uint64)) <= threshold
            if close.any():
                found, left = left[close], left[~close]
                links.append((np.full(len(found), point), found))
                front.extend(found)
    return links


def _compare(limit: int | None):
    """Over batches sorted by key (all columns but the last): links, and rows set aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind, a, b):
            a, b = np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), kind)), pa.array(a), pa.array(b)], ["aside", "a", "b"]
            )

        key, held, over = None, np.empty(0, dtype=np.int64), False

        def close():
            links = [] if over or len(held) < 2 else forest(np.unique(held))
            return [out(False, *map(np.concatenate, zip(*links, strict=True)))] if links else []

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(c.to_numpy(zero_copy_only=False), dtype=np.int64) for c in batch.columns]
            prints, tags = columns[-1], np.stack(columns[:-1])
            cuts = np.flatnonzero((tags[:, 1:] != tags[:, :-1]).any(axis=0)) + 1
            edges = np.concatenate(([0], cuts, [len(prints)]))
            sizes = np.diff(edges)
            # Runs of one row inside the batch meet nothing.
            alone = sizes == 1
            alone[0] = alone[-1] = False
            for start, stop in zip(edges[:-1][~alone].tolist(), edges[1:][~alone].tolist(), strict=True):
                tag = tuple(tags[:, start].tolist())
                if tag != key:
                    yield from close()
                    key, held, over = tag, np.empty(0, dtype=np.int64), False
                held = np.concatenate((held, prints[start:stop])) if len(held) else prints[start:stop]
                if limit is not None and (over or len(held) > limit):
                    over = True
                    yield out(True, np.full(len(held), tag[0]), held)
                    held = np.empty(0, dtype=np.int64)
        yield from close()

    return run


def links(prints: DataFrame, limit: int = RUN_LIMIT) -> DataFrame:
    """``a, b``: links that connect distinct fingerprints ``fp`` wherever they differ in few bits."""
    ship_package(prints.sparkSession)
    schema = "aside boolean, a long, b long"
    at_anchor = prints.select("fp").mapInArrow(_to_anchors, "key long, fp long")
    first = save_and_reload(
        at_anchor.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(limit), schema),
        "simhash-links",
    )
    found = first.where("not aside").select("a", "b")
    aside = first.where("aside").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if aside.isEmpty():
        return found
    # Crowded anchors: blocks by a hash of the fingerprint, every two of them compared by one task.
    blocks = aside.groupBy("key").agg(F.ceil(2 * F.count("*") / limit).cast("long").alias("blocks"))
    placed = aside.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"
    )
    crowded = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(
        _compare(None), schema
    )
    return found.unionByName(crowded.select("a", "b"))


def linked_groups(keys: DataFrame, limit: int = RUN_LIMIT) -> DataFrame:
    """``fp, root, component_id, group_size`` for rows ``(doc_id, fp)``: one row per distinct fingerprint."""
    prints = save_and_reload(
        keys.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-prints"
    )
    roots = save_and_reload(components(links(prints, limit)), "simhash-roots")
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"))
    return rooted.select("fp", "root").join(whole, "root")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``."""
    ship_package(docs.sparkSession)
    keys = save_and_reload(docs.select("doc_id", fingerprint("text").alias("fp")), "simhash-keys")
    return keys.join(linked_groups(keys), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, or any one of repeated rows with it."""
    names = docs.columns
    ship_package(docs.sparkSession)
    fp, hit, same = fresh(docs, "simhash_fp", "simhash_hit", "simhash_same")
    printed = save_and_reload(docs.withColumn(fp, fingerprint(F.col("text"))), "simhash-docs")
    groups = linked_groups(printed.select("doc_id", column(fp).alias("fp")))
    groups = save_and_reload(groups.where("group_size > 1"), "simhash-groups")
    side = groups.select(F.col("fp").alias(same), F.struct("root", "component_id").alias(hit))
    marked = printed.join(side, column(fp) == column(same), "left").drop(same)
    single = marked.where(column(hit).isNull())
    least = marked.where(
        column(hit).isNotNull() & F.col("doc_id").eqNullSafe(column(hit)["component_id"])
    ).withColumn(hit, column(hit)["root"])
    return single.select(*map(column, names)).unionByName(
        # Ids are unique as a rule; of repeated rows with the least id one stays.
        least.dropDuplicates([hit]).select(*map(column, names))
    )
