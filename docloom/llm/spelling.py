"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

A word's point counts its letters: 32 groups of letters (each of a-z is one, the
others share six), each counted up to two. The point is kept as 64 bits, two for
each group ("one or more", "two or more"), so a distance is a count of bits. One
inserted letter raises the point by one at most and lowers nothing; one replaced
letter raises it by one and lowers it by one at most: an L1 distance of at most two.

For each pair of lengths, ``(l, l)`` and ``(l, l + 1)``, words of the first length
search the tree of the second. The upper part of a length's tree is built from a
bounded sample of its points and cuts the space into regions of about ``REGION``
words; every word is sent to its own region, and as a query to each region that
its box search reaches (a word crosses one cut upwards and one downwards at most,
so they grow with the square of the tree's depth, not with its size). There each
task builds the tree of the region down to ``LEAF`` points, prunes by the box of
each node, and checks the letters of the words that are left, column by column. A
region of far more words than the sample tells, such as many words of the same
letters, is cut once more by the words' halves: of two words one edit apart, the
first halves or the second halves are equal.

Words are runs of letters of the text, counted over whole texts; a null text has
none. A null id counts as an empty one in the rule that alters words. Repeated rows count
each. Very long texts are counted like others, very long words are compared like
others. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import save_and_reload, ship_package

SHORTEST = 5
LEAST_COUNT = 3
RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALTERED = 97
# Distinct words that a task counts before it passes them on, and letters matched at once.
COUNTED = 1_000_000
# Points that the upper trees are built from, over all lengths.
SAMPLE_WORDS = 200_000
REGION = 4096
# A region with so many words is cut by halves of words.
CROWDED = 4 * REGION
LEAF = 64
# Pairs of points, and letters of pairs of words, compared at once.
PAIRS = 1 << 20
ONE = np.uint64(1)


# ---- words and their points -----------------------------------------------


def altered(run: str, doc_id: int | None) -> str:
    """A run without one of its letters, if the checksum says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % ALTERED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counts(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for doc_id, text in zip(*batch.columns, strict=True):
                number = doc_id.as_py()
                # A run's letter goes or stays by id and run, so equal runs of a text are one case.
                for word, n in Counter(RUN.findall((text.as_py() or "").translate(LOWERED))).items():
                    if len(word) >= shortest:
                        word = altered(word, number)
                        if len(word) >= shortest:
                            found[word] += n
                if len(found) >= COUNTED:
                    yield flush()
                    found.clear()
        yield flush()

    return run


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of all words of ``shortest`` letters or more that occur ``least`` times or more."""
    ship_package(docs.sparkSession)
    counted = docs.select("doc_id", "text").mapInArrow(_counts(shortest), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _group(letter: int) -> int:
    return letter - 97 if 97 <= letter <= 122 else 26 + letter % 6


BITS = [1 << _group(c) for c in range(256)]


def point(word: bytes) -> int:
    """The letter counts of a word (Latin-1) as bits."""
    once = twice = 0
    for letter in word:
        bit = BITS[letter]
        twice |= once & bit
        once |= bit
    return once | twice << 32


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plain = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
        points = np.fromiter(map(point, plain), dtype=np.uint64, count=len(plain)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(plain, pa.binary()), batch.column(1), pa.array(list(map(len, plain)), pa.int32()), pa.array(points)],
            ["word", "n", "length", "point"],
        )


# ---- trees ----------------------------------------------------------------


def best_bit(points: np.ndarray) -> int:
    """The bit that cuts the points most evenly, or -1 if all are equal."""
    bits = np.unpackbits(points.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    uneven = np.abs(2 * ones - len(points))
    bit = int(uneven.argmin())
    return bit if uneven[bit] < len(points) else -1


class UpperTree:
    """Cuts that divide the points of one length into regions."""

    def __init__(self, points: np.ndarray, share: float):
        """``points`` are a sample with this ``share`` of all."""
        self.cuts: list[tuple[int, int, int]] = []  # bit, node without it, node with it; a region has bit -1 and its number
        self.regions = 0
        self._grow(points, share)

    def _grow(self, points: np.ndarray, share: float) -> int:
        node = len(self.cuts)
        self.cuts.append((-1, self.regions, 0))
        bit = best_bit(points) if len(points) > REGION * share and len(points) > 1 else -1
        if bit < 0:
            self.regions += 1
            return node
        there = (points >> np.uint64(bit) & ONE).astype(bool)
        self.cuts[node] = (bit, self._grow(points[~there], share), self._grow(points[there], share))
        return node

    def search(self, points: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """Which points reach which regions, if theirs may be ``up`` bits above and ``down`` bits below."""
        owners, regions = [], []
        whole = np.arange(len(points))
        todo = [(0, whole, np.full(len(points), up), np.full(len(points), down))]
        while todo:
            node, at, ups, downs = todo.pop()
            bit, low, high = self.cuts[node]
            if bit < 0:
                owners.append(at)
                regions.append(np.full(len(at), low))
                continue
            has = (points[at] >> np.uint64(bit) & ONE).astype(bool)
            for child, crossing in ((low, has), (high, ~has)):
                spent_up, spent_down = (ups, downs - crossing) if child == low else (ups - crossing, downs)
                stay = (spent_up >= 0) & (spent_down >= 0)
                if stay.any():
                    todo.append((child, at[stay], spent_up[stay], spent_down[stay]))
        if not owners:
            return whole[:0], whole[:0]
        return np.concatenate(owners), np.concatenate(regions)


class RegionTree:
    """A tree over the points of one region, with the box of every node."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes: list[tuple] = []  # lowest and highest corner, children or none, places of the points
        self._grow(np.arange(len(points)))

    def _grow(self, at: np.ndarray) -> int:
        node = len(self.nodes)
        here = self.points[at]
        corners = np.bitwise_and.reduce(here), np.bitwise_or.reduce(here)
        self.nodes.append((*corners, None, at))
        bit = best_bit(here) if len(at) > LEAF else -1
        if bit >= 0:
            there = (here >> np.uint64(bit) & ONE).astype(bool)
            self.nodes[node] = (*corners, (self._grow(at[~there]), self._grow(at[there])), None)
        return node

    def near(self, queries: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of queries and of points that are at most ``up`` bits above and ``down`` bits below them."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, at = todo.pop()
            low, high, children, places = self.nodes[node]
            q = queries[at]
            at = at[(np.bitwise_count(low & ~q) <= up) & (np.bitwise_count(q & ~high) <= down)]
            if not len(at):
                continue
            if children:
                todo += [(c, at) for c in children]
                continue
            points, step = self.points[places], max(1, PAIRS // len(places))
            for i in range(0, len(at), step):
                q = queries[at[i:i + step], None]
                a, b = np.nonzero((np.bitwise_count(points & ~q) <= up) & (np.bitwise_count(q & ~points) <= down))
                yield at[i + a], places[b]


def one_edit(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Of pairs of words as rows of letters, of equal lengths or one apart, which are one edit apart."""
    width = shorter.shape[1]
    same = shorter == longer[:, :width]
    if longer.shape[1] == width:
        return same.sum(axis=1) == width - 1
    first = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    last = np.logical_and.accumulate((shorter == longer[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return first + last >= width


# ---- the search -----------------------------------------------------------

PLACED = "shorter int, longer int, region int, half long, query boolean, word binary, n long, point long"
LINKS = "a binary, na long, b binary, nb long"


def _halves(words: list[bytes], shorter: int) -> list[tuple[int, int]]:
    """Tags of first and second half, by the middle of the shorter length."""
    p = shorter // 2
    return [(zlib.crc32(w[:p]) << 1 | 1, zlib.crc32(w[len(w) - (shorter - p):]) << 1 | 1 | 1 << 40) for w in words]


def _place(trees: dict[int, UpperTree], crowded: set[tuple[int, int]]):
    """Each word in its own region, and as a query in the regions that its search reaches.

    The half is 0, or in a crowded region tells the half that two words have to share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            for length in np.unique(lengths).tolist():
                mine = batch.filter(pa.array(lengths == length))
                points = mine.column(3).to_numpy().view(np.uint64)
                home, region = trees[length].search(points, 0, 0)
                moves = [(length - 1, length, False, home, region), (length, length, False, home, region)]
                moves.append((length, length, True, *trees[length].search(points, 1, 1)))
                if length + 1 in trees:
                    moves.append((length, length + 1, True, *trees[length + 1].search(points, 1, 0)))
                for shorter, longer, query, owner, region in moves:
                    if shorter not in trees:
                        continue
                    half = np.zeros(len(owner), dtype=np.int64)
                    tight = np.array([(longer, r) in crowded for r in region.tolist()], dtype=bool)
                    if tight.any():
                        words = mine.column(0).take(pa.array(owner[tight])).to_pylist()
                        tags = np.array(_halves(words, shorter), dtype=np.int64)
                        owner = np.concatenate((owner[~tight], np.repeat(owner[tight], 2)))
                        region = np.concatenate((region[~tight], np.repeat(region[tight], 2)))
                        half = np.concatenate((half[~tight], tags.ravel()))
                    rows, n = mine.take(pa.array(owner)), len(owner)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, shorter, np.int32)), pa.array(np.full(n, longer, np.int32)),
                        pa.array(region.astype(np.int32)), pa.array(half), pa.array(np.full(n, query)),
                        rows.column(0), rows.column(1), rows.column(3),
                    ], [f.split()[0] for f in PLACED.split(", ")])

    return run


class _Region:
    """The words of one region, and the search of its queries."""

    def __init__(self, tag: tuple[int, int, int, int]):
        self.shorter, self.longer, _, self.half = tag
        self.parts: list[pa.RecordBatch] = []
        self.tree = None

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        queries = rows.column(4).to_numpy(zero_copy_only=False)
        if not queries.all():
            self.parts.append(rows.filter(pa.array(~queries)))
        if queries.any() and self.parts:
            yield from self._search(rows.filter(pa.array(queries)))

    def _letters(self, words: pa.Array, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(words.to_pylist()), dtype=np.uint8).reshape(-1, width)

    def _search(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.tree is None:
            whole = pa.Table.from_batches(self.parts).combine_chunks().to_batches()[0]
            self.words, self.n = whole.column(5), whole.column(6)
            self.letters = self._letters(self.words, self.longer)
            self.tree = RegionTree(whole.column(7).to_numpy().view(np.uint64))
        asked = self._letters(rows.column(5), self.shorter)
        equal = self.shorter == self.longer
        middle, step = self.shorter // 2, max(1, PAIRS // self.longer)
        for a, b in self.tree.near(rows.column(7).to_numpy().view(np.uint64), 1, int(equal)):
            for i in range(0, len(a), step):
                p, q = a[i:i + step], b[i:i + step]
                x, y = asked[p], self.letters[q]
                found = one_edit(x, y)
                if self.half:
                    # Words that share both halves are linked by the first ones, and tags may agree by chance.
                    found &= (x[:, :middle] == y[:, :middle]).all(axis=1) != bool(self.half >> 40)
                p, q = p[found], q[found]
                if len(p):
                    yield pa.RecordBatch.from_arrays([
                        rows.column(5).take(pa.array(p)), rows.column(6).take(pa.array(p)),
                        self.words.take(pa.array(q)), self.n.take(pa.array(q)),
                    ], ["a", "na", "b", "nb"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the rows of ``PLACED``, sorted by region with the queries last."""
    tag, region = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        tags = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[:4]])
        cuts = np.flatnonzero((tags[:, 1:] != tags[:, :-1]).any(axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(tags[:, start].tolist())
            if now != tag:
                tag, region = now, _Region(now)
            yield from region.add(batch.slice(start, stop - start))


def near_words(words: DataFrame, sample: int = SAMPLE_WORDS, crowded: int = CROWDED) -> DataFrame:
    """``a, na, b, nb``: words one edit apart with their counts.

    Of different lengths ``a`` is the shorter one, and the pair comes once; of equal lengths it
    comes from either side.
    """
    ship_package(words.sparkSession)
    points = save_and_reload(
        words.select("word", "n").mapInArrow(_points, "word binary, n long, length int, point long"), "spelling-points"
    )
    total = points.count()
    share = min(1.0, sample / max(total, 1))
    # A hash as a number from 0 to 1.
    place = (F.xxhash64("word") / F.lit(2.0**64)) + 0.5
    drawn: dict[int, list[int]] = {}
    for row in points.where(place <= share).select("length", "point").collect():
        drawn.setdefault(row["length"], []).append(row["point"])
    lengths = [r["length"] for r in points.select("length").distinct().collect()]
    trees = {n: UpperTree(np.array(drawn.get(n, []), dtype=np.int64).view(np.uint64), share) for n in lengths}
    placed = points.mapInArrow(_place(trees, set()), PLACED)
    full = placed.where("not query and shorter = longer").groupBy("longer", "region").count().where(F.col("count") > crowded)
    over = {(r["longer"], r["region"]) for r in full.select("longer", "region").collect()}
    keys = ["shorter", "longer", "region", "half"]
    dealt = points.mapInArrow(_place(trees, over), PLACED).repartition(*keys).sortWithinPartitions(*keys, "query")
    return dealt.mapInArrow(_search, LINKS)


def forms(words: DataFrame, links: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n``: the near word of largest count, if that is twice the word's or more.

    ``links`` as ``near_words`` gives them.
    """
    text = lambda name: F.decode(name, "ISO-8859-1")
    pairs = links.select(text("a").alias("a"), "na", text("b").alias("b"), "nb")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(
        pairs.where(F.length("a") != F.length("b")).select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m"))
    )
    best = sides.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min_by("other", F.struct(-F.col("m"), "other")).alias("other"), F.max("m").alias("m")
    )
    told = words.join(best, "word", "left")
    good = F.col("m") >= 2 * F.col("n")
    return told.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("other")).alias("form"), F.when(good, F.col("m")).alias("form_n"),
    )


def roots(told: DataFrame) -> DataFrame:
    """``word, root``: where the forms lead from each word that has one.

    Each round doubles the steps taken. Counts at least double with every step,
    so a chain is no longer than the binary logarithm of the largest count.
    """
    state = save_and_reload(told.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = save_and_reload(
            state.join(further, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ), "spelling-roots",
        )
        state = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return state


def report(docs: DataFrame) -> DataFrame:
    """One row per word: ``word, n, n_near, form, form_n, root``."""
    words = save_and_reload(vocabulary(docs), "spelling-words")
    told = save_and_reload(forms(words, near_words(words)), "spelling-forms")
    return told.join(roots(told), "word", "left").withColumn("root", F.coalesce("root", "word"))
