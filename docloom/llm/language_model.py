"""A Katz backoff language model of words, counted and evaluated in cells of n-grams by history.

A token's probability is its discounted n-gram estimate where the n-gram was
seen, and otherwise the backoff weight of its context times the estimate of the
next lower order; below the unigrams lies one class for all unknown words.
Counts up to ``DISCOUNTED`` are discounted by Good and Turing; where counts of
counts do not allow that, a fixed share of one is taken off. Backoff weights are
exact: over the vocabulary and the unknown class each context's probabilities
add up to one.

A model of order two has the word before a token for its history, one of order
three the two words before it; at the start of a text stand start marks. Each
history is a context of its own, told by a 64-bit hash, however rare it is.

The tokens of all texts, learned from and asked for, are dealt out to cells by the
word before them. So a cell holds whole contexts, and counts, estimates and scores
its n-grams of both orders by itself; no table of n-grams is stored or joined.

- A word that comes before very many tokens has cells of its own, dealt out by the word
  before it, and so has a very common pair, dealt out by texts. A sample of the texts
  names them; it decides on places only, never on a result.
- Counts of words come from a first shuffle by word, which answers each cell with the
  words it holds. For words and pairs with cells of their own it gives the n-gram counts
  too, and what their contexts add up to.
- A second shuffle, of n-gram hashes alone, tells how many n-grams have each small count.
- Texts are split into words anew for each of ``SLICES`` groups of cells, as the shuffle
  of one group is freed before the next.

A word stands for a 64-bit hash. A null text has the end token only. A null id
is in fold 0; repeated rows get a row each. Without training texts every
token is unknown. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import discard, fold, freed_shuffles
from docloom.session import ship_package, work_path

DISCOUNTED = 5
ORDER = 3
SLICES = 4
# Groups of n-gram hashes that are counted one after the other.
COUNT_SLICES = 2
# Tokens of a cell, about, and tokens that a task puts together before they leave it.
CELL = 700_000
TOKENS = 1_000_000
# Bytes of text that are hashed together, and texts that name the common words.
PIECE = 1 << 20
SAMPLE_TEXTS = 4000
# Numbers that describe a context of a common word or pair.
SUMS = 2 * (DISCOUNTED + 1) + 1

_random = np.random.default_rng(9)
_LETTERS = _random.integers(0, 2**64, 256, dtype=np.uint64)
_LETTERS[65:91] = _LETTERS[97:123]
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = int(_random.integers(0, 2**61)) * 8 + 3
START, END = _random.integers(0, 2**63, 2, dtype=np.int64)


def _powers(base: int, size: int) -> np.ndarray:
    powers = np.full(size, base % 2**64, dtype=np.uint64)
    powers[0] = 1
    return np.cumprod(powers)


_UP, _DOWN = _powers(_BASE, PIECE), _powers(pow(_BASE, -1, 2**64), PIECE)


def spread(x: np.ndarray) -> np.ndarray:
    """Numbers whose bits all depend on all bits of ``x``."""
    x = x.view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of numbers."""
    return spread(a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)).view(np.int64)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomials in the letters of words, told by their places."""
    found, at = np.empty(len(starts), dtype=np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        low, size = starts[at], ends[to - 1] - starts[at]
        up, down = (_UP, _DOWN) if size <= PIECE else (_powers(_BASE, size), _DOWN)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_LETTERS[data[low:low + size]] * up[:size], out=sums[1:])
        found[at:to] = (sums[ends[at:to] - low] - sums[starts[at:to] - low]) * down[starts[at:to] - low]
        at = to
    return spread(found).view(np.int64)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and of its end, and the number of these."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    places = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    places, low = places - places[0], places[0]
    size = places[-1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[low:low + size]
    border = np.zeros(size + 1, dtype=bool)
    border[places] = True
    blank = np.ones(size + 2, dtype=bool)
    blank[1:-1] = _BLANK[data]
    starts = np.flatnonzero(~blank[1:-1] & (blank[:-2] | border[:-1]))
    ends = np.flatnonzero(~blank[1:-1] & (blank[2:] | border[1:])) + 1
    sizes = np.diff(np.searchsorted(starts, places)) + 1
    found = np.full(len(starts) + len(texts), END, dtype=np.int64)
    is_word = np.ones(len(found), dtype=bool)
    is_word[np.cumsum(sizes) - 1] = False
    found[is_word] = _word_hashes(data, starts, ends)
    return found, sizes


@dataclass
class Grams:
    """Tokens of many texts: the word ``w``, ``h`` before it, ``k`` before that, the hash ``g`` of these two, the text's place."""

    w: np.ndarray
    h: np.ndarray
    k: np.ndarray
    g: np.ndarray
    text: np.ndarray
    keys: np.ndarray  # these three by text
    asked: np.ndarray
    trained: np.ndarray

    def where(self, rows: np.ndarray) -> Grams:
        return Grams(*(x[rows] for x in (self.w, self.h, self.k, self.g, self.text)), self.keys, self.asked, self.trained)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[Grams]:
    """Tokens of ``TOKENS`` at a time, from batches (key, text, asked, trained)."""
    held, size = [], 0

    def flush() -> Grams:
        words, sizes, keys, asked, trained = (np.concatenate(x) for x in zip(*held, strict=True))
        first = np.cumsum(sizes) - sizes
        before = np.roll(words, 1)
        before[first] = START
        second = np.roll(before, 1)
        second[first] = START
        return Grams(words, before, second, mixed(second, before), np.repeat(np.arange(len(sizes)), sizes), keys, asked, trained)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found, sizes = tokens(part.column(1))
            held.append((found, sizes, *(part.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))))
            size += len(found)
            if size >= TOKENS:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of ``key``, where its distinct values begin there, and a place of each."""
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, dtype=np.int64)
    return order, begin, order[begin]


def _dealt(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Each part with its rows of the columns, as bytes."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    columns = [c[order] for c in columns]
    parts, begin = np.unique(part[order], return_index=True)
    for number, low, high in zip(parts.tolist(), begin, [*begin[1:], len(order)], strict=True):
        yield number, *(c[low:high].tobytes() for c in columns)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)


@dataclass
class Places:
    """The cells: ``cells`` for most words, then some for each common word, then some for each common pair."""

    cells: int
    words: np.ndarray  # sorted, as ``pairs``
    pairs: np.ndarray
    first: np.ndarray  # first cell and number of cells, of the words and then the pairs
    many: np.ndarray
    word_of: np.ndarray  # of each pair the place of its last word

    def of(self, grams: Grams) -> np.ndarray:
        cell = (spread(grams.h) % np.uint64(self.cells)).astype(np.int32)
        for common, own, dealer, skip in ((self.words, grams.h, grams.k, 0), (self.pairs, grams.g, grams.keys[grams.text], len(self.words))):
            if len(common):
                at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                mine = common[at] == own
                at = at[mine] + skip
                cell[mine] = self.first[at] + (spread(dealer[mine]) % self.many[at].astype(np.uint64)).astype(np.int64)
        return cell

    def owner(self, cell: np.ndarray) -> np.ndarray:
        """The common word or, after these, common pair that has a cell; -1 for none."""
        return np.where(cell < self.cells, -1, np.searchsorted(self.first, cell, "right") - 1)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sampled texts the n-grams by history; ``h`` is null for the number of all."""
    for grams in _grams(batches):
        at = _distinct(mixed(mixed(grams.w, grams.g), grams.text))[2]
        h, g = grams.h[at], grams.g[at]
        yield pa.RecordBatch.from_arrays([pa.array([len(at)]), pa.array([0]), pa.array([None], pa.int64())], ["n", "g", "h"])
        for pair in (False, True):
            order, begin, at = _distinct(g if pair else h)
            n = np.diff(np.concatenate((begin, [len(order)])))
            often = n > 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(n[often]), pa.array(g[at][often], mask=np.full(often.sum(), not pair)), pa.array(h[at][often])], ["n", "g", "h"]
            )


def places(source: DataFrame) -> Places:
    """Cells for ``source`` (key, text, asked, trained), from its size and a sample."""
    rows = source.count()
    step = max(1, rows // SAMPLE_TEXTS)
    some = source.where(F.pmod("key", F.lit(step)) == 0)
    found = some.mapInArrow(_common, "n long, g long, h long").groupBy("g", "h").agg(F.sum("n").alias("n"))
    with freed_shuffles(source.sparkSession):
        seen = (found.where(F.col("h").isNull()).agg(F.sum("n")).first()[0] or 0) * step
        cells = max(1, ceil(seen / CELL))
        often = found.where(F.col("h").isNotNull() & (F.col("n") * step > max(CELL / 2, 1))).collect() if cells > 1 else []
    words = {r.h: r.n * step for r in often if r.g is None}
    pairs = {r.g: (r.h, r.n * step) for r in often if r.g is not None}
    for h, n in pairs.values():
        words[h] = max(words.get(h, 0), n)
    names, sides = sorted(words), sorted(pairs)
    many = np.array([ceil(n / CELL) for n in [*(words[h] for h in names), *(pairs[g][1] for g in sides)]], dtype=np.int64)
    names, sides = np.array(names, dtype=np.int64), np.array(sides, dtype=np.int64)
    last = np.array([pairs[g][0] for g in sides.tolist()], dtype=np.int64)
    return Places(cells, names, sides, cells + np.cumsum(many) - many, many, np.searchsorted(names, last))


def _asked_words(where: Places):
    """The distinct words of each cell with their training counts, for the parts of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams in _grams(batches):
            cell = where.of(grams)
            order, begin, at = _distinct(mixed(grams.w, cell.astype(np.int64)))
            n = np.add.reduceat(grams.trained[grams.text][order].astype(np.int64), begin)
            w = grams.w[at]
            rows = list(_dealt((spread(w) >> np.uint64(20)) % np.uint64(where.cells), w, cell[at], n))
            yield _batch(rows, ["part", "w", "cell", "n"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()])

    return run


def _summed(n: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``n`` by keys: a place and the sum of each distinct key, and by row which it belongs to."""
    order = np.lexsort(keys)
    new = np.zeros(len(n), dtype=bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    begin = np.flatnonzero(new)
    which = np.empty(len(n), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return order[begin], np.add.reduceat(n[order], begin) if len(n) else n, which


def _by_class(n: np.ndarray) -> list[int]:
    """How many numbers are 1 to ``DISCOUNTED``, and the sum of larger ones."""
    return [*np.bincount(n[n <= DISCOUNTED], minlength=DISCOUNTED + 1)[1:].tolist(), int(n[n > DISCOUNTED].sum())]


def _answers(where: Places):
    """From a part's words the counts that each cell asks for; rows of a negative cell are sums."""
    kinds = pa.schema([("cell", pa.int32()), *((x, pa.binary()) for x in ("w", "c1", "c2", "c3")), ("sums", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        w, cell, n = _joined(table, "w", np.int64), _joined(table, "cell", np.int32), _joined(table, "n", np.int64)
        at, n, _ = _summed(n, cell, w)
        w, cell = w[at], cell[at]
        at, c1, which = _summed(n, w)
        known = c1[c1 > 0]
        few = np.bincount(known[known <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)[1:].tolist()
        rows = [(-1, None, None, None, None, [len(known), int(c1.sum()), *few, *[0] * (SUMS - 3 - DISCOUNTED)])]
        c1 = c1[which]
        c2, c3 = np.zeros_like(n), np.zeros_like(n)
        owner = where.owner(cell)
        skip = len(where.words)
        if (own := np.flatnonzero(owner >= 0)).size:
            mine = owner[own]
            word = np.where(mine < skip, mine, where.word_of[np.maximum(mine - skip, 0)] if len(where.pairs) else mine)
            for rest, name, counts in ((own, word, c2), (own[mine >= skip], mine[mine >= skip], c3)):
                if rest.size:
                    at, sums, which = _summed(n[rest], name, w[rest])
                    counts[rest] = sums[which]
                    lower = (c1 if counts is c2 else c2)[rest][at]
                    for o in np.unique(name).tolist():
                        has = (name[at] == o) & (sums > 0)
                        rows.append((-2 - o, None, None, None, None, [int(sums[has].sum()), *_by_class(sums[has]), *_by_class(lower[has])]))
        order = np.argsort(cell, kind="stable")
        for number, *rest in _dealt(cell[order], w[order], c1[order], c2[order], c3[order]):
            rows.append((number, *rest, None))
        return pa.Table.from_batches([_batch(rows, kinds.names, kinds.types)])

    return run


def _hashes(order: int, part: int, cells: int):
    """Hashes of training n-grams in group ``part``, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams in _grams(batches):
            grams = grams.where(grams.trained[grams.text])
            for n in range(2, order + 1):
                name = mixed(grams.w, grams.h if n == 2 else grams.g)
                name = np.sort(name[name.view(np.uint64) % np.uint64(COUNT_SLICES) == part])
                name, count = np.unique(name, return_counts=True)
                rows = [(n, *r) for r in _dealt((name.view(np.uint64) >> np.uint64(20)) % np.uint64(cells), name, count.astype(np.int32))]
                yield _batch(rows, ["size", "part", "name", "n"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    return run


def _how_many(table: pa.Table) -> pa.Table:
    """Of n-grams of one size, how many have each small count."""
    name, n = _joined(table, "name", np.int64), _joined(table, "n", np.int32).astype(np.int64)
    order, begin, _ = _distinct(name)
    n = np.add.reduceat(n[order], begin)
    few = np.bincount(n[n <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)
    return pa.table({"size": pa.array([table.column("size")[0].as_py()], pa.int32()), "few": pa.array([few.tolist()], pa.list_(pa.int64()))})


def discounts(counts: dict[int, int]) -> list[float]:
    """Factors for counts 1 to ``DISCOUNTED`` from the number of n-grams with each count."""
    n = [counts.get(r, 0) for r in range(DISCOUNTED + 2)]
    if all(n[1:]):
        common = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1]
        found = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common != 1 else 0 for r in range(1, DISCOUNTED + 1)]
        if all(0 < d <= 1 for d in found):
            return found
    share = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return [(r - share) / r for r in range(1, DISCOUNTED + 1)]


def discounted(count: np.ndarray, factors: list[float]) -> np.ndarray:
    return count * np.array([1, *factors, 1])[np.minimum(count, DISCOUNTED + 1).astype(np.int64)]


@dataclass
class Estimates:
    """What cells need to know of all texts."""

    order: int
    factors: list[list[float]]  # by order
    tokens: int
    size: int
    kept_mass: float  # sum of discounted unigram counts
    unknown: float  # probability of the class of unknown words
    contexts: dict[int, list[int]]  # of common words and pairs: counts, and counts one order below, by class

    def unigram(self, count: np.ndarray) -> np.ndarray:
        known = discounted(count, self.factors[0]) * ((1 - self.unknown) / self.kept_mass if self.kept_mass else 0.0)
        return np.where(count > 0, known, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 probability of words in the add-0.1 unigram model."""
        return np.log10((count + 0.1) / (self.tokens + 0.1 * (self.size + 1)))

    def mass(self, classes: list[int], order: int) -> float:
        """The sum of discounted counts of an order, from counts by class."""
        return sum(r * d * n for r, (d, n) in enumerate(zip(self.factors[order - 1], classes, strict=False), 1)) + classes[-1]

    def weights(self, total, seen, below):
        """Scale of the discounted counts of contexts, and backoff weight."""
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.maximum(1 - seen / total, 1 / (total + 1))
            return (1 - left) / seen, np.where(total > 0, left / (1 - below), 1.0)

    def raised(self, count, lower, order, context=None, known=None):
        """Estimates of an order for n-grams with their count and estimate below, by contexts or by a known one."""
        value = discounted(count, self.factors[order - 1])
        if known is None:
            _, which = np.unique(context, return_inverse=True)
            sums = (np.bincount(which, x) for x in (count, value, np.where(count > 0, lower, 0)))
            scale, alpha = (x[which] for x in self.weights(*sums))
        else:
            scale, alpha = known
        return np.where(count > 0, value * scale, alpha * lower)


def _scored(where: Places, model: Estimates, parts: int):
    """The share of a cell in the scores of its texts."""
    kinds = [pa.int32(), *[pa.binary()] * 5]

    def known(owner: int, order: int, scale: float):
        """Scale and backoff weight of a common context; ``scale`` turns discounted counts one order below into estimates."""
        total, *classes = model.contexts.get(owner, [0] * SUMS)
        seen, below = model.mass(classes[:DISCOUNTED + 1], order), model.mass(classes[DISCOUNTED + 1:], order - 1) * scale
        return tuple(map(float, model.weights(*map(np.float64, (total, seen, below)))))

    def run(key, grams: pa.Table, counts: pa.Table) -> pa.Table:
        if grams.num_rows == 0:
            return pa.Table.from_batches([_batch([], SHARES, kinds)])
        w, h, g = (_joined(grams, x, np.int64) for x in ("w", "h", "g"))
        n = _joined(grams, "n", np.int32).astype(np.int64)
        keys, asked = _joined(grams, "keys", np.int64), _joined(grams, "asked", bool)
        sizes = [len(x) // 8 for x in grams.column("keys").to_pylist()]
        rows = [len(x) // 4 for x in grams.column("n").to_pylist()]
        text = _joined(grams, "text", np.int32) + np.repeat(np.cumsum(sizes) - sizes, rows)
        trained, n = np.maximum(n, 0), np.abs(n)
        word, *told = (_joined(counts, x, np.int64) for x in ("w", "c1", "c2", "c3"))
        order = np.argsort(word)
        # Distinct n-grams, with the counts of their last word.
        begin, which = np.unique(mixed(w, g), return_index=True, return_inverse=True)[1:]
        count = np.bincount(which, trained)
        w, h, g = w[begin], h[begin], g[begin]
        c1, c2, c3 = (x[order[np.searchsorted(word, w, sorter=order)]] for x in told)
        p = model.unigram(c1)
        owner = int(where.owner(np.array([key[0].as_py()]))[0])
        pair = owner >= len(where.words)
        if owner < 0:
            first, of = np.unique(mixed(w, h), return_index=True, return_inverse=True)[1:]
            p = model.raised(np.bincount(of, count), p[first], 2, context=h[first])[of]
        else:
            name = int(where.word_of[owner - len(where.words)]) if pair else owner
            below = (1 - model.unknown) / model.kept_mass if model.kept_mass else 0.0
            weights = known(name, 2, below)
            p = model.raised(c2, p, 2, known=weights)
        if model.order == 3:
            p = model.raised(c3, p, 3, known=known(owner, 3, weights[0])) if pair else model.raised(count, p, 3, context=g)
        shares = (n, n * (c1 > 0)[which], n * model.base(c1)[which], n * np.log10(p)[which])
        rest = np.flatnonzero(asked[text])
        names, of = np.unique(keys[text[rest]], return_inverse=True)
        sums = [np.bincount(of, x[rest], len(names)) for x in shares]
        dealt = _dealt((spread(names) % np.uint64(parts)), names, sums[0].astype(np.int32), sums[1].astype(np.int32), *sums[2:])
        return pa.Table.from_batches([_batch(list(dealt), SHARES, kinds)])

    return run


SHARES = ["part", "keys", "n_tokens", "n_known", "base_score", "score"]


def _added(table: pa.Table) -> pa.Table:
    """Sums of the shares by text."""
    keys, of = np.unique(_joined(table, "keys", np.int64), return_inverse=True)
    sums = {x: np.bincount(of, _joined(table, x, kind)) for x, kind in zip(SHARES[2:], (np.int32, np.int32, float, float), strict=True)}
    return pa.table({"key": keys, **{x: v.astype(np.int64) if x.startswith("n_") else v for x, v in sums.items()}})


def _to_cells(where: Places, part: int, slices: int):
    """Distinct n-grams of each text in the cells of group ``part``; counts of texts not learned from are negative."""
    names = ["cell", "w", "h", "g", "n", "text", "keys", "asked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams in _grams(batches):
            cell = where.of(grams)
            mine = np.flatnonzero(cell % slices == part)
            cell, grams = cell[mine], grams.where(mine)
            order, begin, at = _distinct(mixed(mixed(grams.w, grams.g), grams.text))
            n = np.diff(np.concatenate((begin, [len(order)])))
            grams, cell = grams.where(at), cell[at]
            n = np.where(grams.trained[grams.text], n, -n)
            order = np.lexsort((grams.h, cell))
            grams, cell, n = grams.where(order), cell[order], n[order]
            rows = []
            for number, w, h, g, n, text in _dealt(cell, grams.w, grams.h, grams.g, n.astype(np.int32), grams.text.astype(np.int32)):
                used, text = np.unique(np.frombuffer(text, np.int32), return_inverse=True)
                rows.append((number, w, h, g, n, text.astype(np.int32).tobytes(), grams.keys[used].tobytes(), grams.asked[used].tobytes()))
            yield _batch(rows, names, [pa.int32(), *[pa.binary()] * 7])

    return run


def _evaluated(source: DataFrame, order: int, slices: int) -> tuple[Estimates, str]:
    """Estimates from the trained rows of ``source`` (key, text, asked, trained), and a table of sums by key and group of cells."""
    spark = source.sparkSession
    ship_package(spark)
    where = places(source)
    words_path, path = work_path(spark, "lm-words"), work_path(spark, "lm-scores")
    with freed_shuffles(spark):
        asked = source.mapInArrow(_asked_words(where), "part int, w binary, cell binary, n binary")
        asked.groupBy("part").applyInArrow(
            _answers(where), "cell int, w binary, c1 binary, c2 binary, c3 binary, sums array<long>"
        ).write.parquet(words_path)
        words = spark.read.parquet(words_path)
        added = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(SUMS)]
        sums = {r[0]: list(r[1:]) for r in words.where("cell < 0").groupBy("cell").agg(*added).collect()}
        few = {n: [0] * (DISCOUNTED + 2) for n in range(2, order + 1)}
        for part in range(COUNT_SLICES):
            hashes = source.where("trained").mapInArrow(_hashes(order, part, where.cells), "size int, part int, name binary, n binary")
            counted = hashes.groupBy("size", "part").applyInArrow(_how_many, "size int, few array<long>")
            for r in counted.groupBy("size").agg(*(F.sum(F.col("few")[i]) for i in range(DISCOUNTED + 2))).collect():
                few[r[0]] = [a + b for a, b in zip(few[r[0]], r[1:], strict=True)]
        size, total, *ones = sums.pop(-1, [0] * SUMS)[:3 + DISCOUNTED]
        factors = [discounts(dict(enumerate(ones, 1))), *(discounts(dict(enumerate(few[n]))) for n in range(2, order + 1))]
        contexts = {-2 - k: v for k, v in sums.items()}
        model = Estimates(order, factors, total, size, 0.0, 1.0, contexts)
        if total:
            rare = sum(r * n for r, n in enumerate(ones[:DISCOUNTED], 1))
            model.kept_mass = model.mass([*ones[:DISCOUNTED], total - rare], 1)
            model.unknown = max(1 - model.kept_mass / total, 1 / (total + 1))
        counts = words.where("cell >= 0").drop("sums")
        for part in range(slices):
            grams = source.mapInArrow(
                _to_cells(where, part, slices), "cell int, w binary, h binary, g binary, n binary, text binary, keys binary, asked binary"
            )
            mine = counts.where(F.col("cell") % slices == part)
            shares = grams.groupBy("cell").cogroup(mine.groupBy("cell")).applyInArrow(
                _scored(where, model, where.cells), "part int, keys binary, n_tokens binary, n_known binary, base_score binary, score binary"
            )
            shares.groupBy("part").applyInArrow(
                _added, "key long, n_tokens long, n_known long, base_score double, score double"
            ).write.mode("append").parquet(path)
    discard(source, words_path)
    return model, path


def _rows(docs: DataFrame, path: str) -> DataFrame:
    """Each row of ``docs`` (key, doc_id) with its sums; equal rows have one key and added up under it."""
    sums = docs.sparkSession.read.parquet(path).groupBy("key").agg(*(F.sum(x).alias(x) for x in SHARES[2:]))
    ids = docs.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("rows"))
    each = [(F.col(x) / F.col("rows")).cast("long" if x.startswith("n_") else "double").alias(x) for x in SHARES[2:]]
    return ids.join(sums, "key").withColumn("row", F.explode(F.sequence(F.lit(1), "rows"))).select("doc_id", *each)


@dataclass
class Model:
    """The texts to learn from; counted where others meet them."""

    texts: DataFrame
    order: int


def fit(texts: DataFrame, order: int = 2) -> Model:
    """A model of order two or three of ``texts`` (column ``text``)."""
    return Model(texts.select("text"), order)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))


def score(docs: DataFrame, model: Model, trained: bool = False, slices: int = SLICES) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` for every row of ``docs``.

    ``trained`` says that ``docs`` are the texts the model is fitted on.
    """
    keyed = _keyed(docs)
    source = keyed.select("key", "text", F.lit(True).alias("asked"), F.lit(trained).alias("trained"))
    if not trained:
        learned = model.texts.select(F.xxhash64("text").alias("key"), "text", F.lit(False).alias("asked"), F.lit(True).alias("trained"))
        source = source.unionByName(learned)
    return _rows(keyed, _evaluated(source, model.order, slices)[1])


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts, the base score, and the model's score."""
    held = fold(F.col("doc_id"), 10) == 0
    keyed = _keyed(docs)
    model, path = _evaluated(keyed.select("key", "text", F.lit(True).alias("asked"), (~held).alias("trained")), ORDER, SLICES)
    return _rows(keyed, path).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
