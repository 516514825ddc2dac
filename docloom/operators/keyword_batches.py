"""Counts many keywords in one pass over each text, inside Arrow batches.

Spark has no function that looks for many substrings at once, and testing one
after the other reads a body as often as there are keywords.

No keyword holds white space, so its occurrences lie within the words of a text. Arrow
numbers the distinct words of a block of texts; the keywords are looked for in each of
them once, and the counts of a text are those of its words, added up in arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MATCHES_AT_ONCE = 1_000_000
CELLS_AT_ONCE = 4_000_000
# Bytes of the texts whose words are numbered together.
BYTES_AT_ONCE = 8_000_000


def overlaps_itself(word: str) -> bool:
    return any(word[:n] == word[-n:] for n in range(1, len(word)))


class KeywordCounter:
    """Non-overlapping occurrences of each keyword in a lower-cased text."""

    def __init__(self, words: list[str]):
        import ahocorasick

        self.n = len(words)
        self.lengths = [len(w) for w in words]
        self.repeating = np.array([overlaps_itself(w) for w in words], dtype=bool)
        self.automaton = ahocorasick.Automaton()
        self.longer = ahocorasick.Automaton()
        # Keywords of one or two letters make up most matches: they are looked up in an array
        # by the numbers of their letters. Zero stands for all other letters.
        short = {w: i for i, w in enumerate(words) if len(w) <= 2 and not self.repeating[i]}
        letters = sorted({ord(c) for w in short for c in w})
        self.letter = np.zeros(0x110000, dtype=np.int32)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        width = len(letters) + 1
        self.single, self.pair = np.full(width, -1), np.full((width, width), -1)
        for place, word in enumerate(words):
            self.automaton.add_word(word, place)
            if word not in short:
                self.longer.add_word(word, place)
            elif len(word) == 1:
                self.single[self.letter[ord(word)]] = place
            else:
                self.pair[tuple(self.letter[[ord(c) for c in word]])] = place
        self.automaton.make_automaton()
        self.longer.make_automaton()

    def counts(self, text: str) -> np.ndarray:
        total = np.zeros(self.n, dtype=np.int64)
        free_from: dict[int, int] = {}
        found = self.automaton.iter(text)
        while chunk := list(islice(found, MATCHES_AT_ONCE)):
            places = np.fromiter(map(itemgetter(1), chunk), np.int64, len(chunk))
            total += np.bincount(places, minlength=self.n)
            # A keyword such as "anan" can meet itself: matches that begin
            # inside the one counted before are taken back.
            for i in np.flatnonzero(self.repeating[places]):
                end, place = chunk[i]
                if end - self.lengths[place] + 1 < free_from.get(place, 0):
                    total[place] -= 1
                else:
                    free_from[place] = end + 1
        return total

    def matches_in(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The keywords in each of many words, once for every occurrence: where those of a word begin, and which.

        One pass over all words, which hold no line break.
        """
        ends = np.cumsum(np.asarray(pc.utf8_length(words)).astype(np.int64) + 1)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_py()
        code = self.letter[np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)]
        ats, places = [], []
        for found in (self.single[code], self.pair[code[:-1], code[1:]]):
            ats.append(np.flatnonzero(found >= 0))
            places.append(found[ats[-1]])
        free_from: dict[int, int] = {}
        found = self.longer.iter(joined) if len(self.longer) else iter(())
        while chunk := list(islice(found, MATCHES_AT_ONCE)):
            at = np.fromiter(map(itemgetter(0), chunk), np.int64, len(chunk))
            which = np.fromiter(map(itemgetter(1), chunk), np.int64, len(chunk))
            taken = np.ones(len(chunk), dtype=bool)
            # As in ``counts``: a keyword that meets itself counts once.
            for i in np.flatnonzero(self.repeating[which]):
                end, place = chunk[i]
                if end - self.lengths[place] + 1 < free_from.get(place, 0):
                    taken[i] = False
                else:
                    free_from[place] = end + 1
            ats.append(at[taken])
            places.append(which[taken])
        owner = np.concatenate([np.searchsorted(ends, at, side="right") for at in ats])
        starts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words)))))
        return starts, np.concatenate(places)[np.argsort(owner, kind="stable")]

    def table(self, texts: pa.Array) -> np.ndarray:
        """Counts with a row for each text and a column for each keyword."""
        total = np.zeros((len(texts), self.n), dtype=np.int64)
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        starts, places = self.matches_in(coded.dictionary)
        words = np.asarray(coded.indices)
        sizes = (starts[1:] - starts[:-1])[words]
        rows = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(split)))
        # So many words at a time that their matches stay few.
        until = np.cumsum(sizes)
        cuts = np.searchsorted(until, np.arange(MATCHES_AT_ONCE, until[-1] + MATCHES_AT_ONCE, MATCHES_AT_ONCE)) + 1
        first = 0
        for last in np.unique(np.minimum(cuts, len(words))):
            n, begin = sizes[first:last], starts[words[first:last]]
            at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
            low = rows[first]
            cells = np.repeat((rows[first:last] - low) * self.n, n) + places[at]
            high = rows[last - 1] + 1
            total[low:high] += np.bincount(cells, minlength=(high - low) * self.n).reshape(-1, self.n)
            first = last
        return total


def blocks(texts: pa.Array, rows: int) -> Iterator[tuple[int, int]]:
    """First and last row of blocks of texts of bounded size."""
    until = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
    first = 0
    while first < len(texts):
        before = until[first - 1] if first else 0
        last = int(np.searchsorted(until, before + BYTES_AT_ONCE, side="right"))
        last = max(first + 1, min(last, first + rows))
        yield first, last
        first = last


def score_batches(
    slices: list[list[tuple]], id_type: pa.DataType, keep: int | None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function for ``mapInArrow`` over ``(key, text)`` giving ``(query_id, key, matches)``.

    The key is a struct, ordered by its fields.

    A slice holds ``(query_id, keyword, weight)``, all of its queries. Texts are read and
    their keywords counted once for all slices; then the queries are added up slice by slice. With
    ``keep`` only the best rows per query of the whole task leave it, ties going to the lower key.
    """
    words = sorted({t[1] for terms in slices for t in terms})
    ids = []
    word_place = {w: i for i, w in enumerate(words)}
    plans = []
    for terms in slices:
        mine = sorted({t[0] for t in terms})
        id_place = {q: i for i, q in enumerate(mine)}
        ordered = sorted((id_place[q], word_place[w], n) for q, w, n in terms)
        columns = np.array([w for _, w, _ in ordered])
        weights = np.array([n for _, _, n in ordered])
        starts = np.unique([q for q, _, _ in ordered], return_index=True)[1]
        plans.append((len(ids), columns, weights, starts))
        ids += mine
    widest = max(len(words), *(len(columns) for _, columns, _, _ in plans))
    # A keyword with white space could lie across words.
    plain = all(w.split() == [w] for w in words)

    def scores(batch: pa.RecordBatch, counter: KeywordCounter):
        """Keys, the number of a slice's first query, and matches of these keys and its queries."""
        for first, last in blocks(batch.column(1), max(1, CELLS_AT_ONCE // widest)):
            keys, texts = (column.slice(first, last - first) for column in batch.columns)
            counts = counter.table(texts) if plain else np.stack([counter.counts(t.as_py() or "") for t in texts])
            for base, columns, weights, starts in plans:
                yield keys, base, np.add.reduceat(counts[:, columns] * weights, starts, axis=1)

    def rows(query_places, keys: pa.Array, matches, names) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[q] for q in query_places], id_type),
                keys,
                pa.array(matches, pa.int64()),
            ],
            names=["query_id", names[0], "matches"],
        )

    def all_rows(batches):
        counter = KeywordCounter(words)
        for batch in batches:
            for keys, base, table in scores(batch, counter):
                row, query = np.nonzero(table)
                yield rows(base + query, keys.take(pa.array(row)), table[row, query], batch.schema.names)

    def best_rows(batches):
        counter = KeywordCounter(words)
        best: list[list[tuple]] = [[] for _ in ids]
        # Matches that a row needs to be among the best of a query.
        least = np.ones(len(ids), dtype=np.int64)
        names = key_type = None
        for batch in batches:
            names, key_type = batch.schema.names, batch.schema.types[0]
            for keys, base, table in scores(batch, counter):
                for place in np.flatnonzero((table >= least[base:base + table.shape[1]]).any(axis=0)):
                    query, column = base + place, table[:, place]
                    row = np.flatnonzero(column >= least[query])
                    if len(row) > keep:
                        enough = np.partition(column[row], -keep)[-keep]
                        row = row[column[row] >= enough]
                    added = [(-int(column[r]), tuple(keys[int(r)].as_py().values())) for r in row]
                    best[query] = sorted(best[query] + added)[:keep]
                    if len(best[query]) == keep:
                        least[query] = -best[query][-1][0]
        flat = [(q, key, -m) for q, found in enumerate(best) for m, key in found]
        if flat:
            fields = [f.name for f in key_type]
            keys = pa.array([dict(zip(fields, f[1], strict=True)) for f in flat], key_type)
            yield rows([f[0] for f in flat], keys, [f[2] for f in flat], names)

    return all_rows if keep is None else best_rows
