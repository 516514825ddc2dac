"""Packing token sequences by vector bin packing with the dot-product heuristic.

A sequence has limits on its tokens, its segments (pieces of documents) and its
loss-bearing tokens. A document's first ``prompt`` tokens bear no loss, as in
instruction data; in plain documents all tokens do. Each task packs the
documents of its own partition. It fills one sequence at a time and always adds
the waiting piece whose demands have the greatest dot product with what is left
of the limits. Once no piece fits, one is cut to fill the sequence, unless the
gap is shorter than ``MIN_PIECE``. What is left at the end of a partition goes
into sequences whose lengths are powers of two, which need no padding.

At most ``WAITING`` pieces wait at a time, so memory is bounded; a longer
document is cut as it comes. Each token lies in exactly one piece. A null text
is empty and holds the closing id alone; null ids are carried as they are, and
repeated rows are packed one by one. An empty table gives an empty result. The
number of a sequence holds the number of the partition that made it.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm.common import fresh, release_memory
from docloom.session import ship_package

CLOSING_ID = 1
WAITING = 2048
MIN_PIECE = 16
# Words and stems whose ids a worker remembers in each of two generations, about 250 bytes
# each, and texts that are tokenised at once.
REMEMBERED = 60_000
TEXTS = 256

# Words of these letters and signs are tokenised in two parts, as the
# tokenizer's own splitting does; apostrophes and digits are not among them.
SIMPLE = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Memory:
    """What has been worked out for the keys in use, in two generations.

    Keys in use move to the young one. Once that is full it becomes the old one,
    and keys that nothing has used since the last time are forgotten.
    """

    def __init__(self, size: int):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys) -> set:
        """The keys that are not known; all others are young from now on."""
        missing = set(keys).difference(self.young)
        for key in missing & self.old.keys():
            self.young[key] = self.old.pop(key)
            missing.discard(key)
        return missing

    def age(self) -> None:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


class WordEncoder:
    """Ids of whole texts as little-endian bytes, word by word with a bounded memory.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its words in order. The letters of a simple word are one piece
    for the tokenizer, and go to its merging model directly. Texts that hold one of the
    tokenizer's added tokens, which it takes out before it splits, go to it as a whole.
    """

    def __init__(self, definition: str, remembered: int | None = None):
        remembered = REMEMBERED if remembered is None else remembered
        self.tokenizer = Tokenizer.from_str(definition)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = re.compile("|".join(re.escape(t.content) for t in added) or "(?!)")
        self.words, self.stems = Memory(remembered), Memory(remembered)

    def _stem(self, stem: str) -> bytes:
        letters = stem if stem.isascii() else stem.encode("utf-8").decode("latin-1").translate(self.letters)
        return packed([t.id for t in self.model.tokenize(letters)])

    def _learn(self, fresh_words: set[bytes]) -> None:
        # Fresh words as (word, end) by stem; the stem of a word that is not simple is empty.
        by_stem: dict[str, list[tuple[bytes, str]]] = {"": []}
        ends, simple = {""}, SIMPLE.fullmatch
        for word in fresh_words:
            text = word.decode("utf-8")
            found = simple(text)
            stem, rest = (found[1].lower(), found[2]) if found else ("", text)
            ends.add(rest)
            if stem in by_stem:
                by_stem[stem].append((word, rest))
            else:
                by_stem[stem] = [(word, rest)]
        stems, words = self.stems.young, self.words.young
        for stem in self.stems.missing(by_stem.keys()):
            stems[stem] = self._stem(stem) if stem else b""
        others = list(ends)
        known = {
            part: packed(x.ids)
            for part, x in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True)
        }
        for stem, members in by_stem.items():
            ids = stems[stem]
            for word, rest in members:
                words[word] = ids + known[rest] if rest else ids
        self.stems.age()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        special = {i for i, t in enumerate(texts) if t and self.added.search(t)}
        split = [() if i in special else (t or "").encode("utf-8").split() for i, t in enumerate(texts)]
        missing = self.words.missing(set().union(*split))
        if missing:
            self._learn(missing)
        known = self.words.young.__getitem__
        out = [b"".join(map(known, words)) for words in split]
        for i in special:
            out[i] = packed(self.tokenizer.encode(texts[i], add_special_tokens=False).ids)
        self.words.age()
        return out


class Packer:
    """Packs pieces (document, start, length) into sequences under the limits."""

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
        self.size, self.sequence = limits.tokens, first_sequence
        self.waiting: list[tuple[int, int, int]] = []
        self.prompts: dict[int, int] = {}

    def demand(self, piece: tuple[int, int, int]) -> tuple[int, int, int]:
        doc, start, length = piece
        silent = min(max(self.prompts.get(doc, 0) - start, 0), length)
        return length, 1, length - silent

    def add(self, doc: int, length: int, prompt: int) -> Iterator[tuple]:
        """Take a document; yields (document, start, length, sequence, offset) as sequences fill."""
        self.prompts[doc] = prompt
        start = 0
        while length - start >= self.size and self.demand((doc, start, self.size))[2] <= self.limits[2]:
            yield doc, start, self.size, self.sequence, 0
            self.sequence += 1
            start += self.size
        while start < length:
            step = min(self.size, length - start)
            self.waiting.append((doc, start, step))
            start += step
        if len(self.waiting) > WAITING:
            yield from self._fill(WAITING // 2)

    def _fill(self, leave: int) -> Iterator[tuple]:
        """Pack until at most ``leave`` pieces wait, or less than a full sequence."""
        pieces = self.waiting
        demands = np.array([self.demand(p) for p in pieces], dtype=np.float64).reshape(-1, 3)
        there = np.ones(len(pieces), dtype=bool)
        tokens, segments, loss = demands.T.copy()
        count, total = len(pieces), float(tokens.sum())
        limit = self.limits
        while count > leave and total >= self.size:
            left, offset, chosen = limit.copy(), 0, []
            while left[1] >= 1:
                fits = there & (tokens <= left[0]) & (loss <= left[2])
                # Each demand counts by its share of the limit, and so does what is left.
                weight = left / limit / limit
                at = int(np.argmax(np.where(fits, tokens * weight[0] + segments * weight[1] + loss * weight[2], -1.0)))
                if not fits[at]:
                    break
                chosen.append(pieces[at])
                left -= (tokens[at], 1, loss[at])
                there[at] = False
                count -= 1
                total -= tokens[at]
            gap = int(min(left[0], left[2]))
            if left[1] >= 1 and gap >= (MIN_PIECE if chosen else 1) and count:
                # The longest piece gives the part that fills the gap.
                at = int(np.argmax(np.where(there, tokens, -1.0)))
                doc, start, length = pieces[at]
                if length > gap:
                    chosen.append((doc, start, gap))
                    pieces[at] = (doc, start + gap, length - gap)
                    tokens[at], _, loss[at] = self.demand(pieces[at])
                    total -= gap
            for doc, start, length in chosen:
                yield doc, start, length, self.sequence, offset
                offset += length
            self.sequence += 1
        self.waiting = [p for p, here in zip(pieces, there, strict=True) if here]

    def close(self) -> Iterator[tuple]:
        """Pack what still waits: full sequences first, then lengths that are powers of two."""
        yield from self._fill(0)
        rest, self.waiting = self.waiting, []
        total = sum(p[2] for p in rest)
        while rest:
            room = 1 << (total.bit_length() - 1)
            left = np.array([room, self.limits[1], self.limits[2]])
            offset = 0
            while rest and left[1] >= 1 and min(left[0], left[2]) >= 1:
                doc, start, length = rest.pop()
                step = int(min(length, left[0], left[2]))
                if step < length:
                    rest.append((doc, start + step, length - step))
                yield doc, start, step, self.sequence, offset
                offset += step
                left -= self.demand((doc, start, step))
            total -= offset
            self.sequence += 1


_encoders: dict[tuple[int, int], WordEncoder] = {}


def _pack_batches(definition, limits: Limits, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = definition.value
        # One encoder for each worker, so that words are remembered between tasks.
        key = hash(text), remembered
        if key not in _encoders:
            _encoders[key] = WordEncoder(text, remembered)
        encoder = _encoders[key]
        packer = Packer(limits, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36)
        closing = np.array([CLOSING_ID], dtype="<u4").tobytes()
        held: dict[int, tuple] = {}
        count = 0

        def rows(pieces) -> Iterator[pa.RecordBatch]:
            out = []
            for doc, start, length, sequence, offset in pieces:
                key, ids = held[doc]
                out.append((key, start, length, ids[4 * start:4 * (start + length)], len(ids) // 4, sequence, offset))
                if len(out) >= 1024:
                    yield table(out)
                    out = []
            if out:
                yield table(out)

        def table(out):
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], NAMES)

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                keys, texts, prompts = (c.to_pylist() for c in part.columns)
                for key, ids, prompt in zip(keys, encoder.encode(texts), prompts, strict=True):
                    ids += closing
                    held[count] = (key, ids)
                    yield from rows(packer.add(count, len(ids) // 4, prompt or 0))
                    count += 1
            waiting = {p[0] for p in packer.waiting}
            held = {doc: x for doc, x in held.items() if doc in waiting}
            packer.prompts = {doc: packer.prompts[doc] for doc in waiting}
            release_memory()
        yield from rows(packer.close())
        release_memory()

    return run


NAMES = ["row_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def pack(
    docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), prompt: str | None = None, remembered: int = REMEMBERED
) -> DataFrame:
    """Pieces with their ids: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian 32-bit numbers. ``prompt`` names a column with the
    number of leading tokens without loss. ``remembered`` bounds the memory of words of
    a worker: more of it saves time, and the pieces are the same.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    prompts = (F.col(f"`{prompt}`") if prompt else F.lit(0)).cast("long")
    name, = fresh(docs, "pack_prompt")
    rows = docs.select("doc_id", "text", prompts.alias(name))
    pieces = rows.mapInArrow(
        _pack_batches(definition, limits, remembered),
        "row_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
    return pieces.withColumnRenamed("row_id", "doc_id")


def report(docs: DataFrame, tokenizer_path: str, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece, with a checksum in place of its ids."""
    return pack(docs, tokenizer_path, remembered=remembered).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
