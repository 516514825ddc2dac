"""Byte-level BPE encoding and decoding with recursive queries in each partition.

A task cuts its texts at white space that no match of the pattern can span,
and finds the matches of each distinct cut once. Distinct matches become rows
(word, position, token), and a recursive DuckDB query joins neighbours with the
merge table and contracts the leftmost pair of least rank in every word, until
no pair is left; an ordered aggregate gives a word's ids. Decoding joins ids
with the vocabulary and concatenates the bytes in an ordered aggregate.

A match that is a token as a whole is that token. A match of more than
``LONG`` bytes is merged by a heap instead, as a recursion with one merge a
round takes quadratic time on it; the ids are the same. A null text is empty
and has no ids. Null ids and repeated rows are carried as they are, and an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import ship_package

LONG = 256
# Words that one query merges, tokens that one query decodes, and cuts that a worker
# remembers; once so many are known, new ones are forgotten after their batch.
WORDS = 20_000
TOKENS = 500_000
REMEMBERED = 400_000
TEXTS = 512

CUT = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
# With other white space in it, a text is not cut.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")

# ``k`` holds word and position, ``r`` the rank of a token's pair with the next one, ``n`` the round.
ENCODE = """
WITH RECURSIVE step(n, w, k, id, r) AS (
  SELECT 0, t.w, t.k, t.id, m.r
  FROM (SELECT w, k, id, CASE WHEN lead(w) OVER (ORDER BY k) = w THEN lead(id) OVER (ORDER BY k) END AS nxt
        FROM tokens) t
  LEFT JOIN merges m ON m.pair = t.id * 1048576 + t.nxt
  UNION ALL
  SELECT c.n + 1, c.w, c.k, c.id, m.r
  FROM (
    SELECT s.n, s.w, s.k,
           CASE WHEN s.k = b.k THEN b.r ELSE s.id END AS id,
           CASE WHEN s.k = b.k THEN s.second WHEN s.after = b.k THEN b.r ELSE s.first END AS nxt
    FROM (
      SELECT n, w, k, id, lag(k) OVER o AS before, lead(k) OVER o AS after,
             CASE WHEN lead(w) OVER o = w THEN lead(id) OVER o END AS first,
             CASE WHEN lead(w, 2) OVER o = w THEN lead(id, 2) OVER o END AS second
      FROM step WINDOW o AS (ORDER BY k)) s
    JOIN (
      SELECT w, w * 1048576 + best % 1048576 AS k, best // 1048576 AS r
      FROM (SELECT w, min(r * 1048576 + k % 1048576) AS best FROM step GROUP BY w) WHERE best IS NOT NULL) b
      ON s.w = b.w
    WHERE s.before IS DISTINCT FROM b.k) c
  LEFT JOIN merges m ON m.pair = c.id * 1048576 + c.nxt
)
SELECT w, list(id ORDER BY k) AS ids
FROM step JOIN (SELECT w, max(n) AS n FROM step GROUP BY w) USING (w, n) GROUP BY w ORDER BY w
"""

DECODE = """
SELECT d, unhex(string_agg(h, '' ORDER BY p)) AS bytes
FROM ids JOIN vocabulary USING (id) GROUP BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens whose bytes together are a token, with the rank of that token."""
    pairs, found = [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs.append(a * 1048576 + b)
                found.append(rank)
    return pa.table({"pair": pa.array(pairs, pa.int64()), "r": pa.array(found, pa.int64())})


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: the same merges, found through a heap of pairs."""
    ends = list(range(1, len(word) + 1))
    before = list(range(-1, len(word) - 1))
    alive = [True] * len(word)
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = ends[i]
        if j < len(word):
            rank = ranks.get(word[i:ends[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, j, ends[j]))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, i, j, end = heapq.heappop(heap)
        # Entries whose parts have changed since are stale.
        if not (alive[i] and ends[i] == j and j < len(word) and alive[j] and ends[j] == end):
            continue
        alive[j], ends[i] = False, end
        if end < len(word):
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < len(word):
        out.append(ranks[word[i:ends[i]]])
        i = ends[i]
    return out


class Codec:
    """Encoder and decoder of one worker, around an in-process database."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.names = {rank: str(rank) for rank in ranks.values()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.cuts: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.db.register("merges_in", merge_table(ranks))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.db.register("vocabulary_in", pa.table({
            "id": pa.array(list(ranks.values()), pa.int64()), "h": [token.hex() for token in ranks]
        }))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_in")

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of words by the recursive query, as little-endian 32-bit numbers."""
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        w = np.repeat(np.arange(len(words)), sizes)
        p = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
        self.db.register("tokens", pa.table({"w": w, "k": w * 1048576 + p, "id": self.byte_ids[data]}))
        found = self.db.sql(ENCODE).to_arrow_table().column("ids").combine_chunks()
        ids = np.asarray(found.flatten()).astype("<i4").tobytes()
        places = (4 * np.concatenate(([0], np.cumsum(np.asarray(found.value_lengths()))))).tolist()
        return [ids[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]

    def _learn(self, matches: set[str]) -> None:
        short = []
        for match in matches:
            word = match.encode("utf-8")
            rank = self.ranks.get(word)
            if rank is not None:
                self.known[match] = np.array([rank], dtype="<i4").tobytes()
            elif len(word) > LONG:
                self.known[match] = np.array(merge_long(word, self.ranks), dtype="<i4").tobytes()
            else:
                short.append((match, word))
        for at in range(0, len(short), WORDS):
            part = short[at:at + WORDS]
            for (match, _), ids in zip(part, self.merge([w for _, w in part]), strict=True):
                self.known[match] = ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        split = [CUT.findall(t) if not ODD_SPACE.search(t) else [t] if t else [] for t in (t or "" for t in texts)]
        found = {cut: self.pattern.findall(cut) for cut in set().union(*split).difference(self.cuts)}
        matches = {m for parts in found.values() for m in parts}.difference(self.known)
        self._learn(matches)
        for cut, parts in found.items():
            self.cuts[cut] = b"".join([self.known[m] for m in parts])
        out = [b"".join(map(self.cuts.__getitem__, cuts)) for cuts in split]
        for memory, added in ((self.cuts, found), (self.known, matches)):
            if len(memory) > REMEMBERED:
                for name in added:
                    del memory[name]
        return out

    def decode(self, sequences: list[np.ndarray]) -> list[bytes]:
        """Bytes of each sequence of ids; all ids must be known."""
        out = [b""] * len(sequences)
        at = 0
        while at < len(sequences):
            # A block of sequences; a very long one is a block of its own, in parts.
            stop, size = at, 0
            while stop < len(sequences) and (stop == at or size + len(sequences[stop]) <= TOKENS):
                size += len(sequences[stop])
                stop += 1
            if stop == at + 1:
                parts = [sequences[at][i:i + TOKENS] for i in range(0, len(sequences[at]), TOKENS)]
                out[at] = b"".join([self._decode([part])[0] for part in parts])
            else:
                out[at:stop] = self._decode(sequences[at:stop])
            at = stop
        return out

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers with one space between them."""
        return " ".join(map(self.names.__getitem__, ids.tolist())).encode()

    def _decode(self, sequences: list[np.ndarray]) -> list[bytes]:
        sizes = [len(s) for s in sequences]
        ids = np.concatenate(sequences).astype(np.int64)
        self.db.register("ids", pa.table({
            "d": np.repeat(np.arange(len(sequences)), sizes), "p": np.arange(len(ids)), "id": ids,
        }))
        found = self.db.sql(DECODE).to_arrow_table()
        out = [b""] * len(sequences)
        for d, value in zip(found.column("d").to_pylist(), found.column("bytes").to_pylist(), strict=True):
            out[d] = value
        return out


_codecs: dict[tuple[int, str], Codec] = {}


def worker_codec(ranks: dict[bytes, int], pattern: str) -> Codec:
    """The codec of this worker; it outlives a task, and so does what it remembers."""
    key = (hash(frozenset(ranks.items())), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` with the ids as an array, for every row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                found = codec.encode(part.column(1).to_pylist())
                offsets = np.concatenate(([0], np.cumsum([len(b) // 4 for b in found]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(found), dtype="<i4"))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``rows`` (doc_id, ids) with ``decoded``, the bytes; null ids count as none."""
    spark = rows.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                ids = part.column(1)
                sequences = [np.asarray(s.values) if s.is_valid else np.empty(0, np.int32) for s in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), ids, pa.array(codec.decode(sequences), pa.binary())], ["doc_id", "ids", "decoded"]
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def report(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    One pass encodes, decodes what it encoded and takes both digests, so ids and
    decoded texts do not leave their worker.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                sequences = [np.frombuffer(b, dtype="<i4") for b in codec.encode(part.column(1).to_pylist())]
                decoded = codec.decode(sequences)
                yield pa.RecordBatch.from_arrays([
                    part.column(0),
                    pa.array([len(ids) for ids in sequences], pa.int64()),
                    pa.array([hashlib.sha256(codec.decimal(ids)).hexdigest() for ids in sequences]),
                    pa.array([hashlib.sha256(text).hexdigest() for text in decoded]),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
