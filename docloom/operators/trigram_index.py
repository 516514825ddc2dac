"""A substring index over a stored collection: which files hold which trigrams.

A keyword of three letters or more can only be in a file that has all of its
trigrams. The posting table says for each trigram of lower-cased bodies which files have
it; it is sorted by trigram, so a query reads a few row groups. Files that the postings
of any keyword leave over are read and checked exactly, by whatever search is asked for.
So rows are the same as without the index, and a rare keyword reads few files. A shorter
keyword rules nothing out.

Postings are kept per run of a collection, so a delivery costs its own size, and files
hold ``block_rows`` rows of the collection at most to keep blocks small. A null body has no
trigrams; bodies of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions import search as search_functions
from docloom.operators import search
from docloom.session import ship_package, work_path
from docloom.sources.delta_collection import DeltaCollection
from docloom.sources.pages import _exists

POSTINGS = "trigram string, file string"
# A letter's code takes 21 bits.
LETTER = (1 << 21) - 1
BETWEEN = "\n"
# Letters that are looked at together, and trigrams that a task holds of a file.
LETTERS_AT_ONCE = 1_000_000
CODES_HELD = 1_000_000


def trigrams(word: str) -> set[str]:
    return {word[i:i + 3] for i in range(len(word) - 2)}


def _trigrams_of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct ``trigram, file`` of rows ``file, text``; a file's may come in several parts."""
    found: list[pa.Array] = []
    held, last = 0, None

    def part() -> pa.RecordBatch:
        codes = np.asarray(pc.unique(pa.chunked_array(found)))
        letters = np.stack([codes >> 42, (codes >> 21) & LETTER, codes & LETTER], axis=1)
        joined = letters.astype("<u4").tobytes().decode("utf-32-le")
        names = pa.array([joined[i:i + 3] for i in range(0, len(joined), 3)], pa.string())
        return pa.RecordBatch.from_arrays([names, pa.array([last] * len(names), pa.string())], ["trigram", "file"])

    for batch in batches:
        for file, texts in _blocks(batch):
            if found and (file != last or held > CODES_HELD):
                yield part()
                found, held = [], 0
            last = file
            letters = np.frombuffer(BETWEEN.join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
            # Of letters of one text only.
            ends = np.cumsum([len(t) + 1 for t in texts])[:-1] - 1
            inside = np.ones(max(len(letters) - 2, 0), dtype=bool)
            for back in range(3):
                at = ends - back
                inside[at[(at >= 0) & (at < len(inside))]] = False
            codes = ((letters[:-2] << 42) | (letters[1:-1] << 21) | letters[2:])[inside] if len(inside) else letters[:0]
            if len(codes):
                found.append(pc.unique(pa.array(codes)))
                held += len(found[-1])
    if found:
        yield part()


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    """Texts of one file, in blocks of bounded size."""
    files = batch.column(0).dictionary_encode()
    held, size, at = [], 0, None
    for code, text in zip(files.indices.to_pylist(), batch.column(1), strict=True):
        if held and (code != at or size > LETTERS_AT_ONCE):
            yield files.dictionary[at].as_py(), held
            held, size = [], 0
        at = code
        held.append(text.as_py())
        size += len(held[-1])
    if held:
        yield files.dictionary[at].as_py(), held


def postings(files: DataFrame, body: str = "body") -> DataFrame:
    """``trigram, file``, each pair once, of rows read from files.

    Three letters are one number; a task finds the distinct numbers of a file's texts in
    arrays, so what is shuffled are the trigrams of files and not the letters of texts.
    """
    ship_package(files.sparkSession)
    rows = files.where(F.col(body).isNotNull()).select(
        F.col("_metadata.file_name").alias("file"), F.lower(F.col(body)).alias("text")
    )
    return rows.mapInArrow(_trigrams_of_files, POSTINGS).distinct()


class TrigramIndex:
    def __init__(self, store: DeltaCollection, root: str | None = None, body: str = "body"):
        self.store, self.spark, self.body = store, store.spark, body
        self.root = (root or f"{store.root}/trigrams").rstrip("/")

    def _of(self, run: str) -> str:
        return f"{self.root}/{run.rsplit('/', 1)[-1]}"

    def refresh(self) -> int:
        """Index the live runs that are not indexed yet; their number."""
        missing = [c["run"] for c in self.store.live() if not _exists(self.spark, f"{self._of(c['run'])}/_SUCCESS")]
        for run in missing:
            rows = self.spark.read.schema(self.store.columns).parquet(run)
            postings(rows, self.body).repartitionByRange("trigram").sortWithinPartitions("trigram").write.mode(
                "overwrite"
            ).parquet(self._of(run))
        return len(missing)

    def files(self, query: str) -> DataFrame | None:
        """``run, file`` of the files that may hold a keyword; None if that rules nothing out."""
        wanted = [trigrams(w) for w in set(search_functions.tokenize(query))]
        if not all(wanted):
            return None
        live = self.store.live() if wanted else []
        found = self.spark.createDataFrame([], "run string, file string")
        names = sorted(set().union(*wanted))
        for commit in live:
            rows = self.spark.read.schema(POSTINGS).parquet(self._of(commit["run"])).where(F.col("trigram").isin(names))
            held = rows.groupBy("file").agg(*(
                F.count_if(F.col("trigram").isin(sorted(grams))).alias(f"n{i}") for i, grams in enumerate(wanted)
            ))
            any_word = F.lit(False)
            for i, grams in enumerate(wanted):
                any_word = any_word | (F.col(f"n{i}") == len(grams))
            found = found.unionByName(held.where(any_word).select(F.lit(commit["run"]).alias("run"), "file"))
        return found

    def candidates(self, query: str, most: int = 10_000) -> DataFrame:
        """Current rows of the files that may hold a keyword of the query."""
        live = self.store.live()
        files = self.files(query) if live else None
        rows = files.limit(most + 1).collect() if files is not None else None
        if rows is None or len(rows) > most:
            return self.store.read()
        if not rows:
            return self.spark.createDataFrame([], self.store.columns)
        paths = [f"{r['run']}/{r['file']}" for r in rows]
        return self.store._placed(live, paths).select(*self.store.columns.fieldNames())

    def top_documents(self, query: str, key: str | list[str] = search.KEY, k: int = C.DEFAULT_MAX_RESULTS) -> DataFrame:
        """As ``search.top_documents`` over the whole collection."""
        return search.top_documents(self.candidates(query), query, key, k, body=self.body)


def indexed(docs: DataFrame, block_rows: int, name: str = "indexed-docs") -> TrigramIndex:
    """A new collection of ``docs`` in the shared folder, and its index."""
    store = DeltaCollection(docs.sparkSession, work_path(docs.sparkSession, name), docs.schema, block_rows=block_rows)
    store.upsert(docs)
    index = TrigramIndex(store)
    index.refresh()
    return index
