"""Language identification with language-bitmask filters over letter trigrams.

For each language the trigrams that make up at least ``MIN_SHARE`` of its
training text are kept, at most ``1 / MIN_SHARE`` of them. They go into one
bit-sliced Bloom filter: each cell is a mask with one bit for each language,
and the AND of a trigram's cells holds all languages that contain it. A text's
hits for each language are corrected for the false positives that the filled
share of its slice predicts, and the language with the highest corrected share
wins; ties go to the language with more training rows. The score is that share.

A text that is null or has no letter is ``und`` with score 0. Languages are
learned from rows with text and language outside of the held-out fold; rows
without id are in fold 0. Without training rows every text is ``und``. An empty
table gives an empty result, repeated rows are judged one by one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import fold
from docloom.llm.training import SAMPLE_ROWS, drawn
from docloom.session import save_and_reload, ship_package

UNKNOWN = "und"
MIN_SHARE = 1e-5
HASHES = 4
# Cells for each trigram of the largest language.
ROOM = 16
# Letters whose trigrams are looked up at once.
CHUNK = 1 << 18

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])
    return _letters


def trigrams(text: str) -> np.ndarray:
    """Trigrams of the lower-case letters of a text as 63-bit numbers; words stand between blanks."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = letter_table()[codes]
    if not letters.any():
        return np.empty(0, dtype=np.uint64)
    kept = np.where(letters, codes, 32).astype(np.uint64)
    # Runs of other characters shrink to one blank.
    kept = kept[letters | np.concatenate(([True], letters[:-1]))]
    kept = np.concatenate(([32], kept, [32])).astype(np.uint64)
    grams = kept[:-2] << np.uint64(42) | kept[1:-1] << np.uint64(21) | kept[2:]
    return grams[kept[1:-1] != 32]


def cells(grams: np.ndarray, size: int) -> list[np.ndarray]:
    """The cells of each trigram, one array for each hash; ``size`` is a power of two."""
    x = grams.copy()
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    step = x >> np.uint64(32) | np.uint64(1)
    return [(x + np.uint64(i) * step & np.uint64(size - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass(frozen=True)
class Filters:
    """Masks of shape (cells, words of 64 languages)."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray

    def shares(self, text: str | None) -> np.ndarray | None:
        """Corrected share of the text's trigrams that each language contains; None without letters."""
        grams = trigrams(text) if text else np.empty(0, dtype=np.uint64)
        if not len(grams) or not self.languages:
            return None
        hits = np.zeros(len(self.languages))
        for at in range(0, len(grams), CHUNK):
            places = cells(grams[at:at + CHUNK], len(self.masks))
            both = self.masks[places[0]]
            for more in places[1:]:
                both = both & self.masks[more]
            for i in range(len(self.languages)):
                hits[i] += np.count_nonzero(both[:, i // 64] >> np.uint64(i % 64) & np.uint64(1))
        return np.clip((hits / len(grams) - self.false_rate) / (1 - self.false_rate), 0, 1)

    def decide(self, text: str | None) -> tuple[str, float]:
        shares = self.shares(text)
        if shares is None:
            return UNKNOWN, 0.0
        best = int(np.argmax(shares))  # the first of equals: most training rows
        return self.languages[best], float(shares[best])


def build(grams_of: dict[str, np.ndarray]) -> Filters:
    """Filters over the trigrams of each language, in the order of preference."""
    languages = list(grams_of)
    most = max((len(g) for g in grams_of.values()), default=1)
    size = 1 << max(10, int(ROOM * most - 1).bit_length())
    masks = np.zeros((size, max(1, -(-len(languages) // 64))), dtype=np.uint64)
    for i, language in enumerate(languages):
        for places in cells(grams_of[language], size):
            masks[np.unique(places), i // 64] |= np.uint64(1) << np.uint64(i % 64)
    filled = np.array([
        np.count_nonzero(masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / size for i in range(len(languages))
    ])
    return Filters(languages, masks, filled ** HASHES)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of each batch by language."""
    for batch in batches:
        by_language: dict[str, list[np.ndarray]] = {}
        for language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            by_language.setdefault(language, []).append(trigrams(text))
        for language, parts in by_language.items():
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))],
                ["lang", "gram", "n"],
            )


def fit(docs: DataFrame, bound: int = SAMPLE_ROWS) -> Filters:
    """Filters from a sample of at most about ``bound`` training rows."""
    ship_package(docs.sparkSession)
    usable = docs.select("doc_id", "lang", "text").where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id"), 4) != 2)
    )
    rows = drawn(usable, "doc_id", bound)
    counted = save_and_reload(
        rows.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-trigrams",
    )
    order = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    common = counted.join(F.broadcast(totals), "lang").where(F.col("n") >= MIN_SHARE * F.col("total"))
    # At most 1 / MIN_SHARE rows for each language.
    found = common.select("lang", "gram").toPandas()
    grams = {k: np.sort(v.to_numpy(np.int64)).view(np.uint64) for k, v in found.groupby("lang")["gram"]}
    return build({language: grams[language] for language in order if language in grams})


def predictor(filters: Filters):
    """A column function: text to struct (lang, score)."""
    shape = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(shape)
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [filters.decide(t) for t in texts]
        return pd.DataFrame({"lang": [x for x, _ in found], "score": np.array([s for _, s in found], dtype="float64")})

    return run


def report(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``."""
    predict = predictor(fit(docs))
    return docs.select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), predict("text").alias("p")
    ).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def rejected(prediction: Column, least: float = 0.3) -> Column:
    """Texts without a language: no letters, or too few trigrams of any learned language."""
    return (prediction["lang"] == UNKNOWN) | (prediction["score"] < least)
