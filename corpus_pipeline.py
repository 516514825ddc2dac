"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and gives a table that is written and
read again as the next stage's ``docs``. All stages but the last keep the
columns of ``documents``.

1. ``language_id``: documents without letters, or with few letter trigrams of
   any learned language, go.
2. ``quality_classifier``: documents that the classifier, with the posteriors of
   their site, holds for junk go.
3. ``exact_dedup``: of identical texts the row with the largest id stays.
4. ``simhash_dedup``: of near duplicates, texts whose SimHash fingerprints (four-word
   shingles) are linked by four differing bits or fewer, the row with the smallest id stays.
5. ``packing``: the texts as token sequences of 2048 at most.

Rows with nulls, repeated rows, empty tables and further columns are handled as
the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import exact_dedup, language_id, packing, quality_classifier, simhash
from docloom.llm.common import column, fresh, table
from docloom.session import save_and_reload


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    predict = language_id.predictor(language_id.fit(docs))
    guess, = fresh(docs, "language_guess")
    told = docs.withColumn(guess, predict(F.col("text")))
    return told.where(~language_id.rejected(column(guess))).drop(guess)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    verdict, = fresh(docs, "quality_verdict")
    host, path = quality_classifier.document_site()
    judged = quality_classifier.classify(docs, table(spark, sf_dir, "labels"), host, path, verdict)
    return judged.where(column(verdict)["kept"]).select(*map(column, docs.columns))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.report(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("quality_classifier", keep_good_quality),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

# Classifiers, SimHash and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save_and_reload(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
