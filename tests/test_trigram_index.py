"""Search through a trigram index against a scan of the whole collection."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators import search, trigram_index
from docloom.sources.delta_collection import DeltaCollection

COLUMNS = T.StructType([
    T.StructField("bundle", T.StringType()), T.StructField("doc_path", T.StringType()), T.StructField("body", T.StringType()),
])


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [("b", f"p{i:03d}", f"Common words here {'Zebra' if i == 57 else ''} {chr(97 + i % 26) * 4}") for i in range(200)]
    rows += [("c", "null", None), ("c", "empty", ""), ("c", "short", "ab"), ("c", "signs", "日本語テキスト \U0001F600\U0001F601x ÄÖÜ")]
    store = DeltaCollection(spark, str(tmp_path_factory.mktemp("indexed")), COLUMNS, block_rows=10)
    store.upsert(spark.createDataFrame(rows, COLUMNS))
    made = trigram_index.TrigramIndex(store)
    assert made.refresh() == 1 and made.refresh() == 0
    # A delivery that moves the rare word to other documents, and is indexed alone.
    store.upsert(spark.createDataFrame([("b", "p057", "nothing"), ("b", "p101", "a zebra, zebras"), ("d", "n", "zebrafish")], COLUMNS))
    assert made.refresh() == 1
    return made


@pytest.mark.parametrize(
    "query", ["common", "zebra", "ZEBRA quux", "zzzz", "ab", "here zebra", "日本語", "\U0001F600\U0001F601x", "äöü", "nowhere at all", ""]
)
def test_same_rows_as_a_scan(index, query):
    whole = search.top_documents(index.store.read(), query)
    assert index.top_documents(query).collect() == whole.collect()


def test_a_rare_keyword_reads_few_files(index, spark):
    every = spark.read.parquet(*(c["ranges"] for c in index.store.live())).count()
    assert every >= 20
    assert index.files("common").count() >= 20
    # The old file of the word is still read, but its row there is overwritten.
    assert index.files("zebra").count() <= 2 and index.files("zebrafish").count() == 1
    read = [f for f in index.candidates("zebra").inputFiles() if "/runs/" in f]
    assert len(read) <= 2 < 20 <= len([f for f in index.store.read().inputFiles() if "/runs/" in f])
    assert index.files("quux").isEmpty() and index.files("ab") is None


def test_postings_hold_every_trigram(index, spark):
    rows = spark.read.schema(COLUMNS).parquet(index.store.live()[0]["run"])
    found = {(r.trigram, r.file) for r in trigram_index.postings(rows).collect()}
    named = rows.select(F.col("_metadata.file_name").alias("file"), F.lower("body").alias("body")).where("body is not null")
    expected = {(t, r.file) for r in named.collect() for t in trigram_index.trigrams(r.body)}
    assert found == expected


def test_postings_shuffle_trigrams_and_not_letters(index, spark, monkeypatch):
    rows = spark.read.schema(COLUMNS).parquet(index.store.live()[0]["run"])
    assert "Generate" not in trigram_index.postings(rows)._jdf.queryExecution().executedPlan().toString()
    # Texts of several files, cut into blocks and parts; odd letters, and nothing across texts.
    texts = ["abcabc", "", "zz", "a\0\0\0", "\U0001F600ab\u00e9", "x\ny", "abcd"] * 3
    files = ["f1"] * 5 + ["f2"] * 7 + ["f3"] * 9
    monkeypatch.setattr(trigram_index, "LETTERS_AT_ONCE", 7)
    monkeypatch.setattr(trigram_index, "CODES_HELD", 3)
    batches = [pa.RecordBatch.from_arrays([pa.array(files[a:b]), pa.array(texts[a:b])], ["file", "text"]) for a, b in ((0, 8), (8, 21))]
    found = {(r["trigram"], r["file"]) for out in trigram_index._trigrams_of_files(iter(batches)) for r in out.to_pylist()}
    assert found == {(t, f) for f, text in zip(files, texts, strict=True) for t in trigram_index.trigrams(text)}
