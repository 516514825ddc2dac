"""Every operator and stage on odd rows, on tables with clashing columns, and on empty tables."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest

from docloom.llm import (
    bpe,
    exact_dedup,
    language_id,
    language_model,
    packing,
    quality_classifier,
    quality_rules,
    simhash,
    toxicity,
    url_filters,
)

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

REPORTS = {
    "op1": lambda docs, labels: quality_rules.report(docs),
    "op2": lambda docs, labels: packing.report(docs, WORDS),
    "op3": lambda docs, labels: bpe.report(docs, RANKS, public_tokenizers.PATTERN),
    "op5": lambda docs, labels: language_id.report(docs),
    "op6": lambda docs, labels: exact_dedup.report(docs),
    "op7": quality_classifier.report,
    "op8": lambda docs, labels: simhash.report(docs),
    "op9": lambda docs, labels: language_model.report(docs),
    "op10": toxicity.report,
}


@pytest.mark.parametrize("name", REPORTS)
def test_odd_rows_give_one_row_each(name, odd, clashing, labels, no_docs, no_labels):
    report = REPORTS[name]
    found = report(clashing, labels).collect()
    ids = Counter(r.doc_id for r in found)
    if name == "op2":
        assert set(ids) == {r.doc_id for r in odd.collect()}
    else:
        assert ids == Counter(r.doc_id for r in odd.collect())
    by_id = {r.doc_id: r for r in found}
    if name == "op1":
        assert (by_id[1].n_words, by_id[1].kept, by_id[4].n_words, by_id[4].n_repeat_words) == (0, False, 80_000, 80_000)
    elif name == "op3":
        assert by_id[1].n_tokens == by_id[2].n_tokens == 0
    elif name == "op5":
        assert {by_id[i].lang_pred for i in (1, 2, 3, 8)} == {"und"} and by_id[1].score == 0
    elif name == "op6":
        assert [r.kept for r in found if r.doc_id == 7] in ([True, False], [False, True])
        assert by_id[5].kept and not by_id[4].kept and by_id[6].group_size == 3 and by_id[None].keep_id in (2, 6)
    elif name == "op8":
        assert by_id[1].fingerprint == "0" * 16 and by_id[3].component_id == by_id[1].component_id == 1
        assert by_id[5].component_id == 4 and by_id[None].component_id in (1, 6)
    elif name == "op9":
        assert by_id[1].n_tokens == 1
    elif name == "op10":
        assert all(0 <= r.score <= 1 for r in found)
    assert report(no_docs, no_labels).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(name, stage, spark, clashing, labels, no_docs, no_labels, tmp_path):
    for docs, marks, folder in ((clashing, labels, "a"), (no_docs, no_labels, "b")):
        marks.write.parquet(f"{tmp_path}/{folder}/labels.parquet")
        kept = stage(spark, docs, f"{tmp_path}/{folder}")
        assert kept.columns == docs.columns and kept.schema == docs.schema
        rows = kept.collect()
        ids = Counter(r.doc_id for r in rows)
        assert not ids - Counter(r.doc_id for r in docs.collect())
        if name == "exact_dedup" and rows:
            assert ids == Counter([2, 3, 5, 6, 7, 8, 9, 10, 11])
        if name == "simhash_dedup" and rows:
            assert ids == Counter([1, 4, 6, 7, 8, 9, 10, 11])
        if name == "language_id" and rows:
            assert not {1, 2, 3, 8} & set(ids) and {4, 5, 6} <= set(ids)


def test_url_filters_on_odd_rows(spark):
    captures = spark.createDataFrame(
        [(1, None, 5), (2, "http://a.example/x", None), (3, "", 5), (4, "HTTP://U@A.Example:80/ads/x?y", 5),
         (5, "http://sub.a.example", 9), (5, "http://sub.a.example", 9), (6, "nothing", 5)],
        "blocked long, url string, fetched_at int",
    )
    events = spark.createDataFrame(
        [("a.example", True, 1), ("a.example", True, 1), ("a.example", False, 7), ("a.example", True, 9),
         ("a.example", False, 9), ("a.example/ads/", True, 2), (None, True, 1), ("b", None, 3), ("a.example", True, None)],
        "key string, listed boolean, at int",
    )
    found = url_filters.filter_captures(captures, events)
    assert found.columns == ["blocked", "url", "fetched_at", "matched_key", "listed_since", "_blocked"]
    rows = sorted((r.blocked, r._blocked, r.matched_key, r.listed_since) for r in found.collect())
    assert rows == [
        (1, False, None, None), (2, False, None, None), (3, False, None, None), (4, True, "a.example/ads/", 2),
        (5, False, None, None), (5, False, None, None), (6, False, None, None),
    ]
    assert url_filters.filter_captures(captures.limit(0), events.limit(0)).count() == 0
    assert url_filters.filter_captures(captures, events.limit(0)).where("_blocked").count() == 0
