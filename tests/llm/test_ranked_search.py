"""Ranked search against a plain scan of all documents, in blocks, with ties and odd rows."""

import math
import random
import re
from collections import Counter

import pytest

from docloom.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_search(docs, items, k):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    bags = [(doc_id, Counter(TERM.findall(lower(text)))) for doc_id, text in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(TERM.findall(lower(text)))
    out = []
    for item, terms in wanted.items():
        rows = []
        for doc_id, bag in bags:
            m = 10 + 90 * bag.total() * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                for t in terms if bag[t]
            )
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(rows)[:k], 1):
            out.append((item, rank, doc_id, -score))
    return Counter(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "ärger", "ÄRGER", "x y", "日本"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(400)]
    # Many copies in large classes, whose ids lie between those of others.
    docs += [(i, "w1 W2, w3!") for i in range(1000, 1300)] + [(i, "w3 w2-w1") for i in range(900, 1100)]
    items = [(i, " ".join(rng.sample(words, 5))) for i in range(20)] + [(20, "w1 w1 w2"), (21, "nowhere"), (22, "w1")]
    return docs, items


@pytest.mark.parametrize("k, block_terms", [(10, 1_000), (3, 7), (500, 1_000)])
def test_search_equals_plain_scan(spark, corpus, k, block_terms):
    docs, items = corpus
    found = ranked_search.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
        spark.createDataFrame(items, "item_id long, text string"), k, block_terms,
    )
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, found.collect())) == slow_search(docs, items, k)


def test_search_on_odd_rows(spark, odd, clashing, no_docs):
    rows = [(1, "one two"), (1, "three"), (None, "ALPHA same"), (2, None), (3, ""), (4, "日本語テキスト x"), (5, "endoftext")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    plain = [(r.doc_id, r.text) for r in odd.collect()]
    found = ranked_search.report(clashing, items.withColumn("doc_id", items["item_id"])).collect()
    assert Counter(map(tuple, found)) == slow_search(plain, rows, 10)
    assert ranked_search.report(no_docs, items).count() == 0
    assert ranked_search.report(odd, items.limit(0)).count() == 0


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Alpha beta-gamma Äx " * 500 + "z" * 300
    whole = ranked_search.counted(text)
    monkeypatch.setattr(ranked_search, "PIECE", 17)
    assert ranked_search.counted(text) == whole and whole["Äx".encode()] == 500
