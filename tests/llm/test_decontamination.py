"""Windows of items in documents, against a plain search, with hot shingles, short items and odd rows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from docloom.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_leaks(docs, items, window):
    wanted = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            wanted.setdefault(tuple(w[i:i + window]), set()).add("" if item is None else str(item))
    lengths = {len(p) for p in wanted}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if holders := wanted.get(tuple(w[i:i + k])):
                    hit |= set(range(i, i + k))
                    found |= holders
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return Counter(out)


def digests(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"]),
                    hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in df.collect())


@pytest.mark.parametrize("window, shingle, limit", [(10, 3, 1 << 20), (4, 3, 600), (5, 1, 1 << 20), (2, 4, 300)])
def test_leaks_equal_plain_search(spark, window, shingle, limit):
    rng = random.Random(window)
    vocabulary = ["the"] * 12 + ["of"] * 6 + [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for i in range(40)]
    # One passage in many items, and items of one word over and over.
    items += [(100 + i, "a very common passage of many items " + f"w{i}") for i in range(30)]
    items += [(200, "the " * 30), (201, "the " * 11), (202, "The, THE;the")]
    docs = []
    for i in range(150):
        text = rng.choices(vocabulary, k=rng.randint(0, 40))
        if i % 3 == 0:
            text[5:5] = rng.choice(items)[1].upper().split()
        docs.append((i, "; ".join(text)))
    docs += [(1000 + i, "x a very common passage of many items w3 y") for i in range(60)] + [(3000, "the " * 400)]
    found = decontamination.leaks(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"), window, shingle, limit,
    )
    assert digests(found) == slow_leaks(docs, items, window)


def test_report_on_odd_rows(spark, odd, clashing, no_docs):
    rows = [(None, "one two three"), (3, "alpha beta gamma delta " * 4), (3, "same row"), (4, None), (5, " ?"), (6, "日本語"),
            (10, "ROW"), (2, "endoftext"), (2, "z")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    plain = [(r.doc_id, r.text) for r in odd.collect()]
    found = decontamination.report(clashing, items)
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert Counter(map(tuple, found.collect())) == slow_leaks(plain, rows, 10)
    assert decontamination.report(no_docs, items).count() == 0
    clean = decontamination.report(odd, items.limit(0))
    assert clean.count() == odd.count() and clean.where("contaminated or n_items > 0").isEmpty()


def test_no_python_in_the_plan(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = decontamination.report(docs, spark.read.parquet(f"{small}/benchmark.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
