"""The Katz model against its recursive definition, at both orders and with rare words."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from docloom.llm import language_model


def slow_katz(train, order):
    counts = [None, *(Counter() for _ in range(order))]
    for text in train:
        tokens = [*text.split(), "<end>"]
        padded = ["<start>"] * (order - 1) + tokens
        for i, word in enumerate(tokens):
            for n in range(1, order + 1):
                counts[n][tuple(padded[i + order - n:i + order - 1]), word] += 1
    factors = [None, *(language_model.discounts(Counter(c.values())) for c in counts[1:])]
    off = lambda c, n: c * factors[n][c - 1] if c <= 5 else float(c)
    total = sum(counts[1].values())
    mass = sum(off(c, 1) for c in counts[1].values())
    unknown = max(1 - mass / total, 1 / (total + 1))
    after = [None, *(defaultdict(dict) for _ in range(order))]
    for n in range(1, order + 1):
        for (history, word), c in counts[n].items():
            after[n][history][word] = c

    def p(history, word):
        n = len(history) + 1
        if n == 1:
            c = counts[1][(), word]
            return (1 - unknown) * off(c, 1) / mass if c else unknown
        followers = after[n].get(history)
        if not followers:
            return p(history[1:], word)
        all_of, seen = sum(followers.values()), sum(off(c, n) for c in followers.values())
        left = max(1 - seen / all_of, 1 / (all_of + 1))
        if word in followers:
            return (1 - left) * off(followers[word], n) / seen
        return left * p(history[1:], word) / (1 - sum(p(history[1:], w) for w in followers))

    return p, after


def check(spark, train, texts, order):
    p, after = slow_katz(train, order)
    model = language_model.fit(spark.createDataFrame([(t,) for t in train], "text string"), order)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language_model.score(docs, model).collect():
        tokens = [*(texts[r.doc_id] or "").split(), "<end>"]
        padded = ["<start>"] * (order - 1) + tokens
        expected = sum(math.log10(p(tuple(padded[i:i + order - 1]), w)) for i, w in enumerate(tokens))
        assert math.isclose(r.score, expected, rel_tol=1e-9), texts[r.doc_id]
    trained = spark.createDataFrame(list(enumerate(train)), "doc_id long, text string")
    one, two = (
        {r.doc_id: r.score for r in language_model.score(trained, model, flag, 1).collect()} for flag in (True, False)
    )
    assert one.keys() == two.keys() and np.allclose([one[i] for i in one], [two[i] for i in one], rtol=1e-9)
    return p, after


def test_three_words_back_off_recursively(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(30)]
    weights = 1 / np.arange(1, 31)
    train = [" ".join(rng.choice(vocabulary, 20, p=weights / weights.sum())) for _ in range(80)]
    texts = [*train[:5], "w1 w2 nowhere w3", "nowhere nowhere", "w29 w28 w27 w1", "", None]
    p, after = check(spark, train, texts, 3)
    words = [*after[1][()], "never seen"]
    for history in list(after[3])[:200]:
        assert math.isclose(sum(p(history, w) for w in words), 1)


@pytest.mark.parametrize("order", [2, 3])
def test_rare_words_have_contexts_of_their_own(spark, order):
    """Each rare word has less than a 2^-16 share and always the same follower."""
    rare = [f"a{i} b{i} c{i}" for i in range(5000)]
    train = ["filler " * 200_000, *(" ".join(rare[i:i + 50]) for i in range(0, 5000, 50))] + [rare[7], rare[8]]
    check(spark, train[1:] + train[:1], ["a7 b7 c7", "b4000 c4000", "a1 b2 c3"], order)


def test_common_words_and_pairs_have_cells_of_their_own(spark, monkeypatch):
    """Half of all tokens follow one pair, and one text repeats a word; in cells of any size the scores are the model's."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(40)]
    train = [" ".join(f"so it {w}" for w in rng.choice(vocabulary, 30)) for _ in range(60)] + ["filler " * 3000, "so it", ""]
    monkeypatch.setattr(language_model, "CELL", 300)
    source = spark.createDataFrame([(i, t, True, True) for i, t in enumerate(train)], "key long, text string, asked boolean, trained boolean")
    where = language_model.places(source)
    assert where.cells > 5 and len(where.words) >= 2 and len(where.pairs) >= 1 and max(where.many) > 3
    check(spark, train, [*train[:3], "so it never", "it so w1 w2", "w1 so it filler filler", "", None], 3)


def test_equal_rows_are_scored_one_by_one(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "a b"), (None, "a b c"), (None, "a b c"), (2, None), (3, ""), (4, "x" * 3_000_000 + " a")]
    found = language_model.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in found) == sorted((str(i), len((t or "").split()) + 1) for i, t in rows)
    same = [(r.base_score, r.score) for r in found if r.n_tokens == 4]
    assert len(same) == 4 and np.allclose(same, same[0], rtol=1e-12)


def test_tables_left_between_jobs_are_smaller_than_the_texts(spark, small, monkeypatch, tmp_path):
    paths = []

    def work_path(spark, name):
        paths.append(tmp_path / f"{name}-{len(paths)}")
        return str(paths[-1])

    stored = lambda p: sum(f.stat().st_size for f in p.rglob("*.parquet"))
    monkeypatch.setattr(language_model, "work_path", work_path)
    monkeypatch.setattr(language_model, "discard", lambda df, path: None)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert language_model.report(docs).count() == docs.count()
    assert paths and sum(map(stored, paths)) < docs.agg({"n_chars": "sum"}).first()[0]
