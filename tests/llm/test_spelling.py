"""Words one edit apart, their forms and roots, against all pairs of a small vocabulary."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from docloom.llm import spelling


def one_edit_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_forms(counts):
    out = {}
    for w, n in counts.items():
        near = [(-m, v) for v, m in counts.items() if v != w and one_edit_apart(w, v)]
        best = min(near, default=None)
        good = best and -best[0] >= 2 * n
        out[w] = (n, len(near), best[1] if good else None, -best[0] if good else None)
    return out


def vocabulary(rng):
    words = set()
    for _ in range(250):
        base = "".join(rng.choices("abcdeéß", k=rng.randint(5, 9)))
        for _ in range(6):
            i, c = rng.randrange(len(base)), rng.choice("abcdeéßzÿ")
            words.add(rng.choice([base, base[:i] + c + base[i:], base[:i] + c + base[i + 1:], base[:i] + base[i + 1:]]))
    # One set of letters in every order, and very long words.
    words |= {"".join(rng.sample("abcdefg", 7)) for _ in range(400)} | {"a" * 3000, "a" * 3001, "b" + "a" * 2999}
    return {w: rng.choice([3, 4, 6, 9, 20, 50]) for w in words if len(w) >= 5}


@pytest.mark.parametrize("region, crowded, sample", [(4096, 16384, 200_000), (20, 10_000, 200_000), (20, 30, 200), (8, 1, 40)])
def test_forms_equal_all_pairs(spark, monkeypatch, region, crowded, sample):
    counts = vocabulary(random.Random(5))
    monkeypatch.setattr(spelling, "REGION", region)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    found = spelling.forms(words, spelling.near_words(words, sample, crowded)).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n) for r in found} == slow_forms(counts)
    assert len(found) == len(counts)


def test_a_box_search_misses_no_word():
    rng = random.Random(8)
    words = sorted(vocabulary(rng))
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for length, longer in by_length.items():
        points = np.array([spelling.point(w.encode("latin-1")) for w in longer], dtype=np.uint64)
        tree = spelling.RegionTree(points)
        for shorter in (length - 1, length):
            mine = by_length.get(shorter, [])
            asked = np.array([spelling.point(w.encode("latin-1")) for w in mine], dtype=np.uint64)
            reached = set()
            for a, b in tree.near(asked, 1, int(shorter == length)):
                reached |= set(zip(a.tolist(), b.tolist(), strict=True))
            assert all((i, j) in reached for i, a in enumerate(mine) for j, b in enumerate(longer) if a != b and one_edit_apart(a, b))


def test_roots_follow_forms_to_the_end(spark):
    chain = [(f"word{i:02d}", f"word{i + 1:02d}" if i < 30 else None) for i in range(31)]
    rows = chain + [(f"leaf{i}", "word00") for i in range(50)] + [("alone", None)]
    told = spark.createDataFrame(rows, "word string, form string")
    found = {r.word: r.root for r in spelling.roots(told).collect()}
    assert found == {w: "word30" for w, f in rows if f}


def slow_vocabulary(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in spelling.RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_vocabulary_of_odd_rows(spark, odd, clashing, no_docs, small):
    assert {r.word: r.n for r in spelling.vocabulary(clashing).collect()} == slow_vocabulary(
        [(r.doc_id, r.text) for r in odd.collect()]
    )
    found = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.report(clashing).collect()}
    assert found["alpha"] == (40_000, 0, None, None, "alpha")
    assert spelling.report(no_docs).count() == 0
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert {r.word: r.n for r in spelling.vocabulary(docs).collect()} == slow_vocabulary(
        [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    )
