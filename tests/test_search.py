import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import search
from docloom.operators import lines, search as ops
from docloom.operators.keyword_batches import KeywordCounter

SCHEMA = "bundle string, doc_path string, source_url string, fetched_at timestamp, body string"


def docs_of(spark, bodies):
    return spark.createDataFrame([("k", p, None, None, b) for p, b in bodies.items()], SCHEMA)


def with_hits(n, hit_lines):
    return "\n".join(f"FOO {i}" if i in hit_lines else f"line {i}" for i in range(n))


ISLANDS = [
    (1, [0], [(0, 1)]),
    (12, [0, 5], [(0, 8)]),
    (12, [0, 6], [(0, 3), (4, 9)]),
    (20, [1, 6, 11, 18], [(0, 14), (16, 20)]),
    (9, [8], [(6, 9)]),
]


@pytest.mark.parametrize("n,hit,expected", ISLANDS)
def test_contexts(spark, n, hit, expected):
    body = with_hits(n, hit)
    [row] = ops.hits(docs_of(spark, {"d": body}), "foo").collect()
    assert [(c.start_line, c.end_line) for c in row.context_rows] == expected
    all_lines = body.split("\n")
    for snippet, (start, end) in zip(row.contexts, expected):
        assert snippet == "\n".join(
            ("> " if i in hit else "  ") + all_lines[i] for i in range(start, end)
        )
    assert (row.source_url, row.fetched_at) == ("Unknown", "Unknown")


def test_array_and_window_islands_agree(spark):
    bodies = {f"d{i}": with_hits(n, h) for i, (n, h, _) in enumerate(ISLANDS)}
    docs = docs_of(spark, bodies)
    by_row = docs.select(
        "doc_path", F.inline(search.islands(search.hit_lines(F.split("body", "\n", -1), ["foo"])))
    )
    marked = lines.mark_hits(lines.document_lines(docs, "doc_path"), ["foo"])
    by_window = lines.islands(marked.where("is_hit"), "doc_path")
    assert set(map(tuple, by_row.collect())) == set(map(tuple, by_window.select(*by_row.columns).collect()))
    shown = lines.context_lines_of(marked, "doc_path").count()
    assert shown == sum(e - s for *_, spans in ISLANDS for s, e in spans)


def test_counts(spark):
    docs = docs_of(spark, {"a": "aaaa", "b": "other the THE", "c": "none", "d": ""})

    def counts(query):
        return {r.doc_path: r.matches for r in ops.match_counts(docs, query, "doc_path").collect()}

    assert counts("aa") == {"a": 2}
    assert counts("the") == {"b": 3}
    assert counts("the THE") == {"b": 6}
    assert counts("  ") == {}
    assert ops.hits(docs, "").count() == 0


def test_line_counts_add_up(spark):
    docs = docs_of(spark, {"a": "x the\nthe the\n\nother", "b": "the"})
    per_line = lines.document_lines(docs, "doc_path").groupBy("doc_path").agg(
        F.sum(search.match_count(F.col("line"), ["the"])).alias("matches")
    )
    assert sorted(map(tuple, per_line.collect())) == sorted(map(tuple, ops.match_counts(docs, "the", "doc_path").collect()))


def test_top_documents(spark):
    docs = docs_of(spark, {f"src/{i:02d}.md": "x " * (i % 5) for i in range(20)})

    def top(k):
        return [r.doc_path for r in ops.top_documents(docs, "x", k=k).collect()]

    assert top(0) == []
    assert top(3) == ["src/04.md", "src/09.md", "src/14.md"]
    assert top(10)[:3] == top(3)
    assert len(top(100)) == 16
    with pytest.raises(ValueError):
        ops.top_documents(docs, "x", k=-1)
    assert ops.top_documents(docs, "x", category="api").count() == 0
    assert ops.top_documents(docs, "x", category="src").count() == 10


def test_results_as_json_and_display(spark):
    import json

    docs = docs_of(spark, {"d": with_hits(60, [0, 12, 24, 36])})
    found = ops.hits(docs, "foo")
    assert len(ops.display(found).first().contexts) == 3
    value = json.loads(ops.as_json(found).first().json)
    assert value["file"] == "d" and value["matches"] == 4 and len(value["contexts"]) == 4


WORDS = ["aa", "an", "anan", "the", "é", "b", "abab", "th", "日本", "longer-word"]


def test_keyword_counter_counts_as_python_does():
    counter = KeywordCounter(WORDS)
    for text in ["", "aaaaa", "ananananan", "the other the", "éé b é", "ababababab", "日本日本語", "longer-word" * 3, "banana bandana"]:
        assert counter.counts(text).tolist() == [text.count(w) for w in WORDS]


def brute_force(bodies, queries):
    rows = set()
    for query_id, query in queries:
        for path, body in bodies.items():
            n = sum(body.lower().count(w) for w in query.lower().split())
            if n:
                rows.add((query_id, path, n))
    return rows


BODIES = {
    "a": "The cat, the hat\nand THE bandana banana",
    "b": "an an an anan " + "x" * 400 + "needle" + "y" * 300,
    "c": "",
    "d": "aaaa b b b é É 日本日本",
    "e": "nothing",
}
MANY = [(1, "the"), (2, "the the AN"), (3, ""), (4, "anan b"), (5, "needle xneed"), (6, "é 日本"), (7, "absent"), (8, "aa")]


@pytest.mark.parametrize("slice_terms", [ops.SLICE_TERMS, 4, 1])
def test_many_queries_equal_brute_force(spark, slice_terms):
    docs = docs_of(spark, BODIES)
    queries = spark.createDataFrame(MANY, "query_id long, query string")
    got = ops.match_counts_for_queries(docs, queries, slice_terms=slice_terms)
    assert {tuple(r) for r in got.select("query_id", "doc_path", "matches").collect()} == brute_force(BODIES, MANY)


@pytest.mark.parametrize("slice_terms,k", [(ops.SLICE_TERMS, 2), (3, 2), (ops.SLICE_TERMS, 1001)])
def test_many_queries_ranked(spark, slice_terms, k):
    docs = docs_of(spark, BODIES).repartition(3)
    queries = spark.createDataFrame(MANY, "query_id long, query string")
    got = ops.top_documents_for_queries(docs, queries, k=k, slice_terms=slice_terms).collect()
    expected = set()
    for query_id, _ in MANY:
        mine = sorted((-n, p) for q, p, n in brute_force(BODIES, MANY) if q == query_id)
        expected |= {(query_id, p, -n, i + 1) for i, (n, p) in enumerate(mine[:k])}
    assert {(r.query_id, r.doc_path, r.matches, r["rank"]) for r in got} == expected


def test_long_unbroken_text_and_plan_without_pairs(spark):
    docs = docs_of(spark, {"long": "ab" * 500_000 + "needle", "b": "needle"})
    queries = spark.createDataFrame([(1, "needle"), (2, "ba")], "query_id long, query string")
    got = ops.match_counts_for_queries(docs, queries, slice_terms=1)
    assert {tuple(r) for r in got.drop("bundle").collect()} == {(1, "long", 1), (1, "b", 1), (2, "long", 499_999)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_equal_paths_in_two_bundles(spark):
    docs = docs_of(spark, {"x": "foo foo"}).withColumn("bundle", F.lit("one")).unionByName(
        docs_of(spark, {"x": "foo"}).withColumn("bundle", F.lit("two"))
    )
    found = {(r.bundle, r.doc_path, r.matches, len(r.contexts)) for r in ops.hits(docs, "foo").collect()}
    assert found == {("one", "x", 2, 1), ("two", "x", 1, 1)}
    queries = spark.createDataFrame([(1, "foo")], "query_id long, query string")
    many = {(r.bundle, r.doc_path, r.matches) for r in ops.hits_for_queries(docs, queries).collect()}
    assert many == {("one", "x", 2), ("two", "x", 1)}


def test_hits_for_queries(spark):
    docs = docs_of(spark, BODIES)
    queries = spark.createDataFrame(MANY, "query_id long, query string")
    rows = {(r.query_id, r.doc_path): r.contexts for r in ops.hits_for_queries(docs, queries).collect()}
    assert set(rows) == {(q, p) for q, p, _ in brute_force(BODIES, MANY)}
    assert rows[(1, "a")] == ["> The cat, the hat\n> and THE bandana banana"]
    empty = spark.createDataFrame([], "query_id long, query string")
    assert ops.hits_for_queries(docs, empty).count() == 0


def test_keywords_are_counted_by_distinct_words():
    rng = np.random.default_rng(3)
    alphabet = list("aabbn é日") + ["\n", "\u2003", "\u0085"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 200))) for _ in range(300)] + ["", "anananan", None]
    words = ["a", "aa", "ab", "é", "日a", "anan", "nn", "ba", "bab", "absent", "aaa"]
    table = KeywordCounter(words).table(pa.array(texts, pa.string()))
    assert table.tolist() == [[(t or "").count(w) for w in words] for t in texts]
    assert table.any(axis=0).sum() >= 9


def test_slices_share_passes(spark):
    docs = docs_of(spark, BODIES)
    queries = spark.createDataFrame(MANY, "query_id long, query string")
    for pass_terms, most in ((ops.SLICE_TERMS, 1), (3, 100), (1, 100)):
        got = ops.top_documents_for_queries(docs, queries, k=100, slice_terms=2, pass_terms=pass_terms)
        assert {(r.query_id, r.doc_path, r.matches) for r in got.collect()} == brute_force(BODIES, MANY)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= plan.count("MapInArrow") <= most and (most == 1 or plan.count("MapInArrow") > 1)
