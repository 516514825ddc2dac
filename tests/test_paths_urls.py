from urllib.parse import urljoin

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import paths, urls


def V():
    return F.col("v")


def test_sanitize(apply):
    cases = {
        "docs.example.com/api/index.md": "docs.example.com/api/index.md",
        "docs@example.com/api#v1/index.md": "docs_example.com/api_v1/index.md",
        "": "file.md",
        "   ": "___",
        "/absolute/path": "absolute/path",
        "a//b.md": "a/b.md",
        "/": "file.md",
        "a/../b.md": "a/../b.md",
        "café/日本.md": "caf_/__.md",
        "h/825?page=2&ref=x.md": "h/825_page_2_ref_x.md",
    }
    once = apply(list(cases), paths.sanitize(V()))
    assert once == list(cases.values())
    assert apply(once, paths.sanitize(V())) == once


def test_markdown_path(apply):
    assert apply(["docs/index.html", "page.html", "docs/page", "x.htm"], paths.markdown_path(V())) == [
        "docs/index.md", "page.md", "docs/page.md", "x.htm.md",
    ]


def test_source_url(apply):
    rels = ["docs.shop.example/v1/cards.html", "h/v1/index.html", "h/plain"]
    assert apply(rels, paths.source_url(V(), F.lit("https"))) == [
        "https://docs.shop.example/v1/cards", "https://h/v1/index", "https://h/plain",
    ]
    assert apply(["h/x.html"], paths.source_url(V(), F.lit(""))) == ["https://h/x"]


def test_relative_path(apply):
    cases = {
        "https://h/a": "h/a.html",
        "https://h/a.html": "h/a.html",
        "https://h/a/#top": "h/a/index.html",
        "https://h": "h/index.html",
        "https://h/": "h/index.html",
        "https://h?x=1": "h/index.html?x=1.html",
        "http://h/a?p=2&r=x": "h/a?p=2&r=x.html",
        "http://h/a/?p=2": "h/a/index.html?p=2.html",
    }
    assert apply(list(cases), paths.relative_html_path(V())) == list(cases.values())


def test_containment(apply):
    assert apply(["a/b.md", "../a", "a/../b", "/a", "a/..b/c", ".."], paths.stays_inside(V())) == [
        True, False, False, False, True, False,
    ]


def test_validity(apply):
    reasons = apply(
        ["https://h/a", "HTTP://h", "ftp://h/a", "https:///a", "", "h/a", None, "mailto:x@y"],
        urls.reject_reason(V()),
    )
    assert reasons == [
        None, None, "invalid scheme", "missing host", "invalid scheme", "invalid scheme",
        "invalid scheme", "invalid scheme",
    ]


def test_scope(apply):
    inside = urls.in_scope(V(), F.lit("h"), F.lit("/docs/"))
    cases = {
        "https://h/docs/a": True,
        "https://h/docs/": True,
        "https://h/docs/a.html?x=y.pdf": True,
        "https://h/docs": False,
        "https://h/other": False,
        "https://x/docs/a": False,
        "https://h/docs/x.pdf": False,
        "https://h/docs/x.pdf?q=1#z": False,
        "https://h/docs/pdf": True,
        "https://h/docs/a.b.woff2": False,
        "ftp://h/docs/a": False,
    }
    assert apply(list(cases), inside) == list(cases.values())


BASE = "https://h.com/a/index"


def test_resolution_goldens(apply):
    cases = {
        "b": "https://h.com/a/b",
        "b.html": "https://h.com/a/b.html",
        "../c": "https://h.com/c",
        "/r": "https://h.com/r",
        "//cdn.x/y": "https://cdn.x/y",
        "./": "https://h.com/a/",
        "?q=1": "https://h.com/a/index?q=1",
        "tel:123": "tel:123",
        "javascript:void(0": "javascript:void(0",
        "HTTP://X/y": "HTTP://X/y",
        '/p "T"': 'https://h.com/p "T"',
    }
    assert apply(list(cases), urls.resolve(F.lit(BASE), V())) == list(cases.values())


BASES = [
    BASE, "https://h.com", "https://h.com/", "http://h.com/a/b/c/", "https://h.com/a?x=1#f",
    "https://h.com/a//b/c", "https://h.com/a/../b/c",
]
segment = st.sampled_from(["a", "b.html", "..", ".", "", "x-y", "é", "a b", "c:d", ".well-known"])
reference = st.builds(
    lambda lead, segs, query, fragment: lead + "/".join(segs) + query + fragment,
    st.sampled_from(["", "/", "./", "../", "//cdn.x/", "http://o.org/", "tel:"]),
    st.lists(segment, max_size=5),
    st.sampled_from(["", "?", "?q=1", "?a/../b//c"]),
    st.sampled_from(["", "#", "#f", "#/../x"]),
)


@settings(max_examples=4, deadline=None, derandomize=True, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(BASES), reference), min_size=150, max_size=150))
def test_resolution_matches_the_standard_library(apply, pairs):
    pairs = [(b, r) for b, r in pairs if not r.startswith("///")]
    got = apply(pairs, urls.resolve(F.col("b"), F.col("r")), "b string, r string")
    wrong = [(b, r, ours, urljoin(b, r)) for (b, r), ours in zip(pairs, got) if ours != urljoin(b, r)]
    assert wrong == []


def test_page_key(apply):
    same = ["https://h/a", "http://h/a.html", "https://h/a/", "https://h/a/index", "https://h/a/index.html#x"]
    assert set(apply(same, urls.page_key(V()))) == {"h/a"}


@pytest.mark.parametrize("path,folder", [("", "/"), ("/", "/"), ("/a", "/"), ("/a/b", "/a/"), ("/a/b/", "/a/b/")])
def test_directory(apply, path, folder):
    assert apply([path], urls.directory(V())) == [folder]
