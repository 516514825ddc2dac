"""Page paths, document paths and their safety."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions import urls


def relative_html_path(url: Column) -> Column:
    """``host/path.html`` under which a crawler stores a page; the query is kept."""
    bare = F.regexp_replace(urls.without_fragment(url), r"\A[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_extract(bare, r"\A[^/?]*", 0)
    bare = F.concat(F.lower(host), F.substr(bare, F.length(host) + 1))
    with_root = F.regexp_replace(bare, r"\A([^/?]+)(?=\?|\z)", "$1/")
    indexed = F.regexp_replace(with_root, r"\A([^?]*/)(?=\?)", "$1index.html")
    indexed = F.regexp_replace(indexed, r"/\z", "/index")
    return F.when(F.endswith(indexed, F.lit(".html")), indexed).otherwise(
        F.concat(indexed, F.lit(".html"))
    )


def source_url(rel_path: Column, scheme: Column) -> Column:
    return F.concat(
        F.coalesce(F.when(scheme != "", scheme), F.lit("https")),
        F.lit("://"),
        F.regexp_replace(rel_path, r"\.html\z", ""),
    )


def markdown_path(html_path: Column) -> Column:
    return F.concat(F.regexp_replace(html_path, r"\.html\z", ""), F.lit(".md"))


def sanitize(path: Column) -> Column:
    """Replace unsafe characters in each path part and drop empty parts."""
    parts = F.filter(F.split(path, "/", -1), lambda p: p != "")
    safe = F.array_join(
        F.transform(parts, lambda p: F.regexp_replace(p, C.UNSAFE_PATH_CHARS, "_")), "/"
    )
    return F.when(safe == "", C.EMPTY_PATH_NAME).otherwise(safe)


def document_path(url: Column) -> Column:
    return sanitize(markdown_path(relative_html_path(url)))


def stays_inside(path: Column) -> Column:
    """False for absolute paths and for paths that climb out of their root."""
    return ~F.startswith(path, F.lit("/")) & ~F.exists(
        F.split(path, "/", -1), lambda p: p == ".."
    )


def in_category(path: Column, category: str) -> Column:
    return F.array_contains(F.split(path, "/", -1), category)
