"""URL parts, validity, scope and reference resolution (RFC 3986)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions.text import let

# RFC 3986 appendix B with a well-formed scheme, one pattern per part, so that
# finding a part does not match the rest.
SCHEME = r"\A([A-Za-z][A-Za-z0-9+.\-]*):"
AUTHORITY = r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"\A[^?#]*\?([^#]*)"
FRAGMENT = r"\A[^#]*#((?s:.*))"


def part(url: Column, pattern: str) -> Column:
    return F.regexp_extract(url, pattern, 1)


def scheme(url: Column) -> Column:
    return F.lower(part(url, SCHEME))


def host(url: Column) -> Column:
    """Host, with port if any; in lower case, as case does not tell hosts apart."""
    return F.lower(part(url, AUTHORITY))


def path(url: Column) -> Column:
    return part(url, PATH)


def reject_reason(url: Column) -> Column:
    """Why a start URL is refused; NULL when it is fine."""
    return (
        F.when(url.isNull() | ~scheme(url).isin(C.ALLOWED_SCHEMES), "invalid scheme")
        .when(host(url) == "", "missing host")
    )


def is_valid(url: Column) -> Column:
    return reject_reason(url).isNull()


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def directory(url_path: Column) -> Column:
    """Path up to and including its last slash; the root for an empty path."""
    found = F.regexp_extract(url_path, r"\A(.*/)", 1)
    return F.when(found == "", "/").otherwise(found)


def has_rejected_suffix(url: Column) -> Column:
    name = F.substring_index(path(url), "/", -1)
    return F.regexp_extract(name, r"\.([^.]*)\z", 1).isin(C.REJECTED_SUFFIXES)


def may_be_page(url: Column) -> Column:
    """A valid URL that does not end like a file of a rejected type."""
    return is_valid(url) & ~has_rejected_suffix(url)


def parent_folders(url: Column) -> Column:
    """All folders the URL lies in, from the root down."""
    return let(
        F.split(F.when(path(url) == "", "/").otherwise(path(url)), "/", -1),
        lambda parts: F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")),
        ),
    )


def in_scope(url: Column, seed_host: Column, seed_directory: Column) -> Column:
    """Same host as the seed, at or below the seed's folder, not a rejected type."""
    url_path = F.when(path(url) == "", "/").otherwise(path(url))
    return (
        may_be_page(url)
        & (host(url) == seed_host)
        & F.startswith(url_path, seed_directory)
    )


def page_key(url: Column) -> Column:
    """Comparison key under which a link and the page it leads to are equal."""
    bare = F.regexp_replace(without_fragment(url), r"\A[A-Za-z][A-Za-z0-9+.\-]*://", "")
    return F.regexp_replace(bare, r"(?:/index)?(?:\.html)?/?\z", "")


def _merged_path(base_path: Column, ref_path: Column) -> Column:
    """Path of a reference with a non-empty path, dot segments removed."""
    base_folder = F.split(F.regexp_replace(base_path, r"[^/]+\z", ""), "/", -1)
    # Joining with the base drops empty parts, but for those at both ends.
    joined_parts = let(
        F.concat(base_folder, F.split(ref_path, "/", -1)),
        lambda parts: F.filter(
            parts, lambda s, i: (s != "") | (i == 0) | (i == F.size(parts) - 1)
        ),
    )
    segments = F.when(
        F.startswith(ref_path, F.lit("/")), F.split(ref_path, "/", -1)
    ).otherwise(joined_parts)

    def resolve(parts: Column) -> Column:
        folded = F.aggregate(
            parts,
            F.array().cast("array<string>"),
            lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(s == ".", done)
            .otherwise(F.concat(done, F.array(s))),
        )
        closed = F.when(
            F.element_at(parts, -1).isin(".", ".."), F.concat(folded, F.array(F.lit("")))
        ).otherwise(folded)
        joined = F.array_join(closed, "/")
        return F.when(F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined))

    return let(segments, resolve)


# References of these forms need the full resolution.
UNUSUAL_ROOTED = r"[\x00-\x20]|\A//|/\.|\?#|[?#]\z"
UNUSUAL_PLAIN = r"[\x00-\x20:]|\A[./?#]|//|/\.|\?#|[?#]\z"


def _parts(url: Column) -> Column:
    return F.struct(
        scheme(url).alias("scheme"),
        host(url).alias("host"),
        path(url).alias("path"),
        part(url, QUERY).alias("query"),
        part(url, FRAGMENT).alias("fragment"),
        url.alias("whole"),
    )


def base_parts(url: Column) -> Column:
    """What resolution needs to know of a base, as a struct for many references."""
    return F.struct(
        scheme(url).alias("scheme"),
        host(url).alias("host"),
        path(url).alias("path"),
        part(url, QUERY).alias("query"),
        url.alias("whole"),
        F.concat(scheme(url), F.lit("://"), host(url)).alias("root"),
        directory(path(url)).alias("folder"),
        (~F.regexp_like(path(url), F.lit(r"//|/\."))).alias("is_plain"),
    )


def resolve(base: Column, href: Column) -> Column:
    """Absolute URL of ``href`` seen from ``base``; foreign schemes stay as they are."""
    return let(base_parts(base), lambda b: resolve_from(b, href))


def resolve_from(base: Column, href: Column) -> Column:
    """``resolve`` with the ``base_parts`` at hand; most links need no parsing."""
    rooted = F.startswith(href, F.lit("/")) & ~F.regexp_like(href, F.lit(UNUSUAL_ROOTED))
    plain = (href != "") & base["is_plain"] & ~F.regexp_like(href, F.lit(UNUSUAL_PLAIN))
    return (
        F.when(rooted, F.concat(base["root"], href))
        .when(plain, F.concat(base["root"], base["folder"], href))
        .otherwise(_resolve_fully(base, href))
    )


def _resolve_fully(base: Column, href: Column) -> Column:
    trimmed = F.regexp_replace(F.regexp_replace(href, r"\A[\x00-\x20]+", ""), r"[\t\r\n]", "")

    def from_parts(p: Column) -> Column:
        def with_tail(query: Column) -> Column:
            return F.concat(
                F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
                F.when(p["fragment"] != "", F.concat(F.lit("#"), p["fragment"])).otherwise(""),
            )

        own_path = F.when(
            (p["path"] == "") | F.startswith(p["path"], F.lit("/")), p["path"]
        ).otherwise(F.concat(F.lit("/"), p["path"]))
        kept_query = F.when(p["query"] != "", p["query"]).otherwise(base["query"])
        return (
            F.when(p["whole"] == "", base["whole"])
            .when((p["scheme"] != "") & (p["scheme"] != base["scheme"]), href)
            .when(
                p["host"] != "",
                F.concat(base["scheme"], F.lit("://"), p["host"], own_path, with_tail(p["query"])),
            )
            .when(p["path"] == "", F.concat(base["root"], base["path"], with_tail(kept_query)))
            .otherwise(
                F.concat(
                    base["root"], _merged_path(base["path"], p["path"]), with_tail(p["query"])
                )
            )
        )

    return let(_parts(trimmed), from_parts)
