"""The registered queries, each over whole driver tables.

Where the tables lack a case an operator must handle (bad URLs, Markdown
links, blank runs, crawl logs), Spark derives rows with that case from every
row of a table, and the SQL in ``oracles`` derives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import schema
from docloom.functions import frontmatter, links, paths, search, text, urls
from docloom.operators import (
    bundles,
    collisions,
    crawl_graph,
    crawl_log,
    extraction,
    lines,
    scope,
    trigram_index,
    upsert,
)
from docloom.operators import frontmatter as frontmatter_ingest
from docloom.operators import links as link_tables
from docloom.operators import search as search_ops
from docloom.plans.crawl import reachable
from docloom.session import save_and_reload, spread_small_input, work_path
from docloom.sources import documents as document_source
from docloom.sources import logs
from docloom.sources.bundle_views import BundleViews
from docloom.sources.collection import IngestLog
from docloom.sources.delta_collection import DeltaCollection
from docloom.sources.exports import ExportStore
from docloom.sources.file_tree import read_file_tree, write_file_tree
from docloom.sources.link_status import LinkStatus
from docloom.streaming import activity, ingest
from docloom.streaming.known_keys import KnownKeys
from docloom.streaming.progress import ProgressStream
from docloom.streaming.run_state import RunReports
from docloom.streaming.url_sketches import SKETCH_BITS, UrlSketches

QUERY = "that with"
RARE_QUERY = "ciónrr tschä"
INDEX_BLOCK_ROWS = 10_000
STATUS_BUCKETS = 16
FETCHED_AT = datetime(2024, 1, 1, tzinfo=timezone.utc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prose(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Documents as a collection; ``spread`` for costly work on a small table."""
    documents = table(spark, sf_dir, "documents")
    if spread:
        documents = spread_small_input(documents, "doc_id")
    return document_source.from_prose_table(documents)


def sized_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose(spark, sf_dir).withColumn("md_bytes", bundles.rendered_bytes())


def linked_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with Markdown links of all kinds around its text."""
    n = F.col("doc_id").cast("string")
    body = F.concat(
        F.lit("See [a"), n, F.lit("](/x/"), n,
        F.lit(") and ![i](img.png) [![b](c.png)](page) [e](#t) []() [m](mailto:x@y.z) [h](https://k.org/q)\n"),
        F.col("body"),
        F.lit("\n[up](../up?q=1#f) [p](/p \"T\") [c](d/./e/../f.html)"),
    )
    return prose(spark, sf_dir, spread=True).withColumn("body", body)


def neighbour_links(pages: DataFrame) -> DataFrame:
    """A link from every page to the page with the next id."""
    following = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    return pages.select("page_id", "url").join(following, "page_id").select(
        "page_id", F.col("url").alias("src"), F.col("next_url").alias("dst")
    )


def first_pages(pages: DataFrame) -> DataFrame:
    """The page with the least id of every host."""
    ids = pages.groupBy(urls.host(F.col("url")).alias("host")).agg(F.min("page_id").alias("page_id"))
    return pages.select("page_id", "url").join(ids, "page_id").select("host", "url")


def derived_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines a crawl of the pages would leave; the run is the host.

    Pages with a fragment in their URL are requested and not saved. Each run
    starts with a file saved before any URL line.
    """
    pages = table(spark, sf_dir, "pages")
    base = F.timestamp_seconds(F.col("page_id") + 1704067200)
    stamp = F.date_format(F.to_utc_timestamp(base, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    page_lines = F.array(
        F.struct(F.lit(0).alias("j"), F.concat(F.lit("--"), stamp, F.lit("--  "), F.col("url")).alias("line")),
        F.struct(F.lit(1).alias("j"), F.lit("HTTP request sent, awaiting response... 200 OK").alias("line")),
        F.struct(F.lit(2).alias("j"), F.when(~F.contains("url", F.lit("#")), F.lit("Saving to: 'page.html'")).alias("line")),
        F.struct(F.lit(3).alias("j"), F.when(~F.contains("url", F.lit("#")), F.lit("'page.html' SAVED [10/10]")).alias("line")),
    )
    host = urls.host(F.col("url"))
    body = (
        pages.select(host.alias("run_id"), "page_id", base.alias("ts"), F.explode(page_lines).alias("l"))
        .where("l.line is not null")
        .select("run_id", (F.col("page_id") * 4 + F.col("l.j")).alias("seq"), "ts", "l.line")
    )
    head = pages.groupBy(host.alias("run_id")).agg(F.min("page_id").alias("first_id")).select(
        "run_id",
        (F.col("first_id") * 4 - 1).alias("seq"),
        F.timestamp_seconds(F.col("first_id") + 1704067200 - 5).alias("ts"),
        F.lit("'robots.txt' saved [1/1]").alias("line"),
    )
    return body.unionByName(head)


# ---- scans ----------------------------------------------------------------


@query
def scan_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.octet_length("html").cast("long").alias("n_bytes")
    )


@query
def scan_file_tree(spark, sf_dir):
    """All pages saved as files, some below folders with a leading ``_``, and read back from the tree."""
    root = work_path(spark, "tree")
    host = F.regexp_extract("url", r"\A[a-z]+://([^/?#]*)", 1)
    folder = F.when(F.col("page_id") % 3 == 0, "_saved").otherwise("saved")
    files = table(spark, sf_dir, "pages").select(
        F.concat_ws("/", host, folder, F.concat(F.col("page_id").cast("string"), F.lit(".html"))).alias("rel_path"),
        F.col("html").alias("content"),
    )
    save_and_reload(write_file_tree(files, root), "tree-files")
    return read_file_tree(spark, root, ".html").select("rel_path", "n_bytes", F.md5("content").alias("content_md5"))


@query
def scan_docs(spark, sf_dir):
    return prose(spark, sf_dir).select(
        "doc_id", "doc_path", F.octet_length("body").cast("long").alias("md_bytes")
    )


# ---- URLs and paths -------------------------------------------------------


@query
def valid_urls(spark, sf_dir):
    rest = F.regexp_replace("url", r"\A[a-z]+://", "")
    variants = F.array(
        F.col("url"),
        F.concat(F.lit("ftp://"), rest),
        F.concat(F.lit("HTTPS://"), rest),
        F.concat(F.lit("https:///"), rest),
        rest,
        F.lit(""),
    )
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", F.explode(variants).alias("candidate"))
        .select(
            "page_id",
            urls.scheme(F.col("candidate")).alias("scheme"),
            urls.host(F.col("candidate")).alias("host"),
            urls.is_valid(F.col("candidate")).alias("is_valid"),
        )
    )


@query
def crawl_scope(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    root = F.concat(urls.scheme(F.col("url")), F.lit("://"))
    host, path = urls.host(F.col("url")), urls.path(F.col("url"))
    own = pages.select(
        "page_id",
        F.explode(
            F.array(
                F.col("url"),
                F.concat(root, host, path, F.lit(".pdf")),
                F.concat(root, host, path, F.lit("/a.zip?x=1")),
                F.concat(root, F.lit("other."), host, path),
                F.concat(root, host),
            )
        ).alias("resolved"),
    )
    candidates = save_and_reload(
        scope.page_hrefs(pages).select("page_id", "resolved").unionByName(own), "candidates"
    )
    seeds = scope.seeds_from_urls(first_pages(pages))
    return scope.mark_scope(candidates, seeds).select("page_id", "resolved", "in_scope")


def crawl_edges(pages: DataFrame) -> DataFrame:
    hrefs = scope.page_hrefs(pages).select(F.col("url").alias("src"), F.col("resolved").alias("dst"))
    edges = hrefs.unionByName(neighbour_links(pages).select("src", "dst"))
    return edges.where(~urls.has_rejected_suffix(F.col("dst")))


@query
def crawl_depth(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return crawl_graph.crawl_depth(crawl_edges(pages), first_pages(pages))


@query
def crawl_depth_filtered(spark, sf_dir):
    """The same levels from a bucketed table of visited URLs with Bloom filters."""
    pages = table(spark, sf_dir, "pages")
    return crawl_graph.crawl_depth_filtered(crawl_edges(pages), first_pages(pages))


@query
def path_guard(spark, sf_dir):
    rel = paths.relative_html_path(F.col("url"))
    variants = F.array(
        rel,
        F.concat(F.lit("../"), rel),
        F.concat(F.lit("/"), rel),
        F.replace(rel, F.lit("/"), F.lit("/../")),
        F.replace(rel, F.lit("/"), F.lit("/..x/")),
    )
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", F.explode(variants).alias("rel_path"))
        .withColumn("ok", paths.stays_inside(F.col("rel_path")))
    )


@query
def source_urls(spark, sf_dir):
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", "url", paths.relative_html_path(F.col("url")).alias("rel_path"))
        .select(
            "page_id",
            "rel_path",
            paths.source_url(F.col("rel_path"), urls.scheme(F.col("url"))).alias("source_url"),
        )
    )


@query
def doc_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", paths.document_path(F.col("url")).alias("doc_path")
    )


@query
def path_collisions(spark, sf_dir):
    """Every page next to a copy whose URL differs in characters that are sanitized."""
    copies = F.array(
        F.struct((F.col("page_id") * 2).alias("page_id"), F.col("url").alias("url")),
        F.struct(
            (F.col("page_id") * 2 + 1).alias("page_id"),
            F.regexp_replace("url", "[?&=]", "@").alias("url"),
        ),
    )
    docs = table(spark, sf_dir, "pages").select(F.inline(copies)).select(
        urls.host(F.col("url")).alias("bundle"),
        paths.document_path(F.col("url")).alias("doc_path"),
        "page_id",
    )
    return collisions.path_winners(docs).select("doc_path", "winner_page_id", "n")


@query
def settled_paths(spark, sf_dir):
    """Every page twice with one id, and next to a copy on a contested path."""
    copies = F.array(
        F.struct((F.col("page_id") * 2).alias("page_id"), F.col("url").alias("url")),
        F.struct((F.col("page_id") * 2).alias("page_id"), F.col("url").alias("url")),
        F.struct(
            (F.col("page_id") * 2 + 1).alias("page_id"),
            F.regexp_replace("url", "[?&=]", "@").alias("url"),
        ),
    )
    docs = table(spark, sf_dir, "pages").select(F.inline(copies)).select(
        urls.host(F.col("url")).alias("bundle"), paths.document_path(F.col("url")).alias("doc_path"), "page_id"
    )
    return collisions.keep_winners(docs)


@query
def saved_file_paths(spark, sf_dir):
    """Paths of saved files whose names hold signs that a URL would not give back."""
    pages = table(spark, sf_dir, "pages").select("page_id", paths.relative_html_path(F.col("url")).alias("rel_path"))
    stem = F.regexp_replace("rel_path", r"\.html\z", "")
    names = F.array(
        F.col("rel_path"), F.concat(stem, F.lit("#b.html")), F.concat(F.lit("_modules/"), stem, F.lit("/_x.html"))
    )
    return pages.select("page_id", F.explode(names).alias("rel_path")).select(
        "page_id",
        "rel_path",
        paths.sanitize(paths.markdown_path(F.col("rel_path"))).alias("doc_path"),
        paths.source_url(F.col("rel_path"), F.lit("https")).alias("source_url"),
    )


@query
def index_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "pages").select(
        urls.host(F.col("url")).alias("bundle"), paths.document_path(F.col("url")).alias("doc_path")
    )
    return bundles.index_pages(docs)


# ---- extraction -----------------------------------------------------------


def _extracted(spark, sf_dir):
    return extraction.with_document_fields(
        extraction.parse_pages(table(spark, sf_dir, "pages")), FETCHED_AT
    )


@query
def page_titles(spark, sf_dir):
    return extraction.parse_pages(table(spark, sf_dir, "pages"), ["title"]).select("page_id", "title")


@query
def container_kinds(spark, sf_dir):
    return (
        extraction.parse_pages(table(spark, sf_dir, "pages"), ["container"])
        .groupBy("container")
        .agg(F.count("*").alias("n_pages"))
    )


@query
def extract_docs(spark, sf_dir):
    return extraction.converted(_extracted(spark, sf_dir)).select(
        "page_id", "doc_path", "title", "source_url", "body", "md_bytes"
    )


@query
def rejects_by_stage(spark, sf_dir):
    """Every page intact, without a container, without a title, and with a bad URL."""
    pages = table(spark, sf_dir, "pages")
    bare = F.regexp_replace("html", "</?(?:article|body)>", "")
    untitled = F.regexp_replace("html", "<title>[^<]*</title>", "<title></title>")
    ids = F.col("page_id") * 4
    variants = F.array(
        F.struct(ids.alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html")),
        F.struct((ids + 1).alias("page_id"), F.col("url").alias("url"), bare.alias("html")),
        F.struct((ids + 2).alias("page_id"), F.col("url").alias("url"), untitled.alias("html")),
        F.struct(
            (ids + 3).alias("page_id"),
            F.regexp_replace("url", "^https?", "ftp").alias("url"),
            F.col("html").alias("html"),
        ),
    )
    from docloom.plans.corpus import convert

    _, rejected = convert(pages.select(F.inline(variants)), FETCHED_AT)
    reason = F.regexp_replace("reason", r" [0-9]+\z", "")
    return rejected.groupBy("stage", reason.alias("reason")).agg(F.count("*").alias("n"))


@query
def clean_text(spark, sf_dir):
    blanks = F.replace("text", F.lit("\n"), F.lit(" \t \n\n\n\n \n"))
    return spread_small_input(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", text.clean_markdown(F.concat(blanks, F.lit(" \n"))).alias("cleaned")
    )


# ---- frontmatter ----------------------------------------------------------


def _with_header(spark, sf_dir):
    header = frontmatter.render(
        F.concat(F.lit('Say "'), F.col("bundle"), F.lit('" '), F.col("doc_id").cast("string")),
        F.col("source_url"),
        F.lit("2024-01-01T00:00:00+00:00"),
    )
    return prose(spark, sf_dir, spread=True).withColumn("frontmatter", header)


@query
def render_frontmatter(spark, sf_dir):
    return _with_header(spark, sf_dir).select("doc_id", "frontmatter")


@query
def parse_frontmatter(spark, sf_dir):
    files = _with_header(spark, sf_dir).select(
        "doc_id", F.concat("frontmatter", "body").alias("content")
    )
    # Exploding the expression, not the column, lets Spark compute it once.
    return frontmatter_ingest.parse_plain(files).select(
        "doc_id",
        F.length("body").alias("body_length"),
        F.explode(frontmatter.fields(F.col("content"))).alias("key", "value"),
    )


# ---- links ----------------------------------------------------------------


@query
def md_links(spark, sf_dir):
    return link_tables.body_links(linked_prose(spark, sf_dir), "doc_id").select(
        "doc_id", "ord", "text", "href"
    )


@query
def link_kinds(spark, sf_dir):
    in_bodies = link_tables.body_links(linked_prose(spark, sf_dir), "doc_id").select("kind")
    in_pages = scope.page_hrefs(table(spark, sf_dir, "pages")).select("kind")
    return in_bodies.unionByName(in_pages).groupBy("kind").agg(F.count("*").alias("n"))


@query
def resolve_root_links(spark, sf_dir):
    return scope.page_hrefs(table(spark, sf_dir, "pages")).select("page_id", "ord", "resolved")


@query
def normalize_links(spark, sf_dir):
    return link_tables.normalize_links(linked_prose(spark, sf_dir)).select("doc_id", "body")


@query
def href_spellings(spark, sf_dir):
    """Every link of every page in seven spellings of its anchor."""
    links = scope.page_hrefs(table(spark, sf_dir, "pages")).select("page_id", "ord", "href")
    quoted = F.replace("href", F.lit("&"), F.lit("&amp;"))
    tags = [
        F.concat(F.lit('<a href="'), quoted, F.lit('">')),
        F.concat(F.lit("<a href='"), quoted, F.lit("'>")),
        F.concat(F.lit("<a href="), quoted, F.lit(">")),
        F.concat(F.lit('<a class="x" data-href="no" href="'), quoted, F.lit('" id=y>')),
        F.concat(F.lit('<A HREF="'), quoted, F.lit('">')),
        F.concat(F.lit('<a\n  rel=next\n  href = "'), quoted, F.lit('"\n>')),
        F.concat(F.lit('<a title="a b" Href=\' '), quoted, F.lit(" '>")),
    ]
    pages = links.select(
        (F.col("page_id") * 1000 + F.col("ord")).alias("page_id"),
        F.lit("https://base.example/").alias("url"),
        F.concat_ws("x</a> <abbr href=no>", *tags).alias("html"),
    )
    return scope.page_hrefs(pages).select("page_id", F.col("ord").cast("long").alias("ord"), "href")


@query
def crawl_reachable(spark, sf_dir):
    """What a crawl reaches: links to the next pages, off the host, above the start, and to files."""
    pages = table(spark, sf_dir, "pages")
    host = urls.host(F.col("url"))
    in_host = Window.partitionBy(host).orderBy("page_id")
    base = F.concat(F.lit("https://"), host)
    links = F.concat(
        F.lit("<a href='"), base, F.lit("/s/p"), F.col("n").cast("string"), F.lit("'>next</a><a href=../up>up</a>"),
        F.lit('<a class=x href="https://other.example/s/q">off</a><A HREF="file.pdf">file</A>'),
    )
    chain = (
        pages.withColumn("n", F.row_number().over(in_host))
        .select(
            "page_id",
            F.concat(base, F.lit("/s/p"), (F.col("n") - 1).cast("string")).alias("url"),
            links.alias("html"),
        )
    )
    starts = pages.select(F.concat(base, F.lit("/s/p0")).alias("url")).distinct()
    return reachable(chain, starts)


@query
def link_targets(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = scope.page_hrefs(pages).select("resolved")
    added = neighbour_links(pages).select(
        F.concat(paths.source_url(paths.relative_html_path(F.col("dst")), urls.scheme(F.col("dst"))), F.lit(".html#x")).alias("resolved")
    )
    return crawl_graph.link_targets(found.unionByName(added), pages)


@query
def link_status(spark, sf_dir):
    """Pages and their links in three deliveries, and what became of each target in which of them."""
    pages = table(spark, sf_dir, "pages")
    found = scope.page_hrefs(pages).select("page_id", "resolved")
    added = neighbour_links(pages).select(
        "page_id",
        F.concat(paths.source_url(paths.relative_html_path(F.col("dst")), urls.scheme(F.col("dst"))), F.lit(".html#x")).alias("resolved"),
    )
    every = save_and_reload(found.unionByName(added), "links")
    status = LinkStatus(spark, work_path(spark, "link-status"), STATUS_BUCKETS)
    for part in range(3):
        mine = F.col("page_id") % 3 == part
        status.deliver(every.where(mine), pages.where(mine), part)
    return status.read()


# ---- search ---------------------------------------------------------------


@query
def search_filter(spark, sf_dir):
    return search_ops.matching(prose(spark, sf_dir), QUERY).select("doc_id")


@query
def search_counts(spark, sf_dir):
    return search_ops.match_counts(prose(spark, sf_dir), QUERY, "doc_id")


@query
def search_topk(spark, sf_dir):
    return search_ops.top_documents(prose(spark, sf_dir), QUERY, "doc_id")


@query
def search_indexed(spark, sf_dir):
    """A common and a rarer query over an indexed collection that got its documents in two deliveries."""
    docs = prose(spark, sf_dir).select("bundle", "doc_path", "doc_id", "body")
    index = trigram_index.indexed(docs.where("doc_id % 4 <> 1"), INDEX_BLOCK_ROWS)
    index.store.upsert(docs.where("doc_id % 4 <= 1"))
    index.refresh()
    found = [index.top_documents(q, "doc_id").withColumn("query", F.lit(q)) for q in (QUERY, RARE_QUERY)]
    return found[0].unionByName(found[1])


@query
def search_category(spark, sf_dir):
    docs = prose(spark, sf_dir)
    best = search_ops.top_documents(docs, QUERY, "doc_path", category="src1")
    return best.select(
        F.regexp_extract("doc_path", r"/(\d+)\.md\z", 1).cast("long").alias("doc_id"), "doc_path", "matches"
    )


@query
def multi_query_search(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    return search_ops.top_documents_for_queries(prose(spark, sf_dir), queries, "doc_id")


@query
def multi_query_sliced(spark, sf_dir):
    """The same with a query table that is cut into many slices."""
    queries = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    docs = prose(spark, sf_dir)
    terms = search_ops.query_keywords(queries).count()
    return search_ops.top_documents_for_queries(docs, queries, "doc_id", slice_terms=max(1, terms // 5))


@query
def hits_of_twin_bundles(spark, sf_dir):
    """Every document under one path in two bundles; the second copy has one more match."""
    docs = prose(spark, sf_dir).withColumn("doc_path", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    twins = docs.withColumn("bundle", F.lit("a")).unionByName(
        docs.withColumn("bundle", F.lit("b")).withColumn("body", F.concat("body", F.lit("\nthat")))
    )
    return search_ops.hits(twins, QUERY).select(
        F.col("rank").cast("long").alias("rank"), "bundle", "doc_path", "matches", "source_url"
    )


@query
def multi_query_counts(spark, sf_dir):
    """All matches of one query per language: its code, twice, and a common word."""
    queries = table(spark, sf_dir, "documents").select("lang").distinct().select(
        F.col("lang").alias("query_id"), F.concat_ws(" ", "lang", "lang", F.lit("the")).alias("query")
    )
    return search_ops.match_counts_for_queries(prose(spark, sf_dir), queries, "doc_id")


@query
def doc_lines(spark, sf_dir):
    return prose(spark, sf_dir).select(
        "doc_id", F.size(text.split_lines(F.col("body"))).cast("long").alias("n_lines")
    )


def _hits(docs: DataFrame) -> DataFrame:
    words = search.tokenize(QUERY)
    return search_ops.matching(docs, QUERY).select(
        "doc_id", search.hit_lines(text.split_lines(F.col("body")), words).alias("hits")
    )


@query
def hit_lines(spark, sf_dir):
    return _hits(prose(spark, sf_dir)).select("doc_id", F.explode(F.col("hits").cast("array<long>")).alias("line_no"))


@query
def match_islands(spark, sf_dir):
    return _hits(prose(spark, sf_dir)).select(
        "doc_id", F.inline(search.islands(F.col("hits")))
    ).select(
        "doc_id",
        F.col("first_line").cast("long").alias("first_line"),
        F.col("last_line").cast("long").alias("last_line"),
        F.col("n_hits").cast("long").alias("n_hits"),
    )


@query
def window_islands(spark, sf_dir):
    """The same islands from an exploded line table, with windows."""
    marked = lines.mark_hits(
        lines.document_lines(search_ops.matching(prose(spark, sf_dir), QUERY), "doc_id"), search.tokenize(QUERY)
    )
    found = lines.islands(marked.where("is_hit").select("doc_id", "line_no"), "doc_id")
    return found.select(
        "doc_id",
        F.col("first_line").cast("long").alias("first_line"),
        F.col("last_line").cast("long").alias("last_line"),
        "n_hits",
    )


@query
def search_contexts(spark, sf_dir):
    results = search_ops.hits(prose(spark, sf_dir), QUERY, "doc_id")
    return results.select("doc_id", F.posexplode("context_rows").alias("ctx_no", "c")).select(
        "doc_id",
        F.col("ctx_no").cast("long").alias("ctx_no"),
        F.col("c.start_line").cast("long").alias("start_line"),
        F.col("c.end_line").cast("long").alias("end_line"),
        "c.snippet",
    )


@query
def hits_display(spark, sf_dir):
    shown = search_ops.display(search_ops.hits(prose(spark, sf_dir), QUERY, "doc_id"))
    return shown.select(
        F.col("rank").cast("long").alias("rank"),
        "doc_id",
        "matches",
        "source_url",
        "fetched_at",
        F.size("contexts").cast("long").alias("n_contexts_shown"),
    )


@query
def hits_json(spark, sf_dir):
    return search_ops.as_json(search_ops.hits(prose(spark, sf_dir), QUERY, "doc_id"), "doc_id")


# ---- bundles --------------------------------------------------------------


@query
def upsert_docs(spark, sf_dir):
    """Documents in all languages but French, then a newer French and English delivery."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("bundle"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("doc_path"),
        "doc_id",
        "lang",
    )
    old = docs.where("lang <> 'fr'").withColumn("version", F.lit(1).cast("long"))
    new = docs.where("lang in ('fr', 'en')").withColumn("version", F.lit(2).cast("long"))
    return upsert.upsert(old, new).select("doc_path", "doc_id", "version")


@query
def delta_upserts(spark, sf_dir):
    """All documents in three deliveries to a collection kept by deltas, and then the whole bundles of two."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("bundle"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("doc_path"),
        "doc_id",
        F.col("text").alias("body"),
        F.lit(0).cast("long").alias("version"),
    )
    store = DeltaCollection(spark, work_path(spark, "delta-collection"), docs.schema)
    for version, part in enumerate(("doc_id % 3 <> 0", "doc_id % 3 <> 1", "doc_id % 11 = 0"), 1):
        store.upsert(docs.where(part).withColumn("version", F.lit(version).cast("long")))
    stale = docs.where("bundle in ('src0', 'src1') and doc_id % 3 = 0").withColumn("version", F.lit(4).cast("long"))
    store.upsert(stale, replace_bundles=True)
    return store.read().select("doc_path", "doc_id", "version", F.octet_length("body").cast("long").alias("n_bytes"))


@query
def bundle_report(spark, sf_dir):
    docs = sized_prose(spark, sf_dir)
    return bundles.report(docs, bundles.manifest(docs)).select(
        "bundle", "n_files", "n_md", "total_bytes", "total_mb", "over_limit", "valid",
        F.size("warnings").cast("long").alias("n_warnings"),
        F.element_at("top_files", 1)["doc_path"].alias("largest"),
    )


@query
def bundle_views(spark, sf_dir):
    """Sizes and largest documents kept up to date over three deliveries; the last one replaces two bundles."""
    docs = prose(spark, sf_dir).select("bundle", "doc_path", "doc_id", "title", "source_url", "fetched_at", "body")
    moved = docs.withColumn("body", F.when(F.col("doc_id") % 5 == 0, "moved").otherwise(F.col("body")))
    parts = [
        (docs.where("doc_id % 3 <> 0"), False),
        (moved.where("doc_id % 3 <> 1"), False),
        (docs.where("bundle in ('src0', 'src1') and doc_id % 3 = 0"), True),
    ]
    store = DeltaCollection(spark, work_path(spark, "viewed-collection"), sized_prose(spark, sf_dir).select(*docs.columns, "md_bytes").schema)
    views = BundleViews(spark, work_path(spark, "bundle-views"), store)
    for part, whole in parts:
        store.upsert(part.withColumn("md_bytes", bundles.rendered_bytes()), replace_bundles=whole)
        views.refresh()
    named = views.sizes().select(F.col("bundle").alias("b"), "n_files", "n_md", "total_bytes")
    largest = views.largest_docs()
    return largest.join(named, F.col("bundle").eqNullSafe(F.col("b"))).select(
        "bundle", F.col("rank").cast("long").alias("rank"), "doc_path", "kb", "n_files", "n_md", "total_bytes"
    )


@query
def bundle_validation(spark, sf_dir):
    """For each source one bundle of every kind that the checks tell apart."""
    n = F.col("n")
    sources = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    kinds = ["good", "bare", "nomd", "nofm", "open", "noname", "big", "edge", "empty", "absent"]
    every = sources.select("n", F.explode(F.array(*map(F.lit, kinds))).alias("kind"), "source").withColumn(
        "bundle", F.concat_ws("-", "source", "kind")
    )
    rest = (
        F.when(F.col("kind") == "big", F.lit(8388609) - n).when(F.col("kind") == "edge", F.lit(8388608) - n).otherwise(1)
    )
    end = F.when(F.col("kind") == "nomd", ".txt").otherwise(".md")
    docs = every.where("kind not in ('empty', 'absent')").select(
        "bundle",
        F.inline(F.array(
            F.struct(F.concat(F.lit("a"), end).alias("doc_path"), n.alias("md_bytes")),
            F.struct(F.concat(F.lit("b"), end).alias("doc_path"), rest.cast("long").alias("md_bytes")),
        )),
    )
    head = F.concat(F.lit("---\nname: "), F.col("bundle"))
    described = every.where("kind not in ('bare', 'absent')").select(
        "bundle",
        F.when(F.col("kind") != "noname", F.col("bundle")).alias("name"),
        F.lit("d").alias("description"),
        F.when(F.col("kind") == "nofm", "# x").when(F.col("kind") == "open", head)
        .otherwise(F.concat(head, F.lit("\n---\n"))).alias("descriptor"),
    )
    return bundles.report(docs, described, every.select("bundle"), list_largest=False).select(
        "bundle", F.col("n_files").cast("long").alias("n_files"), F.col("n_md").cast("long").alias("n_md"),
        "total_bytes", "over_limit", "valid",
        F.concat_ws("; ", "errors").alias("errors"), F.concat_ws("; ", "warnings").alias("warnings"),
    )


@query
def largest_docs(spark, sf_dir):
    docs = sized_prose(spark, sf_dir)
    return bundles.largest_docs(docs).select(
        "bundle", F.col("rank").cast("long").alias("rank"), "doc_path", "kb"
    )


@query
def bundle_manifest(spark, sf_dir):
    return bundles.manifest(sized_prose(spark, sf_dir)).select(
        "bundle", "description", "n_docs", "total_bytes", "content_hash"
    )


@query
def export_results(spark, sf_dir):
    """Two exports of all bundles and of one absent bundle for each; in the second one some paths leave their bundle."""
    docs = prose(spark, sf_dir).select("bundle", "doc_path", "doc_id", "body")
    absent = docs.select(F.concat("bundle", F.lit("-absent")).alias("bundle"))
    store = ExportStore(spark, work_path(spark, "exports"))
    store.publish(docs, absent)
    leaving = F.when(F.col("doc_id") % 149 == 0, F.concat(F.lit("../"), F.col("doc_path"))).otherwise(F.col("doc_path"))
    store.publish(docs.where("doc_id % 5 <> 2").withColumn("doc_path", leaving), absent)
    results = store.results().select(
        "version", "bundle", F.coalesce("reason", F.lit("exported")).alias("outcome"), "n_docs"
    )
    kept = store.read("bundle string, doc_path string, doc_id long, body string").groupBy("bundle").agg(F.count("*").alias("n_docs"))
    return results.unionByName(kept.select(F.lit(0).cast("long").alias("version"), "bundle", F.lit("current").alias("outcome"), "n_docs"))


# ---- crawl log ------------------------------------------------------------


@query
def crawl_progress(spark, sf_dir):
    return crawl_log.progress(derived_log(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query
def crawl_outcomes(spark, sf_dir):
    """One run per page; its exit code follows from the length of the page."""
    runs = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("run_id"), (F.length("html") % 10).alias("exit_code")
    )
    return crawl_log.outcomes(runs)


# ---- streams --------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.stream_events(spark, sf_dir)


@query
def stream_rate(spark, sf_dir):
    out = work_path(spark, "rate")
    rates = activity.rate(_events(spark, sf_dir))
    activity.run_updates(rates, out, work_path(spark, "rate-log")).awaitTermination()
    return activity.latest(spark, out, "window_start").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "per_hour"
    )


def _delivered(parts, folder: str, run, kind: str = "parquet") -> None:
    """Write parts of a table into a folder one after the other, and run a stream after each one."""
    for part in parts:
        part.write.format(kind).mode("append").save(folder)
        run().awaitTermination()


def _by_time(rows: DataFrame, n: int) -> list[DataFrame]:
    """Rows in ``n`` parts, equal spans of ``ts`` in order."""
    ends = rows.agg(F.unix_micros(F.min("ts")).alias("low"), F.unix_micros(F.max("ts")).alias("high")).first()
    if ends["low"] is None:
        return [rows]
    span = (ends["high"] - ends["low"]) // n + 1
    part = F.floor((F.unix_micros("ts") - ends["low"]) / span)
    return [rows.where(part == i) for i in range(n)]


@query
def stream_dedup(spark, sf_dir):
    """Events in three deliveries, whose keys come back in each of them."""
    keys = ["user_id", "event_type"]
    source, seen = work_path(spark, "event-files"), KnownKeys(spark, work_path(spark, "seen"), keys)
    events, log = table(spark, sf_dir, "events"), work_path(spark, "seen-log")
    parts = [events.where(F.pmod("event_id", F.lit(3)) == i) for i in range(3)]
    _delivered(parts, source, lambda: seen.start(activity.stream_events(spark, source, "*.parquet"), log))
    return seen.read().select(*keys)


@query
def stream_ingest_docs(spark, sf_dir):
    """Pages in three deliveries, each next to copies with bad URLs and on contested paths."""
    pages = table(spark, sf_dir, "pages")
    bad = pages.withColumn("url", F.regexp_replace("url", "^https?", "ftp"))
    copies = pages.withColumn("url", F.regexp_replace("url", "[?&=]", "@"))
    rows = pages.unionByName(copies).unionByName(bad)
    source, log_path, checkpoint = (work_path(spark, x) for x in ("page-files", "ingest", "ingest-log"))
    _delivered(
        [rows.where(F.col("page_id") % 3 == part) for part in range(3)], source,
        lambda: ingest.start_ingest(ingest.stream_pages(spark, source), log_path, checkpoint, FETCHED_AT),
    )
    log = IngestLog(spark, log_path)
    current = log.current().select("doc_path", "page_id", F.lit("current").alias("state"))
    return current.unionByName(log.rejects().select(
        F.lit(None).cast("string").alias("doc_path"), "page_id", F.concat_ws(": ", "stage", "reason").alias("state")
    ))


@query
def stream_crawl_progress(spark, sf_dir):
    """The derived log as files that arrive out of order, followed as a stream."""
    source, checkpoint = work_path(spark, "log-lines"), work_path(spark, "progress-log")
    lines = derived_log(spark, sf_dir)
    follower = ProgressStream(spark, work_path(spark, "progress"))
    runs = []

    def run():
        runs.append(follower.start(logs.stream_log(spark, source), checkpoint))
        return runs[-1]

    _delivered([lines.where(F.pmod("seq", F.lit(4)) == part) for part in (2, 0, 3, 1)], source, run, "json")
    return follower.report(runs[-1].lastProgress["batchId"]).withColumn("rate", F.round("rate", 6))


@query
def stream_run_parts(spark, sf_dir):
    """The derived log in three deliveries in order of time, followed with keyed state; two minutes of silence end a part."""
    source, checkpoint = work_path(spark, "run-lines"), work_path(spark, "run-log")
    reports = RunReports(spark, work_path(spark, "run-reports"), silence="2 minutes", delay="1 minute")
    _delivered(
        _by_time(derived_log(spark, sf_dir), 3), source,
        lambda: reports.start(logs.stream_log(spark, source), checkpoint), "json",
    )
    return reports.read().select(
        "run_id", F.unix_seconds("started_at").alias("started_s"), "n_urls", "elapsed_s", F.round("rate", 6).alias("rate"), "late"
    )


@query
def stream_url_sketches(spark, sf_dir):
    """Saved URLs of each run from sketches of three deliveries: their error against the exact count is in its bounds."""
    source, checkpoint = work_path(spark, "sketch-files"), work_path(spark, "sketch-log")
    lines = derived_log(spark, sf_dir)
    sketches = UrlSketches(spark, work_path(spark, "url-sketches"))
    _delivered(
        _by_time(lines, 3), source, lambda: sketches.start(logs.stream_log(spark, source), checkpoint), "json"
    )
    told = sketches.report().select("run_id", F.col("n_urls").alias("told"), "elapsed_s")
    exact = crawl_log.progress(lines).select("run_id", "n_urls")
    # Three standard errors, and rounding.
    bound = 3 * 1.04 / 2 ** (SKETCH_BITS / 2) * F.col("n_urls") + 0.5
    return told.join(exact, "run_id").select(
        "run_id", "n_urls", "elapsed_s", (F.abs(F.col("told") - F.col("n_urls")) <= bound).alias("within_bound")
    )
