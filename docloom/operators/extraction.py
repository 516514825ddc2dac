"""Pages to documents: one parse per page, then native clean-up."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import schema
from docloom.functions import frontmatter, links, paths, text, urls
from docloom.operators import page_markdown as pm
from docloom.session import save_and_reload, ship_package, spread_small_input

PARSED = ["title", "container", "markdown", "warning", "error"]

NO_CONTENT = "no content container"
# Pages whose results are held together in a worker.
PAGES_AT_ONCE = 256
BYTES_AT_ONCE = 4_000_000


def _parse_batches(wanted: list[str]):
    """Parse pages; only what the ``wanted`` fields need is worked out."""

    def parsed(part: pa.RecordBatch) -> pa.RecordBatch:
        rows: dict[str, list] = {name: [] for name in wanted}
        for html in part.column("html"):
            found: dict[str, str | None] = dict.fromkeys(PARSED)
            tree = None
            try:
                tree = pm.parse(html.as_py())
                if "title" in wanted or "warning" in wanted:
                    found["title"], found["warning"] = pm.page_title(tree)
                if {"container", "markdown", "error"} & set(wanted):
                    container = pm.content_container(tree)
                    if container is None:
                        found["error"] = NO_CONTENT
                    else:
                        found["container"] = container.name
                        if "markdown" in wanted:
                            found["markdown"] = pm.to_markdown(container)
            except Exception as failure:  # one bad page never stops the batch
                found["error"] = f"{type(failure).__name__}: {failure}"
            if tree is not None:
                tree.dismantle()
            for name in wanted:
                rows[name].append(found[name])
        kept = [name for name in part.schema.names if name != "html"]
        return pa.RecordBatch.from_arrays(
            [part.column(name) for name in kept] + [pa.array(rows[k], pa.string()) for k in wanted],
            names=[*kept, *wanted],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in _parts(batch.column("html")):
                yield parsed(batch.slice(first, last - first))
                # A worker would keep the room of its largest part until it ends.
                pa.default_memory_pool().release_unused()

    return run


def _parts(html: pa.Array) -> Iterator[tuple[int, int]]:
    """First and last row of parts of at most ``PAGES_AT_ONCE`` pages and ``BYTES_AT_ONCE`` bytes, or of one page."""
    first, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(html), 0).to_pylist()):
        if i > first and (held + size > BYTES_AT_ONCE or i - first >= PAGES_AT_ONCE):
            yield first, i
            first, held = i, 0
        held += size
    if first < len(html):
        yield first, len(html)


def parse_pages(pages: DataFrame, fields: list[str] = PARSED) -> DataFrame:
    """Every page with the named fields of its parse: title, container, Markdown, warning, error.

    Columns ``fetched_at`` and ``rel_path`` of the pages are kept.
    """
    ship_package(pages.sparkSession)
    kept = ["page_id", "url"] + [c for c in pages.columns if c in ("fetched_at", "rel_path")]
    slim = spread_small_input(pages.select(*kept, "html"), "page_id")
    shape = [slim.schema[c] for c in kept] + [T.StructField(c, T.StringType()) for c in fields]
    return slim.mapInArrow(_parse_batches(list(fields)), T.StructType(shape))


def with_document_fields(parsed: DataFrame, run_time: datetime) -> DataFrame:
    """Document columns next to the parse result, still with failed pages.

    Pages without a fetch time of their own get the time of the run.
    """
    stamp = F.lit(run_time).cast("timestamp")
    if "fetched_at" in parsed.columns:
        stamp = F.coalesce(F.col("fetched_at").cast("timestamp"), stamp)
    rel = paths.relative_html_path(F.col("url"))
    if "rel_path" in parsed.columns:
        # A saved file's own path decides; its URL may not lead back to it.
        rel = F.coalesce("rel_path", rel)
    source = paths.source_url(rel, urls.scheme(F.col("url")))
    return (
        parsed.withColumn("bundle", urls.host(F.col("url")))
        .withColumn("doc_path", paths.sanitize(paths.markdown_path(rel)))
        .withColumn("source_url", source)
        .withColumn("fetched_at", stamp)
        .withColumn(
            "body", links.rewrite(text.clean_markdown(F.col("markdown")), F.col("source_url"))
        )
        .withColumn(
            "md_bytes",
            F.octet_length(
                F.concat(
                    frontmatter.render(
                        F.coalesce("title", F.lit("")), F.col("source_url"), frontmatter.iso_utc(F.col("fetched_at"))
                    ),
                    F.col("body"),
                )
            ).cast("long"),
        )
    )


def extract(pages: DataFrame, run_time: datetime) -> tuple[DataFrame, DataFrame]:
    """Documents and rejects of pages, before paths are settled.

    Batch and stream share it. Pages are parsed once, into a written table.
    """
    valid = pages.where(urls.is_valid(F.col("url")))
    extracted = save_and_reload(with_document_fields(parse_pages(valid), run_time), "extracted")
    return converted(extracted), url_rejects(pages).unionByName(rejects(extracted))


def converted(extracted: DataFrame) -> DataFrame:
    """Documents of the pages that converted and whose path stays in its bundle."""
    return extracted.where(
        F.col("error").isNull() & paths.stays_inside(F.col("doc_path"))
    ).select(*schema.DOCS.fieldNames())


def rejects(extracted: DataFrame) -> DataFrame:
    """Pages that gave no document, and warnings on pages that did."""
    reasons = F.array(
        F.when(
            F.col("error").isNotNull(), F.struct(F.lit("extract").alias("stage"), F.col("error").alias("reason"))
        ),
        F.when(
            F.col("error").isNull() & ~paths.stays_inside(F.col("doc_path")),
            F.struct(F.lit("path").alias("stage"), F.lit("path leaves its root").alias("reason")),
        ),
        F.when(
            F.col("warning").isNotNull(),
            F.struct(F.lit("title").alias("stage"), F.col("warning").alias("reason")),
        ),
    )
    return (
        extracted.select(
            "page_id", "doc_path", F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("r")
        )
        .select("r.stage", "page_id", "doc_path", "r.reason")
    )


def url_rejects(pages: DataFrame) -> DataFrame:
    reason = urls.reject_reason(F.col("url"))
    return pages.where(reason.isNotNull()).select(
        F.lit("url").alias("stage"),
        "page_id",
        F.lit(None).cast("string").alias("doc_path"),
        reason.alias("reason"),
    )
