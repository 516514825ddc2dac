"""Per-bundle descriptor, size report and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions import frontmatter
from docloom.session import save_and_reload

DESCRIPTOR_BLOCK = r"(?s)\A---\n(.*?)\n---"


def rendered_bytes():
    """Size of a document as exported: header and body."""
    return F.octet_length(
        F.concat(
            frontmatter.render(
                F.col("title"), F.col("source_url"), frontmatter.iso_utc(F.col("fetched_at"))
            ),
            F.col("body"),
        )
    ).cast("long")


def content_digest() -> Column:
    """A number told by a document's path and body."""
    return F.conv(
        F.substring(F.md5(F.concat(F.col("doc_path"), F.lit("\n"), F.col("body"))), 1, 15), 16, 10
    ).cast("long")


def manifest(docs: DataFrame) -> DataFrame:
    """Descriptor row per bundle, with counts and a digest of the content.

    The digest does not depend on order, so it combines before the shuffle.
    """
    return (
        docs.groupBy("bundle")
        .agg(
            F.count("*").alias("n_docs"),
            F.sum("md_bytes").alias("total_bytes"),
            F.bit_xor(content_digest()).alias("content_hash"),
        )
        .withColumn("name", F.col("bundle"))
        .withColumn("description", F.concat(F.upper("bundle"), F.lit(C.DESCRIPTION_SUFFIX)))
        .select("bundle", "name", "description", "n_docs", "total_bytes", "content_hash")
    )


def descriptor_text(manifest_rows: DataFrame) -> DataFrame:
    """Descriptor header as text, for export."""
    return manifest_rows.withColumn(
        "descriptor",
        F.concat(
            F.lit("---\nname: "), F.col("name"), F.lit("\ndescription: "), F.col("description"), F.lit("\n---\n")
        ),
    )


def largest_docs(docs: DataFrame, n: int = C.LARGEST_FILES_LISTED) -> DataFrame:
    """The ``n`` largest documents per bundle: ``bundle, rank, doc_path, md_bytes, kb``.

    Only path and size take part, and every task keeps at most ``n`` rows per
    bundle before the shuffle.
    """
    by_size = Window.partitionBy("bundle").orderBy(F.desc("md_bytes"), "doc_path")
    return (
        docs.select("bundle", "doc_path", "md_bytes")
        .withColumn("rank", F.row_number().over(by_size))
        .where(F.col("rank") <= n)
        .withColumn("kb", F.round(F.col("md_bytes") / 1024, 1))
    )


def sizes(docs: DataFrame) -> DataFrame:
    """Counts and sizes per bundle; all files count towards the limit."""
    return (
        docs.groupBy("bundle")
        .agg(
            F.count("*").alias("n_files"),
            F.count_if(F.endswith("doc_path", F.lit(".md"))).alias("n_md"),
            F.sum("md_bytes").alias("total_bytes"),
        )
        .withColumns(size_limits())
    )


def size_limits() -> dict[str, Column]:
    """Size in MB, and whether it is over the limit, from ``total_bytes``."""
    return {
        "total_mb": F.round(F.col("total_bytes") / (1024 * 1024), 2),
        "over_limit": F.col("total_bytes") > C.SIZE_LIMIT_BYTES,
    }


def index_pages(docs: DataFrame) -> DataFrame:
    return docs.groupBy("bundle").agg(
        F.count_if(F.endswith("doc_path", F.lit("index.md"))).alias("n_index")
    )


def report(
    docs: DataFrame, descriptors: DataFrame, requested: DataFrame | None = None, list_largest: bool = True
) -> DataFrame:
    """Size and validity of every bundle that has documents or a descriptor.

    ``requested(bundle)`` adds bundles that should exist. ``descriptors`` needs
    ``bundle, name, description``; a ``descriptor`` text is checked if present.
    A failed check is reported and never removes a bundle. Path and size of the
    documents are worked out once, into a narrow table that both parts read.
    """
    docs = save_and_reload(docs.select("bundle", "doc_path", "md_bytes"), "report-sizes")
    largest = None
    if list_largest:
        largest = (
            largest_docs(docs)
            .groupBy("bundle")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "doc_path", "kb"))).alias("top_files"))
            .select(
                "bundle",
                F.transform("top_files", lambda f: F.struct(f["doc_path"].alias("doc_path"), f["kb"].alias("kb"))).alias(
                    "top_files"
                ),
            )
        )
    return checked(sizes(docs), descriptors, requested, largest)


def checked(
    sized: DataFrame, descriptors: DataFrame, requested: DataFrame | None = None, largest: DataFrame | None = None
) -> DataFrame:
    """The report from ``sizes`` and the lists of largest documents (``bundle, top_files``) of the bundles."""
    known = descriptors.select(
        "bundle",
        "name",
        "description",
        (F.col("descriptor") if "descriptor" in descriptors.columns else F.lit(None).cast("string")).alias(
            "descriptor"
        ),
        F.lit(True).alias("described"),
    )
    rows = sized.join(known, "bundle", "full_outer")
    if requested is not None:
        rows = rows.join(requested.select("bundle").distinct(), "bundle", "full_outer")
    if largest is not None:
        rows = rows.join(largest, "bundle", "left")

    has_docs, described = F.col("n_files").isNotNull(), F.col("described").isNotNull()
    errors = F.array(
        F.when(~has_docs & ~described, "bundle not found"),
        F.when(has_docs & ~described, "descriptor not found"),
        F.when(~has_docs & described, "documents not found"),
    )
    text = F.col("descriptor")
    whole = F.regexp_like(text, F.lit(DESCRIPTOR_BLOCK))
    warnings = F.array(
        F.when(described & F.col("name").isNull(), "descriptor lacks name"),
        F.when(described & F.col("description").isNull(), "descriptor lacks description"),
        F.when(~F.startswith(text, F.lit("---\n")), "descriptor has no frontmatter"),
        F.when(F.startswith(text, F.lit("---\n")) & ~whole, "descriptor frontmatter is incomplete"),
        F.when(has_docs & (F.col("n_md") == 0), "no Markdown documents"),
        F.when(F.col("over_limit"), "size limit exceeded"),
    )
    return (
        rows.withColumn("errors", F.filter(errors, lambda e: e.isNotNull()))
        .withColumn("warnings", F.filter(warnings, lambda w: w.isNotNull()))
        .withColumn("valid", F.size("errors") == 0)
        .withColumn("n_files", F.coalesce("n_files", F.lit(0)))
        .withColumn("n_md", F.coalesce("n_md", F.lit(0)))
        .withColumn("total_bytes", F.coalesce("total_bytes", F.lit(0)))
        .withColumn("total_mb", F.coalesce("total_mb", F.lit(0.0)))
        .withColumn("over_limit", F.coalesce("over_limit", F.lit(False)))
        .drop("name", "description", "descriptor", "described")
    )
