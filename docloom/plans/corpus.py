"""Build or refresh a searchable corpus from crawled pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from docloom.operators import bundles, collisions, extraction
from docloom.session import save_and_reload
from docloom.sources.collection import Collection, Descriptors, export_bundles, export_descriptors


def convert(pages: DataFrame, fetched_at: datetime) -> tuple[DataFrame, DataFrame]:
    """Documents and rejects of a table of pages.

    Pages are parsed once into a written table. Documents, contested paths and
    rejects are read from it.
    """
    docs, rejected = extraction.extract(pages, fetched_at)
    contested = save_and_reload(collisions.contested_paths(docs), "contested")
    return (
        collisions.keep_winners(docs, contested),
        rejected.unionByName(collisions.collision_rejects(docs, contested)),
    )


def build(
    pages: DataFrame,
    collection: Collection,
    fetched_at: datetime,
    export_path: str | None = None,
    replace_bundles: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Convert pages, merge them into the collection, and report on the bundles.

    A bundle's descriptor is stored when the bundle is new and kept from then on;
    the report checks the stored ones. Only bundles with new documents are
    exported. Returns the report and the rejects. A bundle that fails validation is
    exported all the same.
    """
    docs, rejected = convert(pages, fetched_at)
    collection.upsert(docs, replace_bundles)
    current = collection.read()
    described = Descriptors(collection.spark, f"{collection.root}/descriptors")
    described.add_missing(bundles.descriptor_text(bundles.manifest(current)))
    if export_path is not None:
        touched = docs.select("bundle").distinct()
        export_bundles(current.join(touched, "bundle", "left_semi"), export_path)
        export_descriptors(described.read(), f"{export_path}-descriptors")
    return bundles.report(current, described.read()), rejected
