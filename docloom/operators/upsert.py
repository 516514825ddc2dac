"""Merge new documents into a collection: same path is overwritten, others stay."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docloom.operators.collisions import KEY, keep_winners


def upsert(old: DataFrame, new: DataFrame, replace_bundles: bool = False) -> DataFrame:
    """Old documents whose path is not in ``new``, and all of ``new``.

    With ``replace_bundles`` stale documents of the bundles in ``new`` go too.
    Only keys of the new side take part in the join. Read from a written table
    they are broadcast when few, and the old documents are then not shuffled.
    """
    key = ["bundle"] if replace_bundles else KEY
    kept = old.join(new.select(*key).distinct(), key, "left_anti")
    return kept.select(*new.columns).unionByName(new)


def newest(versions: DataFrame) -> DataFrame:
    """Current documents of an append-only collection: the latest batch wins a path.

    Within a batch the greatest page id does, and of rows with one id the later
    and then the greater one.
    """
    return keep_winners(versions, first=("batch",))


def insert_missing(existing: DataFrame, candidates: DataFrame, key: str = "bundle") -> DataFrame:
    """Existing rows, and candidates whose key is not there yet."""
    fresh = candidates.join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))
