"""Exact duplicates: frequent digests are settled by broadcast, the others by shuffle.

A Misra-Gries sketch (Spark's ``approx_top_k``) finds the digests that may be
frequent. One exact aggregate over these candidates gives their verified
winners, at most ``CANDIDATES`` rows, and copies of them are marked where they
are read. All other digests go through an ordinary shuffle, in which no key is
heavy.

Texts are equal when identical; null counts as empty. Of equal texts the row
with the largest id wins, a null id is below all others, and of repeated rows
with the winning id one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import column, fresh
from docloom.session import save_and_reload

# Size of the sketch, and bound on the winners that are broadcast.
TRACKED = 8192
CANDIDATES = 512


def digest(text):
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def groups(keys: DataFrame) -> DataFrame:
    """``digest, keep_id, group_size, winners`` of rows ``(digest, id)``.

    Two aggregates that combine before their shuffles; ``winners`` counts the
    rows that have the winning id.
    """
    repeated = keys.groupBy("digest", "id").agg(F.count("*").alias("n"))
    return repeated.groupBy("digest").agg(
        F.max(F.struct("id", "n")).alias("top"), F.sum("n").alias("group_size")
    ).select("digest", F.col("top.id").alias("keep_id"), "group_size", F.col("top.n").alias("winners"))


def frequent_groups(keys: DataFrame) -> DataFrame:
    """Exact groups of the digests that the sketch holds for frequent."""
    sketch = keys.agg(F.expr(f"approx_top_k(digest, {CANDIDATES}, {TRACKED})").alias("top"))
    candidates = sketch.select(F.explode("top.item").alias("digest")).where("digest is not null")
    return groups(keys.join(F.broadcast(candidates), "digest", "left_semi"))


def mark(docs: DataFrame, keys: DataFrame, id_col: str, digest_col: str, out: str) -> DataFrame:
    """``docs`` with a struct ``out``: keep_id, group_size, kept.

    ``keys`` holds (digest, id) of all rows of ``docs``, as a written table. A
    digest that occurs once meets nothing in the shuffle, as only groups of two
    or more take part in it.
    """
    heavy = save_and_reload(frequent_groups(keys), "dedup-frequent")
    light = groups(keys.join(F.broadcast(heavy.select("digest")), "digest", "left_anti"))
    light = save_and_reload(light.where("group_size > 1"), "dedup-groups")

    hit, tie, place = fresh(docs, "dedup_hit", "dedup_tie", "dedup_place")
    shape = F.struct("keep_id", "group_size", "winners").alias(hit)
    def joined(rows, found):
        side = found.select(F.col("digest").alias(tie), shape)
        return rows.join(side, column(digest_col) == column(tie), "left").drop(tie)

    settled = joined(docs, heavy.hint("broadcast"))
    frequent = settled.where(column(hit).isNotNull())
    others = joined(settled.where(column(hit).isNull()).drop(hit), light)
    marked = frequent.unionByName(others)

    winner = column(hit).isNull() | column(id_col).eqNullSafe(column(hit)["keep_id"])
    if heavy.where("winners > 1").isEmpty() and light.where("winners > 1").isEmpty():
        both = marked.withColumns({tie: F.lit(False), place: F.lit(True)})
    else:
        # Repeated rows with the winning id: one of them stays, that of the least number in a written table.
        marked = marked.withColumn(tie, winner & (F.coalesce(column(hit)["winners"], F.lit(1)) > 1))
        number, same = fresh(marked, "dedup_number", "dedup_same")
        again = save_and_reload(
            marked.where(column(tie)).withColumn(number, F.monotonically_increasing_id()), "dedup-again"
        )
        first = again.groupBy(column(digest_col).alias(same)).agg(F.min(column(number)).alias(place))
        again = again.join(first, column(digest_col) == column(same)).withColumn(place, column(place) == column(number))
        both = marked.where(~column(tie)).withColumn(place, F.lit(True)).unionByName(again.drop(number, same))
    return both.withColumn(
        out,
        F.struct(
            F.when(column(hit).isNull(), column(id_col)).otherwise(column(hit)["keep_id"]).alias("keep_id"),
            F.coalesce(column(hit)["group_size"], F.lit(1)).cast("long").alias("group_size"),
            (winner & column(place)).alias("kept"),
        ),
    ).drop(hit, tie, place)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    keys = save_and_reload(docs.select(digest(F.col("text")).alias("digest"), F.col("doc_id").alias("id")), "dedup-keys")
    return mark(keys, keys, "id", "digest", "dedup").select(
        F.col("id").alias("doc_id"), "dedup.keep_id", "dedup.group_size", "dedup.kept",
        F.col("digest").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns unchanged."""
    names = docs.columns
    digest_col, out = fresh(docs, "dedup_digest", "dedup_mark")
    with_digest = docs.withColumn(digest_col, digest(F.col("text")))
    keys = save_and_reload(
        with_digest.select(column(digest_col).alias("digest"), F.col("doc_id").alias("id")), "dedup-keys"
    )
    marked = mark(with_digest, keys, "doc_id", digest_col, out)
    return marked.where(column(out)["kept"]).select(*[column(c) for c in names])
