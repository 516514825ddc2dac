"""URL filters whose lists change over time, in DataFrame expressions only.

A list is a table of dated events ``(key, listed, at)``: from ``at`` on the key
is listed or no longer listed. A key is a host (``example.org``, which covers
its subdomains) or a host with a path prefix that ends with a slash
(``example.org/ads/``). Events become validity intervals, and every capture is
joined as of its fetch time with the intervals of its own host, parent domains
and path prefixes.

Captures that share their keys and their fetch time share one row in the join,
and the join itself is an equi-join on the key whose large partitions Spark
splits. A capture with a null or hostless URL, or without fetch time, matches
nothing and stays. Of several events of a key at one time, delisting wins.
Events with a null key or time have no effect. Empty tables are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import let
from docloom.functions.urls import AUTHORITY, PATH
from docloom.llm.common import column, fresh
from docloom.session import save_and_reload


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty when there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), AUTHORITY, 1)
    return F.rtrim(F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")), F.lit("."))


def keys_of(url: Column) -> Column:
    """Hosts and path prefixes under which a URL may be listed."""
    def suffixes(host: Column) -> Column:
        labels = F.split(host, r"\.")
        return F.when(host == "", F.array().cast("array<string>")).otherwise(
            let(labels, lambda parts: F.transform(
                F.sequence(F.lit(1), F.size(parts)),
                lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
            ))
        )

    def prefixes(path: Column) -> Column:
        folders = F.slice(F.split(path, "/", -1), 1, F.size(F.split(path, "/", -1)) - 1)
        return let(folders, lambda parts: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))),
            lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")),
        ))

    path = F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)
    rooted = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    return let(suffixes(host_of(url)), lambda hosts: let(prefixes(rooted), lambda folders: F.array_union(
        hosts,
        F.flatten(F.transform(hosts, lambda h: F.transform(folders, lambda f: F.concat(h, f)))),
    )))


def intervals(events: DataFrame) -> DataFrame:
    """``key, since, until`` of the listed spells; ``until`` is null while a spell lasts."""
    daily = (
        events.where("key is not null and at is not null")
        .groupBy("key", "at").agg(F.bool_and(F.coalesce("listed", F.lit(False))).alias("listed"))
    )
    in_key = Window.partitionBy("key").orderBy("at")
    turns = daily.withColumn("before", F.coalesce(F.lag("listed").over(in_key), F.lit(False)))
    turns = turns.where(F.col("listed") != F.col("before"))
    return (
        turns.withColumn("until", F.lead("at").over(in_key))
        .where("listed").select("key", F.col("at").alias("since"), "until")
    )


def matches(captures: DataFrame, spells: DataFrame) -> DataFrame:
    """``keys, at, matched_key, since``: the longest active key for each distinct case of captures.

    ``captures`` holds (keys, at). Equal cases are folded before keys fan out.
    """
    cases = captures.where("at is not null and size(keys) > 0").select("keys", "at").distinct()
    fanned = cases.select("keys", "at", F.explode("keys").alias("key"))
    active = fanned.join(spells, "key").where(
        (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    )
    best = F.max(F.struct(F.length("key").alias("n"), F.col("key"), F.col("since"))).alias("best")
    return active.groupBy("keys", "at").agg(best).select(
        "keys", "at", F.col("best.key").alias("matched_key"), F.col("best.since").alias("since")
    )


def filter_captures(captures: DataFrame, events: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with ``blocked``, ``matched_key`` and ``listed_since``.

    New columns take other names (a leading underscore) where ``captures`` has
    these already.
    """
    spells = save_and_reload(intervals(events), "url-list")
    keys_col, time_col = fresh(captures, "capture_keys", "capture_time")
    blocked, matched, since = fresh(captures, "blocked", "matched_key", "listed_since")
    keyed = captures.withColumn(keys_col, keys_of(column(url)))
    found = matches(keyed.select(column(keys_col).alias("keys"), column(at).alias("at")), spells).select(
        F.col("keys").alias(f"{keys_col}_"), F.col("at").alias(time_col),
        F.col("matched_key").alias(matched), F.col("since").alias(since),
    )
    same = (column(keys_col) == column(f"{keys_col}_")) & (column(at) == column(time_col))
    return (
        keyed.join(found, same, "left")
        .withColumn(blocked, column(matched).isNotNull())
        .drop(keys_col, f"{keys_col}_", time_col)
    )
