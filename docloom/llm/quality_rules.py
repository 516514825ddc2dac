"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a condition under which a text is rejected. On a sample every rule
is timed and its rejections are counted; rules then run in the order of
rejections per unit of cost, and a text that one rule rejects is not given to
later ones. The order changes the cost and never the verdict.

A null text has no words. Null ids are kept as they are; repeated rows are
judged one by one; an empty table gives an empty result, with the rules in
their written order.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import let
from docloom.llm.common import SEPARATORS, WORD, words
from docloom.session import save_and_reload

WINDOW = 8
# The sample on which costs and rejections are estimated: a share of the rows,
# drawn by a hash of the text, and so many rows at most.
SAMPLE_SHARE = 0.02
SAMPLE_ROWS = 2000

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30


def repeated_words(tokens: Column) -> Column:
    """Words that lie in 8-word windows which occur twice or more.

    Windows are compared by 64-bit hashes of their word hashes. Texts without a
    repeated window, the usual case, end after one pass.
    """
    def windows(hashes: Column) -> Column:
        return F.when(
            F.size(hashes) >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)),
                lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)),
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    def places(found: Column) -> Column:
        """Starts of repeated windows, in order."""
        def neighbours(ordered: Column) -> Column:
            last = F.size(ordered) - 1
            same = lambda a, b: F.get(ordered, a)["h"] == F.get(ordered, b)["h"]
            picked = F.filter(
                ordered,
                lambda x, k: ((k > 0) & same(k, k - 1)) | ((k < last) & same(k, k + 1)),
            )
            return F.sort_array(F.transform(picked, lambda x: x["p"]))

        numbered = F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return let(F.sort_array(numbered), neighbours)

    def covered(starts: Column) -> Column:
        done = F.aggregate(
            starts,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, p: F.struct(
                p.alias("last"),
                (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).cast("long").alias("n"),
            ),
        )
        return done["n"]

    return let(
        let(F.transform(tokens, lambda w: F.xxhash64(w)), windows),
        lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long"))
        .otherwise(covered(places(found))),
    )


def measured(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys``, the text, and the counts that the base rules use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("body", "\n"), lambda line: F.length(F.translate(line, SEPARATORS, "")) > 0)
    base = docs.select(*keys, text.alias("body")).withColumn("tokens", words(F.col("body")))
    return base.select(
        *keys,
        "body",
        F.size("tokens").cast("long").alias("n_words"),
        F.length(F.array_join("tokens", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("tokens")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )


def _count(pattern: str) -> Column:
    return F.regexp_count("body", F.lit(pattern))


# Name, and the condition under which a text is rejected. Thresholds are far
# from what ordinary prose shows in any of the languages.
RULES: list[tuple[str, Callable[[], Column]]] = [
    ("symbols", lambda: 4 * F.col("n_symbols") > F.col("n_words")),
    ("long_words", lambda: F.col("word_chars") > 20 * F.col("n_words")),
    ("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    ("few_letters", lambda: 10 * _count(r"\p{L}") < 6 * F.col("word_chars")),
    ("capitals", lambda: 2 * _count(r"\p{Lu}") > _count(r"\p{L}")),
    ("digits", lambda: 5 * _count(r"[0-9]") > F.col("word_chars")),
    ("exclaims", lambda: 4 * _count(r"!") > F.col("n_words")),
    ("dup_lines", lambda: 10 * F.col("n_dup_lines") > 5 * (1 + _count(r"\n"))),
]


def ordered_rules(rows: DataFrame, rules=None) -> list[tuple[str, Callable[[], Column]]]:
    """Rules by estimated rejections per second, on at most ``SAMPLE_ROWS`` measured rows.

    Costs are the shorter of two timed passes of each rule alone.
    """
    rules = RULES if rules is None else rules
    sample = save_and_reload(rows.limit(SAMPLE_ROWS), "rules-sample")
    total, *rejected = sample.agg(
        F.count("*"), *[F.count_if(rule()).alias(name) for name, rule in rules]
    ).first()
    if not total:
        return list(rules)

    def seconds(rule) -> float:
        took = []
        for _ in range(2):
            start = time.perf_counter()
            sample.agg(F.count_if(rule())).first()
            took.append(time.perf_counter() - start)
        return min(took)

    empty = seconds(lambda: F.lit(False))
    rate = {
        name: n / max(seconds(rule) - empty, 1e-4)
        for (name, rule), n in zip(rules, rejected, strict=True)
    }
    return sorted(rules, key=lambda r: -rate[r[0]])


def rejected_by(order) -> Column:
    """Name of the first rule that rejects the row, null if none; later rules are not evaluated."""
    verdict = F.when(F.col("base_failed"), "base")
    for name, rule in order:
        verdict = verdict.when(rule(), name)
    return verdict.otherwise(F.lit(None).cast("string"))


def judge(docs: DataFrame, rules=None) -> DataFrame:
    """Counts, ``base_failed``, ``rule`` (the rejecting rule) and ``kept`` per document."""
    drawn = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(SAMPLE_SHARE * 1_000_000))
    order = ordered_rules(measured(drawn, "doc_id"), rules)
    rows = measured(docs, "doc_id").withColumn("base_failed", base_failed())
    judged = rows.withColumn("rule", rejected_by(order))
    return judged.withColumn("kept", F.col("rule").isNull()).drop("body")


def report(docs: DataFrame) -> DataFrame:
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
