"""Toxic passages as maximal scoring segments of token log-odds.

Fitting counts, over toxic and other training texts, how many contain each word
and each word beginning. The log-odds of these units between the classes are
taken under Dirichlet priors centred on no difference. A token scores the
log-odds of the most significant unit of its own, less a small drift; tokens
without a significant unit score the drift alone. A word that comes again within
``NEAR`` tokens tells less each time, so its score is divided by the number of
its occurrence in that run. A linear scan (Ruzzo and Tompa) finds all maximal
scoring segments of a text. By extreme-value statistics a segment of score ``S`` in a text of ``m``
tokens is expected ``K m exp(-lambda S)`` times by chance; segments expected
less than once are significant, their evidence ``-ln E`` is added up per text,
and a logistic curve fitted on the training texts turns it into a probability.

A null or empty text has no evidence and gets the probability of that case.
Null ids count as fold 0; repeated rows are scored one by one; without labels
all texts get 0.5 and less. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import fold
from docloom.llm.training import SAMPLE_ROWS, labelled_sample, logistic
from docloom.session import save_and_reload, ship_package

TOKEN = re.compile(r"[^\W_]+")
# Lengths of the word beginnings that are units of their own.
BEGINNINGS = range(3, 8)
# Weight of the Dirichlet priors, in texts; and what every token costs.
PRIOR = 1.0
DRIFT = 0.2
# Occurrences of a word with no more tokens than this from one to the next share out its score.
NEAR = 50
# A unit's log-odds count if they differ from zero by so many standard errors.
SIGNIFICANT = 4.0
PREDICTED_FROM = 0.7
# Words whose scores a task remembers.
REMEMBERED = 500_000


def units(word: str) -> list[str]:
    """A word and its beginnings; these end with a mark that no word has."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if n <= len(word))]


@dataclass
class Model:
    scores: dict[str, tuple[float, float]]  # significant units: score, and how significant
    rate: float  # lambda
    chance: float  # K
    intercept: float
    slope: float

    def word_scores(self, tokens: list[str]) -> dict[str, float]:
        """Scores of words, without the drift; remembered within a task."""
        memo = self.__dict__.setdefault("memo", {})
        if len(memo) > REMEMBERED:
            memo.clear()
        for word in set(tokens).difference(memo):
            known = [self.scores[u] for u in units(word) if u in self.scores]
            memo[word] = max(known, key=lambda x: x[1])[0] if known else 0.0
        return memo

    def hits(self, tokens: list[str]) -> list[tuple[int, float]]:
        """Places and scores, without the drift, of all tokens with a significant unit."""
        memo = self.word_scores(tokens)
        found, runs = [], {}
        for i, word in enumerate(tokens):
            if s := memo[word]:
                last, n = runs.get(word, (i, 0))
                n = n + 1 if i - last <= NEAR else 1
                runs[word] = i, n
                found.append((i, s / n))
        return found

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and (first, last, score) of all maximal scoring segments."""
        tokens = TOKEN.findall((text or "").lower())
        return len(tokens), maximal_segments([(i, s - DRIFT) for i, s in self.hits(tokens)])

    def evidence(self, text: str | None) -> float:
        m, found = self.segments(text)
        return self.summed(m, [s for _, _, s in found])

    def summed(self, m: int, scores) -> float:
        """Evidence of the significant ones among segments of a text of ``m`` tokens."""
        return sum(max(0.0, self.rate * s - math.log(self.chance * m)) for s in scores)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-(self.intercept + self.slope * math.log1p(evidence))))


def maximal_segments(hits: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence given by its scored places.

    Every other place scores ``-DRIFT``; such runs are handled as a whole. Each
    candidate holds its cumulative scores before and after, and is joined with
    the last earlier one that starts lower.
    """
    kept: list[list] = []  # first, last, sum before, sum after, earlier candidate
    total, place = 0.0, 0
    for i, score in hits:
        total -= DRIFT * (i - place)
        place = i + 1
        before, total = total, total + score
        if score <= 0:
            continue
        first, last, low, high = i, i, before, total
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append([first, last, low, high, j])
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high, _ in kept]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either class that contain each unit, by batch."""
    for batch in batches:
        bad, good = Counter(), Counter()
        for text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = {u for word in set(TOKEN.findall(text.lower())) for u in units(word)}
            (bad if y else good).update(found)
        names = list(bad.keys() | good.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([bad[u] for u in names], pa.int64()), pa.array([good[u] for u in names], pa.int64())],
            ["unit", "bad", "good"],
        )


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Model:
    """Learn from labelled rows outside of the held-out fold, about ``bound`` of them at most."""
    ship_package(docs.sparkSession)
    sample = save_and_reload(
        labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), 3) != 1, bound), "toxicity-sample"
    )
    n = sample.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    n_bad, n_good = map(float, n)
    if not n_bad or not n_good:
        return Model({}, 1.0, 1.0, -1.0, 0.0)
    counts = sample.select("text", "y").mapInArrow(_count, "unit string, bad long, good long").groupBy("unit").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    # Prior counts share the weight as the classes share the texts.
    bad = F.col("bad") + PRIOR * n_bad / (n_bad + n_good)
    good = F.col("good") + PRIOR * n_good / (n_bad + n_good)
    scored = counts.withColumn("odds", F.log(bad / good) - math.log(n_bad / n_good)).withColumn(
        "z", F.abs("odds") / F.sqrt(1 / bad + 1 / good)
    )
    # At most as many units as the bounded sample has.
    rows = scored.where(F.col("z") > SIGNIFICANT).select("unit", "odds", "z").collect()
    plain = Model({r["unit"]: (r["odds"], r["z"]) for r in rows}, 1.0, 1.0, 0.0, 0.0)

    # Scores of clean tokens give lambda, and segments of clean texts give K.
    clean = sample.where("y = 0").select(F.explode(_token_scores(plain)("text")).alias("t")).select("t.*")
    shares = clean.groupBy("score").agg(F.sum("n").alias("n")).collect()
    tokens = float(sum(r["n"] for r in shares)) or 1.0
    rate = _rate([(r["n"] / tokens, r["score"] - DRIFT) for r in shares])
    found = sample.select("y", _all_segments(plain)("text").alias("s")).select("y", "s.*").toPandas()
    low = 1.0
    seen = sum(sum(s >= low for s in row) for row in found[found.y == 0].scores)
    chance = max(0.5, float(seen)) / (tokens * math.exp(-rate * low))
    fitted = Model(plain.scores, rate, chance, 0.0, 0.0)
    evidence = np.array([fitted.summed(m, row) for m, row in zip(found.tokens, found.scores, strict=True)])
    intercept, slope = logistic(np.log1p(evidence)[:, None], found.y.to_numpy(float), ridge=1e-3)
    return Model(plain.scores, rate, chance, float(intercept), float(max(slope, 0.0)))


def _rate(shares: list[tuple[float, float]]) -> float:
    """Lambda: the positive root of E[exp(lambda s)] = 1 over clean tokens."""
    def excess(rate: float) -> float:
        return sum(p * math.exp(rate * s) for p, s in shares) - 1

    low, high = 1e-3, 1e-3
    while high < 8 and excess(high) < 0:
        low, high = high, high * 2
    if high >= 8:
        return 8.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(low, 1e-2)


def _token_scores(model: Model):
    """A column function: text to its token scores and how many tokens have them."""
    shape = T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n", T.LongType())]))

    @F.pandas_udf(shape)
    def run(texts: pd.Series) -> pd.Series:
        def counted(text):
            tokens = TOKEN.findall((text or "").lower())
            scores = Counter(s for _, s in model.hits(tokens))
            scores[0.0] += len(tokens) - scores.total()
            return [{"score": s, "n": n} for s, n in scores.items()]

        return pd.Series([counted(t) for t in texts])

    return run


def _all_segments(model: Model):
    shape = T.StructType([
        T.StructField("tokens", T.LongType()), T.StructField("scores", T.ArrayType(T.DoubleType()))
    ])

    @F.pandas_udf(shape)
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [model.segments(t) for t in texts]
        return pd.DataFrame({"tokens": [m for m, _ in found], "scores": [[s for _, _, s in x] for _, x in found]})

    return run


def probability(model: Model):
    """A column function: text to its probability of being toxic."""

    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.probability(model.evidence(t)) for t in texts], dtype="float64")

    return run


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage: ``doc_id, first, last, passage, evidence``; places count tokens from 0."""
    shape = T.ArrayType(T.StructType([
        T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
        T.StructField("passage", T.StringType()), T.StructField("evidence", T.DoubleType()),
    ]))

    @F.pandas_udf(shape)
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            m, found = model.segments(text)
            places = [x.span() for x in TOKEN.finditer((text or "").lower())] if found else []
            whole = (text or "").lower()
            rows = []
            for a, b, s in found:
                evidence = model.rate * s - math.log(model.chance * m)
                if evidence > 0:
                    rows.append({"first": a, "last": b, "passage": whole[places[a][0]:places[b][1]], "evidence": evidence})
            out.append(rows)
        return pd.Series(out)

    ship_package(docs.sparkSession)
    return docs.select("doc_id", F.explode(run("text")).alias("p")).select("doc_id", "p.*")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    ship_package(docs.sparkSession)
    score = probability(fit(docs, labels))
    return docs.select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), score("text").alias("score")
    ).withColumn("predicted", (F.col("score") >= PREDICTED_FROM).cast("int"))
