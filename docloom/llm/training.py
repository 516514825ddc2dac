"""Bounded training samples, and logistic regression on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bound on the rows that a classifier is fitted on. Rows are drawn by a hash of
# their id, so the bound holds but for the spread of a binomial draw.
SAMPLE_ROWS = 20_000
_PARTS = 1 << 62


def threshold(bound: int, total: int) -> int:
    """Hashes of 62 bits below it are about ``bound`` of ``total``; of more rows than any table has it is not zero."""
    return min(bound * _PARTS // max(total, 1), _PARTS)


def drawn(rows: DataFrame, id_col: str, bound: int = SAMPLE_ROWS) -> DataFrame:
    """About ``bound`` of the rows, all of them when there are no more."""
    total = rows.count()
    if total <= bound:
        return rows
    place = F.xxhash64(F.col(id_col), F.lit("sample")).bitwiseAND(F.lit(_PARTS - 1))
    return rows.where(place < F.lit(threshold(bound, total)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, bound: int = SAMPLE_ROWS) -> DataFrame:
    """``text, y`` for a bounded sample of labelled rows; equal texts count once.

    ``usable`` is a condition on ``doc_id``. The drawn labels are bounded and
    therefore broadcast, so no text that is not drawn is moved. Ids with both
    labels, and null labels, are left out; null texts are empty.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(
        F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("most")
    ).where("y = most").drop("most")
    picked = drawn(known, "doc_id", bound)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id").drop("doc_id")
    alike = found.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(
        F.first("text").alias("text"), F.min("y").alias("y")
    )
    return alike.select("text", "y")


def logistic(features: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (intercept first) by Newton steps with a ridge on all but the intercept.

    Without rows of both classes the weights are zero but for the intercept.
    """
    n, k = features.shape
    if not n or y.min() == y.max():
        share = (y.sum() + 0.5) / (n + 1) if n else 0.5
        return np.concatenate(([np.log(share / (1 - share))], np.zeros(k)))
    x = np.hstack([np.ones((n, 1)), features])
    penalty = np.full(k + 1, ridge)
    penalty[0] = 1e-6
    w = np.zeros(k + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w
        )
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
