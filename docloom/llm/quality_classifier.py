"""Document quality with hierarchical empirical Bayes over hosts and paths.

A logistic classifier over counts of the text gives each document's evidence.
Hosts get a posterior mean of their documents' probabilities, shrunk toward the
global mean; paths get theirs, shrunk toward their host. The weights of the
priors come from the data: by the method of moments, from how far the means of
groups scatter beyond what their sizes explain. So a site with few documents
stays near the global prior. A document's final log-odds are its own, plus how
far its path's posterior stands from the prior the classifier has seen.

All statistics are grouped aggregates over all documents, which combine before
they are shuffled, so a host with a third of all rows is no hot spot. Null host
or path form groups of their own, null texts count as empty, repeated rows as
often as they occur. Without labels every document gets the same evidence. An
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import column, fold, fresh, words
from docloom.llm.training import SAMPLE_ROWS, labelled_sample, logistic
from docloom.session import save_and_reload

# Weight of a site's posterior in a document's log-odds, and the score from which a document is kept.
SITE_WEIGHT = 0.5
KEPT_FROM = 0.3
# A group's prior weighs at least and at most so many documents.
LEAST_WEIGHT, MOST_WEIGHT = 5.0, 10_000.0


def features(text: Column) -> Column:
    """Shares that tell prose from junk, as an array."""
    body = F.coalesce(text, F.lit(""))
    # Characters of a class, by what is left without them: no array of matches is built.
    count = lambda kind: (F.length(body) - F.length(F.regexp_replace(body, f"{kind}+", ""))).cast("double")
    per = lambda a, b: a / (b + 1.0)
    chars, letters = F.length(body).cast("double"), count(r"\p{L}")
    tokens = words(text)
    n_words = F.size(tokens).cast("double")
    return F.array(
        F.log1p(n_words),
        per(letters, chars),
        per(count(r"\p{Lu}"), letters),
        F.least(per(count(r"[#$%&*<>]"), n_words), F.lit(3.0)),
        F.least(per(count("[|]"), n_words), F.lit(1.0)),
        F.least(per(count("[!]"), n_words), F.lit(3.0)),
        per(count(r"[0-9]"), chars),
        F.least(per(chars - letters, n_words), F.lit(10.0)),
        per(F.size(F.array_distinct(tokens)).cast("double"), n_words),
        F.least(per(count(r"[.?]"), n_words), F.lit(1.0)),
    )


@dataclass(frozen=True)
class Classifier:
    weights: list[float]  # intercept first, for standardised features
    centre: list[float]
    scale: list[float]

    def log_odds(self, feats: Column) -> Column:
        total = F.lit(self.weights[0])
        for i, (w, c, s) in enumerate(zip(self.weights[1:], self.centre, self.scale, strict=True)):
            total = total + (feats[i] - c) / s * w
        return F.greatest(F.lit(-8.0), F.least(F.lit(8.0), total))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Classifier:
    """Learn from at most about ``bound`` labelled rows; a fifth of the ids stays held out."""
    sample = labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), 5) != 1, bound)
    rows = sample.select("y", features(F.col("text")).alias("f")).toPandas()
    if not len(rows):
        return Classifier([0.0] * 11, [0.0] * 10, [1.0] * 10)
    x, y = np.stack(rows.f.to_numpy()).astype(float), rows.y.to_numpy(float)
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    weights = logistic((x - centre) / scale, y)
    return Classifier(weights.tolist(), centre.tolist(), scale.tolist())


def logit(p: Column) -> Column:
    held = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(held / (1 - held))


def prior_weight(groups: DataFrame, mean: str) -> float:
    """Number of documents that a prior counts as: variance within groups over variance between them.

    ``groups`` has n, s, q (count, sum and sum of squares of probabilities) and
    the prior ``mean`` of each group.
    """
    row = groups.agg(
        F.sum("n").alias("n"), F.count("*").alias("k"),
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(mean), 2)).alias("between"),
    ).first()
    if not row["n"] or row["n"] <= row["k"] or row["k"] < 2:
        return MOST_WEIGHT
    within = row["within"] / (row["n"] - row["k"])
    extra = (row["between"] - row["k"] * within) / row["n"]
    return MOST_WEIGHT if extra <= 0 else float(np.clip(within / extra, LEAST_WEIGHT, MOST_WEIGHT))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """``host, path, prior, host_posterior, path_posterior`` from rows (host, path, p).

    One pass over the rows; hosts and the global prior are sums over paths.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "s", "q")]
    paths = evidence.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")
    )
    hosts = paths.groupBy("host").agg(*sums)
    whole = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    prior = whole["s"] / whole["n"] if whole["n"] else 0.5
    weight = prior_weight(hosts.withColumn("mean", F.lit(prior)), "mean")
    hosts = hosts.select(
        "host", ((F.col("s") + weight * prior) / (F.col("n") + weight)).alias("host_posterior")
    )
    same = F.col("host").eqNullSafe(F.col("host_"))
    placed = paths.join(hosts.withColumnRenamed("host", "host_"), same).drop("host_")
    below = prior_weight(placed, "host_posterior")
    return placed.select(
        "host", "path", F.lit(prior).alias("prior"), "host_posterior",
        ((F.col("s") + below * F.col("host_posterior")) / (F.col("n") + below)).alias("path_posterior"),
    )


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, out: str) -> DataFrame:
    """``docs`` with a struct ``out``: p_document, host_posterior, path_posterior, score, kept."""
    model = fit(docs, labels)
    own, site = fresh(docs, "quality_log_odds", "quality_site")
    log_odds = model.log_odds(features(F.col("text")))
    sigmoid = lambda z: 1 / (1 + F.exp(-z))
    evidence = save_and_reload(
        docs.select(host.alias("host"), path.alias("path"), sigmoid(log_odds).alias("p")), "quality-evidence"
    )
    sites = site_posteriors(evidence)
    named = docs.withColumn(own, log_odds).withColumn(site, F.struct(host.alias("host"), path.alias("path")))
    side = sites.select(
        F.col("host").alias(f"{site}_host"), F.col("path").alias(f"{site}_path"),
        F.struct("prior", "host_posterior", "path_posterior").alias(f"{site}_p"),
    )
    met = column(site)["host"].eqNullSafe(column(f"{site}_host")) & column(site)["path"].eqNullSafe(column(f"{site}_path"))
    joined = named.join(side, met, "left")
    p = column(f"{site}_p")
    score = sigmoid(column(own) + SITE_WEIGHT * (logit(p["path_posterior"]) - logit(p["prior"])))
    return joined.withColumn(out, F.struct(
        sigmoid(column(own)).alias("p_document"), p["host_posterior"].alias("host_posterior"),
        p["path_posterior"].alias("path_posterior"), score.alias("score"), (score >= KEPT_FROM).alias("kept"),
    )).drop(own, site, f"{site}_host", f"{site}_path", f"{site}_p")


def document_site() -> tuple[Column, Column]:
    """Host and path of a row of ``documents``: its source, and the language's folder there."""
    return F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: its evidence, the posteriors of its site, the final score, and ``kept``."""
    return classify(docs.select("doc_id", "text", "lang", "source"), labels, *document_site(), "quality").select(
        "doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "quality.*"
    )
