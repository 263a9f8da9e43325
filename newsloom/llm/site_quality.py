"""Quality of documents from their own text and from where they come from.

Hierarchical empirical Bayes. A logistic classifier of document statistics, fitted to labelled
documents, gives each document's evidence: the log likelihood ratio of good against bad. Hosts and
the paths under them have rates of good documents with Beta priors: a path's prior is its host's
posterior, a host's prior is the global rate. The strength of either prior is estimated from the
spread of the rates themselves (method of moments), so that sparse sites shrink toward what is
above them. A document's posterior odds are its evidence times the odds of its path, with the
document's own share taken out of its path and host.

Only sums per path and host are grouped, map-side first; the rates are joined back to thin rows, as
a broadcast where their table was measured to be small, else with hot sites split.

Defined cases: a null or empty text has the statistics of no words; null hosts or paths count as
''; a null id is carried through; repeated rows count each; without labels of both classes the
evidence is 0 and all documents have the prior, 0.5; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrays import pieces
from newsloom.llm.quality_rules import FEATURES, TRAIN_ROWS, statistics, training_table
from newsloom.llm.tables import stored
from newsloom.operators.lookup import join_lookup

THRESHOLD = 0.5
# Bounds of a prior's strength, in documents.
WEAKEST, STRONGEST = 2.0, 1000.0


class Logistic:
    """Ridge logistic regression on standardised features and their squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.usable = len(set(y.tolist())) == 2
        if not self.usable:
            self.share = 0.5
            return
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-9
        z = self._inputs(x)
        self.share = float(y.mean())
        self.weights = np.zeros(z.shape[1])
        penalty = np.eye(z.shape[1]) * ridge
        penalty[0, 0] = 1e-6
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            gradient = z.T @ (y - p) - penalty @ self.weights
            hessian = (z * (p * (1 - p))[:, None]).T @ z + penalty
            step = np.linalg.solve(hessian, gradient)
            self.weights += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-6:
                break

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.concatenate([np.ones((len(x), 1)), z, z**2], axis=1)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratio, held to +-12."""
        if not self.usable:
            return np.zeros(len(x))
        prior = np.log(self.share / (1 - self.share))
        return np.clip(self._inputs(x) @ self.weights - prior, -12, 12)


def fit_classifier(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Logistic:
    return Logistic(*training_table(documents, labels, rows=rows))


def evidence(documents: DataFrame, model: Logistic, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, evidence, p): p is the probability under the labels' share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior = np.log(model.share / (1 - model.share))
        for batch in batches:
            for piece in pieces(batch.column("text")):
                found = model.evidence(statistics(piece)["x"])
                part = batch.slice(piece.first, len(piece)).select(["doc_id", "host", "path"])
                p = 1 / (1 + np.exp(-(found + prior)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found), pa.array(p)],
                    ["doc_id", "host", "path", "evidence", "p"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(
        "doc_id",
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        "text",
    )
    assert len(FEATURES) > 0
    return rows.mapInArrow(
        run, f"doc_id {kind}, host string, path string, evidence double, p double"
    )


def strength(groups: DataFrame, prior: Column) -> float:
    """Documents that a prior is worth, from groups (n, good) with their prior rates."""
    rate = F.col("good") / F.col("n")
    sampling = prior * (1 - prior) / F.col("n")
    row = groups.agg(
        F.sum(F.col("n") * prior * (1 - prior)).alias("whole"),
        F.sum(F.col("n") * (F.pow(rate - prior, 2) - sampling)).alias("between"),
    ).first()
    if not row["whole"] or row["between"] is None or row["between"] <= 0:
        return STRONGEST
    return float(min(max(row["whole"] / row["between"] - 1, WEAKEST), STRONGEST))


def posterior(scored: DataFrame) -> DataFrame:
    """(doc_id, host, path, evidence, host_rate, path_rate, score, kept) per document."""
    paths = stored(
        scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")),
        "paths",
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = total["good"] / total["n"] if total["n"] else 0.5
    overall = min(max(overall, 1e-3), 1 - 1e-3)
    host_strength = strength(hosts, F.lit(overall))
    host_rates = hosts.select(
        "host", F.col("n").alias("host_n"), F.col("good").alias("host_good"),
        ((F.col("good") + host_strength * overall) / (F.col("n") + host_strength)).alias("rate"),
    )
    sites = stored(paths.join(host_rates, "host"), "sites")
    path_strength = strength(sites, F.col("rate"))
    p = F.col("p")
    # Without the document itself.
    host_rate = (F.col("host_good") - p + host_strength * overall) / (
        F.col("host_n") - 1 + host_strength
    )
    path_rate = (F.col("good") - p + path_strength * F.col("host_rate")) / (
        F.col("n") - 1 + path_strength
    )
    bounded = F.least(F.greatest(F.col("path_rate"), F.lit(1e-3)), F.lit(1 - 1e-3))
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.log(bounded / (1 - bounded)))))
    return (
        join_lookup(scored, sites, ["host", "path"], "inner", ["doc_id", "evidence"])
        .withColumn("host_rate", host_rate)
        .withColumn("path_rate", path_rate)
        .withColumn("score", score)
        .select(
            "doc_id", "host", "path", "evidence", "host_rate", "path_rate", "score",
            (F.col("score") >= THRESHOLD).alias("kept"),
        )
    )


def classify(documents: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    model = fit_classifier(documents, labels)
    return posterior(stored(evidence(documents, model, host, path), "evidence"))
