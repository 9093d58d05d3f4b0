"""Quality classifier: logistic regression over hashed word n-grams, learned by FTRL-proximal.

Labels come from a bounded sample of the rows of ``labels`` outside the held-out
fold; an update touches only the slots of one document, and weights that the L1
term holds at zero are never stored. Whole texts are scored as sparse dot products
in Arrow batches. Only the text enters a score.

Null or empty text scores by the bias alone; without labels of both kinds every
score is 0.5; equal texts get equal scores; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import crc_of, keep_texts, map_texts, table
from sonde.llm.grams import Grams, sigmoid
from sonde.llm.labelled import sample

#: Labelled rows learned from at most.
MOST_ROWS = 4000
BITS, EPOCHS = 18, 6
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3


class Ftrl:
    """Follow-the-regularised-leader: the weights follow from the sums z and n."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, slots) -> np.ndarray:
        z = self.z[slots]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[slots])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def update(self, slots: np.ndarray, values: np.ndarray, label: float) -> None:
        w = self.weights(slots)
        g = (sigmoid(w @ values) - label) * values
        rate = (np.sqrt(self.n[slots] + g * g) - np.sqrt(self.n[slots])) / self.alpha
        self.z[slots] += g - rate * w
        self.n[slots] += g * g


def learned(rows: list[tuple], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray | None:
    """Weights of all slots and, last, the bias."""
    if len({r[0] for r in rows}) < 2:
        return None
    model, rng = Ftrl(1 << bits), np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, slots, values = rows[i]
            model.update(np.append(slots, 1 << bits), np.append(values, 1.0), label)
    return model.weights(slice(None)).astype(np.float32)


def trained(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    return learned(sample(docs, labels, crc_of("doc_id") % FOLDS != HELD_OUT, MOST_ROWS, BITS))


def score(docs: DataFrame, weights: np.ndarray | None):
    """What a task builds to score texts: texts -> scores."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def build():
        grams, known = Grams(BITS), shared.value

        def run(texts):
            raw = [0.0 if known is None else known[-1] + grams.dot(t, known) for t in texts]
            return sigmoid(np.array(raw, dtype=np.float64))
        return run
    return build


def scored(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs`` (doc_id, text)."""
    build = score(docs, weights)

    def columns():
        run = build()
        return lambda texts: ([run(texts)], None)
    return map_texts(docs, columns, "score double").select(
        "doc_id", (crc_of("doc_id") % FOLDS == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def passed(docs: DataFrame, weights: np.ndarray | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    build = score(docs, weights)

    def verdicts():
        run = build()
        return lambda texts: run(texts) >= threshold
    return keep_texts(docs, verdicts)


def op4_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, table(spark, sf_dir, "labels")))


QUERIES, CHECKS = {"op4_quality_classifier": op4_quality_classifier}, {}
