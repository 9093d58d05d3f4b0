"""Quality rules: counted limits, then a calibrated n-gram model against a fixed threshold.

The counted rules reject a text of fewer than ten words or one of whose words more
than a fifth lie in five-word windows that the text repeats. The others are scored by
a logistic regression over hashed word uni- and bigrams and character trigrams,
fitted on a bounded sample of labelled rows; Platt scaling on a part of that sample
that the fit does not see turns scores into probabilities.

Null or empty text has no words and fails; without labels of both kinds the model
rejects nothing; equal texts get equal verdicts; an empty table gives an empty
result; other columns are ignored, texts are read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import WORD, keep_texts, map_texts, table
from sonde.llm.grams import Grams, sigmoid
from sonde.llm.labelled import sample

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
#: Labelled rows fitted at most, and the share (one in) of them kept for calibration.
MOST_ROWS, CALIBRATION = 2000, 4
BITS, CHARS, EPOCHS, RATE, DECAY = 18, 3, 12, 0.5, 1e-4
#: Least calibrated probability of good quality.
THRESHOLD = 0.5


def measures(text: str | None, words: re.Pattern) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or ""
    found = words.findall(text)
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if line in seen:
            duplicates += 1
        elif words.search(line):
            seen.add(line)
    repeated = 0
    windows = list(zip(*(found[i:] for i in range(WINDOW))))
    if len(set(windows)) < len(windows):
        first, marked = {}, np.zeros(len(found), dtype=bool)
        for at, window in enumerate(windows):
            if (before := first.setdefault(window, at)) != at:
                marked[before:before + WINDOW] = True
                marked[at:at + WINDOW] = True
        repeated = int(marked.sum())
    return len(found), sum(map(len, found)), sum(map(text.count, SYMBOLS)), duplicates, repeated


class Model:
    """Weights over hashed n-grams with the calibration of their score."""

    def __init__(self, weights: np.ndarray, slope: float, shift: float):
        self.weights, self.slope, self.shift = weights, slope, shift

    def probability(self, grams: Grams, text: str | None) -> float:
        return float(sigmoid(self.slope * grams.dot(text, self.weights) + self.shift))


def platt(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (score, label), with smoothed targets, by Newton's method."""
    up, down = labels.sum(), (1 - labels).sum()
    goal = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([scores, np.ones_like(scores)], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ theta)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - goal) + 1e-6 * (theta - [1, 0]))
        theta = theta - np.clip(step, -2, 2)
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(rows: list[tuple], bits: int = BITS) -> Model | None:
    """Adaptive-rate logistic regression on most of ``rows``, calibrated on the others."""
    labels = np.array([r[0] for r in rows], dtype=np.float64)
    if len(set(labels)) < 2:
        return None
    weights, squares, rng = np.zeros(1 << bits), np.full(1 << bits, 1e-6), np.random.default_rng(7)
    train = [i for i in range(len(rows)) if i % CALIBRATION]
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            label, slots, values = rows[i]
            step = (sigmoid(weights[slots] @ values) - label) * values + DECAY * weights[slots]
            squares[slots] += step * step
            weights[slots] -= RATE * step / np.sqrt(squares[slots])
    held = range(0, len(rows), CALIBRATION)
    scores = np.array([weights[rows[i][1]] @ rows[i][2] for i in held])
    return Model(weights.astype(np.float32), *platt(scores, labels[list(held)]))


def trained(docs: DataFrame, labels: DataFrame, use: Column | None = None) -> Model | None:
    """The model learned from the labelled rows for which ``use`` holds (all)."""
    return fit(sample(docs, labels, F.lit(True) if use is None else use, MOST_ROWS, BITS, CHARS))


def judge(docs: DataFrame, model: Model | None, threshold: float):
    """What a task builds to judge texts: texts -> the counted measures, base_failed, kept, probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.weights, model.slope, model.shift))

    def build():
        words, grams = re.compile(WORD), Grams(BITS, CHARS)
        known = shared.value and Model(*shared.value)

        def run(texts):
            n = np.array([measures(t, words) for t in texts], dtype=np.int64).reshape(-1, 5)
            failed = (n[:, 0] < LEAST_WORDS) | (100 * n[:, 4] > MOST_REPEATED * n[:, 0])
            p = [None if bad else 1.0 if known is None else known.probability(grams, t) for t, bad in zip(texts, failed)]
            kept = np.array([x is not None and x >= threshold for x in p], dtype=bool)
            return [*n.T.copy(), failed, kept, pa.array(p, pa.float64())]
        return run
    return build


def judged(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counted measures, base_failed, kept and probability (null where the base failed) per row."""
    build = judge(docs, model, threshold)

    def columns():
        run = build()
        return lambda texts: (run(texts), None)
    return map_texts(docs, columns, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                                    "base_failed boolean, kept boolean, probability double")


def passed(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    build = judge(docs, model, threshold)

    def verdicts():
        run = build()
        return lambda texts: run(texts)[6]
    return keep_texts(docs, verdicts)


def op3_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return judged(docs, trained(docs, table(spark, sf_dir, "labels")))


QUERIES, CHECKS = {"op3_quality_rules": op3_quality_rules}, {}
