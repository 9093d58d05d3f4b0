"""A bounded sample of labelled documents as hashed n-gram vectors on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import map_texts
from sonde.llm.grams import Grams

#: Slots of one training vector at most: those of the largest values.
MOST_SLOTS = 8192


def heaviest(slots: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest values, lower slots first among equals, in the order of their slots."""
    keep = np.sort(np.argsort(-values, kind="stable")[:most])
    return slots[keep], values[keep]


def sample(docs: DataFrame, labels: DataFrame, only: Column, most: int, bits: int, chars: int = 0) -> list[tuple]:
    """(label, slots, values) of at most ``most`` labelled documents, chosen by a hash of doc_id.

    ``labels`` has doc_id and quality; rows without either are passed over, a
    doc_id labelled or stored twice counts once (lowest label, lowest text). The
    sample does not grow with the tables, nor does what reaches the driver:
    of a vector the ``MOST_SLOTS`` largest values are learned from.
    """
    chosen = (labels.filter(only).filter("doc_id IS NOT NULL AND quality IS NOT NULL")
              .select("doc_id", "quality", F.xxhash64("doc_id").alias("draw")).orderBy("draw", "doc_id", "quality").limit(most)
              .groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")))
    texts = (docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
             .groupBy("doc_id").agg(F.min("text").alias("text")))

    slots = MOST_SLOTS

    def build():
        grams = Grams(bits, chars)

        def run(batch):
            found = [heaviest(*grams.vector(t), slots) for t in batch]
            return [[s.tobytes() for s, _ in found], [v.tobytes() for _, v in found]], None
        return run
    rows = map_texts(texts, build, "slots binary, values binary").join(F.broadcast(chosen), "doc_id").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [(r["label"], np.frombuffer(r["slots"], np.int32), np.frombuffer(r["values"], np.float32)) for r in rows]
