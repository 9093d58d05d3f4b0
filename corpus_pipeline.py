"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import sonde
from sonde.llm import classifier, mix, packing, rules, simhash
from sonde.llm.common import table, written

# the package may not be installed on the workers: ship its helpers by value
cloudpickle.register_pickle_by_value(sonde)

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counted rules and the calibrated model keep."""
    model = rules.trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rules.passed(docs.select(*COLUMNS), model)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; learned from all documents, as few bad ones are left here."""
    weights = classifier.trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return classifier.passed(docs.select(*COLUMNS), weights)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.deduplicated(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mix.repeated(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their place in a sequence."""
    return packing.packed(docs.select(*COLUMNS))


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates),
          ("mix_sources", mix_sources), ("pack", pack)]

#: Trained models, word hashes and a tokeniser have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
