"""Helpers the operators share: tables, stage tables in the shared folder, word patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.plans.stages import shared_folder, written  # noqa: F401  (re-exported: the folder all executors share)

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fewest rows that make a key hot: one in so many of all rows. So there are at most as many hot keys.
HOT = 10_000


def meet(rows: DataFrame, totals: DataFrame, key: str, n: str, size: int) -> DataFrame:
    """Inner join of ``rows`` (``size`` rows, read twice) with ``totals``, which has one row per key and its rows in ``n``.

    A key of more than one in ``HOT`` rows, of which there are at most ``HOT``, meets its
    rows where they are; the others are too small to weigh on the task they share.
    """
    named = totals.withColumnRenamed(key, "_key").withColumn("_hot", F.col(n) * HOT > size).drop(n)
    hot = F.broadcast(named.filter("_hot"))
    marked = rows.join(hot, F.col(key).eqNullSafe(F.col("_key")), "left")
    others = marked.filter("_hot IS NULL").select(rows.columns).join(named.filter("NOT _hot"), F.col(key).eqNullSafe(F.col("_key")))
    return marked.filter("_hot").unionByName(others).drop("_key", "_hot")


def crc_of_text(text: Column) -> Column:
    """crc32 of a text's UTF-8."""
    return F.crc32(text.cast("binary"))


def crc_of(column: str) -> Column:
    """crc32 of a number written as text (null: of the empty text)."""
    return crc_of_text(F.coalesce(F.col(column).cast("string"), F.lit("")))


def count_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def map_texts(docs: DataFrame, build, schema: str, rows: int = 500) -> DataFrame:
    """Apply a Python function to whole texts in Arrow batches; doc_id passes through untouched.

    ``build()`` runs once per partition and returns a function from a list of texts
    (None for null) to ``(columns, row)``: arrays in the order of ``schema`` and,
    unless there is one output row per text, the text each output row belongs to.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        apply = None
        for batch in batches:
            apply = apply or build()
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                columns, row = apply(part.column(1).to_pylist())
                ids = part.column(0) if row is None else part.column(0).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c) for c in columns]], names=names)

    names = ["doc_id"] + [c.strip().split(" ")[0] for c in schema.split(",")]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {schema}")


def keep_texts(docs: DataFrame, build) -> DataFrame:
    """The rows of ``docs``, all columns, whose text a Python function keeps.

    ``build()`` runs once per partition and returns a function from a list of texts
    to a list of booleans; rows are filtered where they are read.
    """
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa
        apply = None
        for batch in batches:
            apply = apply or build()
            yield batch.filter(pa.array(apply(batch.column(at).to_pylist()), pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
