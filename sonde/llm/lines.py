"""Line deduplication with levelled sorted runs of line digests.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased.
Keys of at least ``LEAST_CHARS`` code points that occur in at least ``LEAST_DOCS``
documents lose all their lines but those of one document, the one with the largest
doc_id; the other lines stay.

How it works: the digests of long keys are counted once. The lines of common keys are
dealt into batches of falling doc_id. A batch's digests are merge-anti-joined with
the runs, so those that remain have their largest doc_id in this batch, and are added
as a run of their own. Runs are tables bucketed and sorted by digest, so neither the
joins nor the compactions sort them anew; ``FANOUT`` runs of a level are compacted
into one of the next. A hot key is summed before every shuffle and met where its lines
are. Texts are shuffled once, to meet the numbers of their dropped lines.

Null text is one empty line, as is the empty text. Rows that share a doc_id are one
document; rows without one are one document too, below all others (doc_id must be a
number). Equal rows get equal results, an empty table gives an empty result, other
columns are ignored. Digests have 128 bits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sonde.llm.common import meet, shared_folder, table, written

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Batches of documents, and runs of one level that are compacted into one of the next.
BATCHES, FANOUT = 8, 3
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_digest(docs: DataFrame) -> Column:
    """Equal for rows of equal doc_id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), F.lit("\n"), F.coalesce(docs["text"], F.lit(""))).cast("binary")))


def keyed(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """row (a digest of the document), doc_id, at (from 0), line (a digest of the key) of every long line."""
    # the digest has a step of its own: beside the generator it would be computed for every line
    known = docs.select(row_digest(docs).alias("row"), "doc_id", "text")
    split = known.select("row", "doc_id", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    bare = F.btrim("line", F.lit(_SPACE))
    return (split.filter(F.length(bare) >= least_chars)
            .select("row", "doc_id", "at", F.unhex(F.md5(F.translate(bare, _UPPER, _LOWER).cast("binary"))).alias("line")))


class Runs:
    """Sorted runs of (line, keeper) by level: ``add`` takes batches, ``rows`` has every line added so far once."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.write.bucketBy(self.buckets, "line").sortBy("line")
         .option("path", f"{shared_folder(self.spark)}/{name}").saveAsTable(name))
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Add the lines of ``batch`` (line, doc_id) that no run has, each with its largest doc_id."""
        new = batch.groupBy("line").agg(F.max("doc_id").alias("keeper"))
        for run in self.runs():
            new = new.join(run.select("line").hint("merge"), "line", "left_anti")
        self.levels[0].append(self._write(new))
        self._compact()

    def _compact(self) -> None:
        for at in range(len(self.levels)):
            if len(self.levels[at]) < self.fanout:
                return
            merged = self.spark.table(self.levels[at][0])
            for name in self.levels[at][1:]:
                merged = merged.unionByName(self.spark.table(name))
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(self._write(merged.repartition(self.buckets, "line")))
            self._forget(self.levels[at])
            self.levels[at] = []

    def _forget(self, names: list[str]) -> None:
        for name in names:  # the files stay until the application ends
            self.spark.sql(f"DROP TABLE {name}")

    def rows(self) -> DataFrame:
        """line, keeper; there must have been a batch."""
        first, *others = self.runs()
        for run in others:
            first = first.unionByName(run)
        return first

    def close(self) -> None:
        for level in self.levels:
            self._forget(level)
        self.levels = [[]]


def dropped(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES,
            fanout: int = FANOUT) -> DataFrame:
    """row, cut (rising numbers of its dropped lines, from 0) of every document that loses lines."""
    spark = docs.sparkSession
    lines = written(keyed(docs, least_chars), "lines")
    held_by = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    common = lines.groupBy("line").agg(F.count("*").alias("n"), held_by.alias("held_by")).filter(F.col("held_by") >= least_docs)
    common = written(common.drop("held_by"), "common-lines")
    met = written(meet(lines, common, "line", "n", lines.count()), "held-lines")
    bounds = met.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000)).first()[0] or []
    batch = sum((F.coalesce(F.col("doc_id") <= b, F.lit(True)).cast("int") for b in sorted(set(bounds))), F.lit(0))
    dealt = f"{shared_folder(spark)}/line-batches-{uuid.uuid4().hex}"
    met.withColumn("batch", batch).hint("rebalance", "batch").write.partitionBy("batch").parquet(dealt)
    held = spark.read.schema(StructType([*met.schema, StructField("batch", IntegerType())])).parquet(dealt)
    runs = Runs(spark, fanout)
    for k in range(len(set(bounds)) + 1):
        runs.add(held.filter(F.col("batch") == k))
    keepers = written(runs.rows(), "keepers").withColumnRenamed("line", "kept_line")
    runs.close()
    lost = held.join(keepers.hint("merge"), (F.col("line") == F.col("kept_line")) & F.col("doc_id").eqNullSafe(F.col("keeper")), "left_anti")
    return lost.groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("cut"))


def without(lines: Column, cut: Column) -> Column:
    """The lines but those numbered in ``cut``, joined, in time proportional to their number.

    The numbers become one byte a line, 1 for a cut; a byte is read from its place, while slices
    of an array copy it whole each time.
    """
    cuts = F.concat(F.array(F.lit(-1)), cut, F.array(F.size(lines)))
    known = F.array(F.struct(lines.alias("lines"), cuts.alias("cuts")))  # one struct, so that the text is split once

    def flagged(s):
        zeros = F.transform(F.sequence(F.lit(1), F.size(s["cuts"]) - 1),
                            lambda i: F.repeat(F.lit("0"), F.element_at(s["cuts"], i + 1) - F.element_at(s["cuts"], i) - 1))
        return F.struct(s["lines"].alias("lines"), F.array_join(zeros, "1").cast("binary").alias("flags"))

    def joined(s):
        return F.array_join(F.filter(s["lines"], lambda line, i: F.substr(s["flags"], i + 1, F.lit(1)) == F.lit(b"0")), "\n")
    return F.transform(F.transform(known, flagged), joined)[0]


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text without its dropped lines) of every row of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", "text")
    cuts = written(dropped(rows, **settings), "dropped-lines").withColumnRenamed("row", "cut_row")
    met = rows.withColumn("row", row_digest(rows)).join(cuts.hint("merge"), F.col("row") == F.col("cut_row"), "left")
    text = F.coalesce("text", F.lit(""))
    return met.select("doc_id", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
                      F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_dropped"),
                      F.when(F.col("cut").isNull(), text).otherwise(without(lines_of(F.col("text")), F.col("cut"))).alias("kept"))


def op13_line_dedup(spark, sf_dir):
    found = deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
each AS (
  SELECT r, doc_id, i, ls[i] AS line,
         translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key
  FROM texts, unnest(range(1, len(ls) + 1)) AS u(i)),
common AS (
  SELECT key, max(doc_id) AS keeper FROM each WHERE length(key) >= {LEAST_CHARS} GROUP BY key
  HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= {LEAST_DOCS}),
judged AS (
  SELECT e.r, e.doc_id, e.i, e.line, c.key IS NOT NULL AND e.doc_id IS DISTINCT FROM c.keeper AS lost
  FROM each e LEFT JOIN common c ON c.key = e.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""
QUERIES, CHECKS = {"op13_line_dedup": op13_line_dedup}, {"op13_line_dedup": SQL}
