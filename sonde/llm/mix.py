"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document's expected copies grow with the
binary digits of its size, up to the cap, at the one rate that brings its source to
the target. Their whole part are its certain copies, the rest is its probability of one
more: documents are ranked by Pareto order, random odds divided by inclusion odds,
and the lowest ranks are taken until their words come nearest to what the source
still lacks.

Null text has size 0 and is never taken; a null source is a source of its own and
comes last; rows of equal doc_id and text rank next to each other, and as many of them
are taken as fit, whichever these are; an empty table gives an empty result. Other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonde.llm.common import WORD, count_words, table, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and most copies of a document.
SHARE, CAP = 1.5, 2
#: Rows in one of the ranges in which the Pareto order is summed, about, before the cut is searched in one of them.
RANGE_ROWS, LEAST_RANGES = 20_000, 64


def number(digest: Column, at: int, digits: int) -> Column:
    """Hexadecimal digits of a digest as a long."""
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("long")


def drawn(docs: DataFrame, seed: int) -> Column:
    """A digest of doc_id and text under ``seed``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"),
                          F.coalesce(docs["text"], F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size -> target, by filling up.

    A target is weight * level, or cap * size where that is less; the level is
    found at the first source, in order of cap * size / weight, that the words
    left can no longer fill. One row per source goes through these windows.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    ranked = (sizes.withColumn("at", F.row_number().over(by_code) - 1).withColumn("weight", pick)
              .withColumn("most", cap * F.col("source_size")).withColumn("full", F.col("most") / F.col("weight")))
    fill = Window.orderBy("full", "at")
    before, rest, every = (fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing),
                           Window.partitionBy(F.lit(0)))
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))
    return (ranked.withColumn("level", left / F.sum("weight").over(rest))
            .withColumn("level", F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "at", "level"))).over(every)["level"])
            .select("source", "source_size",
                    F.coalesce(F.least(F.col("most").cast("double"), F.col("weight") * F.col("level")),
                               F.col("most").cast("double")).alias("target")))


def rates(words: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """goal_source, goal_grade, source_size, target, whole, chance, lack of every source and grade, by filling up.

    Documents of grade g expect ``rate * g`` copies, or ``cap`` where that is less; the
    rate is found at the first grade, from the highest, that it does not fill. A source has
    about thirty grades at most.
    """
    known = words.join(targets.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source")))
    fill = Window.partitionBy("source").orderBy(F.col("grade").desc())
    whole = Window.partitionBy("source")
    full = F.coalesce(F.sum(cap * F.col("words")).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("grade")).over(fill.rowsBetween(0, Window.unboundedFollowing))
    return (known.filter("grade > 0").withColumn("level", (F.col("target") - full) / rest)
            .withColumn("level", F.min(F.when(F.col("level") * F.col("grade") <= cap, F.struct(-F.col("grade"), "level"))).over(whole)["level"])
            .withColumn("copies", F.coalesce(F.least(F.col("level") * F.col("grade"), F.lit(float(cap))), F.lit(float(cap))))
            .withColumn("whole", F.floor("copies")).withColumn("chance", F.col("copies") - F.col("whole"))
            .withColumn("lack", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(whole))
            .select("goal_source", F.col("grade").alias("goal_grade"), "whole", "chance", "lack"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = 1, carry: bool = False) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken per row of ``docs`` (doc_id, text, source), and the row itself if ``carry``."""
    digest = drawn(docs, seed)
    rows = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"),
                       ((number(digest, 1, 13).cast("double") + 0.5) / float(1 << 52)).alias("u"), number(digest, 14, 15).alias("tie"),
                       *([F.struct(*docs.columns).alias("row")] if carry else []))
    rows = written(rows.withColumn("grade", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)), "mix-sizes")
    words = rows.groupBy("source", "grade").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    words = written(words, "mix-words")
    count = words.agg(F.sum("n")).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-count // RANGE_ROWS))
    targets = written(source_targets(words.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap), "mix-targets")
    # written: of known size, so that the rows need not be shuffled by source to meet them
    goals = written(rates(words, targets, cap), "mix-rates")
    named = targets.select(F.col("source").alias("own_source"), "source_size", "target")
    pareto = (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance")))
    ranked = (rows.join(named, F.col("source").eqNullSafe(F.col("own_source")))
              .join(goals, F.col("source").eqNullSafe(F.col("goal_source")) & (F.col("grade") == F.col("goal_grade")), "left")
              .withColumn("order", F.when(F.col("chance") > 0, pareto / (1 + pareto)))
              .withColumn("bin", F.least(F.floor(F.col("order") * ranges), F.lit(ranges - 1))))
    # words below each range of the order; the cut lies in the one range that reaches the missing words
    summed = ranked.filter("bin IS NOT NULL").groupBy("goal_source", "bin", "lack").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("goal_source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (summed.withColumn("below", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
            .filter((F.col("below") <= F.col("lack")) & (F.col("below") + F.col("words") > F.col("lack")))
            .select(F.col("goal_source").alias("cut_source"), F.col("bin").alias("cut_bin"), "below"))
    rank = ["order", "doc_id", "size", "tie"]
    near = (ranked.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("bin") == F.col("cut_bin")))
            .groupBy("source", "cut_bin", "below", "lack", *rank).agg(F.count("*").alias("times")))
    in_order = Window.partitionBy("source").orderBy(*rank).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("below") + F.coalesce(F.sum(F.col("size") * F.col("times")).over(in_order), F.lit(0))
    # a document is taken while more than half of it is lacking: of equal ones so many
    fits = F.floor((2 * (F.col("lack") - F.col("start")) - F.col("size")) / (2 * F.col("size"))) + 1
    first = (near.withColumn("start", start).withColumn("fit", F.greatest(fits, F.lit(0)))
             .groupBy(F.col("source").alias("cut_source"), "cut_bin")
             .agg(F.min(F.when(F.col("fit") < F.col("times"), F.struct(F.struct(*rank).alias("rank"), "fit"))).alias("cut")))
    cuts = written(first.select("cut_source", "cut_bin", F.col("cut.rank").alias("cut_rank"), F.col("cut.fit").alias("fit")), "mix-cuts")
    cut = ranked.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").withColumn("rank", F.struct(*rank))
    # rows that fit in part, all equal, are counted off; the others know whether they lie before the cut
    partly = F.coalesce((F.col("rank") == F.col("cut_rank")) & (F.col("fit") > 0), F.lit(False))
    before = (F.col("bin") < F.coalesce(F.col("cut_bin"), F.lit(ranges))) | ((F.col("bin") == F.col("cut_bin")) & F.coalesce(F.col("rank") < F.col("cut_rank"), F.lit(True)))
    some = cut.filter(partly).withColumn("extra", (F.row_number().over(Window.partitionBy("source").orderBy("order")) <= F.col("fit")).cast("int"))
    others = cut.filter(~partly).withColumn("extra", F.coalesce(before, F.lit(False)).cast("int"))
    copies = F.coalesce(F.col("whole") + F.col("extra"), F.lit(0))
    return (some.unionByName(others).withColumn("copies", copies.cast("long"))
            .select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
                    *(["row"] if carry else [])))


def repeated(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    taken = mix(docs, carry=True, **settings).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op2_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


SQL = rf"""
WITH drawn AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5('1:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS h FROM documents),
sized AS (
  SELECT doc_id, source, size, CASE WHEN size > 0 THEN len(bin(size)) ELSE 0 END AS grade,
         (('0x' || substr(h, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u, ('0x' || substr(h, 14, 15))::BIGINT AS tie
  FROM drawn),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, 2 * source_size AS most, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS pos,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM totals),
filled AS (
  SELECT *, most::DOUBLE / weight AS full_at,
         (1.5 * (sum(source_size) OVER ())::DOUBLE
          - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(weight) OVER (ORDER BY most::DOUBLE / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM ranked),
lvl AS (SELECT level FROM filled WHERE level <= full_at ORDER BY full_at, pos LIMIT 1),
targets AS (SELECT source, source_size, least(most::DOUBLE, coalesce(weight * (SELECT level FROM lvl), most::DOUBLE)) AS target FROM filled),
words AS (SELECT source, grade, sum(size)::BIGINT AS words FROM sized WHERE grade > 0 GROUP BY ALL),
levels AS (
  SELECT w.*, t.target,
         (t.target - coalesce(sum(2 * words) OVER (PARTITION BY w.source ORDER BY grade DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(words * grade) OVER (PARTITION BY w.source ORDER BY grade DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM words w JOIN targets t ON w.source IS NOT DISTINCT FROM t.source),
rate AS (SELECT source, arg_max(level, grade) AS level FROM levels WHERE level * grade <= 2 GROUP BY source),
expected AS (
  SELECT l.source, l.grade, l.words, l.target, coalesce(least(r.level * l.grade, 2.0), 2.0) AS copies
  FROM levels l LEFT JOIN rate r ON r.source IS NOT DISTINCT FROM l.source),
goals AS (
  SELECT source, grade, floor(copies) AS whole, copies - floor(copies) AS chance,
         target - sum(floor(copies) * words) OVER (PARTITION BY source) AS lack FROM expected),
ordered AS (
  SELECT s.*, t.source_size, t.target, g.whole, g.lack, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS q
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
       LEFT JOIN goals g ON s.source IS NOT DISTINCT FROM g.source AND s.grade = g.grade),
cut AS (
  SELECT *, coalesce(sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q / (1 + q) NULLS LAST, doc_id, size, tie
                                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM ordered),
judged AS (SELECT *, coalesce(whole + CASE WHEN q IS NOT NULL AND 2 * start + size <= 2 * lack THEN 1 ELSE 0 END, 0)::BIGINT AS copies FROM cut)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken FROM judged
"""
QUERIES, CHECKS = {"op2_mix_sources": op2_mix_sources}, {"op2_mix_sources": SQL}
