"""Connected components of a link table by alternating large-star and small-star steps.

Nothing is gathered: a round is two aggregates and two joins on the node, and its
links are written to the shared folder, so that a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
            .filter("a <> b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    # every link runs from the larger node a to the smaller node b
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    linked = links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return linked.unionByName(least.select("a", F.col("least").alias("b"))).filter("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of the nodes in ``links`` (a, b); single nodes have no row."""
    now = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    while state[0]:
        now = written(_small_star(_large_star(now)), "links")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
