"""Trace spans: calls, latency, fingerprints, roots and trace evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.functions import scalars as S
from sonde.operators.stats import exact_percentiles
from sonde.operators.windows import top_k


def _parents(spans: DataFrame, keys) -> DataFrame:
    """One component per span id (the smallest when an id repeats)."""
    return spans.groupBy(*keys, "span_id").agg(F.min("component").alias("caller"))


def call_pairs(spans: DataFrame, keys=(), keep_self: bool = False) -> DataFrame:
    """Calls between components: a span whose parent is a span of the same trace.

    Children are counted per (trace, parent, component) before the shuffle, so a parent
    with very many children costs one row per component; parents are unique, so the join
    neither multiplies nor skews.
    """
    on = [*keys, "trace_id"]
    children = (spans.filter(F.col("parent_id").isNotNull())
                .groupBy(*on, F.col("parent_id").alias("span_id"), F.col("component").alias("callee"))
                .agg(F.count("*").alias("calls")))
    pairs = children.join(_parents(spans, on), [*on, "span_id"])
    if not keep_self:
        pairs = pairs.filter(F.col("caller") != F.col("callee"))
    return pairs.groupBy(*keys, "caller", "callee").agg(F.sum("calls").alias("calls"))


def direct_pairs(spans: DataFrame, keys=()) -> DataFrame:
    """Rows that name the called data source or service themselves."""
    targets = F.array_compact(F.array("ds_name", "service_name"))
    return (spans.select(*keys, F.col("component").alias("caller"), F.explode(targets).alias("callee"))
            .filter(F.col("caller") != F.col("callee"))
            .groupBy(*keys, "caller", "callee").agg(F.count("*").alias("calls")))


def all_calls(spans: DataFrame, keys=()) -> DataFrame:
    both = call_pairs(spans, keys).unionByName(direct_pairs(spans, keys))
    return both.groupBy(*keys, "caller", "callee").agg(F.sum("calls").alias("calls"))


def component_calls(spans: DataFrame, components, keys=()) -> DataFrame:
    """Calls between candidates: parent and child spans, and rows that name what they call, in candidate form.

    Ids are brought to the candidate list after counting, on one row per pair.
    """
    named = "ds_name" in spans.columns and "service_name" in spans.columns
    pairs = all_calls(spans, keys) if named else call_pairs(spans, keys)
    for end in ("caller", "callee"):
        pairs = pairs.withColumn(end, S.normalise_component(F.col(end), components))
    return pairs.filter(F.col("caller") != F.col("callee")).groupBy(*keys, "caller", "callee").agg(F.sum("calls").alias("calls"))


def component_statistics(spans: DataFrame) -> DataFrame:
    """Count, mean, exact median and p95 (max below five spans), max, population deviation."""
    keys = ["incident_id", "component"]
    basic = spans.groupBy(*keys).agg(
        F.count("*").alias("span_count"), F.count("duration").alias("_n"),
        F.avg("duration").alias("mean_duration"), F.max("duration").alias("max_duration"),
        F.stddev_pop("duration").alias("std_duration")).filter("_n > 0")
    q = exact_percentiles(spans, keys, "duration", {"median_duration": 0.5, "_p95": 0.95})
    return (basic.join(q, keys)
            .withColumn("p95_duration", F.when(F.col("_n") >= 5, F.col("_p95")).otherwise(F.col("max_duration")))
            .drop("_n", "_p95"))


def latency_outliers(statistics: DataFrame) -> DataFrame:
    """Components whose median is more than two deviations above the median of medians."""
    g = statistics.groupBy("incident_id").agg(
        F.percentile("median_duration", F.lit(0.5)).alias("_m"),
        F.stddev_pop("median_duration").alias("_s")).filter("_s >= 1e-6")
    z = (F.col("median_duration") - F.col("_m")) / F.col("_s")
    return (statistics.join(g, "incident_id").withColumn("z", z).filter("z > 2.0")
            .select("incident_id", "component", "median_duration", S.rounded(F.col("z"), 4).alias("z_score"),
                    F.least(F.lit(1.0), F.col("z") / 5.0).alias("anomaly_score")))


def duration_distribution(spans: DataFrame) -> DataFrame:
    """All durations of each component as (duration, n) rows.

    A sorted list per component would gather its spans; counted rows carry the same information.
    """
    return spans.filter(F.col("duration").isNotNull()).groupBy("incident_id", "component", "duration").agg(F.count("*").alias("n"))


def latency_profile(spans: DataFrame) -> DataFrame:
    """Average, maximum and count of the durations, and how many different ones there are."""
    per = duration_distribution(spans)
    return per.groupBy("incident_id", "component").agg(
        (F.sum(F.col("duration") * F.col("n")) / F.sum("n")).alias("avg_duration"),
        F.max("duration").alias("max_duration"), F.sum("n").alias("span_count"),
        F.count("*").alias("distinct_durations"))


def slow_cut(spans: DataFrame) -> DataFrame:
    return exact_percentiles(spans, ["incident_id"], "duration", {"q95": 0.95})


def trace_evidence(spans: DataFrame, metric_components: DataFrame) -> DataFrame:
    """Component scores from calls into metric components, self calls, slow and failed spans."""
    calls = call_pairs(spans, ["incident_id"], keep_self=True)
    known = metric_components.select("incident_id", F.col("component").alias("callee"))
    into = (calls.join(known, ["incident_id", "callee"], "left_semi")
            .join(known.select("incident_id", F.col("callee").alias("caller"), F.lit(True).alias("_both")),
                  ["incident_id", "caller"], "left")
            .select("incident_id", F.col("callee").alias("component"), F.when(
                F.col("_both"), F.least(F.lit(5.0), 0.08 * F.col("calls"))).otherwise(
                F.least(F.lit(2.0), 0.03 * F.col("calls"))).alias("s")))
    own = calls.filter("caller = callee").select(
        "incident_id", F.col("callee").alias("component"),
        F.least(F.lit(4.0), 0.15 * F.col("calls")).alias("s"))
    flagged = (spans.join(slow_cut(spans), "incident_id")
               .groupBy("incident_id", "component").agg(
        F.count_if((F.col("q95") != 0) & (F.col("duration") > F.col("q95"))).alias("slow"),
        F.count_if(~F.col("success")).alias("failed")))
    bad = flagged.select("incident_id", "component", (
        F.least(F.lit(4.0), 0.08 * F.col("slow")) + F.least(F.lit(4.0), 0.2 * F.col("failed"))).alias("s"))
    return (into.unionByName(own).unionByName(bad.filter("s > 0"))
            .groupBy("incident_id", "component").agg(F.sum("s").alias("score")))


def _pattern_id():
    return F.substring(F.sha1(F.encode(F.array_join("eps", "\n"), "UTF-8")), 1, 12)


def fingerprints(spans: DataFrame, keys=("incident_id",)) -> DataFrame:
    """Pattern of a trace: the sorted set of its calls and failing components, and its hash.

    The set is made distinct before it is gathered, so it is bounded by component pairs.
    """
    on = [*keys, "trace_id"]
    calls = spans.filter(F.col("parent_id").isNotNull()).groupBy(
        *on, F.col("parent_id").alias("span_id"), F.col("component").alias("callee")).agg(F.lit(1).alias("_"))
    calls = calls.join(_parents(spans, on), [*on, "span_id"]).select(
        *on, F.concat(F.lit("call:"), "caller", F.lit("->"), "callee").alias("e"))
    errors = spans.filter(~F.col("success")).select(*on, F.concat(F.lit("status_error:"), "component").alias("e"))
    marks = calls.unionByName(errors).distinct()
    return (marks.groupBy(*on).agg(F.array_sort(F.collect_list("e")).alias("eps"))
            .withColumn("pattern_id", _pattern_id()))


def roots(spans: DataFrame, keys=("incident_id",)) -> DataFrame:
    """Root component per trace: the first span whose parent is not in the trace, else the first."""
    on = [*keys, "trace_id"]
    ids = spans.select(*on, F.col("span_id").alias("parent_id")).distinct().withColumn("_inside", F.lit(1))
    marked = spans.join(ids, [*on, "parent_id"], "left")
    first = F.struct(F.coalesce("_inside", F.lit(0)).alias("inside"), F.col("span_id"), F.col("component"))
    return marked.groupBy(*on).agg(F.min(first).alias("r")).select(*on, F.col("r.component").alias("root"))


def trace_anomaly(spans: DataFrame, scores: DataFrame, keys=("incident_id",)) -> DataFrame:
    """Sum of the metric scores of a trace's components plus two per failed span."""
    on = [*keys, "trace_id"]
    per = spans.groupBy(*on, "component").agg(F.count_if(~F.col("success")).alias("failed"))
    return (per.join(scores, [*keys, "component"], "left")
            .groupBy(*on).agg((F.sum(F.coalesce("score", F.lit(0.0))) + 2.0 * F.sum("failed")).alias("anomaly")))


def trace_profiles(spans: DataFrame, scores: DataFrame, keys=("incident_id",)) -> DataFrame:
    """:func:`fingerprints`, :func:`roots` and :func:`trace_anomaly` of every trace with a mark, in one pass.

    A span meets its parent once, for its call and for the root; the trace is grouped once. What is
    gathered is a set of (caller, component, failing), bounded by component pairs as the marks are.
    """
    on = [*keys, "trace_id"]
    parents = _parents(spans, on).select(*on, F.col("span_id").alias("parent_id"), "caller", F.lit(1).alias("_inside"))
    rows = (spans.select(*on, "span_id", "parent_id", "component", (~F.col("success")).alias("_failed"))
            .join(parents, [*on, "parent_id"], "left").join(scores.select(*keys, "component", "score"), [*keys, "component"], "left"))
    failed, inside = F.coalesce("_failed", F.lit(False)), F.coalesce("_inside", F.lit(0))
    traces = rows.groupBy(*on).agg(
        F.collect_set(F.struct("component", F.coalesce("score", F.lit(0.0)).alias("score"), "caller", failed.alias("failed"))).alias("_parts"),
        F.min(F.struct(inside.alias("inside"), "span_id", "component")).alias("_first"),
        F.count_if(failed).alias("_failures"), F.bool_or(failed | (inside == 1)).alias("_marked")).filter("_marked")
    marks = F.flatten(F.transform("_parts", lambda x: F.array(
        F.concat(F.lit("call:"), x["caller"], F.lit("->"), x["component"]),
        F.when(x["failed"], F.concat(F.lit("status_error:"), x["component"])))))
    met = F.array_sort(F.array_distinct(F.transform("_parts", lambda x: F.struct(x["component"], x["score"]))))
    total = F.aggregate(met, F.lit(0.0), lambda a, x: a + x["score"])
    return traces.select(
        *on, F.array_sort(F.array_distinct(F.array_compact(marks))).alias("eps"), F.col("_first.component").alias("root"),
        (total + 2.0 * F.col("_failures")).alias("anomaly")).withColumn("pattern_id", _pattern_id())


def call_chains(spans: DataFrame, limit: int | None = 50) -> DataFrame:
    """First ``limit`` traces (None: all) of an incident that touch at least two components."""
    parts = spans.select("incident_id", "trace_id", "component").distinct()
    chains = parts.groupBy("incident_id", "trace_id").agg(
        F.array_sort(F.collect_list("component")).alias("components")).filter(F.size("components") >= 2)
    return top_k(chains, ["incident_id"], ["trace_id"], limit).withColumn("depth", F.size("components"))
