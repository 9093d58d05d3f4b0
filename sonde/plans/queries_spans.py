"""Registered queries: calls, latency, fingerprints, roots and trace evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.functions import scalars as S
from sonde.operators import spans as SP
from sonde.operators import windows as WN
from sonde.plans.registry import cte, query
from sonde.plans.stages import stage
from sonde.sources import tables as T


def r(name, digits=6):
    return S.rounded(F.col(name), digits).alias(name)


def incident_spans(spark, sf_dir):
    """The large spans with the thirty-day incident they fall in, written once: most span queries read it often.

    The windows are written before, so that Spark knows how few they are and need not shuffle the spans by their day.
    """
    windows = stage(spark, sf_dir, "span_windows", lambda: T.span_incidents(spark, sf_dir))
    return stage(spark, sf_dir, "incident_spans", lambda: WN.window_join(
        T.spans(spark, sf_dir), windows, width=86400).drop("start_ts", "end_ts"))


cte("inc_spans", "SELECT i.incident_id, s.* FROM spans s JOIN span_incidents i ON s.ts BETWEEN i.start_ts AND i.end_ts")
cte("calls", """
SELECT p.component AS caller, c.component AS callee, count(*) AS calls FROM spans c
JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_id GROUP BY ALL""")


@query("join2_span_self_join", "SELECT * FROM calls WHERE caller <> callee")
def span_self_join(spark, sf_dir):
    return SP.call_pairs(T.spans(spark, sf_dir))


def _direct(spark, sf_dir):
    s = T.event_spans(spark, sf_dir)
    return s.withColumn("ds_name", F.when(~F.col("success"), "mysql_02")).withColumn(
        "service_name", F.when(F.col("span_id") % 3 == 0, "frontend"))


cte("direct_calls", """
SELECT component AS caller, 'mysql_02' AS callee FROM event_spans WHERE NOT success AND component <> 'mysql_02'
UNION ALL SELECT component, 'frontend' FROM event_spans WHERE span_id % 3 = 0 AND component <> 'frontend'""")


@query("join3_direct_dependencies", "SELECT caller, callee, count(*) AS calls FROM direct_calls GROUP BY ALL")
def direct_dependencies(spark, sf_dir):
    return SP.direct_pairs(_direct(spark, sf_dir))


cte("event_calls", """
SELECT i.incident_id, p.component AS caller, c.component AS callee, count(*) AS calls
FROM event_spans c JOIN short_or_day i ON c.ts BETWEEN i.start_ts AND i.end_ts
JOIN event_spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_id AND p.ts BETWEEN i.start_ts AND i.end_ts
GROUP BY ALL""".replace("short_or_day", "incidents"))


@query("grf1_call_graph", """
SELECT caller, callee, sum(calls)::BIGINT AS calls FROM (
  SELECT p.component AS caller, c.component AS callee, count(*) AS calls FROM event_spans c
  JOIN event_spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_id WHERE p.component <> c.component GROUP BY ALL
  UNION ALL SELECT caller, callee, count(*) FROM direct_calls GROUP BY ALL) GROUP BY ALL""")
def call_graph(spark, sf_dir):
    return SP.all_calls(_direct(spark, sf_dir))


cte("span_stats", """
SELECT incident_id, component, count(*) AS span_count, avg(duration) AS mean_duration, median(duration) AS median_duration,
  CASE WHEN count(*) >= 5 THEN quantile_cont(duration, 0.95) ELSE max(duration) END AS p95_duration,
  max(duration) AS max_duration, stddev_pop(duration) AS std_duration FROM inc_spans GROUP BY ALL""")


@query("agg13_span_statistics", """
SELECT incident_id, component, span_count, round(mean_duration, 6) AS mean_duration, round(median_duration, 6) AS median_duration,
  round(p95_duration, 6) AS p95_duration, max_duration, round(std_duration, 6) AS std_duration FROM span_stats""")
def span_statistics(spark, sf_dir):
    return SP.component_statistics(incident_spans(spark, sf_dir)).select(
        "incident_id", "component", "span_count", r("mean_duration"), r("median_duration"), r("p95_duration"),
        "max_duration", r("std_duration"))


@query("agg14_latency_outliers", """
WITH g AS (SELECT incident_id, median(median_duration) AS m, stddev_pop(median_duration) AS s FROM span_stats GROUP BY ALL)
SELECT incident_id, component, median_duration, round((median_duration - m) / s, 4) AS z_score,
  round(least(1, (median_duration - m) / s / 5), 6)::DOUBLE AS anomaly_score
FROM span_stats JOIN g USING (incident_id) WHERE s >= 1e-6 AND (median_duration - m) / s > 2""")
def latency_outliers(spark, sf_dir):
    return SP.latency_outliers(SP.component_statistics(incident_spans(spark, sf_dir))).withColumn(
        "anomaly_score", S.rounded(F.col("anomaly_score"), 6))


@query("agg15_duration_distribution", "SELECT incident_id, component, duration, count(*) AS n FROM inc_spans GROUP BY ALL")
def duration_distribution(spark, sf_dir):
    return SP.duration_distribution(incident_spans(spark, sf_dir))


@query("agg15_latency_profile", """
SELECT incident_id, component, round(avg(duration), 6) AS avg_duration, max(duration) AS max_duration, count(*) AS span_count,
  count(DISTINCT duration) AS distinct_durations FROM inc_spans GROUP BY ALL""")
def latency_profile(spark, sf_dir):
    return SP.latency_profile(incident_spans(spark, sf_dir)).withColumn("avg_duration", S.rounded(F.col("avg_duration"), 6))


def _known(spark, sf_dir):
    """Components with metric evidence: those with an even number, per incident."""
    s = incident_spans(spark, sf_dir)
    return s.select("incident_id", "component").distinct().filter(
        F.col("component").isin("c0", "c2", "c4", "c6", "c8", "c10"))


cte("known_components", """
SELECT DISTINCT incident_id, component FROM inc_spans WHERE component IN ('c0', 'c2', 'c4', 'c6', 'c8', 'c10')""")
cte("inc_calls", """
SELECT c.incident_id, p.component AS caller, c.component AS callee, count(*) AS calls FROM inc_spans c
JOIN inc_spans p ON p.incident_id = c.incident_id AND p.trace_id = c.trace_id AND p.span_id = c.parent_id GROUP BY ALL""")
cte("trace_scores", """
WITH q AS (SELECT incident_id, quantile_cont(duration, 0.95) AS q95 FROM inc_spans GROUP BY ALL),
f AS (SELECT incident_id, component, count(*) FILTER (duration > q95 AND q95 <> 0) AS slow, count(*) FILTER (NOT success) AS failed
  FROM inc_spans JOIN q USING (incident_id) GROUP BY ALL),
parts AS (
  SELECT c.incident_id, callee AS component, CASE WHEN (c.incident_id, caller) IN (SELECT (incident_id, component) FROM known_components)
    THEN least(5, 0.08 * calls) ELSE least(2, 0.03 * calls) END AS s FROM inc_calls c
  WHERE (c.incident_id, callee) IN (SELECT (incident_id, component) FROM known_components)
  UNION ALL SELECT incident_id, callee, least(4, 0.15 * calls) FROM inc_calls WHERE caller = callee
  UNION ALL SELECT incident_id, component, least(4, 0.08 * slow) + least(4, 0.2 * failed) FROM f)
SELECT incident_id, component, sum(s)::DOUBLE AS score FROM parts GROUP BY ALL HAVING sum(s) > 0""")


@query("agg16_trace_evidence", "SELECT incident_id, component, round(score, 4) AS score FROM trace_scores")
def trace_evidence(spark, sf_dir):
    return SP.trace_evidence(incident_spans(spark, sf_dir), _known(spark, sf_dir)).withColumn(
        "score", S.rounded(F.col("score"), 4))


cte("trace_marks", """
SELECT DISTINCT c.incident_id, c.trace_id, 'call:' || p.component || '->' || c.component AS e FROM inc_spans c
JOIN inc_spans p ON p.incident_id = c.incident_id AND p.trace_id = c.trace_id AND p.span_id = c.parent_id
UNION SELECT DISTINCT incident_id, trace_id, 'status_error:' || component FROM inc_spans WHERE NOT success""")
cte("trace_patterns", """
SELECT incident_id, trace_id, substr(sha1(string_agg(e, chr(10) ORDER BY e)), 1, 12) AS pattern_id, count(*) AS marks
FROM trace_marks GROUP BY ALL""")


@query("smp1_trace_fingerprint", "SELECT * FROM trace_patterns")
def fingerprint(spark, sf_dir):
    return SP.fingerprints(incident_spans(spark, sf_dir)).select(
        "incident_id", "trace_id", "pattern_id", F.size("eps").cast("bigint").alias("marks"))


cte("trace_roots", """
SELECT s.incident_id, s.trace_id, arg_min(s.component, (CASE WHEN i.span_id IS NULL THEN 0 ELSE 1 END, s.span_id)) AS root
FROM inc_spans s LEFT JOIN inc_spans i ON i.incident_id = s.incident_id AND i.trace_id = s.trace_id AND i.span_id = s.parent_id
GROUP BY ALL""")


@query("join7_trace_roots", "SELECT * FROM trace_roots")
def trace_roots(spark, sf_dir):
    return SP.roots(incident_spans(spark, sf_dir))


@query("join6_semi_join_sampling", """
SELECT incident_id, trace_id, span_id, component FROM inc_spans
JOIN (SELECT DISTINCT incident_id, trace_id FROM inc_spans WHERE NOT success) AS failed USING (incident_id, trace_id)""")
def semi_join(spark, sf_dir):
    s = incident_spans(spark, sf_dir)
    chosen = s.filter(~F.col("success")).select("incident_id", "trace_id").distinct()
    return s.join(chosen, ["incident_id", "trace_id"], "left_semi").select(
        "incident_id", "trace_id", "span_id", "component")


@query("smp7_call_chains", """
WITH c AS (SELECT incident_id, trace_id, string_agg(DISTINCT component, ',' ORDER BY component) AS components,
  count(DISTINCT component) AS depth FROM inc_spans GROUP BY ALL HAVING count(DISTINCT component) >= 2)
SELECT incident_id, trace_id, components, CAST(depth AS INTEGER) AS depth,
  CAST(row_number() OVER (PARTITION BY incident_id ORDER BY trace_id) AS INTEGER) AS rank FROM c
QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY trace_id) <= 50""")
def call_chains(spark, sf_dir):
    return SP.call_chains(incident_spans(spark, sf_dir)).withColumn("components", F.array_join("components", ","))
