"""Registered queries: detectors, severity, candidates and layer filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.functions import fixed as V
from sonde.functions import scalars as S
from sonde.operators import detect as D
from sonde.operators import stats as ST
from sonde.plans.queries_sources import hint_sql, saturation_open_sql, saturation_sql
from sonde.plans.registry import cte, query, sql_any
from sonde.plans.stages import stage
from sonde.sources import tables as T
from sonde.sources.telemetry import mean_per_timestamp

# relaxed setting used on the sparse series of the derived metrics
HIGH, LOW, BETA, MIN_POINTS = 0.90, 0.10, 0.25, 1


def r(name, digits=6):
    return S.rounded(F.col(name), digits).alias(name)


def metrics(spark, sf_dir):
    return mean_per_timestamp(T.raw_metrics(spark, sf_dir), ["component", "kpi", "day"])


def stats_relaxed(spark, sf_dir):
    return ST.day_thresholds(T.raw_metrics(spark, sf_dir), HIGH, LOW)


def stats_table(spark, sf_dir):
    return stage(spark, sf_dir, "stats", lambda: stats_relaxed(spark, sf_dir))


# ------------------------------------------------------------------ detector A
_SEG_HINT = hint_sql("lower(kpi || ' metric_container.csv')", V.REASON_HINT_RULES_SHORT)
cte("points_a", f"""
WITH x AS (SELECT w.incident_id, w.component, w.kpi, w.ts, w.value, d.median_gap, d.scale, d.high, d.low, d.q10,
  {_SEG_HINT} AS reason_hint,
  CASE WHEN {sql_any('w.kpi', V.LOW_SENSITIVE_WORDS)} THEN d.q10 ELSE d.low END AS cut,
  {saturation_open_sql('w.kpi', 'w.value', 'd.median', 'd.high')} AS sat
  FROM in_window w JOIN day_stats d USING (component, kpi, day) WHERE d.n >= 4),
y AS (SELECT *, greatest(0, (value - high) / scale, sat) AS hs, greatest(0, (cut - value) / scale) AS ls FROM x),
z AS (SELECT *, CASE WHEN hs >= ls THEN 'high' ELSE 'low' END AS direction, CASE WHEN hs >= ls THEN high ELSE cut END AS threshold,
  CASE WHEN high <= 1e-9 AND abs(value) < 1 THEN least(greatest(hs, ls), CASE WHEN reason_hint IS NULL THEN 1.75 ELSE 2.5 END)
       ELSE greatest(hs, ls) END AS score FROM y)
SELECT incident_id, component, kpi, ts, value, score, direction, threshold, median_gap, reason_hint FROM z WHERE score >= 0.35""")
cte("islands_a", """
SELECT *, sum(fresh) OVER (PARTITION BY incident_id, component, kpi ORDER BY ts) AS island FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY incident_id, component, kpi ORDER BY ts) <= greatest(180, median_gap * 3)
    THEN 0 ELSE 1 END AS fresh FROM points_a)""")
cte("segments_a_all", """
WITH s AS (SELECT incident_id, component, kpi, island, any_value(median_gap) AS gap, any_value(reason_hint) AS reason_hint,
  min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS points, sum(score) + max(score) AS mass,
  arg_max(value, (score, -ts)) AS value, arg_max(threshold, (score, -ts)) AS threshold, arg_max(direction, (score, -ts)) AS direction
  FROM islands_a GROUP BY incident_id, component, kpi, island),
w AS (SELECT *, CASE WHEN points <= 1 THEN 0.28 WHEN points = 2 THEN 0.65 WHEN end_ts - start_ts >= greatest(240, gap * 4) THEN 1.25
  ELSE 1.0 END * CASE WHEN reason_hint IS NULL THEN 0.85 ELSE 1.0 END AS weight FROM s)
SELECT incident_id, component, kpi, start_ts, end_ts, points, weight, round(mass * weight, 4) AS severity, reason_hint, value, threshold, direction FROM w""")
cte("segments_a", """
SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY severity DESC, component, kpi, start_ts) AS rank
FROM segments_a_all QUALIFY rank <= 80""")


def points_a(spark, sf_dir):
    return D.points_a(T.raw_metrics(spark, sf_dir), ST.day_thresholds(T.raw_metrics(spark, sf_dir)),
                      T.incidents(spark, sf_dir), T.REASONS, T.METRIC_FILE)


def segments_a(spark, sf_dir):
    return stage(spark, sf_dir, "segments_a", lambda: D.segments_a(points_a(spark, sf_dir)))


@query("det1_segments_a", """
SELECT incident_id, component, kpi, start_ts, end_ts, points, severity, reason_hint, value, round(threshold, 6) AS threshold,
  direction, CAST(rank AS INTEGER) AS rank FROM segments_a""")
def det1(spark, sf_dir):
    return D.segments_a(points_a(spark, sf_dir)).select(
        "incident_id", "component", "kpi", "start_ts", "end_ts", "points", "severity", "reason_hint", "value",
        r("threshold"), "direction", "rank")


@query("win3_islands", """
SELECT incident_id, component, kpi, CAST(island AS BIGINT) AS island, count(*) AS points, min(ts) AS start_ts, max(ts) AS end_ts
FROM islands_a GROUP BY ALL""")
def islands(spark, sf_dir):
    from sonde.operators.windows import islands as number
    runs = number(points_a(spark, sf_dir), D.KEYS, F.greatest(F.lit(180), F.col("median_gap") * 3))
    return runs.groupBy(*D.KEYS, "island").agg(
        F.count("*").alias("points"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


@query("win14_persistence_weight", """
SELECT incident_id, component, kpi, start_ts, points, round(weight, 4)::DOUBLE AS weight FROM segments_a""")
def persistence(spark, sf_dir):
    return D.segments_a(points_a(spark, sf_dir)).select(*D.KEYS, "start_ts", "points", r("weight", 4))


# ------------------------------------------------------------------ detector B
cte("day_stats_r", """
WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY component, kpi, day ORDER BY ts) AS gap FROM metrics),
s AS (SELECT component, kpi, day, count(*) AS n, coalesce(stddev_samp(value), 0) AS std,
  CAST(floor(coalesce(median(gap), 60)) AS BIGINT) AS median_gap,
  quantile_cont(value, 0.90) AS high, quantile_cont(value, 0.10) AS low, median(value) AS median,
  quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM g GROUP BY ALL)
SELECT *, greatest(iqr / 1.349, std, abs(high - low) / 3, abs(median) * 0.05, 1e-6) AS scale FROM s""")
cte("pre_fault_day", """
SELECT i.incident_id, d.component, d.kpi, coalesce(avg(m.value), any_value(d.median)) AS baseline_mean
FROM incidents i JOIN day_stats_r d ON d.day = i.start_ts // 86400
LEFT JOIN metrics m ON m.component = d.component AND m.kpi = d.kpi AND m.ts >= i.start_ts - 1800 AND m.ts < i.start_ts
GROUP BY i.incident_id, d.component, d.kpi""")


def _points_b_sql(change):
    return f"""
WITH x AS (SELECT w.incident_id, w.component, w.kpi, w.ts, w.value, d.median_gap, d.scale, d.high, d.low, d.median,
  {saturation_sql('w.kpi', 'w.value', 'd.median', 'd.high')} AS sat, b.baseline_mean
  FROM in_window w JOIN day_stats_r d USING (component, kpi, day) LEFT JOIN pre_fault_day b USING (incident_id, component, kpi)),
h AS (SELECT incident_id, component, kpi, CASE WHEN count(*) < 3 THEN 0
  WHEN {sql_any('kpi', V.MEMORY_WORDS)} AND max(median) >= 90 THEN
    CASE WHEN avg(CASE WHEN value >= 95 THEN 1 ELSE 0 END) >= 0.7 THEN least(1, 0.3 + (avg(value) - 90) / 15) ELSE 0 END
  WHEN contains(kpi, 'cpu') AND {sql_any('kpi', ('util', 'percent', 'pct'))} AND max(median) >= 80 THEN
    CASE WHEN avg(CASE WHEN value >= 90 THEN 1 ELSE 0 END) >= 0.7 THEN least(1, 0.25 + (avg(value) - 80) / 20) ELSE 0 END
  ELSE 0 END AS held FROM x GROUP BY incident_id, component, kpi),
y AS (SELECT x.*, held, greatest(0, (value - high) / greatest(abs(high), scale, 1e-6)) AS rh,
  greatest(0, (low - value) / greatest(abs(low), scale, 1e-6)) * CASE WHEN {sql_any('kpi', V.LOW_SENSITIVE_WORDS)} THEN 1 ELSE 0.25 END AS rl,
  {change} AS change FROM x JOIN h USING (incident_id, component, kpi)),
z AS (SELECT *, greatest(CASE WHEN rh > 1 THEN 0.3 * rh ELSE rh END, sat, change, held) AS hi, CASE WHEN rl > 1 THEN 0.3 * rl ELSE rl END AS lo FROM y)
SELECT incident_id, component, kpi, ts, value, median_gap, greatest(hi, lo) AS deviation,
  CASE WHEN hi >= lo THEN 'high' ELSE 'low' END AS direction, CASE WHEN hi >= lo THEN high ELSE low END AS threshold
FROM z WHERE greatest(hi, lo) > 0"""


def _segments_b_sql(points, beta, min_points):
    return f"""
WITH c AS (SELECT * FROM {points} WHERE deviation >= {beta}),
f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= greatest(180, median_gap * 3) THEN 0 ELSE 1 END AS fresh FROM c
  WINDOW w AS (PARTITION BY incident_id, component, kpi ORDER BY ts)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY incident_id, component, kpi ORDER BY ts) AS island FROM f)
SELECT incident_id, component, kpi, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_points, max(deviation) AS max_deviation,
  round(max(deviation), 6) AS severity, {hint_sql("lower(kpi || ' metric_container.csv')", V.REASON_HINT_RULES)} AS reason_hint,
  arg_max(value, (deviation, -ts)) AS peak_value, arg_max(threshold, (deviation, -ts)) AS threshold,
  arg_max(direction, (deviation, -ts)) AS direction, list(struct_pack(ts := ts, dev := deviation) ORDER BY ts) AS pts
FROM i GROUP BY incident_id, component, kpi, island HAVING count(*) >= {min_points}"""


cte("points_b", _points_b_sql(
    "coalesce(0.3 * least(1, 0.5 * abs(value - baseline_mean) / greatest(abs(baseline_mean), 1)), 0)"))
cte("points_b2", _points_b_sql("0"))
cte("segments_b", _segments_b_sql("points_b", BETA, MIN_POINTS))
cte("segments_b2", _segments_b_sql("points_b2", 0.5, 1))
_SEG_COLS = """incident_id, component, kpi, start_ts, end_ts, n_points, severity, reason_hint, peak_value,
  round(threshold, 6) AS threshold, direction"""


def points_b(spark, sf_dir):
    return stage(spark, sf_dir, "points_b", lambda: D.points_b(
        T.raw_metrics(spark, sf_dir), stats_table(spark, sf_dir), T.incidents(spark, sf_dir)))


def segments(spark, sf_dir):
    """Segments of detector B, the table most later stages read."""
    return stage(spark, sf_dir, "segments_b", lambda: D.segments_b(
        points_b(spark, sf_dir), T.REASONS, BETA, MIN_POINTS, T.METRIC_FILE))


@query("det2_segments_b", f"SELECT {_SEG_COLS} FROM segments_b")
def det2(spark, sf_dir):
    pts = D.points_b(T.raw_metrics(spark, sf_dir), stats_relaxed(spark, sf_dir), T.incidents(spark, sf_dir))
    return D.segments_b(pts, T.REASONS, BETA, MIN_POINTS, T.METRIC_FILE).select(
        "incident_id", "component", "kpi", "start_ts", "end_ts", "n_points", "severity", "reason_hint", "peak_value",
        r("threshold"), "direction")


@query("det2_segments_b_no_baseline", f"SELECT {_SEG_COLS} FROM segments_b2")
def det2_plain(spark, sf_dir):
    pts = D.points_b(T.raw_metrics(spark, sf_dir), stats_relaxed(spark, sf_dir), T.incidents(spark, sf_dir), None)
    return D.segments_b(pts, T.REASONS, 0.5, 1, T.METRIC_FILE).select(
        "incident_id", "component", "kpi", "start_ts", "end_ts", "n_points", "severity", "reason_hint", "peak_value",
        r("threshold"), "direction")


cte("intensity", "SELECT incident_id, component, ts, max(deviation) AS intensity FROM points_b GROUP BY ALL")


@query("agg26_intensity", "SELECT incident_id, component, ts, round(intensity, 6) AS intensity FROM intensity")
def intensity(spark, sf_dir):
    return D.intensity(points_b(spark, sf_dir)).withColumn("intensity", S.rounded(F.col("intensity"), 6))


cte("relative_dev", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY incident_id, kpi ORDER BY max_deviation) AS rn,
  count(*) OVER (PARTITION BY incident_id, kpi) AS n FROM segments_b),
m AS (SELECT incident_id, kpi, max_deviation AS med FROM o WHERE rn = n // 2 + 1)
SELECT s.*, max_deviation / greatest(med, 0.01) AS relative FROM segments_b s JOIN m USING (incident_id, kpi)""")
cte("scores", """
SELECT incident_id, component, round(least(3, max(relative) * (1 + 0.15 * (count(DISTINCT kpi) - 1))) / 3, 6) AS score,
  min(start_ts) AS first_ts, count(DISTINCT kpi) AS kpis FROM relative_dev GROUP BY ALL""")


def scores(spark, sf_dir):
    return stage(spark, sf_dir, "scores", lambda: D.severity_ratio(segments(spark, sf_dir)))


@query("agg22_severity_ratio", "SELECT * FROM scores")
def severity_ratio(spark, sf_dir):
    return D.severity_ratio(segments(spark, sf_dir))


cte("scores_idf", """
WITH n AS (SELECT incident_id, count(DISTINCT component) AS nc FROM segments_b GROUP BY ALL),
i AS (SELECT incident_id, kpi, greatest(0.05, ln((1.0 + any_value(nc)) / (1.0 + count(DISTINCT component)))) AS idf
  FROM segments_b JOIN n USING (incident_id) GROUP BY incident_id, kpi),
w AS (SELECT incident_id, component, CAST(max(relative * idf) * (1 + 0.10 * (count(DISTINCT kpi) - 1)) AS DOUBLE) AS raw0, min(start_ts) AS first_ts
  FROM relative_dev JOIN i USING (incident_id, kpi) GROUP BY ALL),
v AS (SELECT incident_id, component, first_ts, round(raw0, 9) AS raw FROM w)
SELECT a.incident_id, a.component, a.first_ts, round(least(1, 0.6 * least(1, a.raw / greatest((SELECT max(raw) FROM v b WHERE b.incident_id = a.incident_id), 1e-6))
  + 0.4 * (1 - (SELECT count(*) FROM v b WHERE b.incident_id = a.incident_id AND b.raw >= a.raw)::DOUBLE / nc)), 6) AS score
FROM v a JOIN n ON n.incident_id = a.incident_id""")


@query("agg23_severity_idf", "SELECT incident_id, component, score, first_ts FROM scores_idf")
def severity_idf(spark, sf_dir):
    return D.severity_idf(segments(spark, sf_dir))


cte("cands", """
SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, component) AS rank FROM scores
WHERE score > 0.05 QUALIFY rank <= 30""")


def candidates(spark, sf_dir):
    return D.candidates(scores(spark, sf_dir))


@query("det3_candidate_set", "SELECT incident_id, component, score, first_ts, kpis, CAST(rank AS INTEGER) AS rank FROM cands")
def det3(spark, sf_dir):
    """Flagship: thresholds, range join, deviations, islands, severity and top components in one plan."""
    pts = D.points_b(T.raw_metrics(spark, sf_dir), stats_relaxed(spark, sf_dir), T.incidents(spark, sf_dir))
    seg = D.segments_b(pts, T.REASONS, BETA, MIN_POINTS, T.METRIC_FILE)
    return D.candidates(D.severity_ratio(seg))


@query("det3_kpi_onsets", "SELECT incident_id, component, kpi, min(start_ts) AS onset FROM segments_b GROUP BY ALL")
def kpi_onsets(spark, sf_dir):
    return D.kpi_onsets(segments(spark, sf_dir))


cte("layers", """
SELECT incident_id, ctype AS layer, max(score) AS layer_score FROM cands JOIN component_types USING (component) GROUP BY ALL""")


@query("agg27_layer_score", "SELECT * FROM layers")
def layer_scores(spark, sf_dir):
    return D.layer_scores(candidates(spark, sf_dir))


cte("refined", """
WITH p AS (SELECT incident_id, arg_max(layer, (layer_score, layer)) AS prim, max(layer_score) AS best FROM layers GROUP BY ALL),
k AS (SELECT c.incident_id, c.component, c.score, t.ctype AS layer, prim, best, t.ctype = prim OR c.score >= 0.5 * best AS refined
  FROM cands c JOIN component_types t USING (component) JOIN p USING (incident_id))
SELECT *, NOT (sum(refined::INT) OVER (PARTITION BY incident_id) = 1 AND best >= 0.8) AS needs_causal FROM k""")


@query("det4_layer_filter", """
SELECT incident_id, component, score, layer, prim AS "primary", refined, needs_causal FROM refined""")
def det4(spark, sf_dir):
    return D.layer_filter(candidates(spark, sf_dir))
