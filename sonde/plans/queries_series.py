"""Registered queries: range joins, thresholds, robust scores, resampling, onsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.functions import scalars as S
from sonde.operators import stats as ST
from sonde.operators import windows as WN
from sonde.plans.queries_sources import short_incidents
from sonde.plans.registry import cte, query
from sonde.sources import tables as T


def r(name, digits=6):
    return S.rounded(F.col(name), digits).alias(name)


# ------------------------------------------------------------------ windows and joins
cte("in_window", """
SELECT i.incident_id, m.component, m.kpi, m.day, m.ts, m.value
FROM metrics m JOIN incidents i ON m.ts BETWEEN i.start_ts AND i.end_ts""")


@query("scl1_window_filter", "SELECT incident_id, component, kpi, count(*) AS n FROM in_window GROUP BY ALL")
def window_filter(spark, sf_dir):
    inside = WN.window_join(T.raw_metrics(spark, sf_dir), T.incidents(spark, sf_dir))
    return inside.select("incident_id", "component", "kpi", "ts").distinct().groupBy(
        "incident_id", "component", "kpi").agg(F.count("*").alias("n"))


cte("roles", """
SELECT i.incident_id, m.*, CASE WHEN m.ts < i.start_ts THEN 'b' ELSE 'i' END AS role
FROM raw_metrics m JOIN incidents i
  ON m.ts >= i.start_ts - 3 * (i.end_ts - i.start_ts) AND m.ts <= i.end_ts""")


@query("scl2_baseline_window", """
SELECT incident_id, component, kpi, role, count(*) AS n, round(avg(value), 6) AS mean_value FROM roles GROUP BY ALL""")
def baseline_window(spark, sf_dir):
    return WN.with_roles(T.raw_metrics(spark, sf_dir), T.incidents(spark, sf_dir)).groupBy(
        "incident_id", "component", "kpi", "role").agg(
        F.count("*").alias("n"), S.rounded(F.avg("value"), 6).alias("mean_value"))


cte("day_stats", """
WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY component, kpi, day ORDER BY ts) AS gap FROM metrics),
s AS (SELECT component, kpi, day, count(*) AS n, coalesce(stddev_samp(value), 0) AS std,
  CAST(floor(coalesce(median(gap), 60)) AS BIGINT) AS median_gap,
  quantile_cont(value, 0.95) AS high, quantile_cont(value, 0.05) AS low, median(value) AS median,
  quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, quantile_cont(value, 0.10) AS q10
  FROM g GROUP BY ALL)
SELECT *, greatest(iqr / 1.349, std, abs(high - low) / 3, abs(median) * 0.05, 1e-6) AS scale FROM s""")


@query("agg1_day_thresholds", """
SELECT component, kpi, day, n, round(std, 6) AS std, median_gap, round(high, 6) AS high, round(low, 6) AS low,
  round(median, 6) AS median, round(iqr, 6) AS iqr, round(q10, 6) AS q10, round(scale, 6) AS scale FROM day_stats""")
def day_thresholds(spark, sf_dir):
    return ST.day_thresholds(T.raw_metrics(spark, sf_dir)).select(
        "component", "kpi", "day", "n", "median_gap", r("std"), r("high"), r("low"), r("median"),
        r("iqr"), r("q10"), r("scale"))


@query("src17_dead_series", """
WITH flat AS (SELECT component, kpi, day, ts, CASE WHEN component = 'node-1' THEN 5.0 ELSE value END AS value FROM metrics),
s AS (SELECT component, kpi, day, count(*) AS n, coalesce(stddev_samp(value), 0) AS std, median(value) AS med,
  quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM flat GROUP BY ALL)
SELECT component, kpi, day, n FROM s WHERE NOT (std / greatest(abs(med), 1e-6) < 0.001 AND iqr < 1e-4)""")
def dead_series(spark, sf_dir):
    flat = T.raw_metrics(spark, sf_dir).withColumn(
        "value", F.when(F.col("component") == "node-1", 5.0).otherwise(F.col("value")))
    return ST.drop_dead_series(ST.day_thresholds(flat)).select("component", "kpi", "day", "n")


cte("pre_fault", """
SELECT i.incident_id, d.component, d.kpi, coalesce(avg(m.value), any_value(d.median)) AS baseline_mean
FROM short_incidents i JOIN day_stats d ON d.day = i.start_ts // 86400
LEFT JOIN raw_metrics m ON m.component = d.component AND m.kpi = d.kpi AND m.ts >= i.start_ts - 1800 AND m.ts < i.start_ts
GROUP BY i.incident_id, d.component, d.kpi""")


@query("scl3_pre_fault_mean", "SELECT incident_id, component, kpi, round(baseline_mean, 6) AS baseline_mean FROM pre_fault")
def pre_fault_mean(spark, sf_dir):
    m = T.raw_metrics(spark, sf_dir)
    return ST.pre_fault_mean(m, ST.day_thresholds(m), short_incidents(spark, sf_dir)).select(
        "incident_id", "component", "kpi", r("baseline_mean"))


@query("join1_range_join", """
SELECT i.incident_id, e.component, count(*) AS spans, sum(CASE WHEN e.success THEN 0 ELSE 1 END)::BIGINT AS failed
FROM spans e JOIN span_incidents i ON e.ts BETWEEN i.start_ts AND i.end_ts GROUP BY ALL""")
def range_join(spark, sf_dir):
    # thirty-day windows: day-wide slots keep the exploded windows small
    return WN.window_join(T.spans(spark, sf_dir), T.span_incidents(spark, sf_dir), width=86400).groupBy(
        "incident_id", "component").agg(F.count("*").alias("spans"), F.count_if(~F.col("success")).alias("failed"))


@query("join10_label_lookup", """
SELECT i.incident_id, r.row_id, r.component, r.reason FROM records r JOIN short_incidents i
ON r.ts BETWEEN i.start_ts - 900 AND i.end_ts + 900""")
def label_lookup(spark, sf_dir):
    inc = short_incidents(spark, sf_dir).select(
        "incident_id", (F.col("start_ts") - 900).alias("start_ts"), (F.col("end_ts") + 900).alias("end_ts"))
    return WN.window_join(T.records(spark, sf_dir), inc).select("incident_id", "row_id", "component", "reason")


# ------------------------------------------------------------------ resampled series
cte("hour_bins", """
SELECT component, kpi, day, ts // 3600 * 3600 AS ts, avg(value) AS value FROM raw_metrics GROUP BY ALL""")
cte("resampled", """
WITH span AS (SELECT component, kpi, day, min(ts) AS a, max(ts) AS b FROM hour_bins GROUP BY ALL),
grid AS (SELECT component, kpi, day, unnest(range(a, b + 1, 3600)) AS ts FROM span)
SELECT component, kpi, day, ts, value FROM grid LEFT JOIN hour_bins USING (component, kpi, day, ts)""")
cte("filled", """
WITH n AS (SELECT *, row_number() OVER w AS pos FROM resampled WINDOW w AS (PARTITION BY component, kpi, day ORDER BY ts)),
k AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, first_value(value IGNORE NULLS) OVER f AS v1,
  last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0,
  first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS p1 FROM n
  WINDOW b AS (PARTITION BY component, kpi, day ORDER BY ts ROWS UNBOUNDED PRECEDING),
  f AS (PARTITION BY component, kpi, day ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT component, kpi, day, ts, coalesce(value, v0 + (v1 - v0) * ((pos - p0) / (p1 - p0)), v0, v1) AS value, v0 FROM k""")


@query("win1_resample", "SELECT component, kpi, day, ts, round(value, 6) AS value FROM resampled")
def resample(spark, sf_dir):
    return WN.resample(T.raw_metrics(spark, sf_dir), 3600).withColumn("value", S.rounded(F.col("value"), 6))


@query("win2_fill_missing", """
SELECT component, kpi, day, ts, round(value, 6) AS linear, round(v0, 6) AS ffilled FROM filled""")
def fill_missing(spark, sf_dir):
    bins = WN.resample(T.raw_metrics(spark, sf_dir), 3600)
    lin = WN.fill_missing(bins).select("component", "kpi", "day", "ts", S.rounded(F.col("value"), 6).alias("linear"))
    ff = WN.fill_missing(bins, "ffill").select("component", "kpi", "day", "ts", S.rounded(F.col("value"), 6).alias("ffilled"))
    return lin.join(ff, ["component", "kpi", "day", "ts"])


@query("win10_change_rate", """
SELECT component, kpi, day, ts, round(abs(value - p) / (abs(p) + 1e-8), 4) AS rate FROM (
  SELECT *, lag(value) OVER (PARTITION BY component, kpi, day ORDER BY ts) AS p FROM filled) WHERE p IS NOT NULL""")
def change_rate(spark, sf_dir):
    from pyspark.sql import Window as W
    x = WN.resampled_filled(T.raw_metrics(spark, sf_dir), 3600)
    p = F.lag("value").over(W.partitionBy("component", "kpi", "day").orderBy("ts"))
    return x.withColumn("p", p).filter("p IS NOT NULL").select(
        "component", "kpi", "day", "ts",
        S.rounded(F.abs(F.col("value") - F.col("p")) / (F.abs("p") + 1e-8), 4).alias("rate"))


@query("scl29_normalise", """
WITH s AS (SELECT component, kpi, day, min(value) AS lo, max(value) AS hi, avg(value) AS m, stddev_pop(value) AS sd
  FROM metrics GROUP BY ALL)
SELECT component, kpi, day, ts, CASE WHEN hi - lo < 1e-12 THEN 0 ELSE round((value - lo) / (hi - lo), 6) + 0.0 END::DOUBLE AS minmax,
  CASE WHEN sd < 1e-12 THEN 0 ELSE round((value - m) / sd, 6) + 0.0 END::DOUBLE AS zscore
FROM metrics JOIN s USING (component, kpi, day)""")
def normalise(spark, sf_dir):
    from sonde.sources.telemetry import mean_per_timestamp
    m = mean_per_timestamp(T.raw_metrics(spark, sf_dir), ["component", "kpi", "day"])
    a = WN.normalise(m).withColumnRenamed("normalised", "minmax")
    b = WN.normalise(a, "zscore").withColumnRenamed("normalised", "zscore")
    return b.select("component", "kpi", "day", "ts", r("minmax"), r("zscore"))


cte("fixed_roles", """
SELECT i.incident_id, f.component, f.kpi, f.ts, f.value, CASE WHEN f.ts < i.start_ts THEN 'b' ELSE 'i' END AS role
FROM filled f JOIN incidents i ON f.ts >= i.start_ts - 3 * (i.end_ts - i.start_ts) AND f.ts <= i.end_ts""")
cte("base_stats", """
WITH c AS (SELECT incident_id, component, kpi, median(value) AS med, quantile_cont(value, 0.99) AS q99, count(*) AS n
  FROM fixed_roles WHERE role = 'b' GROUP BY ALL)
SELECT incident_id, component, kpi, any_value(med) AS med, any_value(q99) AS q99, median(abs(value - med)) AS mad, any_value(c.n) AS n_base
FROM fixed_roles JOIN c USING (incident_id, component, kpi) WHERE role = 'b' GROUP BY ALL""")
cte("rates", """
SELECT incident_id, component, kpi, role, abs(value - p) / (abs(p) + 1e-8) AS rate FROM (
  SELECT *, lag(value) OVER (PARTITION BY incident_id, component, kpi, role ORDER BY ts) AS p FROM fixed_roles)
WHERE p IS NOT NULL""")
cte("rate_stats", """
WITH c AS (SELECT incident_id, component, kpi, median(rate) AS rm FROM rates WHERE role = 'b' GROUP BY ALL)
SELECT incident_id, component, kpi, any_value(rm) AS rm, median(abs(rate - rm)) AS rmad
FROM rates JOIN c USING (incident_id, component, kpi) WHERE role = 'b' GROUP BY ALL""")
cte("traditional", """
WITH x AS (SELECT incident_id, component, kpi, max(value) AS mx, count(*) AS n_inc, max(abs(value - med)) AS dev,
  any_value(med) AS med, any_value(q99) AS q99, any_value(mad) AS mad, any_value(n_base) AS n_base
  FROM fixed_roles JOIN base_stats USING (incident_id, component, kpi) WHERE role = 'i' GROUP BY ALL),
y AS (SELECT incident_id, component, kpi, max(rate) AS mr FROM rates WHERE role = 'i' GROUP BY ALL),
z AS (SELECT x.*, coalesce(y.mr, 0) AS max_rate, CASE WHEN q99 <= 1e-8 THEN 0 ELSE least(1, greatest(0, (mx - q99) / (abs(q99) + 1e-8))) END AS thr,
  dev / (1.4826 * mad + 1e-8) AS maxz,
  CASE WHEN n_inc < 2 OR n_base < 2 THEN 0 ELSE least(1, greatest(0, (mr - rm) / (1.4826 * rmad + 1e-8) / 5)) END AS rate_s
  FROM x LEFT JOIN y USING (incident_id, component, kpi) LEFT JOIN rate_stats USING (incident_id, component, kpi))
SELECT *, least(1, maxz / 5) AS zs, 0.2 * thr + 0.35 * least(1, maxz / 5) + 0.25 * rate_s + 0.2 * least(1, maxz / 5) AS trad FROM z""")


def arrays(spark, sf_dir):
    return ST.scored_arrays(WN.resampled_filled(T.raw_metrics(spark, sf_dir), 3600), T.incidents(spark, sf_dir))


@query("agg2_median_mad", "SELECT incident_id, component, kpi, round(med, 6) AS med, round(mad, 6) AS mad FROM base_stats "
       "JOIN (SELECT incident_id, component, kpi FROM traditional) USING (incident_id, component, kpi)")
def median_mad(spark, sf_dir):
    return ST.traditional_scores(arrays(spark, sf_dir)).filter("size(inc) > 0 AND size(base) > 0").select(
        "incident_id", "component", "kpi", r("med"), r("mad"))


_TRAD = "SELECT incident_id, component, kpi, round({0}, 4) + 0.0 AS {1} FROM traditional"


def _trad(spark, sf_dir, *cols):
    return ST.traditional_scores(arrays(spark, sf_dir).filter("size(inc) > 0 AND size(base) > 0")).select(
        "incident_id", "component", "kpi", *[r(c, 4) for c in cols])


@query("agg3_threshold_score", "SELECT incident_id, component, kpi, (round(thr, 4) + 0.0)::DOUBLE AS threshold_score FROM traditional")
def threshold_score(spark, sf_dir):
    return _trad(spark, sf_dir, "threshold_score")


@query("agg4_robust_z", "SELECT incident_id, component, kpi, round(maxz, 4) AS max_abs_z, round(zs, 4)::DOUBLE AS z_score FROM traditional")
def robust_z(spark, sf_dir):
    return _trad(spark, sf_dir, "max_abs_z", "z_score")


@query("agg5_change_rate_score", "SELECT incident_id, component, kpi, round(max_rate, 4) AS max_rate, (round(rate_s, 4) + 0.0)::DOUBLE AS rate_score FROM traditional")
def change_rate_score(spark, sf_dir):
    return _trad(spark, sf_dir, "max_rate", "rate_score")


@query("agg6_max_deviation", "SELECT incident_id, component, kpi, round(dev, 4) AS max_dev, round(zs, 4)::DOUBLE AS deviation_score FROM traditional")
def max_deviation(spark, sf_dir):
    return _trad(spark, sf_dir, "max_dev", "deviation_score")


@query("agg7_traditional_score", "SELECT incident_id, component, kpi, (round(trad, 4) + 0.0)::DOUBLE AS traditional_score FROM traditional")
def traditional(spark, sf_dir):
    return _trad(spark, sf_dir, "traditional_score")


@query("win11_multi_resolution_onset", """
WITH sizes AS (SELECT unnest([3600, 7200, 21600]) AS size),
starts AS (SELECT incident_id, start_ts, size, unnest(range(start_ts, end_ts - size + 1, size // 2)) AS ws FROM incidents, sizes),
means AS (SELECT s.incident_id, s.size, s.ws, m.component, m.kpi, m.day, avg(m.value) AS mean_value FROM starts s JOIN metrics m
  ON m.ts >= s.ws AND m.ts < s.ws + s.size GROUP BY ALL)
SELECT incident_id, component, CAST(size AS INTEGER) AS resolution, min(ws) AS onset
FROM means JOIN day_stats USING (component, kpi, day) WHERE mean_value > high * 0.9 GROUP BY ALL""")
def multi_resolution_onset(spark, sf_dir):
    from sonde.sources.telemetry import mean_per_timestamp
    m = T.raw_metrics(spark, sf_dir)
    unique = mean_per_timestamp(m, ["component", "kpi", "day"])
    return WN.multi_resolution_onset(unique, ST.day_thresholds(m), T.incidents(spark, sf_dir),
                                     sizes=(3600, 7200, 21600))


@query("win16_collision_flag", """
SELECT row_id, count(*) OVER (PARTITION BY ts // 1800) > 1 AS collides, count(*) OVER (PARTITION BY ts // 1800) AS num FROM records""")
def collisions(spark, sf_dir):
    from sonde.operators.tasks import collision_flag
    return collision_flag(T.records(spark, sf_dir)).select("row_id", "collides", "num")
