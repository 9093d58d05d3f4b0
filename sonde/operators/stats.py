"""Day thresholds, robust scores, exact percentiles of unbounded groups, quality profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonde.functions import fixed as V
from sonde.functions import scalars as S
from sonde.functions import series as A
from sonde.operators.windows import SERIES, window_join, with_roles
from sonde.sources.telemetry import mean_per_timestamp


def day_thresholds(metrics: DataFrame, high: float = 0.95, low: float = 0.05) -> DataFrame:
    """Whole-day thresholds per series, never restricted to an incident window.

    Timestamps are made unique first (partial aggregation), which bounds a series-day to
    86,400 values and makes the exact percentile safe whatever the row skew. The median
    sampling gap uses the same partitioning.
    """
    keys = [*SERIES, "day"]
    unique = mean_per_timestamp(metrics, keys)
    w = W.partitionBy(*keys).orderBy("ts")
    gaps = unique.withColumn("gap", F.col("ts") - F.lag("ts").over(w))
    probs = F.array(*[F.lit(p) for p in (high, low, 0.50, 0.25, 0.75, 0.10)])
    s = gaps.groupBy(*keys).agg(
        F.percentile("value", probs).alias("q"), F.count("*").alias("n"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.floor(F.coalesce(F.percentile("gap", F.lit(0.5)), F.lit(60.0))).cast("bigint").alias("median_gap"))
    q = F.col("q")
    s = s.select(
        *keys, "n", "std", "median_gap", q[0].alias("high"), q[1].alias("low"), q[2].alias("median"),
        (q[4] - q[3]).alias("iqr"), q[5].alias("q10"))
    scale = F.greatest(F.col("iqr") / V.IQR_TO_SIGMA, F.col("std"),
                       F.abs(F.col("high") - F.col("low")) / 3.0, F.abs("median") * 0.05, F.lit(1e-6))
    return s.withColumn("scale", scale)


def drop_dead_series(stats: DataFrame) -> DataFrame:
    """Drop series that never change."""
    dead = (F.col("std") / F.greatest(F.abs("median"), F.lit(1e-6)) < 0.001) & (F.col("iqr") < 1e-4)
    return stats.filter(~dead)


#: Cells into which the bracket of a wanted rank is cut.
CELLS = 1024


def exact_percentiles(df: DataFrame, keys, value: str, probs: dict[str, float],
                      accuracy: int = 10000, interpolate: bool = True) -> DataFrame:
    """Exact percentiles of groups of any size: interpolated, or the element at floor(n * p).

    A mergeable sketch gives each wanted rank a bracket that surely holds it. Rows meet the
    brackets of their key and are folded where they are read: what lies outside a bracket is
    a count, what lies inside a counted value. A bracket is cut into ``CELLS`` equal cells, and
    only the values of the cells that hold the rank are put in order, so no task sees more
    than about 4 / accuracy / CELLS of a group's values, however large the group.
    """
    keys = list(keys)
    slack = 2.0 / accuracy
    bounds = []
    for p in probs.values():
        bounds += [max(0.0, p - slack), min(1.0, p + slack)]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", F.array(*[F.lit(b) for b in bounds]), F.lit(accuracy)).alias("_b"),
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))

    def bracket(i, p):
        # ranks floor(pos) and ceil(pos), zero-based, must both lie inside
        lo = F.when(F.lit(bounds[2 * i]) <= 0, F.col("_min")).otherwise(F.col("_b")[2 * i])
        hi = F.when(F.lit(bounds[2 * i + 1]) >= 1, F.col("_max")).otherwise(F.col("_b")[2 * i + 1])
        return F.struct(F.lit(i).alias("i"), lo.alias("lo"), hi.alias("hi"),
                        ((F.col("_n") - 1) * F.lit(p) if interpolate else F.least(
                            F.col("_n") - 1, F.floor(F.col("_n") * F.lit(p)))).cast("double").alias("pos"))

    targets = sketch.select(*keys, "_n", F.array(*[
        bracket(i, p) for i, p in enumerate(probs.values())]).alias("_t"))
    hit = rows.join(targets, keys).select(*keys, "_v", F.explode("_t").alias("t"))
    width = F.col("t.hi") - F.col("t.lo")
    inner = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("t.lo")) / width * CELLS), F.lit(CELLS - 1))).otherwise(0)
    cell = F.when(F.col("_v") < F.col("t.lo"), -1).when(F.col("_v") <= F.col("t.hi"), inner).otherwise(CELLS).cast("int")
    folded = (hit.groupBy(*keys, F.col("t.i").alias("i"), F.col("t.pos").alias("pos"), cell.alias("_cell"),
                          F.when(cell.between(0, CELLS - 1), F.col("_v")).alias("_in"))
              .agg(F.count("*").alias("_c"), F.min("_v").alias("_first"), F.max("_v").alias("_last")))
    before = W.partitionBy(*keys, "i").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = folded.groupBy(*keys, "i", "pos", "_cell").agg(F.sum("_c").alias("_n")).withColumn(
        "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    wanted = cells.filter((F.floor("pos") < F.col("_start") + F.col("_n")) & (F.ceil("pos") >= F.col("_start"))).select(*keys, "i", "_cell", "_start")
    # what lies outside a bracket is one row on each side; of it a wanted rank can only be
    # the last one below or the first one above
    upto = F.col("_start") + F.sum("_c").over(W.partitionBy(*keys, "i", "_cell").orderBy("_in").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = (folded.join(wanted, [*keys, "i", "_cell"]).withColumn("_hi", upto - 1).withColumn("_lo", F.col("_hi") - F.col("_c") + 1)
              .withColumn("_v", F.when(F.col("_cell") == CELLS, F.col("_first")).otherwise(F.col("_last"))))
    at_floor = F.max(F.when(F.floor("pos").between(F.col("_lo"), F.col("_hi")), F.col("_v")))
    at_ceil = F.max(F.when(F.ceil("pos").between(F.col("_lo"), F.col("_hi")), F.col("_v")))
    found = ranked.groupBy(*keys, "i").agg(
        (at_floor + (at_ceil - at_floor) * (F.max("pos") - F.floor(F.max("pos")))).alias("q"))
    out = found.groupBy(*keys).agg(*[
        F.max(F.when(F.col("i") == i, F.col("q"))).alias(name) for i, name in enumerate(probs)])
    return out


def scored_arrays(filled: DataFrame, incidents: DataFrame, multiplier: int = 3) -> DataFrame:
    """Ordered incident and baseline values per (incident, series) of a resampled series.

    The arrays are bounded by the bins of the windows. With the ``empty`` mark of the
    resampling, the share of empty bins comes along.
    """
    rows = with_roles(filled, incidents, multiplier).filter(F.col("value").isNotNull())
    point = F.struct("ts", "value")
    pick = lambda role: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("role") == role, point))), lambda p: p["value"])
    share = [F.avg(F.col("empty").cast("double")).alias("missing_share")] if "empty" in filled.columns else []
    return rows.groupBy("incident_id", *SERIES).agg(pick("i").alias("inc"), pick("b").alias("base"), *share)


def traditional_scores(arrays: DataFrame, threshold=None) -> DataFrame:
    """Threshold, robust z, change-rate and deviation scores and their fusion."""
    eps = V.EPS
    df = (arrays
          .withColumn("_sorted", F.array_sort("base"))
          .withColumn("med", A.quantile_sorted(F.col("_sorted"), 0.5))
          .withColumn("q99", F.lit(threshold) if threshold is not None
                      else A.quantile_sorted(F.col("_sorted"), 0.99))
          .withColumn("mad", A.mad(F.col("base"), F.col("med")))
          .withColumn("_rates", A.change_rates(F.col("inc"), eps))
          .withColumn("_base_rates", A.change_rates(F.col("base"), eps))
          .withColumn("_rm", A.median(F.col("_base_rates")))
          .withColumn("_rmad", A.mad(F.col("_base_rates"), F.col("_rm")))
          .withColumn("max_rate", F.coalesce(F.array_max("_rates"), F.lit(0.0)))
          .withColumn("max_value", F.array_max("inc"))
          .withColumn("max_dev", F.array_max(F.transform("inc", lambda x: F.abs(x - F.col("med"))))))
    scale = V.MAD_TO_SIGMA * F.col("mad") + eps
    rate_scale = V.MAD_TO_SIGMA * F.col("_rmad") + eps
    one = F.lit(1.0)
    df = (df
          .withColumn("threshold_score", F.when(F.col("q99") <= eps, 0.0).otherwise(
              S.clamp((F.col("max_value") - F.col("q99")) / (F.abs("q99") + eps))))
          .withColumn("max_abs_z", F.col("max_dev") / scale)
          .withColumn("z_score", F.least(one, F.col("max_abs_z") / 5.0))
          .withColumn("rate_score", F.when(
              (F.size("inc") < 2) | (F.size("base") < 2), 0.0).otherwise(
              S.clamp((F.col("max_rate") - F.col("_rm")) / rate_scale / 5.0)))
          .withColumn("deviation_score", F.least(one, F.col("max_dev") / scale / 5.0)))
    t = V.TRADITIONAL_WEIGHTS
    fused = (t["threshold"] * F.col("threshold_score") + t["zscore"] * F.col("z_score")
             + t["rate"] * F.col("rate_score") + t["deviation"] * F.col("deviation_score"))
    return df.withColumn("traditional_score", fused).drop("_sorted", "_rates", "_base_rates", "_rm", "_rmad")


def pre_fault_mean(metrics: DataFrame, stats: DataFrame, incidents: DataFrame, seconds: int = 1800) -> DataFrame:
    """Mean of the half hour before the incident per (incident, series); day median if empty."""
    before = incidents.select(
        "incident_id", F.floor(F.col("start_ts") / 86400).cast("bigint").alias("_d"),
        (F.col("start_ts") - seconds).alias("from_ts"), (F.col("start_ts") - 1).alias("to_ts"))
    means = window_join(metrics, before, start="from_ts", end="to_ts").groupBy(
        "incident_id", *SERIES).agg(F.avg("value").alias("_m"))
    base = stats.join(before.select("incident_id", F.col("_d").alias("day")), "day")
    return base.join(means, ["incident_id", *SERIES], "left").select(
        "incident_id", *SERIES, F.coalesce("_m", "median").alias("baseline_mean"))


def data_quality(incidents: DataFrame, metrics: DataFrame, spans: DataFrame, logs: DataFrame, files: DataFrame,
                 logs_optional: bool = False) -> DataFrame:
    """Files of the day, series, series with rows in the window, span and log rows, and the quality score.

    ``files`` holds (day, kind, file_name) with the kinds metric, trace and log; a dataset without
    logs (``logs_optional``) loses nothing by their absence.
    """
    day = incidents.select("incident_id", "start_ts", "end_ts",
                           F.floor(F.col("start_ts") / 86400).cast("bigint").alias("day"))
    per_series = metrics.join(day, "day").groupBy("incident_id", *SERIES).agg(
        F.max(F.col("ts").between(F.col("start_ts"), F.col("end_ts")).cast("int")).alias("hit"))
    m = per_series.groupBy("incident_id").agg(
        F.count("*").alias("metric_series"), F.sum("hit").alias("series_with_window_rows"))
    t = window_join(spans, incidents).groupBy("incident_id").agg(F.count("*").alias("trace_rows"))
    lg = window_join(logs, incidents).groupBy("incident_id").agg(F.count("*").alias("log_rows"))
    found = files.select("day", "kind", "file_name").distinct().groupBy("day").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_files") for k in ("metric", "trace", "log")])
    f = day.join(found, "day").drop("day", "start_ts", "end_ts")
    out = incidents.select("incident_id").join(f, "incident_id", "left").join(m, "incident_id", "left").join(
        t, "incident_id", "left").join(lg, "incident_id", "left").na.fill(0)
    parts = [("metric_files", 0.35), ("metric_series", 0.35), ("series_with_window_rows", 0.15), ("trace_files", 0.10)]
    log_part = F.lit(0.05) if logs_optional else F.when(F.col("log_files") > 0, 0.05).otherwise(0.0)
    score = reduce(lambda a, b: a + b, [F.when(F.col(c) > 0, w).otherwise(0.0) for c, w in parts]) + log_part
    return out.withColumn("quality", S.rounded(score, 4))


def component_coverage(incidents: DataFrame, rows: DataFrame) -> DataFrame:
    """Components of the whole day against those with rows in the window."""
    day = incidents.select("incident_id", F.floor(F.col("start_ts") / 86400).cast("bigint").alias("day"))
    full = rows.select("day", "component").distinct().join(day, "day").select("incident_id", "component")
    seen = window_join(rows, incidents).select("incident_id", "component").distinct()
    gone = full.join(seen, ["incident_id", "component"], "left_anti")
    kind = S.component_type(F.col("component"))
    order = S.first_match([(kind == k, i) for i, k in enumerate(("db", "redis", "service", "middleware"))], 5)
    only = gone.groupBy("incident_id").agg(F.array_sort(F.collect_list(
        F.struct(order.alias("o"), F.col("component")))).alias("g"))
    n_day = full.groupBy("incident_id").agg(F.count("*").alias("day_components"))
    n_win = seen.groupBy("incident_id").agg(F.count("*").alias("window_components"))
    return (incidents.select("incident_id").join(n_day, "incident_id", "left")
            .join(n_win, "incident_id", "left").join(only, "incident_id", "left")
            .select("incident_id", F.coalesce("day_components", F.lit(0)).alias("day_components"),
                    F.coalesce("window_components", F.lit(0)).alias("window_components"),
                    F.coalesce(F.array_join(F.col("g.component"), ","), F.lit("")).alias("only_in_day")))
