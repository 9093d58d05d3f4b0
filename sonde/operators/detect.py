"""Anomalous points and segments, component severity, candidates, layer filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonde.functions import fixed as V
from sonde.functions import scalars as S
from sonde.operators.windows import SERIES, islands, top_k, window_join

KEYS = ["incident_id", *SERIES]


def _with_stats(metrics: DataFrame, stats: DataFrame, incidents: DataFrame, before: int = 0) -> DataFrame:
    """Incident rows, one per timestamp, next to the statistics of their series-day.

    Only rows of the windows (and ``before`` seconds ahead of them) are made unique and
    shuffled; the range join reaches the scan first. What a KPI's name tells (``_traits``)
    is looked up once per series-day, not per row.
    """
    wide = incidents.select("incident_id", "start_ts", "end_ts", (F.col("start_ts") - before).alias("_from"))
    rows = window_join(metrics, wide, start="_from").groupBy(*KEYS, "day", "ts", "start_ts").agg(S.steady_mean(F.col("value")).alias("value"))
    return rows.join(stats.withColumn("_traits", S.kpi_traits(F.col("kpi"))), [*SERIES, "day"])


def points_a(metrics: DataFrame, stats: DataFrame, incidents: DataFrame, reasons,
             file_name: str = "") -> DataFrame:
    """Detector A: scaled distance beyond P95 or below P10 / P05, saturation, spike caps; cut 0.35.

    ``stats`` are the day thresholds at 0.95 / 0.05.
    """
    v, zero, traits = F.col("value"), F.lit(0.0), F.col("_traits")
    low_cut = F.when(S.has_trait(traits, "low_sensitive"), F.col("q10")).otherwise(F.col("low"))
    hint = S.reason_hint(F.concat("kpi", F.lit(f" {file_name}")), reasons, V.REASON_HINT_RULES_SHORT)
    df = (_with_stats(metrics, stats.filter("n >= 4").withColumn("reason_hint", hint), incidents)
          .withColumn("_high", F.greatest(
              zero, (v - F.col("high")) / F.col("scale"),
              S.saturation_open(F.col("kpi"), v, F.col("median"), F.col("high"), traits)))
          .withColumn("_cut", low_cut)
          .withColumn("_low", F.greatest(zero, (F.col("_cut") - v) / F.col("scale")))
          .withColumn("direction", F.when(F.col("_high") >= F.col("_low"), "high").otherwise("low"))
          .withColumn("threshold", F.when(F.col("direction") == "high", F.col("high")).otherwise(F.col("_cut"))))
    spike = F.when((F.col("high") <= 1e-9) & (F.abs(v) < 1.0),
                   F.when(F.col("reason_hint").isNotNull(), 2.5).otherwise(1.75)).otherwise(F.lit(1e308))
    agent = F.when(S.has_trait(traits, "agent"), 1.5).otherwise(F.lit(1e308))
    score = F.least(F.greatest("_high", "_low"), spike, agent)
    return df.withColumn("score", score).filter("score >= 0.35").select(
        *KEYS, "ts", "value", "score", "direction", "threshold", "median_gap", "reason_hint")


def persistence_weight(points: Column, duration: Column, gap: Column, hint: Column, kpi: Column) -> Column:
    """Weight of an island by its length; less without a hint and for monitoring agents."""
    base = (F.when(points <= 1, 0.28).when(points == 2, 0.65)
            .when(duration >= F.greatest(F.lit(240), gap * 4), 1.25).otherwise(1.0))
    return (base * F.when(hint.isNull(), 0.85).otherwise(1.0)
            * F.when(F.contains(F.lower(kpi), F.lit("zabbix_agentd")), 0.35).otherwise(1.0))


def segments_a(points: DataFrame, keep: int | None = 80) -> DataFrame:
    """Islands of detector A with severity (sum + max) * persistence; top ``keep`` per incident (None: all)."""
    runs = islands(points, KEYS, F.greatest(F.lit(180), F.col("median_gap") * 3))
    seg = runs.groupBy(*KEYS, "island", "median_gap", "reason_hint").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("points"),
        F.sum("score").alias("_sum"), F.max("score").alias("_max"),
        F.max_by(F.struct("value", "threshold", "direction"), F.struct("score", -F.col("ts"))).alias("peak"))
    weight = persistence_weight(F.col("points"), F.col("end_ts") - F.col("start_ts"), F.col("median_gap"),
                                F.col("reason_hint"), F.col("kpi"))
    seg = seg.withColumn("weight", weight).withColumn(
        "severity", S.rounded((F.col("_sum") + F.col("_max")) * F.col("weight"), 4))
    seg = seg.select(*KEYS, "start_ts", "end_ts", "points", "weight", "severity", "reason_hint", "peak.*")
    return top_k(seg, ["incident_id"], [F.desc("severity"), *SERIES, "start_ts"], keep)


def points_b(metrics: DataFrame, stats: DataFrame, incidents: DataFrame, baseline: int | None = 1800) -> DataFrame:
    """Detector B: deviation relative to the threshold, saturation, and change from the baseline.

    ``baseline`` is the length in seconds of the pre-fault window whose mean (day median when
    empty) the change term compares with; None switches the term off. Baseline and saturation
    are windows over the rows of an incident's series (bounded by a day of timestamps), in
    the partitioning and order that the islands use next, so reruns add in the same order.
    """
    v, zero, traits = F.col("value"), F.lit(0.0), F.col("_traits")
    rows = _with_stats(metrics, stats, incidents, baseline or 0)
    inside = F.col("ts") >= F.col("start_ts")
    w = W.partitionBy(*KEYS).orderBy("ts").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    over = lambda c: F.avg(F.when(inside, c)).over(w)
    memory, cpu = S.has_trait(traits, "memory"), S.has_trait(traits, "cpu_util")
    df = rows.select(
        "*", F.count(F.when(inside, v)).over(w).alias("_n"), over(v).alias("_mean"),
        over((v >= 95).cast("double")).alias("_at95"), over((v >= 90).cast("double")).alias("_at90"),
        F.avg(F.when(~inside, v)).over(w).alias("_before")).filter(inside)
    held = (F.when(F.col("_n") < 3, 0.0)
            .when(memory & (F.col("median") >= 90), F.when(
                F.col("_at95") >= 0.7, F.least(F.lit(1.0), 0.30 + (F.col("_mean") - 90.0) / 15.0)).otherwise(0.0))
            .when(cpu & (F.col("median") >= 80), F.when(
                F.col("_at90") >= 0.7, F.least(F.lit(1.0), 0.25 + (F.col("_mean") - 80.0) / 20.0)).otherwise(0.0)).otherwise(0.0))
    if baseline is not None:
        base = F.coalesce("_before", "median")
        change = 0.3 * F.least(F.lit(1.0), 0.5 * F.abs(v - base) / F.greatest(F.abs(base), F.lit(1.0)))
    else:
        change = zero

    def relative(distance: Column, threshold: Column) -> Column:
        return F.greatest(zero, distance / F.greatest(F.abs(threshold), F.col("scale"), F.lit(1e-6)))

    def squeeze(c: Column) -> Column:
        return F.when(c > 1.0, 0.3 * c).otherwise(c)

    high = relative(v - F.col("high"), F.col("high"))
    low = relative(F.col("low") - v, F.col("low")) * F.when(S.has_trait(traits, "low_sensitive"), 1.0).otherwise(0.25)
    df = (df.withColumn("_hi", F.greatest(
              squeeze(high), S.saturation_bounded(F.col("kpi"), v, F.col("median"), F.col("high"), traits), change, held))
          .withColumn("_lo", squeeze(low))
          .withColumn("direction", F.when(F.col("_hi") >= F.col("_lo"), "high").otherwise("low"))
          .withColumn("deviation", F.greatest("_hi", "_lo"))
          .withColumn("threshold", F.when(F.col("direction") == "high", F.col("high")).otherwise(F.col("low"))))
    return df.filter("deviation > 0").select(
        *KEYS, "ts", "value", "deviation", "direction", "threshold", "median_gap")


def segments_b(points: DataFrame, reasons, beta: float = 0.5, min_points: int = 2,
               file_name: str = "") -> DataFrame:
    """Islands of detector B; severity is the peak deviation, the first ten points are exported.

    Both onsets look at all points of a segment. Sustained: the first at 0.3 or more whose successor
    is at 0.15 or more, else the first at 0.3, else the first. Steepest: the point before the steepest
    rise within [-2, +3) of the first point at half the peak, else that point.
    """
    chosen = points.filter(F.col("deviation") >= beta)
    runs = islands(chosen, KEYS, F.greatest(F.lit(180), F.col("median_gap") * 3))
    whole = W.partitionBy(*KEYS, "island")
    pos = F.row_number().over(whole.orderBy("ts"))
    runs = (runs.withColumn("_pos", pos).withColumn("_next", F.lead("deviation").over(whole.orderBy("ts")))
            .withColumn("_peak", F.max("deviation").over(whole))
            .withColumn("_half", F.min(F.when(F.col("deviation") >= 0.5 * F.col("_peak"), F.col("_pos"))).over(whole)))
    firm = (F.col("deviation") >= 0.3) & (F.col("_next") >= 0.15)
    rise = F.col("_next") - F.col("deviation")
    near = (rise > 0) & (F.col("_pos") >= F.col("_half") - 2) & (F.col("_pos") < F.col("_half") + 3)
    sustained = F.coalesce(F.min(F.when(firm, F.col("ts"))), F.min(F.when(F.col("deviation") >= 0.3, F.col("ts"))), F.min("ts"))
    steepest = F.when((F.count("*") <= 1) | (F.max("deviation") <= 0), F.min("ts")).otherwise(F.coalesce(
        F.max_by("ts", F.when(near, F.struct(rise, -F.col("_pos")))), F.min(F.when(F.col("_pos") == F.col("_half"), F.col("ts")))))
    first = F.when(F.col("_pos") <= 10, F.struct("ts", "value", "deviation", "direction", "threshold"))
    seg = runs.groupBy(*KEYS, "island").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n_points"),
        F.max("deviation").alias("max_deviation"), sustained.alias("sustained_ts"), steepest.alias("steepest_ts"),
        F.max_by(F.struct(F.col("value").alias("peak_value"), "threshold", "direction"),
                 F.struct("deviation", -F.col("ts"))).alias("peak"),
        F.array_sort(F.collect_list(first)).alias("points"))
    hint = S.reason_hint(F.concat("kpi", F.lit(f" {file_name}")), reasons)
    return (seg.filter(F.col("n_points") >= min_points)
            .withColumn("reason_hint", hint)
            .withColumn("severity", S.rounded(F.col("max_deviation"), 6))
            .select(*KEYS, "start_ts", "end_ts", "n_points", "max_deviation", "severity", "reason_hint",
                    "peak.*", "points", "sustained_ts", "steepest_ts"))


def intensity(points: DataFrame) -> DataFrame:
    """Largest deviation per (incident, component, ts) over the KPIs."""
    return points.groupBy("incident_id", "component", "ts").agg(F.max("deviation").alias("intensity"))


def _relative(segments: DataFrame) -> DataFrame:
    """Add the ratio of a segment's peak to the upper median of its KPI over the incident (one window)."""
    w = W.partitionBy("incident_id", "kpi")
    df = segments.withColumn("_r", F.row_number().over(w.orderBy("max_deviation"))).withColumn("_n", F.count("*").over(w))
    middle = F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col("max_deviation"))).over(w)
    return df.withColumn("kpi_median", middle).withColumn(
        "relative", F.col("max_deviation") / F.greatest(F.col("kpi_median"), F.lit(0.01))).drop("_r", "_n")


def severity_ratio(segments: DataFrame) -> DataFrame:
    """Component score: best ratio to the KPI median, more for several KPIs, capped at 3."""
    raw = _relative(segments).groupBy("incident_id", "component").agg(
        F.max("relative").alias("_m"), F.count_distinct("kpi").alias("_k"), F.min("start_ts").alias("first_ts"))
    score = F.least(F.lit(3.0), F.col("_m") * (1.0 + 0.15 * (F.col("_k") - 1))) / 3.0
    return raw.select("incident_id", "component", S.rounded(score, 6).alias("score"), "first_ts",
                      F.col("_k").alias("kpis"))


def severity_idf(segments: DataFrame) -> DataFrame:
    """Component score with rare KPIs weighted up and blended with the rank among components."""
    n = segments.groupBy("incident_id").agg(F.count_distinct("component").alias("_n"))
    df = segments.groupBy("incident_id", "kpi").agg(F.count_distinct("component").alias("_df"))
    idf = df.join(n, "incident_id").withColumn(
        "idf", F.greatest(F.lit(0.05), F.log((1.0 + F.col("_n")) / (1.0 + F.col("_df")))))
    raw = (_relative(segments).join(idf, ["incident_id", "kpi"])
           .groupBy("incident_id", "component").agg(
        (F.max(F.col("relative") * F.col("idf")) * (1.0 + 0.10 * (F.count_distinct("kpi") - 1))).alias("raw"),
        F.min("start_ts").alias("first_ts"), F.max("_n").alias("_n")))
    raw = raw.withColumn("raw", F.round("raw", 9))
    w = W.partitionBy("incident_id")
    upto = F.count("*").over(w.orderBy(F.desc("raw")).rangeBetween(W.unboundedPreceding, W.currentRow))
    top = F.max("raw").over(w)
    magnitude = F.least(F.lit(1.0), F.col("raw") / F.greatest(top, F.lit(1e-6)))
    score = F.least(F.lit(1.0), 0.60 * magnitude + 0.40 * (1.0 - upto / F.col("_n")))
    return raw.withColumn("score", S.rounded(score, 6)).select("incident_id", "component", "score", "first_ts")


def candidates(scores: DataFrame, cut: float = 0.05, keep: int | None = 30) -> DataFrame:
    """Components above the cut, best ``keep`` per incident (None: all)."""
    return top_k(scores.filter(F.col("score") > cut), ["incident_id"], [F.desc("score"), "component"], keep)


def kpi_onsets(segments: DataFrame) -> DataFrame:
    return segments.groupBy(*KEYS).agg(F.min("start_ts").alias("onset"))


def layer_scores(cands: DataFrame) -> DataFrame:
    return cands.groupBy("incident_id", S.component_type(F.col("component")).alias("layer")).agg(
        F.max("score").alias("layer_score"))


def _primary(layers: DataFrame, score: str) -> DataFrame:
    best = F.max_by(F.struct(F.col("layer").alias("primary"), F.col(score).alias("best")),
                    F.struct(F.col(score), F.col("layer")))
    return layers.groupBy("incident_id").agg(best.alias("b")).select("incident_id", "b.*")


def layer_filter(cands: DataFrame, single_cut: float = 0.80) -> DataFrame:
    """Keep the layer with the best score and others at half of it; the rest is reserve.

    A sole survivor at or above ``single_cut`` needs no causal stage.
    """
    typed = cands.withColumn("layer", S.component_type(F.col("component")))
    top = _primary(layer_scores(cands), "layer_score")
    kept = typed.join(top, "incident_id").withColumn(
        "refined", (F.col("layer") == F.col("primary")) | (F.col("score") >= 0.5 * F.col("best")))
    size = F.sum(F.col("refined").cast("int")).over(W.partitionBy("incident_id"))
    return kept.withColumn("needs_causal", ~((size == 1) & (F.col("best") >= single_cut))).select(
        "incident_id", "component", "score", "layer", "primary", "refined", "needs_causal")


def layer_filter_weighted(cands: DataFrame, profiles: DataFrame, failure_count: int = 1,
                          top: int | None = 4) -> DataFrame:
    """Evidence-weighted filter: 0.65 severity + 0.35 local evidence, 58% cut, best per layer, width cap (top None: no cap)."""
    typed = (cands.join(profiles.select("incident_id", "component", "local_evidence"),
                        ["incident_id", "component"], "left")
             .withColumn("evidence", F.round(0.65 * F.col("score") + 0.35 * F.coalesce("local_evidence", "score"), 9))
             .withColumn("layer", S.component_type(F.col("component"))))
    layers = typed.groupBy("incident_id", "layer").agg(
        F.max("evidence").alias("layer_score"),
        F.max_by("component", F.struct("evidence", "component")).alias("layer_best"))
    best = _primary(layers, "layer_score")
    df = typed.join(layers, ["incident_id", "layer"]).join(best, "incident_id")
    own = F.col("layer") == F.col("primary")
    keep = (F.col("evidence") >= 0.58 * F.col("best")) | (
        (own | (F.col("layer_score") >= 0.5 * F.col("best"))) & (F.col("component") == F.col("layer_best")))
    width = None if top is None else max(top * 3, failure_count * 4, 8)
    return top_k(df.filter(keep), ["incident_id"], [F.desc("evidence"), "component"], width).select(
        "incident_id", "component", "evidence", "layer", "primary", "rank")
