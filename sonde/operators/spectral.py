"""Frequency-domain anomaly scores, edge validation and spectral root ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonde.functions import fixed as V
from sonde.functions import scalars as S
from sonde.functions import spectrum as X
from sonde.operators.stats import traditional_scores
from sonde.operators.windows import SERIES, top_k

KEYS = ["incident_id", *SERIES]
STAT_FEATURES = X.BASE_FEATURES


def features(arrays: DataFrame, column: str = "inc") -> DataFrame:
    """Band shares, dominant bin and entropy of one array column (at most a day of minutes)."""
    return arrays.withColumn("_f", X.spectral_features(F.col(column))).select("*", "_f.*").drop("_f")


def baseline_stats(arrays: DataFrame) -> DataFrame:
    """Median and MAD of the features over baseline windows of the incident's length.

    Windows do not overlap, an incomplete last one is dropped, a short baseline is one window.
    """
    return arrays.withColumn("_b", X.baseline_features(F.col("base"), F.size("inc"))).select("*", "_b.*").drop("_b")


def spectral_scores(arrays: DataFrame) -> DataFrame:
    """Robust z of the features against the baseline windows, score and class.

    The energy z sets the logarithm of the energy against the MAD of the raw energy; that
    mix of units is part of the definition.
    """
    eps = V.EPS
    df = baseline_stats(features(arrays))

    def z(value, f):
        return (value - (F.log(F.col(f"{f}_med") + eps) if f == "total_energy" else F.col(f"{f}_med"))) / (
            V.MAD_TO_SIGMA * F.col(f"{f}_mad") + eps)

    df = (df.withColumn("energy_z", z(F.log(F.col("total_energy") + eps), "total_energy"))
          .withColumn("low_z", z(F.col("low_ratio"), "low_ratio"))
          .withColumn("high_z", z(F.col("high_ratio"), "high_ratio"))
          .withColumn("dominant_z", z(F.col("dominant_ratio"), "dominant_ratio"))
          .withColumn("entropy_z", z(F.col("entropy"), "entropy")))
    w = V.SPECTRAL_WEIGHTS
    score = (w["energy"] * S.sigmoid(F.col("energy_z") - V.ENERGY_Z_CUT)
             + w["low"] * S.sigmoid(F.abs("low_z") - V.RATIO_Z_CUT)
             + w["high"] * S.sigmoid(F.abs("high_z") - V.RATIO_Z_CUT)
             + w["periodic"] * S.sigmoid(F.col("dominant_z") - V.RATIO_Z_CUT)
             + w["entropy"] * S.sigmoid(F.abs("entropy_z") - V.RATIO_Z_CUT))
    c = V.SPECTRAL_CLASSES
    kind = (F.when(F.col("energy_z") < V.ENERGY_Z_CUT, c["none"])
            .when(F.col("low_ratio") >= 0.55, c["slow"]).when(F.col("high_ratio") >= 0.45, c["burst"])
            .when(F.col("dominant_ratio") >= 0.60, c["periodic"]).otherwise(c["mixed"]))
    return df.withColumn("spectral_score", score).withColumn("spectral_class", kind)


def anomaly_evidence(arrays: DataFrame, use_traditional: bool = True, use_spectral: bool = True) -> DataFrame:
    """Full evidence per (incident, series): both scores, fusion, level, quality, explanation.

    The share of empty bins, where the arrays carry it, marks low quality. Series with fewer than
    four baseline or two incident points get an empty record; fewer than eight incident
    points skip the spectral part.
    """
    enough = (F.size("base") >= 4) & (F.size("inc") >= 2)
    good = arrays.filter(enough)
    share = F.coalesce("missing_share", F.lit(0.0)) if "missing_share" in arrays.columns else F.lit(0.0)
    short = F.size("inc") < V.MIN_SPECTRAL_POINTS
    df = spectral_scores(traditional_scores(good)).withColumn(
        "quality_flag", F.when(short, "too_short_for_spectral")
        .when(share > V.MISSING_SHARE, "low_quality").otherwise("ok"))
    off = (F.col("quality_flag") == "too_short_for_spectral") if use_spectral else F.lit(True)
    zero = F.lit(0.0)
    for c in ("spectral_score", "total_energy", "energy_z", "low_ratio", "mid_ratio", "high_ratio",
              "dominant_ratio", "entropy"):
        df = df.withColumn(c, F.when(off, zero).otherwise(F.col(c)))
    df = (df.withColumn("dominant_index", F.when(off, 0).otherwise(F.col("dominant_index")))
          .withColumn("spectral_class", F.when(off, V.SPECTRAL_CLASSES["none"]).otherwise(F.col("spectral_class"))))
    if not use_traditional:
        for c in ("traditional_score", "max_abs_z", "max_rate", "deviation_score"):
            df = df.withColumn(c, zero)
    w = V.FINAL_WEIGHTS
    df = df.withColumn("final_score", w["traditional"] * F.col("traditional_score")
                       + w["spectral"] * F.col("spectral_score"))
    df = df.withColumn("level", F.when(F.col("final_score") >= V.HIGH_CONFIDENCE, "high_confidence_anomaly")
                       .when(F.col("final_score") >= V.CANDIDATE, "candidate_anomaly")
                       .otherwise("normal_or_weak"))
    node = F.concat("component", F.lit("."), "kpi")
    number = lambda c: F.format_string("%.2f", F.col(c))
    text = F.concat_ws(
        ", ", node, S.first_match([(F.col("level") == k, t) for k, t in V.EXPLAIN_LEVELS.items()], F.lit(None).cast("string")),
        *[F.when(F.col(c) > low, F.concat(F.lit(f"{t} ("), number(c), F.lit(")"))) for c, low, t in V.EXPLAIN_SCORES],
        S.first_match([(F.col("spectral_class") == k, t) for k, t in V.EXPLAIN_CLASSES.items()], F.lit(None).cast("string")))
    rounded = ["traditional_score", "spectral_score", "final_score", "max_abs_z", "max_rate", "deviation_score",
               "total_energy", "energy_z", "low_ratio", "mid_ratio", "high_ratio", "dominant_ratio", "entropy"]
    full = df.select(*KEYS, *[S.rounded(F.col(c), 4).alias(c) for c in rounded], "dominant_index",
                     "spectral_class", "quality_flag", "level", F.concat(text, F.lit(".")).alias("explanation"))
    empty = arrays.filter(~enough).select(
        *KEYS, *[zero.alias(c) for c in rounded], F.lit(0).alias("dominant_index"),
        F.lit(V.SPECTRAL_CLASSES["none"]).alias("spectral_class"), F.lit("insufficient_data").alias("quality_flag"),
        F.lit("normal_or_weak").alias("level"),
        F.concat(node, F.lit(V.EXPLAIN_TOO_SHORT)).alias("explanation"))
    return full.unionByName(empty)


def detection_summary(evidence: DataFrame) -> DataFrame:
    """Series, high and candidate counts per incident, and the classes scored above 0.3."""
    base = evidence.groupBy("incident_id").agg(
        F.count("*").alias("series"), F.count_if(F.col("final_score") >= V.HIGH_CONFIDENCE).alias("high"),
        F.count_if(F.col("final_score") >= V.CANDIDATE).alias("candidates"))
    kinds = (evidence.filter("final_score > 0.3").groupBy("incident_id", "spectral_class").agg(F.count("*").alias("n"))
             .groupBy("incident_id").agg(F.map_from_entries(F.array_sort(F.collect_list(
                 F.struct("spectral_class", "n")))).alias("classes")))
    return base.join(kinds, "incident_id", "left")


# ------------------------------------------------------------------ edges
def candidate_edges(evidence: DataFrame, sources: int | None = 20, targets: int | None = 30) -> DataFrame:
    """Pairs of a top source (score >= 0.5) and a top target (score >= 0.3) of one incident.

    Both sides are cut before the join, so an incident yields at most ``sources * targets`` pairs;
    None lifts a cut.
    """
    node = evidence.select("incident_id", F.concat("component", F.lit("."), "kpi").alias("node"),
                           F.col("final_score").alias("s"))
    order = [F.desc("s"), "node"]
    src = top_k(node.filter("s >= 0.5"), ["incident_id"], order, sources).select(
        "incident_id", F.col("node").alias("source"), F.col("s").alias("source_score"))
    tgt = top_k(node.filter("s >= 0.3"), ["incident_id"], order, targets).select(
        "incident_id", F.col("node").alias("target"), F.col("s").alias("target_score"))
    return (src.join(tgt, "incident_id").filter("source <> target")
            .withColumn("prior", S.clamp(0.5 * (F.col("source_score") - F.col("target_score") + 0.5), 0.1, 1.0)))


def graph_consistency(source_score, target_score, eta: float = 1.0):
    """How far an edge runs from the more to the less anomalous node."""
    ratio = source_score / (source_score + target_score + 1e-12)
    return (F.when((source_score < 1e-8) & (target_score < 1e-8), 0.0)
            .when(ratio >= 0.5, 1.0 - eta * (1.0 - ratio)).otherwise(F.greatest(F.lit(0.0), ratio / (eta + 1e-12))))


def edge_measures(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """Lag correlation, shape, dominant bin and phase of each pair; both series need four points."""
    nodes = arrays.filter(F.size("inc") >= 4).select(
        "incident_id", F.concat("component", F.lit("."), "kpi").alias("node"), F.col("inc").alias("x"))
    side = lambda role, name: nodes.select("incident_id", F.col("node").alias(role), F.col("x").alias(name))
    both = pairs.join(side("source", "_x"), ["incident_id", "source"]).join(side("target", "_y"), ["incident_id", "target"])
    return both.withColumn("_m", X.pair_measures("_x", "_y")).select(*pairs.columns, "_m.*")


def weigh_edges(measured: DataFrame, consistency: bool = True, lag: bool = True,
                spectral: bool = True) -> DataFrame:
    """Final weight of measured pairs; kept at 0.30 and above."""
    w = V.EDGE_WEIGHTS
    corr = F.col("lag_corr") if lag else F.lit(0.0)
    extra = w["shape"] * F.col("shape") + w["freq"] * F.col("freq_match") + w["phase"] * F.col("phase")
    df = (measured.withColumn("spectral", extra if spectral else F.lit(0.0))
          .withColumn("raw_weight", S.rounded(
              F.col("prior") * (1.0 + F.col("source_score")) * F.greatest(F.lit(0.0), corr)
              * (1.0 + F.col("spectral")), 4))
          .withColumn("consistency", graph_consistency(F.col("source_score"), F.col("target_score"))))
    factor = F.col("consistency") if consistency else F.lit(1.0)
    return (df.withColumn("weight", S.rounded(F.col("raw_weight") * factor, 4))
            .withColumn("keep", F.col("weight") >= V.EDGE_KEEP))


def path_scores(paths: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean edge weight of a path times a penalty for rising anomaly scores along it.

    ``paths`` holds (incident_id, path_id, path ARRAY<STRING>).
    """
    steps = paths.select("incident_id", "path_id", F.size("path").alias("n"), F.posexplode("path").alias("i", "component"),
                         F.col("path"))
    steps = steps.withColumn("next", F.get("path", F.col("i") + 1)).drop("path")
    scored = (steps.join(nodes.select("incident_id", "component", "score"), ["incident_id", "component"], "left")
              .join(nodes.select("incident_id", F.col("component").alias("next"), F.col("score").alias("next_score")),
                    ["incident_id", "next"], "left")
              .join(edges.select("incident_id", F.col("source").alias("component"), F.col("target").alias("next"), "weight"),
                    ["incident_id", "component", "next"], "left"))
    s, t = F.coalesce("score", F.lit(0.0)), F.coalesce("next_score", F.lit(0.0))
    hop = F.col("next").isNotNull()
    g = scored.groupBy("incident_id", "path_id", "n").agg(
        F.avg(F.when(hop, F.coalesce("weight", F.lit(0.0)))).alias("_w"),
        F.sum(F.when(hop, F.greatest(F.lit(0.0), t - s)).otherwise(0.0)).alias("_rise"), F.sum(s).alias("_sum"))
    mono = F.greatest(F.lit(0.0), 1.0 - F.col("_rise") / F.greatest(F.col("_sum"), F.lit(1e-12)))
    return g.select("incident_id", "path_id", F.when(F.col("n") < 2, 0.0).otherwise(F.col("_w") * mono).alias("path_score"))


def onset_bonus(onsets: DataFrame) -> DataFrame:
    """1 for the earliest onset of an incident down to 0 for the latest."""
    span = onsets.groupBy("incident_id").agg(F.min("onset").alias("_lo"), F.max("onset").alias("_hi"))
    return onsets.join(span, "incident_id").withColumn(
        "onset_bonus", 1.0 - (F.col("onset") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))
    ).drop("_lo", "_hi")


def root_ranking(evidence: DataFrame, edges: DataFrame, onsets: DataFrame | None = None) -> DataFrame:
    """Rank nodes by anomaly, outgoing and incoming kept edges, and onset."""
    node = evidence.select("incident_id", F.concat("component", F.lit("."), "kpi").alias("node"),
                           F.col("final_score").alias("anomaly"), "spectral_class")
    kept = edges.filter("keep")
    out = kept.groupBy("incident_id", F.col("source").alias("node")).agg(F.sum("weight").alias("out_evidence"))
    inc = kept.groupBy("incident_id", F.col("target").alias("node")).agg(F.sum("weight").alias("in_evidence"))
    df = (node.join(out, ["incident_id", "node"], "left").join(inc, ["incident_id", "node"], "left")
          .na.fill(0.0, ["out_evidence", "in_evidence"]))
    if onsets is not None:
        df = df.join(onset_bonus(onsets).select("incident_id", "node", "onset_bonus"), ["incident_id", "node"], "left").na.fill(
            0.0, ["onset_bonus"])
    else:
        df = df.withColumn("onset_bonus", F.lit(0.0))
    w = V.ROOT_WEIGHTS
    score = F.greatest(F.lit(0.0), w["anomaly"] * F.col("anomaly") + w["out"] * F.col("out_evidence")
                       - w["in"] * F.col("in_evidence") + w["onset"] * F.col("onset_bonus"))
    text = F.concat(F.concat_ws(
        ", ", F.concat(F.lit(V.RANK_SUBJECT), "node"),
        S.first_match([(F.col("anomaly") > low, t) for low, t in V.RANK_ANOMALY], V.RANK_ANOMALY_LOW),
        *[F.when(F.col(c) > low, t) for c, low, t in V.RANK_HINTS],
        F.when(F.col("spectral_class") != V.SPECTRAL_CLASSES["none"], F.concat(F.lit(V.RANK_CLASS), "spectral_class"))), F.lit("."))
    df = df.withColumn("root_score", S.rounded(score, 4)).withColumn("explanation", text)
    for c in ("out_evidence", "in_evidence"):
        df = df.withColumn(c, S.rounded(F.col(c), 4))
    rank = F.row_number().over(W.partitionBy("incident_id").orderBy(F.desc("root_score"), "node"))
    return df.withColumn("rank", rank)
