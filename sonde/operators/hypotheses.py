"""Hypotheses with belief states, abductive re-ranking, support counts and the reflect decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonde.functions import fixed as V
from sonde.functions import scalars as S
from sonde.operators.windows import top_k


def _confidence(state, n_for, n_against):
    base = F.create_map(*[F.lit(x) for kv in V.BELIEF_BASE.items() for x in kv])[state]
    return F.round(S.clamp(base + F.least(F.lit(0.1), 0.02 * n_for) - F.least(F.lit(0.3), 0.05 * n_against)), 9)


def hypothesise(evidence: DataFrame, ranking: DataFrame, top: int | None = 5) -> DataFrame:
    """One row per incident and node: the ``top`` best scored nodes (None: all) and the three best ranked."""
    node = evidence.select("incident_id", F.concat("component", F.lit("."), "kpi").alias("node"),
                           "final_score", "spectral_class")
    best = top_k(node, ["incident_id"], [F.desc("final_score"), "node"], top).filter("final_score >= 0.1")
    reason = F.create_map(*[F.lit(x) for kv in V.REASON_BY_SPECTRAL_CLASS.items() for x in kv])
    own = best.select("incident_id", "node", reason[F.col("spectral_class")].alias("reason"))
    extra = ranking.filter("rank <= 3").select("incident_id", "node").join(
        own, ["incident_id", "node"], "left_anti").withColumn("reason", F.lit(None).cast("string"))
    return own.unionByName(extra)


def believe(hypotheses: DataFrame, evidence: DataFrame, edges: DataFrame, iterations: int = 3,
            enough: float = 0.3) -> DataFrame:
    """Update the belief state of every hypothesis for up to ``iterations`` rounds.

    Evidence per round: anomaly above 0.5 for, below 0.2 against; mean outgoing weight above
    0.3 for; mean incoming above 0.5 against; then the spectral class confirms or rejects,
    and confident hypotheses are validated. A round whose best confidence of the incident is
    below ``enough`` sends contradicted and rejected hypotheses back to the start.
    """
    node = evidence.select("incident_id", F.concat("component", F.lit("."), "kpi").alias("node"),
                           "final_score", "spectral_class")
    kept = edges.filter("keep")
    out = kept.groupBy("incident_id", F.col("source").alias("node")).agg(F.avg("weight").alias("_out"))
    inc = kept.groupBy("incident_id", F.col("target").alias("node")).agg(F.avg("weight").alias("_in"))
    one = lambda c: F.when(c, 1).otherwise(0)
    df = (hypotheses.join(node, ["incident_id", "node"], "left")
          .join(out, ["incident_id", "node"], "left").join(inc, ["incident_id", "node"], "left")
          .select("*", (one(F.col("final_score") > 0.5) + one(F.col("_out") > 0.3)).alias("_for"),
                  (one(F.col("final_score") < 0.2) + one(F.col("_in") > 0.5)).alias("_against"),
                  (F.col("spectral_class") != V.SPECTRAL_CLASSES["none"]).alias("_confirmed"),
                  F.lit(0).alias("n_for"), F.lit(0).alias("n_against"), F.lit("hypothesized").alias("belief_state"),
                  F.lit(0.0).alias("confidence"), F.lit(True).alias("_open")))
    w = W.partitionBy("incident_id")
    state, sure = F.col("_state"), F.coalesce("_confirmed", F.lit(False))
    unsure = F.coalesce(~F.col("_confirmed"), F.lit(False))
    for _ in range(iterations):
        df = (df.withColumn("_f", F.col("n_for") + F.col("_for") + one(sure))
              .withColumn("_a", F.col("n_against") + F.col("_against") + one(unsure))
              .withColumn("_state", F.when(sure, "spectral_confirmed").when(unsure, "spectral_rejected")
                          .when(F.col("_a") > F.col("_f"), "evidence_contradicted").otherwise("evidence_supported"))
              .withColumn("_c", _confidence(state, F.col("_f"), F.col("_a")))
              .withColumn("_state", F.when(state.isin("spectral_confirmed", "evidence_supported") & (F.col("_c") > 0.6),
                                           "validated").otherwise(state))
              .withColumn("_c", _confidence(state, F.col("_f"), F.col("_a")))
              .withColumn("_done", F.max("_c").over(w) >= enough))
        back = ~F.col("_done") & state.isin("evidence_contradicted", "spectral_rejected")
        go = F.col("_open")
        # incidents that found a confident hypothesis keep their state
        df = (df.withColumn("n_for", F.when(go, F.when(back, 0).otherwise(F.col("_f"))).otherwise(F.col("n_for")))
              .withColumn("n_against", F.when(go, F.when(back, 0).otherwise(F.col("_a"))).otherwise(F.col("n_against")))
              .withColumn("confidence", F.when(go, F.when(back, 0.0).otherwise(F.col("_c"))).otherwise(F.col("confidence")))
              .withColumn("belief_state", F.when(go, F.when(back, "hypothesized").otherwise(state)).otherwise(F.col("belief_state")))
              .withColumn("_open", go & ~F.col("_done")))
    return df.select("incident_id", "node", "reason", "spectral_class", "belief_state", "n_for", "n_against", "confidence")


def rerank(ranking: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Root score times (1 + confidence) for validated, confirmed or supported hypotheses."""
    boost = hypotheses.filter(F.col("belief_state").isin("validated", "spectral_confirmed", "evidence_supported")).select(
        "incident_id", "node", "confidence")
    df = ranking.join(boost, ["incident_id", "node"], "left").withColumn(
        "new_score", S.rounded(F.col("root_score") * (1.0 + F.coalesce("confidence", F.lit(0.0))), 4))
    return top_k(df, ["incident_id"], [F.desc("new_score"), "node"], None, "new_rank")


def verify_support(support: DataFrame) -> DataFrame:
    """Per node: how many evidence reports name it, out of those present for the incident."""
    reports = support.groupBy("incident_id").agg(F.count_distinct("agent").alias("_n"))
    named = support.filter(F.col("node").isNotNull()).groupBy("incident_id", "node").agg(
        F.count("*").alias("support_count"), F.array_sort(F.collect_set("agent")).alias("sources"))
    return named.join(reports, "incident_id").select(
        "incident_id", "node", "support_count", S.rounded(F.col("support_count") / F.col("_n"), 4).alias("verification_score"),
        "sources")


def reflect(confidence: DataFrame, ranking: DataFrame, threshold: float = 0.5) -> DataFrame:
    """backtrack, re_hypothesize or finalize per incident.

    ``confidence`` holds (incident_id, max_confidence, supported).
    """
    top = ranking.filter("rank = 1").select("incident_id", "root_score")
    action = (F.when(F.col("max_confidence") < threshold, "backtrack").when(F.col("supported") == 0, "backtrack")
              .when(F.col("root_score") < 0.3, "re_hypothesize").otherwise("finalize"))
    return confidence.join(top, "incident_id", "left").select(
        "incident_id", "max_confidence", "supported", "root_score", action.alias("action"))
