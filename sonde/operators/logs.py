"""Log lines: error profiles, reason evidence, template scores and call topology from messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonde.functions import fixed as V
from sonde.functions import scalars as S
from sonde.operators.windows import top_k, window_join


def _first_word(text, words):
    return S.first_match([(F.contains(text, F.lit(w)), w) for w in words], F.lit(None).cast("string"))


def error_profile(logs: DataFrame, incidents: DataFrame) -> DataFrame:
    """Error lines per component: count, ratio, counts by first matching word, score min(1, 3 * ratio).

    Lines of the incident window count; those of its whole day where the window has none. The
    lines meet the day once; the choice is made on the counts.
    """
    day = F.floor(F.col("start_ts") / 86400).cast("bigint") * 86400
    wide = incidents.select("incident_id", "start_ts", "end_ts", day.alias("_from"), F.greatest(day + 86399, F.col("end_ts")).alias("_to"))
    lines = window_join(logs, wide, start="_from", end="_to").withColumn("word", _first_word(F.lower("value"), V.LOG_ERROR_WORDS))
    inside = F.col("ts").between(F.col("start_ts"), F.col("end_ts"))
    counted = lines.groupBy("incident_id", "component", "word", inside.alias("_in")).agg(F.count("*").alias("n"))
    any_inside = F.max("_in").over(W.partitionBy("incident_id"))
    per = counted.withColumn("_any", any_inside).filter(F.col("_in") == F.col("_any"))
    entry = F.when(F.col("word").isNotNull(), F.struct("word", "n"))
    out = per.groupBy("incident_id", "component").agg(
        F.sum("n").alias("total_logs"), F.sum(F.when(F.col("word").isNotNull(), F.col("n")).otherwise(0)).alias("error_count"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("error_types"))
    ratio = F.col("error_count") / F.col("total_logs")
    return out.filter("error_count > 0").withColumn("error_ratio", S.rounded(ratio, 4)).withColumn(
        "anomaly_score", F.least(F.lit(1.0), ratio * 3.0))


def _template_rule(template, reasons):
    """Struct(reason, weight) of the first rule with a key word and a candidate reason."""
    chain = []
    for words, wanted, weight in V.LOG_REASON_RULES:
        allowed = [x for x in (wanted or reasons) if x in reasons]
        if allowed:
            chain.append((S.has_any(template, words),
                          F.struct(F.lit(allowed[0]).alias("reason"), F.lit(weight).alias("weight"))))
    return S.first_match(chain, F.lit(None).cast("struct<reason:string,weight:double>"))


def templated(logs: DataFrame, incidents: DataFrame) -> DataFrame:
    """Counts per (incident, component, template): masking happens before the one shuffle."""
    rows = window_join(logs, incidents).withColumn("template", S.log_template(F.col("value")))
    return rows.groupBy("incident_id", "component", "template").agg(F.count("*").alias("n"))


def reason_evidence(counts: DataFrame, reasons) -> DataFrame:
    """(incident, component, reason, score) summed over templates."""
    # filtered on the sum, not on the rule: that filter would be pushed below the templates'
    # grouping and run the masking once per key word
    ruled = counts.withColumn("_r", _template_rule(F.col("template"), list(reasons)))
    return ruled.groupBy("incident_id", "component", F.col("_r.reason").alias("reason")).agg(
        F.sum(F.col("_r.weight") * F.col("n")).alias("score")).filter("score IS NOT NULL")


def template_counts(counts: DataFrame, keep: int | None = 50) -> DataFrame:
    """Most frequent ``keep`` templates of an incident (None: all)."""
    per = counts.withColumn("template_id", S.template_id(F.col("template"))).groupBy("incident_id", "template_id").agg(
        F.sum("n").alias("n"))
    return top_k(per, ["incident_id"], [F.desc("n"), "template_id"], keep)


def template_sample(counts: DataFrame, keep: int | None = 80) -> DataFrame:
    """Templates by weight 1, +4 with an error word, +2 with a resource word, per line; first ``keep`` of an incident (None: all)."""
    low = F.lower("template")
    weight = (1 + F.when(S.has_any(low, V.TEMPLATE_ERROR_WORDS), 4).otherwise(0)
              + F.when(S.has_any(low, V.TEMPLATE_RESOURCE_WORDS), 2).otherwise(0))
    per = (counts.withColumn("template_id", S.template_id(F.col("template")))
           .groupBy("incident_id", "template_id").agg(F.sum(weight * F.col("n")).alias("weight")))
    return top_k(per, ["incident_id"], [F.desc("weight"), "template_id"], keep)
