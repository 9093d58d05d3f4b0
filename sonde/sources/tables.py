"""Telemetry relations derived from the driver tables, each with its SQL twin.

The tables hold no telemetry, so metrics, logs, spans and records are expressed over
``events`` (same window for all four), larger traces over ``lineitem``, log texts over
``documents`` and past cases over ``embeddings`` and ``conversations``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.functions import scalars as S
from sonde.plans.registry import cte

DAY = 86400
FIRST_DAY = 1704067200
SPAN_START = 788918400
COMPONENTS = ("node-1", "mysql_02", "redis_03", "checkout-4", "gateway_5", "frontend")
KPIS = {
    "view": "cpu_used_percent",
    "click": "network_latency_ms",
    "error": "packet_loss_rate",
    "purchase": "mem_used_percent",
    "signup": "disk_read_bytes",
}
REASONS = (
    "high CPU usage", "high memory usage", "network latency", "network packet loss",
    "high disk I/O read usage", "db connection limit", "db close",
)
METRIC_FILE = "metric_container.csv"
WORDS = ("timeout", "connection reset", "gc memory", "disk read", "cpu")


_KNOWN: dict[tuple, DataFrame] = {}


def once(build):
    """Keep the (lazy) relation of a session and folder, so footers are read and plans built once."""
    @wraps(build)
    def relation(spark: SparkSession, sf_dir: str, *names) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, build.__name__, *names)
        if key not in _KNOWN:
            _KNOWN[key] = build(spark, sf_dir, *names)
        return _KNOWN[key]
    return relation


@once
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _component(user):
    out = F
    for i, name in enumerate(COMPONENTS):
        out = out.when(user % len(COMPONENTS) == i, name)
    return out


_COMPONENT_SQL = "CASE user_id % 6 " + " ".join(
    f"WHEN {i} THEN '{c}'" for i, c in enumerate(COMPONENTS)) + " END"
_KPI_SQL = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in KPIS.items()) + " END"
_EPOCH_SQL = "CAST(floor(epoch(ts)) AS BIGINT)"


@once
def raw_metrics(spark, sf_dir) -> DataFrame:
    """One row per event: component, kpi, day, ts, value (timestamps may repeat)."""
    kpi = F
    for event, name in KPIS.items():
        kpi = kpi.when(F.col("event_type") == event, name)
    ts = S.epoch_of_naive(F.col("ts"))
    return table(spark, sf_dir, "events").select(
        _component(F.col("user_id")).alias("component"), kpi.alias("kpi"),
        F.floor(ts / DAY).cast("bigint").alias("day"), ts.alias("ts"), F.col("value"))


cte("raw_metrics", f"""
SELECT {_COMPONENT_SQL} AS component, {_KPI_SQL} AS kpi,
       CAST(floor({_EPOCH_SQL} / 86400) AS BIGINT) AS day, {_EPOCH_SQL} AS ts, value
FROM events""")
cte("metrics", """
SELECT component, kpi, day, ts, avg(value) AS value FROM raw_metrics GROUP BY ALL""")


@once
def incidents(spark, sf_dir) -> DataFrame:
    """A one-day window for every day with telemetry, as the windows of parsed tasks would be."""
    days = (table(spark, sf_dir, "events")
            .select(F.floor(S.epoch_of_naive(F.col("ts")) / DAY).cast("bigint").alias("day"))
            .distinct())
    start = F.col("day") * DAY
    offset = F.col("day") - FIRST_DAY // DAY
    return (days.select(offset.cast("bigint").alias("incident_id"), start.alias("start_ts"),
                    (start + DAY - 1).alias("end_ts")))


cte("incidents", f"""
SELECT DISTINCT CAST(floor({_EPOCH_SQL} / 86400) AS BIGINT) - {FIRST_DAY // DAY} AS incident_id,
       CAST(floor({_EPOCH_SQL} / 86400) AS BIGINT) * 86400 AS start_ts,
       CAST(floor({_EPOCH_SQL} / 86400) AS BIGINT) * 86400 + 86399 AS end_ts
FROM events""")


@once
def event_spans(spark, sf_dir) -> DataFrame:
    """Spans in the window of the metrics: traces of five consecutive events."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.floor(e / 5).cast("bigint").alias("trace_id"), e.alias("span_id"),
        F.when(e % 5 != 0, e - 1).alias("parent_id"),
        _component(F.col("user_id")).alias("component"),
        S.epoch_of_naive(F.col("ts")).alias("ts"), F.col("value").alias("duration"),
        (F.col("event_type") != "error").alias("success"))


cte("event_spans", f"""
SELECT CAST(floor(event_id / 5) AS BIGINT) AS trace_id, event_id AS span_id,
       CASE WHEN event_id % 5 <> 0 THEN event_id - 1 END AS parent_id,
       {_COMPONENT_SQL} AS component, {_EPOCH_SQL} AS ts, value AS duration,
       event_type <> 'error' AS success
FROM events""")


@once
def spans(spark, sf_dir) -> DataFrame:
    """Traces from orders: a line is the child of the line before it."""
    return (table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_orderkey").alias("trace_id"),
                     F.col("l_linenumber").cast("bigint").alias("span_id"))
            .agg(F.min("l_suppkey").alias("s"), F.min("l_shipdate").alias("d"),
                 F.min("l_quantity").alias("duration"),
                 # min(l_returnflag) <> 'R' on flags: a smallest string would sort all lines
                 (F.bool_or(F.col("l_returnflag") < "R") | F.bool_and(F.col("l_returnflag") > "R")).alias("success"))
            .select("trace_id", "span_id", (F.col("span_id") - 1).alias("parent_id"),
                    F.concat(F.lit("c"), (F.col("s") % 12).cast("string")).alias("component"),
                    S.epoch_of_naive(F.col("d")).alias("ts"), "duration", "success"))


cte("spans", """
SELECT l_orderkey AS trace_id, CAST(l_linenumber AS BIGINT) AS span_id,
       CAST(l_linenumber AS BIGINT) - 1 AS parent_id,
       'c' || CAST(min(l_suppkey) % 12 AS VARCHAR) AS component,
       CAST(floor(epoch(min(l_shipdate))) AS BIGINT) AS ts, min(l_quantity) AS duration,
       min(l_returnflag) <> 'R' AS success
FROM lineitem GROUP BY l_orderkey, l_linenumber""")


@once
def span_incidents(spark, sf_dir) -> DataFrame:
    """Thirty-day windows that tile the range of the ship dates."""
    width = 30 * DAY
    slot = F.floor((F.unix_date(F.to_date("l_shipdate")).cast("bigint") * DAY - SPAN_START) / width)
    return (table(spark, sf_dir, "lineitem").select(slot.cast("bigint").alias("incident_id"))
            .distinct()
            .select("incident_id", (F.col("incident_id") * width + SPAN_START).alias("start_ts"),
                    (F.col("incident_id") * width + SPAN_START + width - 1).alias("end_ts")))


cte("span_incidents", f"""
SELECT incident_id, incident_id * {30 * DAY} + {SPAN_START} AS start_ts,
       incident_id * {30 * DAY} + {SPAN_START + 30 * DAY - 1} AS end_ts
FROM (SELECT DISTINCT CAST(floor((floor(epoch(l_shipdate) / 86400) * 86400 - {SPAN_START})
      / {30 * DAY}) AS BIGINT) AS incident_id FROM lineitem)""")


@once
def logs(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    word = F
    for i, text in enumerate(WORDS):
        word = word.when(k % 6 == i, text)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"), _component(F.col("user_id")).alias("component"),
        S.epoch_of_naive(F.col("ts")).alias("ts"),
        F.concat(F.col("event_type"), F.lit(" user "), F.col("user_id").cast("string"), F.lit(" "),
                 word.otherwise("ok"), F.lit(" k="), k.cast("string")).alias("value"))


_K_SQL = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
cte("logs", f"""
SELECT event_id AS log_id, {_COMPONENT_SQL} AS component, {_EPOCH_SQL} AS ts,
       event_type || ' user ' || CAST(user_id AS VARCHAR) || ' ' || CASE {_K_SQL} % 6 """
    + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS))
    + f""" ELSE 'ok' END || ' k=' || CAST({_K_SQL} AS VARCHAR) AS value
FROM events""")


@once
def text_logs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("log_id"), F.col("source").alias("component"),
        (F.lit(FIRST_DAY) + F.col("doc_id") * 60).alias("ts"), F.col("text").alias("value"))


cte("text_logs", f"""
SELECT doc_id AS log_id, source AS component, {FIRST_DAY} + doc_id * 60 AS ts, text AS value
FROM documents""")


@once
def records(spark, sf_dir) -> DataFrame:
    """Failure records: every error event, with a reason by its ``k``."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    reason = F
    for i, text in enumerate(REASONS):
        reason = reason.when(k % len(REASONS) == i, text)
    return (table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
            .select(F.col("event_id").alias("row_id"),
                    _component(F.col("user_id")).alias("component"), reason.alias("reason"),
                    S.epoch_of_naive(F.col("ts")).alias("ts")))


cte("records", f"""
SELECT event_id AS row_id, {_COMPONENT_SQL} AS component, CASE {_K_SQL} % {len(REASONS)} """
    + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REASONS))
    + f""" END AS reason, {_EPOCH_SQL} AS ts
FROM events WHERE event_type = 'error'""")


@once
def experiences(spark, sf_dir) -> DataFrame:
    """Past cases: all features of each vector as a sparse pattern."""
    pattern = F.map_from_arrays(
        F.transform("embedding", lambda _, i: F.concat(F.lit("f"), i.cast("string"))),
        F.transform("embedding", lambda x: S.rounded(x.cast("double"), 4)))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("case_id"),
        F.concat(F.lit("c"), (F.col("vec_id") % 12).cast("string")).alias("component"),
        F.concat(F.lit("type-"), F.col("label").cast("string")).alias("anomaly_type"),
        F.concat(F.lit("reason-"), (F.col("vec_id") % 5).cast("string")).alias("reason"),
        pattern.alias("pattern"), (F.col("vec_id") % 3 != 0).alias("success"))


cte("experiences", """
SELECT vec_id AS case_id, 'c' || CAST(vec_id % 12 AS VARCHAR) AS component,
       'type-' || CAST(label AS VARCHAR) AS anomaly_type,
       'reason-' || CAST(vec_id % 5 AS VARCHAR) AS reason, vec_id % 3 <> 0 AS success, embedding
FROM embeddings""")
cte("patterns", """
SELECT case_id, component, anomaly_type, reason, success, 'f' || CAST(i AS VARCHAR) AS feature,
       round(CAST(embedding[i + 1] AS DOUBLE), 4) AS weight
FROM experiences, unnest(range(len(embedding))) AS u(i)""")


@once
def cases(spark, sf_dir) -> DataFrame:
    """Case memory: one case per conversation, tokens of all its turns."""
    c = table(spark, sf_dir, "conversations")
    return (c.select("conv_id", F.explode(S.tokens(F.col("text"))).alias("token")).distinct()
            .groupBy(F.col("conv_id").alias("case_id"))
            .agg(F.array_sort(F.collect_list("token")).alias("tokens")))
