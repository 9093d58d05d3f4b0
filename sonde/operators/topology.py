"""Call topology mined from log messages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.functions import fixed as V
from sonde.operators.windows import window_join


def _first(components, pattern):
    """The first configured component whose name matches, by name."""
    return next((c for c in sorted(components) if re.search(pattern, c, re.IGNORECASE)), None)


def mine_calls(logs: DataFrame, incidents: DataFrame, components) -> DataFrame:
    """Calls (incident, caller, callee, calls) from data sources, cache pools, URLs and access lines.

    ``components`` is the configured candidate list. A line can carry several hints; they are
    extracted in one pass over the lines and summed with partial aggregation. Cache pools
    count once per component.
    """
    db, cache = _first(components, "mysql"), _first(components, "redis")
    oracle, plain = _first(components, "oracle"), _first(components, r"db_\d+")
    caches = sorted(c for c in components if "redis" in c.lower())
    v, own = F.col("value"), F.col("component")
    named = F.col("log_name").rlike(V.ACCESS_LOG_RE) if "log_name" in logs.columns else F.lit(True)
    # each pattern is tried once a line: what it finds is a column before it is used
    rows = window_join(logs, incidents).select(
        "incident_id", "component", F.regexp_extract(v, V.DATASOURCE_RE, 1).alias("_source"), F.regexp_extract(v, V.JDBC_RE, 1).alias("_host"),
        F.when(named, F.nullif(F.regexp_extract(v, V.ACCESS_RE, 1), F.lit(""))).alias("_caller"), v.rlike(V.CACHE_POOL_RE).alias("_pool"))
    source, caller = F.col("_source"), F.col("_caller")
    target = (F.when((source == "") | F.upper(source).isin(*V.DATASOURCE_NOISE), F.lit(None))
              .when(source.rlike("(?i)mysql"), F.lit(db)).when(source.rlike("(?i)redis"), F.lit(cache))
              .when(source.rlike("(?i)oracle"), F.lit(oracle)).otherwise(F.lit(plain)))
    url = F.when(F.col("_host").rlike(V.IP_RE), F.lit(db or cache))
    caller = F.when(~F.lower(caller).isin(*V.ACCESS_NOISE) & (caller != own), caller)
    hint = lambda a, b, n, once=False: F.when(a.isNotNull() & b.isNotNull(), F.struct(
        a.alias("caller"), b.alias("callee"), F.lit(n).cast("bigint").alias("calls"), F.lit(once).alias("once")))
    pools = [hint(F.when(F.col("_pool"), own), F.lit(c), V.LOG_CALLS, True) for c in caches]
    hints = F.array_compact(F.array(hint(own, F.col("_target"), V.LOG_CALLS), hint(own, F.col("_url"), V.LOG_CALLS), hint(F.col("_caller"), own, 1), *pools))
    found = rows.select("incident_id", "component", target.alias("_target"), url.alias("_url"), caller.alias("_caller"), "_pool")
    per = found.select("incident_id", F.inline(hints)).groupBy("incident_id", "caller", "callee", "once").agg(
        F.sum("calls").alias("_sum"), F.max("calls").alias("_one"))
    return per.groupBy("incident_id", "caller", "callee").agg(F.sum(F.when(F.col("once"), F.col("_one")).otherwise(F.col("_sum"))).alias("calls"))


def connection_errors(logs: DataFrame, incidents: DataFrame) -> DataFrame:
    """Components with connection errors: a signal only, never an edge."""
    return (window_join(logs, incidents).filter(F.col("value").rlike(V.CONNECTION_ERROR_RE))
            .groupBy("incident_id", "component").agg(F.count("*").alias("errors")))


def _nodes(calls: DataFrame) -> DataFrame:
    return calls.select("incident_id", F.explode(F.array("caller", "callee")).alias("n")).distinct()


def merge_status(incidents: DataFrame, main: DataFrame, mined: DataFrame, logs: DataFrame) -> DataFrame:
    """NO_LOG, EMPTY, MERGED or INDEPENDENT per incident, with shared nodes and shared calls."""
    overlap = _nodes(main).intersect(_nodes(mined)).groupBy("incident_id").agg(F.count("*").alias("overlap_nodes"))
    matched = mined.join(main, ["incident_id", "caller", "callee"], "left_semi").groupBy("incident_id").agg(
        F.count("*").alias("matched"))
    has_log = window_join(logs, incidents).select("incident_id").distinct().withColumn("_log", F.lit(True))
    has_calls = mined.select("incident_id").distinct().withColumn("_calls", F.lit(True))
    df = incidents.select("incident_id")
    for part in (overlap, matched, has_log, has_calls):
        df = df.join(part, "incident_id", "left")
    status = (F.when(F.col("_log").isNull(), "NO_LOG").when(F.col("_calls").isNull(), "EMPTY")
              .when(F.col("overlap_nodes") > 0, "MERGED").otherwise("INDEPENDENT"))
    return df.select("incident_id", F.coalesce("overlap_nodes", F.lit(0)).alias("overlap_nodes"),
                     F.coalesce("matched", F.lit(0)).alias("matched"), status.alias("status"))
