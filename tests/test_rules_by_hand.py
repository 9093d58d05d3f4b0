"""The fixed tables, case by case: expected values are written out, not computed from the tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonde.functions import scalars as S
from sonde.operators import logs as L
from sonde.operators import stats as ST

REASONS = ["high CPU usage", "high memory usage", "network latency", "network packet loss", "high disk I/O read usage", "high disk space usage",
           "db connection limit", "db close", "JVM Out of Memory (OOM) Heap", "high JVM CPU load", "node disk write I/O consumption",
           "container process termination", "container network packet corruption"]


def check(spark, cases, expr, columns=1):
    """``cases``: (input, ..., expected); ``expr`` takes the input columns."""
    names = [f"c{k}" for k in range(columns)]
    df = spark.createDataFrame([(i, *case[:columns]) for i, case in enumerate(cases)], ", ".join(["i int", *[f"{n} string" for n in names]]))
    got = [r[0] for r in df.orderBy("i").select(expr(*[F.col(n) for n in names])).collect()]
    assert [(c[:columns], g) for c, g in zip(cases, got)] == [(c[:columns], c[columns]) for c in cases]


def test_kpi_category(spark):
    check(spark, [("Mem_Used_Pct", "memory"), ("MemFree", "memory"), ("cpu_load", "cpu"), ("cpu_idle", "other"), ("tcp_retrans", "network"),
                  ("dsk_busy", "disk"), ("jdbc_active", "db"), ("container_restart", "process"), ("rows", "other")], S.kpi_category)


def test_reason_hint(spark):
    check(spark, [("Heap_size", "JVM Out of Memory (OOM) Heap"), ("JVMUsedMemory", "high memory usage"), ("cpuload", "high JVM CPU load"),
                  ("proc_user_pct", "high CPU usage"), ("memory_pct", "high memory usage"), ("packet_count", "network packet loss"),
                  ("CLOSE-WAIT", "network packet loss"), ("mrt", "network latency"), ("sess_active", "db connection limit"),
                  ("cursor_close", "db close"), ("io_util", "high disk I/O read usage"), ("bytes_write", "node disk write I/O consumption"),
                  ("space_left", "high disk space usage"), ("restart_count", "container process termination"),
                  ("corrupt_frames", "container network packet corruption"), ("iowait", "high disk I/O read usage"), ("rows", None)],
          lambda c: S.reason_hint(c, REASONS))


def test_low_sensitive_kpis(spark):
    check(spark, [("success_total", True), ("sr", True), ("cpu_idle", True), ("MemAvail", True), ("cpu_used", False)], S.is_low_sensitive)


def test_type_prior(spark):
    check(spark, [("db", "service", 0.55), ("db", "db", 0.40), ("redis", "node", 0.45), ("service", "redis", 0.50), ("pod", "pod", 0.55),
                  ("node", "pod", 0.65), ("node", "node", 0.50), ("node", "db", 0.60), ("middleware", "db", 0.45)], S.type_prior, 2)


def test_reason_prior(spark):
    check(spark, [("db connection limit", "db", 0.85), ("high memory usage", "redis", 0.80), ("node CPU load", "node", 0.85),
                  ("container memory load", "pod", 0.75), ("network latency", "service", 0.90), ("network packet loss", "service", 0.85),
                  ("high CPU usage", "service", 0.60), ("high memory usage", "service", 0.55), ("db close", "service", 0.70),
                  ("network delay", "middleware", 0.80), ("packet loss", "middleware", 0.80), ("jvm load", "middleware", 0.60),
                  ("oom", "middleware", 0.55), ("high memory usage", "node", 0.35)], S.reason_prior, 2)


def test_log_reason_rules(spark):
    cases = [("java outofmemory here", "JVM Out of Memory (OOM) Heap", 3.0), ("gc pause", "high memory usage", 1.0), ("cpu busy", "high CPU usage", 1.5),
             ("timeout waiting", "network latency", 2.0), ("packet dropped", "network packet loss", 2.0), ("too many clients", "db connection limit", 2.0),
             ("disk full", "high disk I/O read usage", 1.5), ("warn about it", "high CPU usage", 0.5), ("all is well", None, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = df.select("i", L._template_rule(F.col("t"), REASONS).alias("r")).select("i", "r.reason", "r.weight").orderBy("i").collect()
    assert [(r.reason, r.weight) for r in got] == [c[1:] for c in cases]


def test_signal_family(spark):
    check(spark, [("oom_kills", "jvm_oom"), ("jvm_cpu", "jvm_cpu"), ("heap_used", "jvm_memory"), ("retrans", "network_loss"),
                  ("time-wait", "network_latency"), ("mrt", "network_latency"), ("success_rate", "network_loss"), ("filesystem_used", "disk_space"),
                  ("iowait", "disk_io"), ("qcache_pool", "db_connection"), ("innodb_closed", "db_close"), ("sql_rows", "db"),
                  ("processor_x", "cpu"), ("rss", "memory"), ("killed", "process"), ("x", "other")], S.signal_family)


def test_reason_family_and_alignment(spark):
    check(spark, [("OOM killer", "jvm_oom"), ("heap memory", "jvm_oom"), ("jvm cpu", "jvm_cpu"), ("packet corruption", "network_loss"),
                  ("timeout", "network_latency"), ("disk space", "disk_space"), ("disk read", "disk_io"), ("limit reached", "db_connection"),
                  ("db close", "db_close"), ("mem", "memory"), ("cpu", "cpu"), ("process gone", "process")], S.reason_family)
    check(spark, [("memory", "jvm_memory", 0.45), ("cpu", "cpu", 1.0), ("cpu", "disk_io", 0.0), ("db_close", "db_connection", 0.45),
                  ("process", "process", 1.0), ("network_loss", "network_latency", 0.0)], S.family_alignment, 2)


def test_ownership_and_metric_type(spark):
    check(spark, [("db", "mysql_x", 1.0), ("redis", "Redis_mem", 1.0), ("service", "jvm_heap", 1.0), ("middleware", "mrt", 0.95),
                  ("pod", "container_x", 0.85), ("db", "network_in", 0.45), ("db", "x", 0.65)], S.ownership_weight, 2)
    check(spark, [("cpuload", "cpu"), ("mem", "memory"), ("fin-wait", "packet"), ("tnsping", "latency"), ("sess", "connection"), ("zzz", "unknown")],
          S.metric_type)


@pytest.mark.parametrize("interpolate", [True, False])
def test_percentiles_of_a_hot_key(spark, interpolate):
    """One key with nine tenths of the rows, ties, far outliers; every group exact."""
    rng = np.random.default_rng(7)
    groups = {"hot": np.concatenate([rng.normal(50, 10, 18_000), np.repeat(55.5, 500), [1e9, -1e9]]), "ties": np.repeat([1.0, 2.0], [900, 600]),
              "one": np.array([3.0]), "two": np.array([1.0, 9.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r["k"]: [r[n] for n in probs] for r in ST.exact_percentiles(df, ["k"], "v", probs, accuracy=200, interpolate=interpolate).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        want = [np.quantile(vs, p) for p in probs.values()] if interpolate else [np.sort(vs)[min(len(vs) - 1, int(len(vs) * p))] for p in probs.values()]
        assert got[k] == pytest.approx(want, rel=1e-12)
