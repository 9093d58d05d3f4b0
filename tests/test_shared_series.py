"""Steps that many queries share: word tests per series, series per pair of components, one pass over log lines."""

import random
import re
from fractions import Fraction
from pathlib import Path

from pyspark.sql import functions as F

from sonde.functions import fixed as V
from sonde.functions import scalars as S
from sonde.operators import detect as D
from sonde.operators import graph as G
from sonde.operators import stats as ST
from sonde.operators import topology as TP


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_of_kpis_are_not_searched_row_by_row(spark):
    rows = [("a", "cpu_used_percent", 0, 60 * i, 50.0 + i) for i in range(20)]
    metrics = spark.createDataFrame(rows, "component string, kpi string, day long, ts long, value double")
    stats = ST.day_thresholds(metrics)
    window = spark.createDataFrame([(1, 600, 86399)], "incident_id long, start_ts long, end_ts long")
    for points in (D.points_b(metrics, stats, window), D.points_a(metrics, stats, window, ("high CPU usage",))):
        above_joins = [line for line in plan(points).split("Join", 1)[0].splitlines()]
        assert not any("RLIKE" in line or "lower(" in line for line in above_joins)


def test_traits_say_what_the_words_say(spark):
    names = ["cpu_util", "CPU_used_percent", "MemFree_pct", "heap", "idle", "dskpercentbusy", "zabbix_agentd.cpu", "sr", "other", None]
    df = spark.createDataFrame([(n,) for n in names], "kpi string")
    low = F.lower("kpi")
    tests = {name: F.coalesce(test(low), F.lit(False)) for name, test in S.KPI_TRAITS}
    traits = S.kpi_traits(F.col("kpi"))
    for row in df.select("kpi", *[(S.has_trait(traits, n) == t).alias(n) for n, t in tests.items()]).collect():
        assert all(row[n] for n in tests), row


def test_edges_share_the_series_of_their_pair(spark):
    random.seed(3)
    series = [(1, c, 10 * t, random.random()) for c in "abc" for t in range(60) if random.random() < 0.7]
    intensity = spark.createDataFrame(series, "incident_id long, component string, ts long, intensity double")
    edges = spark.createDataFrame([(1, *e) for e in ("ab", "ba", "cb", "aa", "cx")], "incident_id long, source string, target string")
    seen = lambda df: {(r.source, r.target): (r.rows, round(r.lag_corr, 12), round(r.lead_score, 12)) for r in df.collect()}
    shared = G.edge_lag_scores(edges, intensity)
    assert seen(shared) == seen(G.lag_scores(G.aligned(edges, intensity)))
    merging = shared._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [incident_id" in merging and not re.search(r"Aggregate \[incident_id#\S+, source#\S+, target#\S+, ts#", merging)  # no table of all times
    assert set(seen(shared)) == {tuple(e) for e in ("ab", "ba", "cb", "aa", "cx")}


def test_log_calls_in_one_pass(spark):
    logs = spark.createDataFrame([
        ("a", 10, "log", "Created JedisPool"), ("a", 11, "log", "redis.clients.jedis up"), ("b", 12, "log", "Name = APP_MYSQL Property url"),
        ("b", 13, "log", "open jdbc:mysql://10.0.0.7:3306/app"), ("mysql_02", 14, "access_log", "front POST /x"), ("a", 15, "access_log", "curl GET /x"),
    ], "component string, ts long, log_name string, value string")
    window = spark.createDataFrame([(1, 0, 100)], "incident_id long, start_ts long, end_ts long")
    calls = TP.mine_calls(logs, window, ["redis_03", "redis_04", "mysql_02"])
    got = {(r.caller, r.callee): r.calls for r in calls.collect()}
    assert got == {("a", "redis_03"): V.LOG_CALLS, ("a", "redis_04"): V.LOG_CALLS, ("b", "mysql_02"): 2 * V.LOG_CALLS, ("front", "mysql_02"): 1}
    assert plan(calls).count("LogicalRDD") == 2  # lines and windows, each read once


def test_a_stage_table_has_one_builder():
    names = [n for f in sorted((Path(__file__).parents[1] / "sonde" / "plans").glob("*.py")) for n in re.findall(r'stage\(spark, sf_dir, "(\w+)"', f.read_text())]
    assert len(names) > 20 and len(names) == len(set(names)), [n for n in names if names.count(n) > 1]


def test_means_do_not_depend_on_the_order_of_tasks(spark):
    same, mixed, tiny, huge = [3.1] * 60, [0.1, 0.2, 0.3, 1e6, 7.7, 123.45] * 10, [1e-15, 3e-15], [1e300, 2e300, 3e300]
    rows = [(k, v) for k, group in enumerate((same, mixed, tiny, huge, [None])) for v in group]
    got = []
    for parts in (1, 7, 60):
        df = spark.createDataFrame(rows, "k int, v double").repartition(parts)
        got.append({r.k: r.m for r in df.groupBy("k").agg(S.steady_mean(F.col("v")).alias("m")).collect()})
    assert [g[1] for g in got] == [got[0][1]] * 3 and got[0][1] == sum(map(Fraction, map(str, mixed))) / 60
    assert all(g[0] == 3.1 and abs(g[2] - 2e-15) < 1e-28 and abs(g[3] - 2e300) < 1e286 and g[4] is None for g in got)


def test_the_scan_broadcasts_windows_not_rows(spark):
    from sonde.plans.queries_sources import window_scan
    join = window_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("Join ", 1)[1].splitlines()[0]
    assert "rightHint=(strategy=broadcast)" in join
