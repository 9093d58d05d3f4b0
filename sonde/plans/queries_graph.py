"""Registered queries: causal edges, influence, explanation, log topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.functions import scalars as S
from sonde.operators import graph as G
from sonde.operators import spans as SP
from sonde.operators import windows as WN
from sonde.plans import queries_detect as QD
from sonde.plans.registry import cte, query
from sonde.plans.stages import stage
from sonde.sources import tables as T

E3 = "incident_id, source, target"


def r(name, digits=6):
    return S.rounded(F.col(name), digits).alias(name)


# ------------------------------------------------------------------ stages
def calls(spark, sf_dir):
    return stage(spark, sf_dir, "calls", lambda: SP.call_pairs(window_spans(spark, sf_dir), ["incident_id"]))


def window_spans(spark, sf_dir):
    """Event spans inside the incidents."""
    return stage(spark, sf_dir, "window_spans", lambda: WN.window_join(
        T.event_spans(spark, sf_dir), T.incidents(spark, sf_dir)).drop("start_ts", "end_ts"))


def candidates(spark, sf_dir):
    return stage(spark, sf_dir, "candidates", lambda: QD.candidates(spark, sf_dir))


def refined(spark, sf_dir):
    def build():
        from sonde.operators.detect import layer_filter
        kept = layer_filter(candidates(spark, sf_dir)).filter("refined").select("incident_id", "component")
        return candidates(spark, sf_dir).join(kept, ["incident_id", "component"], "left_semi")
    return stage(spark, sf_dir, "refined", build)


def pairs(spark, sf_dir):
    nodes = G.select_nodes(calls(spark, sf_dir), refined(spark, sf_dir))
    return G.restrict(G.causal_pairs(calls(spark, sf_dir)), nodes)


def merged_series(spark, sf_dir):
    from sonde.operators.detect import intensity
    return G.aligned(pairs(spark, sf_dir), intensity(QD.points_b(spark, sf_dir)))


def lag_table(spark, sf_dir):
    from sonde.operators.detect import intensity
    return stage(spark, sf_dir, "lags", lambda: G.edge_lag_scores(
        pairs(spark, sf_dir), intensity(QD.points_b(spark, sf_dir))))


def onsets(spark, sf_dir):
    from sonde.operators.detect import kpi_onsets
    def build():
        m = QD.metrics(spark, sf_dir)
        res = WN.multi_resolution_onset(m, QD.stats_table(spark, sf_dir), T.incidents(spark, sf_dir), (3600, 7200, 21600))
        return G.onset_choice(QD.scores(spark, sf_dir), res, kpi_onsets(QD.segments(spark, sf_dir)), (3600, 7200, 21600))
    return stage(spark, sf_dir, "onsets", build)


def edges(spark, sf_dir):
    return stage(spark, sf_dir, "causal_edges", lambda: G.weigh(
        pairs(spark, sf_dir), lag_table(spark, sf_dir), onsets(spark, sf_dir)))


def strengths(spark, sf_dir):
    return stage(spark, sf_dir, "strengths", lambda: G.influence(edges(spark, sf_dir), candidates(spark, sf_dir)))


# ------------------------------------------------------------------ nodes and pairs
cte("calls_inc", "SELECT * FROM event_calls WHERE caller <> callee")
cte("refined_set", "SELECT c.* FROM cands c JOIN refined r USING (incident_id, component) WHERE r.refined")
cte("graph_nodes", """
SELECT incident_id, component FROM refined_set UNION
SELECT c.incident_id, callee FROM calls_inc c JOIN refined_set r ON r.incident_id = c.incident_id AND r.component = caller UNION
SELECT c.incident_id, caller FROM calls_inc c JOIN refined_set r ON r.incident_id = c.incident_id AND r.component = callee""")
cte("graph_pairs", """
SELECT c.incident_id, callee AS source, caller AS target, calls AS call_count FROM calls_inc c
WHERE (c.incident_id, caller) IN (SELECT (incident_id, component) FROM graph_nodes)
  AND (c.incident_id, callee) IN (SELECT (incident_id, component) FROM graph_nodes)""")


@query("grf2_select_nodes_direct", "SELECT * FROM graph_nodes")
def select_nodes(spark, sf_dir):
    return G.select_nodes(calls(spark, sf_dir), refined(spark, sf_dir))


@query("grf2_select_nodes_full_path", """
WITH RECURSIVE l AS (SELECT incident_id, caller AS a, callee AS b FROM calls_inc UNION SELECT incident_id, callee, caller FROM calls_inc),
w(incident_id, origin, node, d) AS (SELECT incident_id, component, component, 0 FROM refined_set
  UNION SELECT w.incident_id, origin, l.b, d + 1 FROM w JOIN l ON l.incident_id = w.incident_id AND l.a = w.node WHERE d < 12),
m AS (SELECT incident_id, origin, node, min(d) AS d FROM w GROUP BY ALL)
SELECT incident_id, component FROM graph_nodes UNION
SELECT p.incident_id, x.node FROM m p JOIN refined_set t ON t.incident_id = p.incident_id AND t.component = p.node
JOIN m x ON x.incident_id = p.incident_id AND x.origin = p.origin
JOIN m y ON y.incident_id = p.incident_id AND y.origin = p.node AND y.node = x.node WHERE x.d + y.d = p.d""")
def select_nodes_path(spark, sf_dir):
    return G.select_nodes(calls(spark, sf_dir), refined(spark, sf_dir), "full_path")


cte("aligned", f"""
SELECT {E3}, ts, sum(x) AS x, sum(y) AS y FROM (
  SELECT e.incident_id, source, target, ts, intensity AS x, 0.0 AS y FROM graph_pairs e JOIN intensity i ON i.incident_id = e.incident_id AND i.component = source
  UNION ALL SELECT e.incident_id, source, target, ts, 0.0, intensity FROM graph_pairs e JOIN intensity i ON i.incident_id = e.incident_id AND i.component = target)
GROUP BY ALL""")


@query("join4_full_outer_series", f"SELECT {E3}, ts, round(x, 6)::DOUBLE AS x, round(y, 6)::DOUBLE AS y FROM aligned")
def full_outer(spark, sf_dir):
    return merged_series(spark, sf_dir).select("incident_id", "source", "target", "ts", r("x"), r("y"))


def _corr(a, b):
    return (f"CASE WHEN count({b}) >= 3 AND sqrt((var_pop({a}) FILTER ({b} IS NOT NULL)) * var_pop({b})) * count({b}) >= 1e-12 "
            f"THEN abs(corr({a}, {b})) ELSE 0 END")


cte("lags", f"""
WITH l AS (SELECT {E3}, x, y, {', '.join(f'lead(y, {k}) OVER w AS y{k}, lead(x, {k}) OVER w AS x{k}' for k in range(1, 6))}
  FROM aligned WINDOW w AS (PARTITION BY {E3} ORDER BY ts)),
g AS (SELECT {E3}, count(*) AS n, {_corr('x', 'y')} AS c0, greatest({', '.join(_corr('x', f'y{k}') for k in range(1, 6))}) AS f,
  greatest({', '.join(_corr('y', f'x{k}') for k in range(1, 6))}) AS b FROM l GROUP BY {E3})
SELECT {E3}, n AS rows, CASE WHEN n >= 3 THEN least(1, greatest(c0, f)) ELSE 0 END AS lag_corr,
  CASE WHEN n >= 3 AND f + b >= 1e-6 THEN (f - b + f + b) / (2 * (f + b)) ELSE 0.5 END AS lead_score FROM g""")


@query("win4_lagged_correlation", f"SELECT {E3}, round(lag_corr, 6)::DOUBLE AS lag_corr FROM lags")
def lagged(spark, sf_dir):
    return lag_table(spark, sf_dir).select("incident_id", "source", "target", r("lag_corr"))


@query("win5_lead_score", f"SELECT {E3}, round(lead_score, 6)::DOUBLE AS lead_score FROM lags")
def lead(spark, sf_dir):
    return lag_table(spark, sf_dir).select("incident_id", "source", "target", r("lead_score"))


cte("res_onsets", """
WITH sizes AS (SELECT unnest([3600, 7200, 21600]) AS size),
starts AS (SELECT incident_id, start_ts, size, unnest(range(start_ts, end_ts - size + 1, size // 2)) AS ws FROM incidents, sizes),
means AS (SELECT s.incident_id, s.size, s.ws, m.component, m.kpi, m.day, avg(m.value) AS mean_value FROM starts s JOIN metrics m
  ON m.ts >= s.ws AND m.ts < s.ws + s.size GROUP BY ALL)
SELECT incident_id, component, size, min(ws) AS onset FROM means JOIN day_stats_r USING (component, kpi, day) WHERE mean_value > high * 0.9 GROUP BY ALL""")
cte("node_onset", """
SELECT s.incident_id, s.component, coalesce(min(onset) FILTER (size = 3600), min(onset) FILTER (size = 7200), min(onset) FILTER (size = 21600), any_value(first_ts)) AS onset
FROM scores s LEFT JOIN res_onsets o ON o.incident_id = s.incident_id AND o.component = s.component GROUP BY s.incident_id, s.component""")


@query("grf4_onset_choice", "SELECT * FROM node_onset")
def onset_choice(spark, sf_dir):
    return onsets(spark, sf_dir)


_TIME = """CASE WHEN {t} - {s} IS NULL THEN {u} WHEN {t} - {s} > 0 THEN 1 / (1 + greatest({t} - {s}, 0) / 60) WHEN {t} = {s} THEN 0.5 ELSE 0.1 END"""
cte("causal_edges", f"""
WITH x AS (SELECT p.*, {_TIME.format(s='a.onset', t='b.onset', u='0.5')} AS s_time, coalesce(lag_corr, 0) AS s_corr, coalesce(lead_score, 0.5) AS s_lead,
  coalesce(tp.prior, 0.45) AS s_prior, 1 - exp(-call_count / 5) AS reliability FROM graph_pairs p
  LEFT JOIN node_onset a ON a.incident_id = p.incident_id AND a.component = p.source
  LEFT JOIN node_onset b ON b.incident_id = p.incident_id AND b.component = p.target
  LEFT JOIN lags l ON l.incident_id = p.incident_id AND l.source = p.source AND l.target = p.target
  LEFT JOIN component_types ca ON ca.component = p.source LEFT JOIN component_types cb ON cb.component = p.target
  LEFT JOIN type_priors tp ON tp.st = ca.ctype AND tp.tt = cb.ctype)
SELECT *, round(least(1, greatest(0, reliability * (0.35 * s_time + 0.25 * s_corr + 0.15 * s_lead + 0.25 * s_prior) + (1 - reliability) * s_prior)), 6) AS weight FROM x""")


@query("grf3_time_precedence", f"SELECT {E3}, round(s_time, 6)::DOUBLE AS s_time FROM causal_edges")
def time_precedence(spark, sf_dir):
    return edges(spark, sf_dir).select("incident_id", "source", "target", r("s_time"))


@query("grf5_causal_edge_weight", f"""
SELECT {E3}, call_count, round(s_time, 6)::DOUBLE AS s_time, round(s_corr, 6)::DOUBLE AS s_corr, round(s_lead, 6)::DOUBLE AS s_lead,
  s_prior::DOUBLE AS s_prior, round(reliability, 6)::DOUBLE AS reliability, weight FROM causal_edges""")
def causal_edges(spark, sf_dir):
    return G.weigh(pairs(spark, sf_dir), lag_table(spark, sf_dir), onsets(spark, sf_dir)).select(
        "incident_id", "source", "target", "call_count", r("s_time"), r("s_corr"), r("s_lead"), "s_prior", r("reliability"), "weight")


@query("join8_map_lookup", f"""
SELECT e.incident_id, source, target, weight, a.score AS source_score, b.score AS target_score FROM causal_edges e
LEFT JOIN scores a ON a.incident_id = e.incident_id AND a.component = source LEFT JOIN scores b ON b.incident_id = e.incident_id AND b.component = target""")
def map_lookup(spark, sf_dir):
    return G._ends(edges(spark, sf_dir), QD.scores(spark, sf_dir), "score", ("source_score", "target_score")).select(
        "incident_id", "source", "target", "weight", "source_score", "target_score")


# ------------------------------------------------------------------ log topology
def topology_logs(spark, sf_dir):
    """Service messages over the events: data sources, pools, URLs, errors and access lines."""
    e = T.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint") % 6
    other = T._component((F.col("user_id") + 1 + k).cast("bigint"))
    ts = S.epoch_of_naive(F.col("ts"))
    value = (F.when(k == 0, F.concat(F.lit("Name = APP_"), F.when(F.col("user_id") % 2 == 0, "MYSQL").otherwise("REDIS"), F.lit(" Property url")))
             .when(k == 1, "Created JedisPool to master at 10.0.0.1:6379").when(k == 2, "open jdbc:mysql://10.0.0.7:3306/app")
             .when(k == 3, "Communications link failure, connection closed").when(k == 4, F.concat(other, F.lit(" POST /api/v1"))).otherwise("ok"))
    name = F.when(k == 4, "localhost_access_log").otherwise("catalina")
    return e.select(F.col("event_id").alias("log_id"), T._component(F.col("user_id")).alias("component"), ts.alias("ts"),
                    name.alias("log_name"), value.alias("value"))


cte("topology_logs", f"""
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) % 6 AS k FROM events)
SELECT event_id AS log_id, {T._COMPONENT_SQL} AS component, {T._EPOCH_SQL} AS ts, CASE WHEN k = 4 THEN 'localhost_access_log' ELSE 'catalina' END AS log_name,
  CASE k WHEN 0 THEN 'Name = APP_' || CASE WHEN user_id % 2 = 0 THEN 'MYSQL' ELSE 'REDIS' END || ' Property url'
   WHEN 1 THEN 'Created JedisPool to master at 10.0.0.1:6379' WHEN 2 THEN 'open jdbc:mysql://10.0.0.7:3306/app'
   WHEN 3 THEN 'Communications link failure, connection closed' WHEN 4 THEN ({T._COMPONENT_SQL.replace('user_id', '(user_id + 1 + k)')}) || ' POST /api/v1' ELSE 'ok' END AS value FROM e""")
cte("log_calls", """
WITH l AS (SELECT i.incident_id, t.component, t.value FROM topology_logs t JOIN incidents i ON t.ts BETWEEN i.start_ts AND i.end_ts),
x AS (SELECT incident_id, component AS caller, CASE WHEN contains(value, 'MYSQL') THEN 'mysql_02' ELSE 'redis_03' END AS callee, 5 AS c FROM l WHERE starts_with(value, 'Name =')
 UNION ALL SELECT DISTINCT incident_id, component, 'redis_03', 5 FROM l WHERE contains(value, 'JedisPool')
 UNION ALL SELECT incident_id, component, 'mysql_02', 5 FROM l WHERE contains(value, 'jdbc:')
 UNION ALL SELECT incident_id, split_part(value, ' ', 1), component, 1 FROM l WHERE contains(value, ' POST ') AND split_part(value, ' ', 1) <> component)
SELECT incident_id, caller, callee, sum(c)::BIGINT AS calls FROM x GROUP BY ALL""")


def log_calls(spark, sf_dir):
    from sonde.operators.topology import mine_calls
    return stage(spark, sf_dir, "log_calls", lambda: mine_calls(
        topology_logs(spark, sf_dir), T.incidents(spark, sf_dir), T.COMPONENTS))


@query("grf8_log_topology", "SELECT * FROM log_calls")
def log_topology(spark, sf_dir):
    from sonde.operators.topology import mine_calls
    return mine_calls(topology_logs(spark, sf_dir), T.incidents(spark, sf_dir), T.COMPONENTS)


@query("grf8_topology_status", """
WITH a AS (SELECT incident_id, caller AS n FROM calls_inc UNION SELECT incident_id, callee FROM calls_inc),
b AS (SELECT incident_id, caller AS n FROM log_calls UNION SELECT incident_id, callee FROM log_calls),
o AS (SELECT incident_id, count(*) AS overlap FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY ALL)
SELECT i.incident_id, coalesce(overlap, 0) AS overlap_nodes, (SELECT count(*) FROM log_calls l JOIN calls_inc c USING (incident_id, caller, callee)
  WHERE l.incident_id = i.incident_id) AS matched,
  CASE WHEN i.incident_id NOT IN (SELECT incident_id FROM log_calls) THEN 'EMPTY' WHEN coalesce(overlap, 0) > 0 THEN 'MERGED' ELSE 'INDEPENDENT' END AS status
FROM incidents i LEFT JOIN o USING (incident_id)""")
def topology_status(spark, sf_dir):
    from sonde.operators.topology import merge_status
    return merge_status(T.incidents(spark, sf_dir), calls(spark, sf_dir), log_calls(spark, sf_dir), topology_logs(spark, sf_dir))


cte("merged_calls", """
SELECT incident_id, caller, callee, coalesce(t.calls, 0) AS trace_calls, coalesce(l.calls, 0) AS log_calls, greatest(coalesce(t.calls, 0), coalesce(l.calls, 0)) AS calls
FROM calls_inc t FULL JOIN log_calls l USING (incident_id, caller, callee)""")


# incidents of half an hour, around noon: their call graph is that of the whole local day
cte("noon_windows", "SELECT incident_id, start_ts + 43200 AS start_ts, start_ts + 44999 AS end_ts FROM incidents")


def noon_windows(spark, sf_dir):
    return T.incidents(spark, sf_dir).select("incident_id", (F.col("start_ts") + 43200).alias("start_ts"), (F.col("start_ts") + 44999).alias("end_ts"))


@query("grf1_whole_day_calls", """
WITH d AS (SELECT incident_id, (start_ts + 28800) // 86400 AS day FROM noon_windows),
s AS (SELECT d.incident_id, e.* FROM event_spans e JOIN d ON (e.ts + 28800) // 86400 = d.day),
p AS (SELECT incident_id, trace_id, span_id, min(component) AS component FROM s GROUP BY ALL)
SELECT s.incident_id, p.component AS caller, s.component AS callee, count(*) AS calls FROM s JOIN p ON p.incident_id = s.incident_id AND p.trace_id = s.trace_id AND p.span_id = s.parent_id
WHERE p.component <> s.component GROUP BY ALL""")
def whole_day_calls(spark, sf_dir):
    days = WN.whole_days(noon_windows(spark, sf_dir))
    spans = WN.window_join(T.event_spans(spark, sf_dir), days).drop("start_ts", "end_ts")
    return SP.component_calls(spans, T.COMPONENTS, ["incident_id"])


@query("grf9_merge_calls", "SELECT * FROM merged_calls")
def merge_calls(spark, sf_dir):
    return G.merge_calls(calls(spark, sf_dir), log_calls(spark, sf_dir))


cte("edges_v2", f"""
WITH x AS (SELECT m.incident_id, callee AS source, caller AS target, m.calls AS call_count, trace_calls AS tc, m.log_calls AS lc,
  {_TIME.format(s='a.first_ts', t='b.first_ts', u='1e-5')} AS t, CASE WHEN coalesce(l.rows, 0) >= 3 THEN lag_corr ELSE 1e-5 END AS c, coalesce(tp.prior, 0.45) AS p
  FROM merged_calls m LEFT JOIN scores a ON a.incident_id = m.incident_id AND a.component = callee LEFT JOIN scores b ON b.incident_id = m.incident_id AND b.component = caller
  LEFT JOIN lags l ON l.incident_id = m.incident_id AND l.source = callee AND l.target = caller
  LEFT JOIN component_types ca ON ca.component = callee LEFT JOIN component_types cb ON cb.component = caller
  LEFT JOIN type_priors tp ON tp.st = ca.ctype AND tp.tt = cb.ctype WHERE caller <> callee),
y AS (SELECT *, 0.35 * t + 0.3 * c + 0.35 * p AS s, CASE WHEN tc > 0 THEN 1 - exp(-tc / 5) WHEN lc > 0 THEN least(0.55, 0.2 + 0.3 * greatest(t, c))
  ELSE least(0.45, 0.1 + 0.3 * greatest(t, c)) END AS r, p * CASE WHEN tc > 0 THEN 1 WHEN lc > 0 THEN 0.5 ELSE 0.35 END AS anchor FROM x)
SELECT {E3}, call_count, CASE WHEN tc > 0 AND lc > 0 THEN 'confirmed' WHEN tc > 0 THEN 'trace' WHEN lc > 0 THEN 'log' ELSE 'inferred' END AS evidence,
  round(least(1, greatest(0, (r * s + (1 - r) * anchor) * CASE WHEN tc > 0 AND lc > 0 THEN 1.05 ELSE 1 END)), 6) AS weight FROM y""")


def edges_v2(spark, sf_dir):
    return stage(spark, sf_dir, "edges_v2", lambda: G.weigh_with_logs(
        G.merge_calls(calls(spark, sf_dir), log_calls(spark, sf_dir)), lag_table(spark, sf_dir), QD.scores(spark, sf_dir)))


@query("grf6_edge_weight_v2", f"SELECT {E3}, call_count, evidence, weight FROM edges_v2")
def edge_weight_v2(spark, sf_dir):
    return G.weigh_with_logs(G.merge_calls(calls(spark, sf_dir), log_calls(spark, sf_dir)), lag_table(spark, sf_dir),
                             QD.scores(spark, sf_dir))


@query("grf1_inferred_dependencies", """
WITH few AS (SELECT * FROM calls_inc WHERE caller NOT IN ('mysql_02', 'node-1') AND callee NOT IN ('mysql_02', 'node-1')),
seen AS (SELECT incident_id, caller AS c FROM few UNION SELECT incident_id, callee FROM few),
k AS (SELECT c.incident_id, c.component, t.ctype FROM cands c JOIN component_types t USING (component)),
x AS (SELECT a.incident_id, a.component AS caller, b.component AS callee, CASE WHEN b.ctype = 'node' THEN 3 ELSE 5 END AS calls FROM k a JOIN k b ON a.incident_id = b.incident_id
  WHERE b.ctype IN ('db', 'redis', 'node') AND (b.incident_id, b.component) NOT IN (SELECT (incident_id, c) FROM seen) AND a.component <> b.component
  AND (a.ctype IN ('service', 'pod') OR (b.ctype = 'node' AND a.ctype IN ('db', 'redis'))))
SELECT incident_id, caller, callee, sum(calls)::BIGINT AS calls FROM (SELECT incident_id, caller, callee, calls FROM few UNION ALL SELECT * FROM x) GROUP BY ALL""")
def inferred(spark, sf_dir):
    few = calls(spark, sf_dir).filter(~F.col("caller").isin("mysql_02", "node-1") & ~F.col("callee").isin("mysql_02", "node-1"))
    return G.infer_missing(few, candidates(spark, sf_dir))


@query("grf7_isolated_edges", """
WITH e AS (SELECT * FROM causal_edges WHERE source <> 'mysql_02' AND target <> 'mysql_02'),
ends AS (SELECT incident_id, source AS c FROM e UNION SELECT incident_id, target FROM e),
x AS (SELECT a.incident_id, a.component AS source, b.component AS target, b.first_ts - a.first_ts AS dt, a.score AS s1, b.score AS s2, coalesce(prior, 0.45) AS p FROM cands a
  JOIN cands b ON a.incident_id = b.incident_id LEFT JOIN component_types ca ON ca.component = a.component LEFT JOIN component_types cb ON cb.component = b.component
  LEFT JOIN type_priors ON st = ca.ctype AND tt = cb.ctype
  WHERE (a.incident_id, a.component) NOT IN (SELECT (incident_id, c) FROM ends) AND (b.incident_id, b.component) IN (SELECT (incident_id, c) FROM ends) AND b.first_ts > a.first_ts)
SELECT incident_id, source, target, round(least(1, greatest(0, 0.4 / (1 + dt / 120) + 0.35 * p + 0.25 * least(1, s1 / greatest(s2, 0.01)))), 6)::DOUBLE AS weight FROM x""")
def isolated(spark, sf_dir):
    few = edges(spark, sf_dir).filter("source <> 'mysql_02' AND target <> 'mysql_02'")
    return G.isolated_edges(few, candidates(spark, sf_dir))


# ------------------------------------------------------------------ influence and scores
_HOPS = """
WITH mv AS (SELECT incident_id, source AS node, target AS next, weight FROM causal_edges UNION ALL SELECT incident_id, component, component, 1.0 FROM cands),
h0 AS (SELECT incident_id, component AS origin, component AS node, 1.0::DOUBLE AS strength FROM cands)""" + "".join(f""",
h{k} AS (SELECT h.incident_id, origin, next AS node, max(least(strength, weight)) AS strength FROM h{k - 1} h
  JOIN mv ON mv.incident_id = h.incident_id AND mv.node = h.node GROUP BY ALL)""" for k in range(1, 7)) + """
SELECT * FROM h6"""
cte("strengths", _HOPS)


@query("grf10_bottleneck_influence", "SELECT incident_id, origin, node, strength::DOUBLE AS strength FROM strengths")
def bottleneck(spark, sf_dir):
    return G.influence(edges(spark, sf_dir), candidates(spark, sf_dir))


@query("grf11_topology_score", """
WITH RECURSIVE r(incident_id, origin, node) AS (SELECT incident_id, source, target FROM causal_edges
  UNION SELECT r.incident_id, origin, e.target FROM r JOIN causal_edges e ON e.incident_id = r.incident_id AND e.source = r.node),
k AS (SELECT r.incident_id, origin AS component, count(*) AS reach FROM r JOIN cands c ON c.incident_id = r.incident_id AND c.component = node WHERE origin <> node GROUP BY ALL),
o AS (SELECT incident_id, source AS component, count(*) AS n, sum(weight) AS w FROM causal_edges GROUP BY ALL),
i AS (SELECT e.incident_id, target AS component, count(*) AS n, sum(weight) AS w, sum(CASE WHEN c.component IS NULL THEN 0 ELSE weight END) AS hw
  FROM causal_edges e LEFT JOIN cands c ON c.incident_id = e.incident_id AND c.component = source GROUP BY ALL),
t AS (SELECT incident_id, count(*) AS n FROM cands GROUP BY ALL)
SELECT c.incident_id, c.component, CASE WHEN o.n IS NULL AND i.n IS NULL THEN 0.5 ELSE round(least(1, greatest(0, 0.4 * coalesce(reach, 0) / t.n
  + 0.35 * coalesce(o.n, 0) / (coalesce(o.n, 0) + coalesce(i.n, 0) + 1e-9) - 0.25 * coalesce(hw, 0) / (coalesce(i.w, 0) + coalesce(o.w, 0) + 1e-9))), 6) END::DOUBLE AS topology_score
FROM cands c JOIN t USING (incident_id) LEFT JOIN k USING (incident_id, component) LEFT JOIN o USING (incident_id, component) LEFT JOIN i USING (incident_id, component)""")
def topology_score(spark, sf_dir):
    return G.topology_score(edges(spark, sf_dir), candidates(spark, sf_dir)).withColumn(
        "topology_score", S.rounded(F.col("topology_score"), 6))


cte("explain_scores", """
WITH x AS (SELECT s.*, b.score AS severity, a.rank FROM strengths s JOIN cands b ON b.incident_id = s.incident_id AND b.component = s.node
  JOIN refined_set a ON a.incident_id = s.incident_id AND a.component = s.origin WHERE strength > 0),
y AS (SELECT p.*, (SELECT count(*) FROM x q WHERE q.incident_id = p.incident_id AND q.node = p.node AND q.rank < p.rank AND q.strength > 0.1) AS rivals FROM x p),
g AS (SELECT incident_id, origin AS component, sum(severity * strength * greatest(0.7, 1 - 0.075 * rivals)) AS num, sum(severity) AS den FROM y WHERE origin <> node GROUP BY ALL),
m AS (SELECT incident_id, max(score) AS mx FROM cands GROUP BY ALL)
SELECT c.incident_id, c.component, round(least(1, greatest(0, CASE WHEN den > 0 THEN num / den
  WHEN (c.incident_id, c.component) IN (SELECT (incident_id, source) FROM causal_edges) THEN score / mx * 0.3 ELSE score / mx * 0.6 END)), 6)::DOUBLE AS explain_score
FROM refined_set c JOIN m USING (incident_id) LEFT JOIN g USING (incident_id, component)""")


def explain(spark, sf_dir):
    return stage(spark, sf_dir, "explain", lambda: G.explain_score(
        strengths(spark, sf_dir), edges(spark, sf_dir), refined(spark, sf_dir), candidates(spark, sf_dir)))


@query("grf12_explain_score", "SELECT * FROM explain_scores")
def explain_score(spark, sf_dir):
    return G.explain_score(strengths(spark, sf_dir), edges(spark, sf_dir), refined(spark, sf_dir), candidates(spark, sf_dir))


cte("unexplained_scores", """
WITH h AS (SELECT e.*, p.score AS ps, p.first_ts AS pt FROM edges_v2 e JOIN cands p ON p.incident_id = e.incident_id AND p.component = e.source WHERE p.score > 0),
g AS (SELECT incident_id, target AS c, count(*) AS n FROM h GROUP BY ALL),
u AS (SELECT h.incident_id, h.target AS component, sum(ps * weight / (1 + 0.3 * coalesce(g.n, 0))) AS up FROM h
  JOIN cands c ON c.incident_id = h.incident_id AND c.component = h.target LEFT JOIN g ON g.incident_id = h.incident_id AND g.c = h.source WHERE pt < c.first_ts GROUP BY ALL)
SELECT c.incident_id, c.component, round(CASE WHEN score <= 0 THEN 0 WHEN up IS NULL THEN least(1, score)
  ELSE least(1, greatest(0, (1 - least(1, up / greatest(score, 1e-6))) * score)) END, 6)::DOUBLE AS unexplained
FROM cands c LEFT JOIN u USING (incident_id, component)""")


@query("grf13_unexplained_score", "SELECT * FROM unexplained_scores")
def unexplained(spark, sf_dir):
    return G.unexplained_score(edges_v2(spark, sf_dir), candidates(spark, sf_dir))


cte("contextual_scores", """
WITH h AS (SELECT e.incident_id, e.source, e.target, weight * p.score AS pull FROM causal_edges e JOIN cands p ON p.incident_id = e.incident_id AND p.component = e.source),
x AS (SELECT s.incident_id, s.origin, s.node, b.score AS sy, s.strength * a.score AS mine, (SELECT coalesce(sum(pull), 0) FROM h WHERE h.incident_id = s.incident_id AND h.target = s.node AND h.source <> s.origin) AS others
  FROM strengths s JOIN cands a ON a.incident_id = s.incident_id AND a.component = s.origin JOIN cands b ON b.incident_id = s.incident_id AND b.component = s.node
  WHERE s.strength > 0 AND s.origin <> s.node),
g AS (SELECT incident_id, origin AS component, sum(sy * CASE WHEN mine + others > 1e-9 THEN least(1, mine / (mine + others)) ELSE 0 END) AS num, sum(sy) AS den FROM x GROUP BY ALL),
m AS (SELECT incident_id, max(score) AS mx FROM cands GROUP BY ALL)
SELECT c.incident_id, c.component, round(least(1, greatest(0, CASE WHEN score <= 0 THEN 0 WHEN den > 1e-9 THEN num / den
  WHEN (c.incident_id, c.component) IN (SELECT (incident_id, source) FROM causal_edges) THEN score / mx * 0.3 ELSE score / mx * 0.6 END)), 6)::DOUBLE AS contextual
FROM cands c JOIN m USING (incident_id) LEFT JOIN g USING (incident_id, component)""")
cte("discounted_scores", """
WITH s AS (SELECT e.incident_id, target AS component, count(c.component)::DOUBLE / count(*) AS share FROM causal_edges e
  LEFT JOIN cands c ON c.incident_id = e.incident_id AND c.component = e.source GROUP BY ALL)
SELECT incident_id, component, contextual, round(contextual * (1 - 0.7 * coalesce(share, 0)), 6)::DOUBLE AS discounted FROM contextual_scores LEFT JOIN s USING (incident_id, component)""")


def discounted(spark, sf_dir):
    c = G.contextual_score(strengths(spark, sf_dir), edges(spark, sf_dir), candidates(spark, sf_dir))
    return G.downstream_discount(c, edges(spark, sf_dir), candidates(spark, sf_dir))


@query("grf14_contextual_score", "SELECT * FROM discounted_scores")
def contextual(spark, sf_dir):
    return discounted(spark, sf_dir)


cte("quality", """
WITH cov AS (SELECT r.incident_id, count(g.component)::DOUBLE / count(*) AS c FROM refined_set r LEFT JOIN graph_nodes g USING (incident_id, component) GROUP BY ALL),
e AS (SELECT incident_id, count(*) AS n, avg(weight) AS w FROM causal_edges GROUP BY ALL),
s AS (SELECT DISTINCT incident_id FROM graph_nodes WHERE (incident_id, component) NOT IN (SELECT (incident_id, target) FROM causal_edges)),
q AS (SELECT c.incident_id, e.n, 0.35 + 0.35 * c.c AS base, least(0.3, 0.1 + 0.05 * e.n) * least(1, e.w) AS bonus, s.incident_id IS NULL AS nosrc
  FROM cov c LEFT JOIN e USING (incident_id) LEFT JOIN s USING (incident_id))
SELECT incident_id, round(0.6 * least(1, CASE WHEN n IS NULL THEN base * 0.5 ELSE (base + bonus) * CASE WHEN nosrc THEN 0.9 ELSE 1 END END)
  + 0.4 * CASE WHEN n IS NULL THEN 0.45 ELSE 0.85 END, 6)::DOUBLE AS quality FROM q""")


def quality(spark, sf_dir):
    nodes = G.select_nodes(calls(spark, sf_dir), refined(spark, sf_dir))
    return G.graph_quality(nodes, edges(spark, sf_dir), refined(spark, sf_dir))


@query("rnk15_graph_quality", "SELECT * FROM quality")
def graph_quality(spark, sf_dir):
    return quality(spark, sf_dir)


@query("src13_graph_export", """
WITH n AS (SELECT incident_id, string_agg(component || ':' || ctype || ':' || CAST(score AS VARCHAR), ';' ORDER BY component) AS nodes FROM cands JOIN component_types USING (component) GROUP BY ALL),
e AS (SELECT incident_id, string_agg(source || '>' || target || ':' || CAST(call_count AS VARCHAR), ';' ORDER BY source, target) AS edges FROM causal_edges GROUP BY ALL)
SELECT incident_id, nodes, edges FROM n LEFT JOIN e USING (incident_id)""")
def graph_export(spark, sf_dir):
    """Graph documents written as JSON and read back."""
    from sonde.plans.queries_sources import _folder
    from sonde.sources.telemetry import graph_export as export
    nodes = candidates(spark, sf_dir).select("incident_id", "component", S.component_type(F.col("component")).alias("component_type"),
                                             F.col("score").alias("severity"))
    path = _folder(spark, sf_dir, "graphs", lambda p: export(nodes, edges(spark, sf_dir)).write.json(p))
    schema = ("struct<nodes:array<struct<component:string,component_type:string,severity:double>>,"
              "edges:array<struct<source:string,target:string,weight:double,call_count:bigint>>>")
    g = spark.read.schema("incident_id BIGINT, graph STRING").json(path).withColumn("g", F.from_json("graph", schema))
    node = F.transform("g.nodes", lambda x: F.concat_ws(":", x["component"], x["component_type"], x["severity"].cast("string")))
    edge = F.transform("g.edges", lambda x: F.concat(x["source"], F.lit(">"), x["target"], F.lit(":"), x["call_count"].cast("string")))
    return g.select("incident_id", F.array_join(node, ";").alias("nodes"), F.array_join(edge, ";").alias("edges"))
