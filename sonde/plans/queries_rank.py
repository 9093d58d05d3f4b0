"""Registered queries: rankings, onsets, cause selection, answers of the three flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.functions import scalars as S
from sonde.operators import graph as G
from sonde.operators import logs as L
from sonde.operators import rank as RK
from sonde.operators import reason as R
from sonde.operators import spans as SP
from sonde.operators import windows as WN
from sonde.plans import queries_detect as QD
from sonde.plans import queries_graph as QG
from sonde.plans import queries_reason as QR
from sonde.plans.registry import cte, query, sql_case
from sonde.plans.stages import stage
from sonde.sources import tables as T
from sonde.functions import fixed as V

C = "incident_id, component"
DEFAULT_COMPONENT, DEFAULT_REASON = T.COMPONENTS[0], T.REASONS[0]


def r(name, digits=6):
    return S.rounded(F.col(name), digits).alias(name)


def tasks(spark, sf_dir):
    """Incidents with a failure count and whether only the time is asked for."""
    i = F.col("incident_id")
    return T.incidents(spark, sf_dir).withColumn("failure_count", (1 + F.floor(i / 3) % 3).cast("int")).withColumn(
        "time_only", i % 4 == 2)


cte("tasks", "SELECT *, CAST(1 + incident_id // 3 % 3 AS INTEGER) AS failure_count, incident_id % 4 = 2 AS time_only FROM incidents")
_PRIOR = "CASE ctype WHEN 'service' THEN 0.85 WHEN 'pod' THEN 0.8 WHEN 'node' THEN 0.75 WHEN 'middleware' THEN 0.75 WHEN 'redis' THEN 0.7 WHEN 'db' THEN 0.65 ELSE 0.7 END"

# ------------------------------------------------------------------ intervention rankings
cte("rank_v1", f"""
WITH x AS (SELECT s.incident_id, s.component, s.score, s.first_ts, e.explain_score AS es, {_PRIOR} AS tp,
  exp(-(s.first_ts - min(s.first_ts) OVER (PARTITION BY s.incident_id)) / 300.0) AS early
  FROM refined_set s JOIN explain_scores e USING (incident_id, component) JOIN component_types USING (component)),
y AS (SELECT *, round(least(1, greatest(0, ((0.40 * es + 0.30 * tp + 0.15 * early + 0.15 * score) + (0.10 * es + 0.20 * tp + 0.20 * early + 0.50 * score)
  + (0.15 * es + 0.50 * tp + 0.15 * early + 0.20 * score)) / 3)), 6)::DOUBLE AS root_score FROM x)
SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY root_score DESC, component) AS rank,
  exp(5 * (root_score - max(root_score) OVER w)) AS e FROM y WINDOW w AS (PARTITION BY incident_id)""")


def rank_v1(spark, sf_dir):
    return stage(spark, sf_dir, "rank_v1", lambda: RK.intervention_ranking(QG.refined(spark, sf_dir).drop("rank"), QG.explain(spark, sf_dir)))


@query("rnk2_intervention_ranking", "SELECT incident_id, component, root_score, CAST(rank AS INTEGER) AS rank FROM rank_v1")
def intervention_ranking(spark, sf_dir):
    return RK.intervention_ranking(QG.refined(spark, sf_dir).drop("rank"), QG.explain(spark, sf_dir)).select(
        "incident_id", "component", "root_score", "rank")


@query("win17_softmax", "SELECT incident_id, component, round(e / sum(e) OVER (PARTITION BY incident_id), 6)::DOUBLE AS probability FROM rank_v1")
def softmax(spark, sf_dir):
    return rank_v1(spark, sf_dir).select("incident_id", "component", "probability")


@query("rnk14_top_confidence", """
WITH g AS (SELECT incident_id, max(root_score) FILTER (rank = 1) AS a, coalesce(max(root_score) FILTER (rank = 2), 0) AS b FROM rank_v1 GROUP BY ALL)
SELECT incident_id, round(0.5 * a + 0.3 * greatest(0, a - b) + 0.2 * coalesce(quality, 0), 6)::DOUBLE AS confidence FROM g LEFT JOIN quality USING (incident_id)""")
def top_confidence(spark, sf_dir):
    return RK.top_confidence(rank_v1(spark, sf_dir), QG.quality(spark, sf_dir))


cte("evidence_weighted", f"""
SELECT c.incident_id, c.component, round(0.65 * c.score + 0.35 * coalesce(local_evidence, c.score), 9) AS ev FROM cands c LEFT JOIN profiles p USING ({C})""")
cte("rank_v2", f"""
WITH p AS (SELECT e.incident_id, target AS component, max(c.score) AS pm FROM edges_v2 e JOIN cands c ON c.incident_id = e.incident_id AND c.component = source GROUP BY ALL),
x AS (SELECT c.incident_id, c.component, c.score, c.first_ts, round(least(1, greatest(0, 0.35 * ev + 0.2 * CASE WHEN pm IS NULL THEN 0.85 ELSE greatest(0.15, 0.5 * c.score / greatest(pm, 0.01)) END
  + 0.2 * exp(-(c.first_ts - min(c.first_ts) OVER (PARTITION BY c.incident_id)) / 300.0) + 0.25 * coalesce(unexplained, 0))), 6)::DOUBLE AS root_score
  FROM cands c JOIN evidence_weighted USING ({C}) LEFT JOIN p USING ({C}) LEFT JOIN unexplained_scores USING ({C})),
y AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY root_score DESC, component) AS rank, count(*) OVER (PARTITION BY incident_id) AS n FROM x)
SELECT *, rank <= greatest(4, ceil(sqrt(n)) + 4) AS kept FROM y""")


def rank_v2(spark, sf_dir):
    def build():
        cand = QG.candidates(spark, sf_dir)
        prof = R.component_profiles(QD.segments(spark, sf_dir), T.METRIC_FILE)
        ev = cand.join(prof, ["incident_id", "component"], "left").select("incident_id", "component", F.round(
            0.65 * F.col("score") + 0.35 * F.coalesce("local_evidence", "score"), 9).alias("evidence"))
        edges = QG.edges_v2(spark, sf_dir)
        return RK.intervention_ranking_v2(cand.drop("rank"), ev, edges, G.unexplained_score(edges, cand))
    return stage(spark, sf_dir, "rank_v2", build)


@query("rnk3_intervention_ranking_v2", "SELECT incident_id, component, root_score, CAST(rank AS INTEGER) AS rank, kept FROM rank_v2")
def intervention_ranking_v2(spark, sf_dir):
    return rank_v2(spark, sf_dir).select("incident_id", "component", "root_score", "rank", "kept")


cte("final_v1", f"""
WITH x AS (SELECT k.*, coalesce(reason_score, 0) AS rs, reason, coalesce(discounted, 0) AS ces, coalesce(q.quality, 0) AS gq,
  1 - (first_ts - min(first_ts) OVER w) / greatest(max(first_ts) OVER w - min(first_ts) OVER w, 1) AS eb, 0.0005 * (count(*) OVER w - rank + 1) AS bonus
  FROM (SELECT * FROM rank_v1 WHERE rank <= 4) k LEFT JOIN chosen_reason USING ({C}) LEFT JOIN discounted_scores USING ({C}) LEFT JOIN quality q USING (incident_id)
  WINDOW w AS (PARTITION BY incident_id)),
y AS (SELECT *, round(0.35 * score + 0.25 * eb + 0.2 * rs + 0.2 * tp, 6)::DOUBLE AS gf FROM x),
z AS (SELECT *, round(0.1 * score + 0.1 * eb + 0.25 * rs + 0.2 * root_score + 0.25 * gf + 0.05 * ces + 0.05 * gq + bonus, 6)::DOUBLE AS c0 FROM y),
a AS (SELECT *, first_value(gf) OVER l AS lgf, first_value(c0) OVER l AS lc, first_value(component) OVER l AS lcomp,
  row_number() OVER (PARTITION BY incident_id ORDER BY gf DESC, c0 DESC, component) AS gfr FROM z WINDOW l AS (PARTITION BY incident_id ORDER BY c0 DESC, component)),
b AS (SELECT *, CASE WHEN gfr = 1 AND component <> lcomp AND gf > lgf + 0.1 THEN greatest(c0, lc + 0.01) ELSE c0 END AS c1 FROM a),
d AS (SELECT b.*, ctype, first_value(c1) OVER l AS lc1, first_value(ctype) OVER l AS lk, row_number() OVER l AS pos FROM b JOIN component_types USING (component)
  WINDOW l AS (PARTITION BY incident_id ORDER BY c1 DESC, component)),
e AS (SELECT *, min(CASE WHEN pos > 1 AND ctype IN ('service', 'pod') AND lc1 - c1 < 0.15 THEN pos END) OVER (PARTITION BY incident_id) AS near FROM d),
f AS (SELECT *, round(CASE WHEN lk IN ('middleware', 'db', 'redis') AND pos = near THEN lc1 + 0.01 ELSE c1 END, 6)::DOUBLE AS combined FROM e)
SELECT incident_id, component, reason, rs::DOUBLE AS reason_score, root_score, gf AS graph_free, combined,
  row_number() OVER (PARTITION BY incident_id ORDER BY combined DESC, component) AS final_rank FROM f""")


def final_v1(spark, sf_dir):
    return RK.final_blend(rank_v1(spark, sf_dir), QR.chosen(spark, sf_dir), QG.discounted(spark, sf_dir), QG.quality(spark, sf_dir))


@query("rnk4_final_blend", "SELECT * REPLACE (CAST(final_rank AS INTEGER) AS final_rank) FROM final_v1")
def final_blend(spark, sf_dir):
    return final_v1(spark, sf_dir)


cte("final_v2", f"""
WITH x AS (SELECT k.incident_id, k.component, reason, coalesce(reason_score, 0)::DOUBLE AS reason_score, root_score,
  round(least(1, greatest(0, 0.65 * root_score + 0.35 * coalesce(reason_score, 0))), 6)::DOUBLE AS final_score
  FROM rank_v2 k LEFT JOIN chosen_reason_v2 USING ({C}) WHERE kept)
SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY final_score DESC, component) AS final_rank FROM x""")


def final_v2(spark, sf_dir):
    return stage(spark, sf_dir, "final_v2", lambda: RK.final_blend_v2(rank_v2(spark, sf_dir), QR.chosen_v2(spark, sf_dir)))


@query("rnk5_final_blend_v2", "SELECT * REPLACE (CAST(final_rank AS INTEGER) AS final_rank) FROM final_v2")
def final_blend_v2(spark, sf_dir):
    return RK.final_blend_v2(rank_v2(spark, sf_dir), QR.chosen_v2(spark, sf_dir))


# ------------------------------------------------------------------ onsets and times
cte("seg_points", f"""
SELECT {C}, kpi, start_ts, unnest(pts).ts AS ts, unnest(pts).dev AS dev, unnest(range(len(pts))) AS i FROM segments_b""")
cte("seg_onsets", f"""
WITH a AS (SELECT *, lead(dev) OVER w AS nxt, max(dev) OVER (PARTITION BY {C}, kpi, start_ts) AS peak, count(*) OVER (PARTITION BY {C}, kpi, start_ts) AS n
  FROM seg_points WINDOW w AS (PARTITION BY {C}, kpi, start_ts ORDER BY i)),
f AS (SELECT *, min(CASE WHEN dev >= 0.5 * peak THEN i END) OVER (PARTITION BY {C}, kpi, start_ts) AS fi FROM a),
g AS (SELECT {C}, kpi, start_ts, coalesce(min(ts) FILTER (dev >= 0.3 AND nxt >= 0.15), min(ts) FILTER (dev >= 0.3), min(ts)) AS sustained_ts, any_value(n) AS n, any_value(peak) AS peak,
  min(ts) AS t0, max(ts) FILTER (i = fi) AS tf, arg_max(ts, (nxt - dev, -i)) FILTER (nxt - dev > 0 AND i >= fi - 2 AND i < fi + 3) AS tr FROM f GROUP BY {C}, kpi, start_ts)
SELECT {C}, kpi, start_ts, sustained_ts, CASE WHEN n <= 1 OR peak <= 0 THEN t0 ELSE coalesce(tr, tf) END AS steepest_ts FROM g""")


def onsets(spark, sf_dir):
    return QD.segments(spark, sf_dir)


@query("win12_sustained_onset", f"SELECT {C}, kpi, start_ts, sustained_ts FROM seg_onsets")
def sustained_onset(spark, sf_dir):
    return onsets(spark, sf_dir).select("incident_id", "component", "kpi", "start_ts", "sustained_ts")


@query("win13_steepest_onset", f"SELECT {C}, kpi, start_ts, steepest_ts FROM seg_onsets")
def steepest_onset(spark, sf_dir):
    return onsets(spark, sf_dir).select("incident_id", "component", "kpi", "start_ts", "steepest_ts")


cte("seg_full", f"SELECT s.*, sustained_ts, steepest_ts, i.end_ts - i.start_ts AS len FROM segments_b s JOIN seg_onsets USING ({C}, kpi, start_ts) JOIN incidents i ON i.incident_id = s.incident_id")
cte("root_v1", f"""
SELECT {C}, arg_max(sustained_ts, (CASE WHEN end_ts - start_ts < 0.75 * len THEN 1 ELSE 0 END, CASE WHEN end_ts - start_ts < 0.75 * len THEN end_ts::DOUBLE ELSE severity::DOUBLE END,
  severity, kpi, start_ts)) AS root_ts FROM seg_full GROUP BY ALL""")


@query("rnk7_root_time", "SELECT * FROM root_v1")
def root_time(spark, sf_dir):
    return RK.root_time(onsets(spark, sf_dir), T.incidents(spark, sf_dir))


cte("root_v2", f"""
WITH x AS (SELECT s.*, greatest(CASE WHEN a.rf = a.sf THEN 1.0 WHEN b1.broad = b2.broad THEN 0.45 ELSE 0 END, CASE WHEN reason_hint = c.reason THEN 1.0 ELSE 0 END) AS m
  FROM seg_full s JOIN chosen_reason_v2 c USING ({C}) JOIN (SELECT DISTINCT reason, kpi, rf, sf FROM alignment) a ON a.reason = c.reason AND a.kpi = s.kpi
  LEFT JOIN broad_family b1 ON b1.family = a.rf LEFT JOIN broad_family b2 ON b2.family = a.sf),
y AS (SELECT *, round(CASE WHEN end_ts - start_ts >= 0.85 * len THEN severity * 0.1 ELSE severity * (0.55 * m + 0.3 * (1 - least(1, (end_ts - start_ts) / greatest(len, 1))) + 0.15) END, 9) AS sc FROM x)
SELECT {C}, arg_max(steepest_ts, (sc, kpi, start_ts)) AS root_ts FROM y GROUP BY ALL""")


@query("rnk7_root_time_v2", "SELECT * FROM root_v2")
def root_time_v2(spark, sf_dir):
    return RK.root_time_v2(onsets(spark, sf_dir), T.incidents(spark, sf_dir), QR.chosen_v2(spark, sf_dir), T.METRIC_FILE)


@query("rnk8_global_root_time", f"""
SELECT s.incident_id, max(sustained_ts) AS global_ts FROM seg_full s JOIN rank_v1 k USING ({C}) WHERE rank <= 4 AND end_ts - start_ts < 0.75 * len GROUP BY ALL""")
def global_root_time(spark, sf_dir):
    return RK.global_root_time(onsets(spark, sf_dir), T.incidents(spark, sf_dir), rank_v1(spark, sf_dir).filter("rank <= 4"))


cte("onset_rows", f"""
SELECT s.incident_id, s.component, severity, end_ts - start_ts AS dur, len, steepest_ts AS ts, 3 * greatest(30, len // 20) AS reach FROM seg_full s JOIN rank_v2 k USING ({C})
WHERE kept AND end_ts - start_ts < 0.85 * len AND end_ts - start_ts >= 0""")


@query("win18_onset_clusters", """
WITH c AS (SELECT DISTINCT incident_id, ts, reach, len FROM onset_rows),
n AS (SELECT c.incident_id, c.ts, c.reach, c.len, count(DISTINCT ctype) AS types, count(DISTINCT o.component) AS components, count(*) AS size, avg(severity) AS sev, avg(dur) AS dur
  FROM c JOIN onset_rows o ON o.incident_id = c.incident_id AND abs(o.ts - c.ts) <= c.reach JOIN component_types t ON t.component = o.component GROUP BY c.incident_id, c.ts, c.reach, c.len),
s AS (SELECT *, round(types * components * sev * least(2, 1 + dur / greatest(len, 1)), 6)::DOUBLE AS cluster_score FROM n),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY cluster_score DESC, ts) = 1),
m AS (SELECT b.*, o.ts AS ot, row_number() OVER (PARTITION BY b.incident_id ORDER BY o.ts) - 1 AS i, count(*) OVER (PARTITION BY b.incident_id) AS cnt FROM b
  JOIN onset_rows o ON o.incident_id = b.incident_id AND abs(o.ts - b.ts) <= b.reach)
SELECT incident_id, ot AS global_ts, types, components, size, cluster_score FROM m WHERE i = cnt // 2""")
def onset_clusters(spark, sf_dir):
    # single-point segments have no length, so the minimum length is lifted
    return RK.onset_clusters(onsets(spark, sf_dir), T.incidents(spark, sf_dir), rank_v2(spark, sf_dir).filter("kept"), 0).withColumn(
        "size", F.col("size").cast("bigint"))


# ------------------------------------------------------------------ several causes
cte("cause_pool", f"""
WITH a AS (SELECT f.incident_id, f.component, root_ts AS ts, final_score AS score, f.component AS key FROM final_v2 f JOIN root_v2 USING ({C})
  UNION ALL SELECT s.incident_id, s.component, steepest_ts, round(final_score * (0.75 + 0.25 * severity), 9)::DOUBLE, s.component || '.' || kpi FROM seg_full s JOIN final_v2 f USING ({C}))
SELECT incident_id, component, ts, max((score, key, -ts)) AS b, max(score) AS score, failure_count, greatest(60.0, (t.end_ts - t.start_ts) / (2.0 * failure_count)) AS gap
FROM a JOIN tasks t USING (incident_id) GROUP BY ALL""")


def _rounds():
    sql, far = "", ""
    for n in (1, 2, 3):
        sql += f"""{',' if n > 1 else ''}
p{n} AS (SELECT p.incident_id, arg_max(p.component, b) AS component, arg_max(p.ts, b) AS ts, max(p.score) AS score, {n} AS pick FROM cause_pool p {far} WHERE p.failure_count >= {n}
  {''.join(f' AND (p{k}.ts IS NULL OR abs(p.ts - p{k}.ts) >= p.gap)' for k in range(1, n))} GROUP BY p.incident_id)"""
        far += f" LEFT JOIN p{n} ON p{n}.incident_id = p.incident_id"
    return "WITH" + sql


@query("rnk9_select_causes", _rounds() + """,
c AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3),
h AS (SELECT incident_id, count(*) AS have FROM c GROUP BY ALL),
r AS (SELECT p.*, row_number() OVER (PARTITION BY incident_id ORDER BY b DESC) AS k FROM cause_pool p WHERE (incident_id, component, ts) NOT IN (SELECT (incident_id, component, ts) FROM c)),
f AS (SELECT * FROM c UNION ALL SELECT r.incident_id, r.component, r.ts, r.score, have + k FROM r JOIN h USING (incident_id) WHERE k <= failure_count - have)
SELECT incident_id, component, ts, score, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY ts, pick) AS INTEGER) AS position FROM f""")
def select_causes(spark, sf_dir):
    return RK.select_causes(_cause_pool(spark, sf_dir), tasks(spark, sf_dir))


cte("time_pool", f"""
WITH a AS (SELECT s.incident_id, s.component, steepest_ts AS ts, round(root_score * greatest(0.1, severity), 9)::DOUBLE AS score, s.component || '.' || kpi AS key
  FROM seg_full s JOIN rank_v2 r USING ({C}) WHERE r.kept AND s.end_ts - s.start_ts < 0.75 * len)
SELECT incident_id, component, ts, max((score, key, -ts)) AS b, max(score) AS score, failure_count, greatest(60.0, (t.end_ts - t.start_ts) / (2.0 * failure_count)) AS gap
FROM a JOIN tasks t USING (incident_id) GROUP BY ALL""")


@query("rnk9_time_only_causes", _rounds().replace("cause_pool", "time_pool") + """,
c AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)
SELECT incident_id, component, ts, score, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY ts, pick) AS INTEGER) AS position FROM c""")
def time_only_causes(spark, sf_dir):
    return RK.time_causes(onsets(spark, sf_dir), rank_v2(spark, sf_dir).filter("kept"), tasks(spark, sf_dir))


def _cause_pool(spark, sf_dir):
    keys = ["incident_id", "component"]
    final = final_v2(spark, sf_dir)
    root = RK.root_time_v2(onsets(spark, sf_dir), T.incidents(spark, sf_dir), QR.chosen_v2(spark, sf_dir), T.METRIC_FILE)
    own = final.join(root, keys).select(*keys, F.col("root_ts").alias("ts"), F.col("final_score").alias("score"), F.col("component").alias("key"))
    seg = onsets(spark, sf_dir).join(final.select(*keys, "final_score"), keys).select(
        *keys, F.col("steepest_ts").alias("ts"), F.round(F.col("final_score") * (0.75 + 0.25 * F.col("severity")), 9).alias("score"),
        F.concat("component", F.lit("."), "kpi").alias("key"))
    return own.unionByName(seg)


@query("rnk12_fallback_prediction", f"""
WITH t AS (SELECT incident_id, arg_max(component, (score, component)) AS component FROM cands GROUP BY ALL),
f AS (SELECT {C}, arg_max(coalesce(reason_hint, ''), (severity, kpi, -start_ts)) AS hint, arg_max(start_ts, (severity, kpi, -start_ts)) AS ts FROM segments_b GROUP BY ALL)
SELECT i.incident_id, coalesce(t.component, '{DEFAULT_COMPONENT}') AS component, coalesce(nullif(hint, ''), '{DEFAULT_REASON}') AS reason, coalesce(ts, i.start_ts) AS ts
FROM incidents i LEFT JOIN t USING (incident_id) LEFT JOIN f ON f.incident_id = i.incident_id AND f.component = t.component""")
def fallback_prediction(spark, sf_dir):
    return RK.fallback_prediction(T.incidents(spark, sf_dir), QG.candidates(spark, sf_dir), QD.segments(spark, sf_dir),
                                  DEFAULT_COMPONENT, DEFAULT_REASON)


# ------------------------------------------------------------------ evidence-graph flow
cte("metric_scores", "SELECT incident_id, component, sum(severity) AS score FROM segments_a GROUP BY ALL")
cte("flow_calls", "SELECT * FROM event_calls")
cte("flow_trace", """
WITH q AS (SELECT incident_id, quantile_cont(duration, 0.95) AS q95 FROM inc_event_spans GROUP BY ALL),
f AS (SELECT incident_id, component, count(*) FILTER (duration > q95 AND q95 <> 0) AS slow, count(*) FILTER (NOT success) AS failed FROM inc_event_spans JOIN q USING (incident_id) GROUP BY ALL),
parts AS (SELECT c.incident_id, callee AS component, CASE WHEN (c.incident_id, caller) IN (SELECT (incident_id, component) FROM metric_scores) THEN least(5, 0.08 * calls) ELSE least(2, 0.03 * calls) END AS s
  FROM flow_calls c WHERE (c.incident_id, callee) IN (SELECT (incident_id, component) FROM metric_scores)
  UNION ALL SELECT incident_id, callee, least(4, 0.15 * calls) FROM flow_calls WHERE caller = callee
  UNION ALL SELECT incident_id, component, least(4, 0.08 * slow) + least(4, 0.2 * failed) FROM f)
SELECT incident_id, component, sum(s)::DOUBLE AS score FROM parts GROUP BY ALL HAVING sum(s) > 0""")
cte("log_component", "SELECT incident_id, component, sum(score) AS score FROM log_reason GROUP BY ALL")


def metric_scores(spark, sf_dir):
    return QD.segments_a(spark, sf_dir).groupBy("incident_id", "component").agg(F.sum("severity").alias("score"))


def flow_trace(spark, sf_dir):
    return stage(spark, sf_dir, "flow_trace", lambda: SP.trace_evidence(
        QG.window_spans(spark, sf_dir), metric_scores(spark, sf_dir)))


def log_reasons(spark, sf_dir):
    return L.reason_evidence(QR.template_counts(spark, sf_dir), T.REASONS)


def log_component(spark, sf_dir):
    return log_reasons(spark, sf_dir).groupBy("incident_id", "component").agg(F.sum("score").alias("score"))


cte("confidences", """
WITH m AS (SELECT incident_id, sum(severity) / 25 AS c FROM segments_a WHERE rank <= 5 GROUP BY ALL),
t AS (SELECT incident_id, sum(score) / 15 AS c FROM flow_trace GROUP BY ALL), l AS (SELECT incident_id, sum(score) / 20 AS c FROM log_component GROUP BY ALL)
SELECT i.incident_id, round(coalesce(least(1, m.c), 0.05), 6)::DOUBLE AS metric, round(coalesce(least(1, t.c), 0.05), 6)::DOUBLE AS trace, round(coalesce(least(1, l.c), 0.05), 6)::DOUBLE AS log
FROM incidents i LEFT JOIN m USING (incident_id) LEFT JOIN t USING (incident_id) LEFT JOIN l USING (incident_id)""")


@query("agg30_report_confidence", "SELECT * FROM confidences")
def report_confidence(spark, sf_dir):
    return RK.report_confidence(QD.segments_a(spark, sf_dir), flow_trace(spark, sf_dir), log_component(spark, sf_dir), T.incidents(spark, sf_dir))


@query("rnk16_recheck_notes", """
SELECT incident_id, coalesce(nullif(concat_ws('; ', CASE WHEN metric < 0.15 THEN 'metric confidence is low' END, CASE WHEN trace <= 0.05 THEN 'trace report is empty' END,
  CASE WHEN log < 0.1 THEN 'log evidence is weak' END), ''), 'no recheck needed') AS notes FROM confidences""")
def recheck_notes(spark, sf_dir):
    return RK.recheck_notes(report_confidence(spark, sf_dir)).withColumn("notes", F.array_join("notes", "; "))


@query("rnk11_conflict", f"""
WITH a AS (SELECT {C} FROM metric_scores QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY round(score, 9) DESC, component) <= 5),
b AS (SELECT {C} FROM flow_trace QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY round(score, 9) DESC, component) <= 5),
s AS (SELECT incident_id, count(*) AS n FROM a JOIN b USING ({C}) GROUP BY ALL)
SELECT DISTINCT a.incident_id, coalesce(n, 0) AS shared, coalesce(n, 0) = 0 AS conflict FROM a JOIN (SELECT DISTINCT incident_id FROM b) USING (incident_id) LEFT JOIN s USING (incident_id)""")
def conflict(spark, sf_dir):
    return RK.conflict(metric_scores(spark, sf_dir), flow_trace(spark, sf_dir))


cte("prior_rows", f"""
SELECT s.incident_id, s.component, reason, sum(prior * severity) AS score FROM segments_a s
JOIN (SELECT DISTINCT kpi, {sql_case([(" OR ".join(f"contains(lower(kpi), '{w}')" for w in words), f"'{n}'") for n, words in V.METRIC_TYPES], "'unknown'")} AS mtype FROM raw_metrics) t USING (kpi)
JOIN metric_type_priors USING (mtype) GROUP BY ALL""")
cte("component_reason_rows", """
SELECT incident_id, component, reason, sum(score) AS score FROM (SELECT incident_id, component, reason_hint AS reason, severity AS score FROM segments_a WHERE reason_hint IS NOT NULL
  UNION ALL SELECT * FROM prior_rows) GROUP BY ALL""")
cte("memory_rows", """
SELECT i.incident_id, r.component, r.reason FROM incidents i JOIN records r ON r.ts >= i.start_ts - 3600 AND r.ts <= i.start_ts - 1""")
cte("accumulated", """
WITH a AS (SELECT incident_id, 'component' AS kind, component AS name, severity AS score FROM segments_a
 UNION ALL SELECT incident_id, 'reason', reason_hint, severity FROM segments_a WHERE reason_hint IS NOT NULL
 UNION ALL SELECT incident_id, 'reason', reason, score FROM prior_rows
 UNION ALL SELECT incident_id, 'component', component, score * 1.2 FROM flow_trace
 UNION ALL SELECT incident_id, 'component', component, score FROM log_reason UNION ALL SELECT incident_id, 'reason', reason, score FROM log_reason
 UNION ALL SELECT incident_id, 'component', component, 0.5 FROM memory_rows UNION ALL SELECT incident_id, 'reason', reason, 0.5 FROM memory_rows)
SELECT incident_id, kind, name, sum(score) AS score FROM a GROUP BY ALL""")


def prior_rows(spark, sf_dir):
    return R.prior_edges(QD.segments_a(spark, sf_dir).select("incident_id", "component", "kpi", "severity"))


def accumulated(spark, sf_dir):
    def build():
        seg = QD.segments_a(spark, sf_dir)
        kinds = lambda df, comp, reason, score: df.select("incident_id", F.explode(F.array(
            F.struct(F.lit("component").alias("kind"), F.col(comp).alias("name")),
            F.struct(F.lit("reason").alias("kind"), F.col(reason).alias("name")))).alias("k"), F.col(score).alias("score")).select(
            "incident_id", "k.*", "score").filter("name IS NOT NULL")
        metric = kinds(seg, "component", "reason_hint", "severity")
        prior = prior_rows(spark, sf_dir).select("incident_id", F.lit("reason").alias("kind"), F.col("reason").alias("name"), F.col("weight").alias("score"))
        trace = flow_trace(spark, sf_dir).select("incident_id", F.lit("component").alias("kind"), F.col("component").alias("name"), "score")
        log = kinds(log_reasons(spark, sf_dir), "component", "reason", "score")
        before = T.incidents(spark, sf_dir).select("incident_id", (F.col("start_ts") - 3600).alias("start_ts"), (F.col("start_ts") - 1).alias("end_ts"))
        memory = kinds(WN.window_join(T.records(spark, sf_dir), before).withColumn("score", F.lit(0.5)), "component", "reason", "score")
        return RK.accumulate(metric, prior, trace, log, memory)
    return stage(spark, sf_dir, "accumulated", build)


@query("agg29_evidence_accumulation", "SELECT incident_id, kind, name, round(score, 4)::DOUBLE AS score FROM accumulated")
def accumulation(spark, sf_dir):
    return accumulated(spark, sf_dir).withColumn("score", S.rounded(F.col("score"), 4))


cte("answer_v3", f"""
WITH l AS (SELECT {C}, arg_max(reason, (round(score, 9), reason)) AS lr, max(round(score, 9)) AS ls, arg_max(score, (round(score, 9), reason)) AS lraw FROM component_reason_rows GROUP BY ALL),
g AS (SELECT incident_id, arg_max(name, (round(score, 9), name)) AS any_r FROM accumulated WHERE kind = 'reason' GROUP BY ALL),
w AS (SELECT {C}, arg_max(start_ts, (severity, kpi, -start_ts)) AS ts FROM segments_a GROUP BY ALL),
s AS (SELECT {C}, kpi, start_ts, round(severity + least(3, (end_ts - start_ts) / 180) + CASE WHEN reason_hint IS NULL THEN 0 ELSE 1.5 END, 4) AS sc FROM segments_a),
bt AS (SELECT {C}, max(sc) AS score, arg_max(start_ts, (sc, kpi, -start_ts)) AS ts FROM s GROUP BY ALL),
x AS (SELECT a.incident_id, a.name AS component, a.score, w.ts, false AS t FROM accumulated a LEFT JOIN w ON w.incident_id = a.incident_id AND w.component = a.name WHERE a.kind = 'component'
  UNION ALL SELECT incident_id, component, score, ts, true FROM bt),
y AS (SELECT x.incident_id, x.component, coalesce(lr, any_r) AS reason, coalesce(x.ts, k.start_ts) AS ts, round(x.score, 9) AS base, round(x.score + CASE WHEN t THEN 0 ELSE coalesce(lraw, 0) END, 4)::DOUBLE AS score, failure_count
  FROM x JOIN tasks k ON k.incident_id = x.incident_id AND k.time_only = x.t LEFT JOIN l ON l.incident_id = x.incident_id AND l.component = x.component LEFT JOIN g ON g.incident_id = x.incident_id)
SELECT incident_id, component, coalesce(reason, '{DEFAULT_REASON}') AS reason, ts, score, row_number() OVER (PARTITION BY incident_id ORDER BY base DESC, component) AS rank FROM y
QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY base DESC, component) <= failure_count
UNION ALL SELECT k.incident_id, '{DEFAULT_COMPONENT}', coalesce(any_r, '{DEFAULT_REASON}'), k.start_ts, 0.0, 1 FROM tasks k LEFT JOIN g ON g.incident_id = k.incident_id
WHERE k.incident_id NOT IN (SELECT incident_id FROM y)""")


def answers(spark, sf_dir):
    def build():
        seg, acc = QD.segments_a(spark, sf_dir), accumulated(spark, sf_dir)
        comp = acc.filter("kind = 'component'").select("incident_id", F.col("name").alias("component"), "score")
        reas = acc.filter("kind = 'reason'").select("incident_id", F.col("name").alias("reason"), "score")
        local = seg.filter("reason_hint IS NOT NULL").select("incident_id", "component", F.col("reason_hint").alias("reason"), F.col("severity").alias("score")).unionByName(
            prior_rows(spark, sf_dir).select("incident_id", "component", "reason", F.col("weight").alias("score"))).groupBy(
            "incident_id", "component", "reason").agg(F.sum("score").alias("score"))
        return RK.evidence_ranking(seg, comp, local, reas, tasks(spark, sf_dir), DEFAULT_COMPONENT, DEFAULT_REASON)
    return stage(spark, sf_dir, "answers", build)


@query("rnk10_evidence_ranking", "SELECT incident_id, component, reason, ts, score, CAST(rank AS INTEGER) AS rank FROM answer_v3")
def evidence_ranking(spark, sf_dir):
    return answers(spark, sf_dir)


def given(spark, sf_dir):
    """Partly filled answers: the first cause of the fallback with shortened names, no time."""
    f = RK.fallback_prediction(T.incidents(spark, sf_dir), QG.candidates(spark, sf_dir), QD.segments(spark, sf_dir), DEFAULT_COMPONENT, DEFAULT_REASON)
    return f.select("incident_id", F.lit(1).alias("position"), F.expr("substring(component, 2)").alias("component"),
                    F.lit("").alias("reason"), F.lit(None).cast("bigint").alias("ts"))


def _closest_sql(value, names):
    arr = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    ratio = f"round(1.0 - levenshtein({value}, n)::DOUBLE / greatest(length({value}), length(n), 1), 9)"
    return (f"CASE WHEN list_contains({arr}, {value}) THEN {value} WHEN list_max(list_transform({arr}, lambda n: {ratio})) >= 0.3 "
            f"THEN {arr}[list_position(list_transform({arr}, lambda n: {ratio}), list_max(list_transform({arr}, lambda n: {ratio})))] ELSE '{names[0]}' END")


cte("completed", f"""
WITH t AS (SELECT incident_id, arg_max(component, (score, component)) AS component FROM cands GROUP BY ALL),
n AS (SELECT incident_id, max(rank) AS n FROM answer_v3 GROUP BY ALL),
p AS (SELECT incident_id, start_ts, unnest(range(1, failure_count + 1)) AS position FROM tasks),
j AS (SELECT p.incident_id, p.position, coalesce(nullif(CASE WHEN position = 1 THEN substr(t.component, 2) END, ''), a.component) AS component, a.reason, coalesce(a.ts, p.start_ts) AS ts
  FROM p LEFT JOIN t USING (incident_id) LEFT JOIN n USING (incident_id) LEFT JOIN answer_v3 a ON a.incident_id = p.incident_id AND a.rank = least(position, n.n))
SELECT incident_id, CAST(position AS INTEGER) AS position, {_closest_sql('component', T.COMPONENTS)} AS component, {_closest_sql('reason', T.REASONS)} AS reason, ts FROM j""")


def completed(spark, sf_dir):
    return RK.complete_answers(tasks(spark, sf_dir), given(spark, sf_dir), answers(spark, sf_dir), T.COMPONENTS, T.REASONS)


@query("rnk13_complete_answers", "SELECT * FROM completed")
def complete_answers(spark, sf_dir):
    return completed(spark, sf_dir)


@query("scl25_prediction_json", f"""
WITH f AS (SELECT c.*, c.incident_id % 7 + 1 AS k, strftime(make_timestamp((ts + 28800) * 1000000), '%Y-%m-%d %H:%M:%S') AS lt FROM completed c),
e AS (SELECT incident_id, position, '"' || position || '": {{' || concat_ws(', ', CASE WHEN k IN (1, 4, 5, 7) THEN '"root cause occurrence datetime": "' || lt || '"' END,
  CASE WHEN k IN (3, 5, 6, 7) THEN '"root cause component": "' || component || '"' END, CASE WHEN k IN (2, 4, 6, 7) THEN '"root cause reason": "' || reason || '"' END) || '}}' AS e FROM f)
SELECT incident_id, '{{' || string_agg(e, ', ' ORDER BY position) || '}}' AS prediction FROM e GROUP BY ALL""")
def prediction_json(spark, sf_dir):
    fields = F.create_map(*[x for k, v in V.TASK_FIELDS.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))])
    index = F.concat(F.lit("task_"), (F.col("incident_id") % 7 + 1).cast("string"))
    return RK.render_predictions(completed(spark, sf_dir).withColumn("fields", fields[index]), "fields")
