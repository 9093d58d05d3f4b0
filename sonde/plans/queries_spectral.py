"""Registered queries: spectral scores, edges, spectral ranking, hypotheses, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.functions import fixed as V
from sonde.functions import scalars as S
from sonde.operators import hypotheses as H
from sonde.operators import spectral as SP
from sonde.operators import windows as WN
from sonde.plans.queries_series import arrays as build_arrays
from sonde.plans.registry import cte, query
from sonde.plans.stages import stage
from sonde.sources import tables as T

K = "incident_id, component, kpi"


def r(name, digits=4):
    return S.rounded(F.col(name), digits).alias(name)


# ------------------------------------------------------------------ checks: features relationally
cte("spec_points", f"""
WITH p AS (SELECT {K}, role, value, row_number() OVER (PARTITION BY {K}, role ORDER BY ts) - 1 AS pos,
  count(*) OVER (PARTITION BY {K}, role) AS cnt FROM fixed_roles),
n AS (SELECT {K}, max(cnt) FILTER (role = 'i') AS ni, coalesce(max(cnt) FILTER (role = 'b'), 0) AS nb FROM p GROUP BY ALL)
SELECT {K}, -1 AS w, pos, value, ni AS n, ni, nb FROM p JOIN n USING ({K}) WHERE role = 'i'
UNION ALL
SELECT {K}, CASE WHEN nb < ni THEN 0 ELSE pos // ni END, CASE WHEN nb < ni THEN pos ELSE pos % ni END, value,
  CASE WHEN nb < ni THEN nb ELSE ni END, ni, nb FROM p JOIN n USING ({K})
WHERE role = 'b' AND ni IS NOT NULL AND (nb < ni OR pos // ni < nb // ni)""")
cte("spec_power", f"""
WITH m AS (SELECT *, value - avg(value) OVER (PARTITION BY {K}, w) AS x FROM spec_points)
SELECT {K}, w, k, n, pow(sum(x * cos(2 * pi() * k * pos / n)), 2) + pow(sum(x * sin(2 * pi() * k * pos / n)), 2) AS p
FROM m, (SELECT unnest(range(1, 721)) AS k) WHERE k <= n // 2 GROUP BY {K}, w, k, n""")
cte("spec_features", f"""
WITH t AS (SELECT *, sum(p) OVER (PARTITION BY {K}, w) AS total, n // 2 AS nk, greatest(1, (n // 2) // 3) AS third FROM spec_power),
g AS (SELECT {K}, w, any_value(total) AS e, sum(CASE WHEN k <= third THEN p ELSE 0 END) AS lo,
  sum(CASE WHEN k > third AND k <= least(2 * third, nk) THEN p ELSE 0 END) AS mi, sum(CASE WHEN k > least(2 * third, nk) THEN p ELSE 0 END) AS hi,
  arg_max(k - 1, (p, -k)) AS dom, max(p) AS mx, sum(CASE WHEN p > 0 THEN -(p / total) * log2(p / total) ELSE 0 END) AS ent
  FROM t WHERE total > 0 GROUP BY {K}, w),
a AS (SELECT DISTINCT {K}, w, ni, nb FROM spec_points)
SELECT {K}, w, ni, nb, CASE WHEN e >= 1e-12 THEN e ELSE 0 END AS total_energy, CASE WHEN e >= 1e-12 THEN lo / e ELSE 0 END AS low_ratio,
  CASE WHEN e >= 1e-12 THEN mi / e ELSE 0 END AS mid_ratio, CASE WHEN e >= 1e-12 THEN hi / e ELSE 0 END AS high_ratio,
  CASE WHEN e >= 1e-12 THEN dom ELSE 0 END AS dominant_index, CASE WHEN e >= 1e-12 THEN mx / e ELSE 0 END AS dominant_ratio,
  CASE WHEN e >= 1e-12 THEN ent ELSE 0 END AS entropy
FROM a LEFT JOIN g USING ({K}, w)""")
_F = SP.STAT_FEATURES
cte("spec_raw", f"""
WITH m AS (SELECT {K}, {', '.join(f'median({f}) AS {f}_med' for f in _F)} FROM spec_features WHERE w >= 0 GROUP BY ALL)
SELECT {K}, {', '.join(f'any_value({f}_med) AS {f}_med, median(abs({f} - {f}_med)) AS {f}_mad' for f in _F)}
FROM spec_features JOIN m USING ({K}) WHERE w >= 0 GROUP BY {K}""")
cte("spec_base", f"""
SELECT {K}, {', '.join(f'{f}_med, CASE WHEN {f}_mad < 1e-9 * abs({f}_med) THEN 0 ELSE {f}_mad END AS {f}_mad' for f in _F)} FROM spec_raw""")
cte("spec_z", f"""
SELECT f.*, (ln(total_energy + 1e-8) - ln(total_energy_med + 1e-8)) / (1.4826 * total_energy_mad + 1e-8) AS energy_z,
  (low_ratio - low_ratio_med) / (1.4826 * low_ratio_mad + 1e-8) AS low_z, (high_ratio - high_ratio_med) / (1.4826 * high_ratio_mad + 1e-8) AS high_z,
  (dominant_ratio - dominant_ratio_med) / (1.4826 * dominant_ratio_mad + 1e-8) AS dominant_z,
  (entropy - entropy_med) / (1.4826 * entropy_mad + 1e-8) AS entropy_z
FROM spec_features f JOIN spec_base b USING ({K}) WHERE w = -1""")


def _sig(x):
    return f"(CASE WHEN {x} >= 0 THEN 1 / (1 + exp(-greatest({x}, 0))) ELSE exp(least({x}, 0)) / (1 + exp(least({x}, 0))) END)"


cte("spec_scores", f"""
SELECT *, 0.4 * {_sig('(energy_z - 3.0)')} + 0.2 * {_sig('(abs(low_z) - 2.5)')} + 0.2 * {_sig('(abs(high_z) - 2.5)')}
  + 0.1 * {_sig('(dominant_z - 2.5)')} + 0.1 * {_sig('(abs(entropy_z) - 2.5)')} AS spectral_score,
  CASE WHEN energy_z < 3 THEN 'no_strong_spectral_anomaly' WHEN low_ratio >= 0.55 THEN 'slow_trend_anomaly'
   WHEN high_ratio >= 0.45 THEN 'fast_burst_or_jitter_anomaly' WHEN dominant_ratio >= 0.6 THEN 'periodic_oscillation_anomaly'
   ELSE 'mixed_spectral_anomaly' END AS spectral_class FROM spec_z""")
cte("missing_share", f"""
SELECT i.incident_id, f.component, f.kpi, avg(CASE WHEN f.value IS NULL THEN 1 ELSE 0 END) AS missing
FROM resampled f JOIN incidents i ON f.ts >= i.start_ts - 3 * (i.end_ts - i.start_ts) AND f.ts <= i.end_ts GROUP BY ALL""")


def _evidence_sql(spectral=True):
    off = "s.ni < 8" if spectral else "true"
    pick = lambda c: f"CASE WHEN {off} THEN 0 ELSE {c} END"
    return f"""
WITH e AS (SELECT s.incident_id, s.component, s.kpi, t.trad, t.maxz, t.max_rate, t.zs,
  CASE WHEN s.ni < 8 THEN 'too_short_for_spectral' WHEN missing > 0.3 THEN 'low_quality' ELSE 'ok' END AS quality_flag,
  {', '.join(f'{pick("s." + c)} AS {c}' for c in ('spectral_score', 'total_energy', 'energy_z', 'low_ratio', 'mid_ratio', 'high_ratio', 'dominant_index', 'dominant_ratio', 'entropy'))},
  CASE WHEN {off} THEN 'no_strong_spectral_anomaly' ELSE spectral_class END AS spectral_class
  FROM spec_scores s JOIN traditional t USING ({K}) LEFT JOIN missing_share USING ({K}) WHERE s.nb >= 4 AND s.ni >= 2),
f AS (SELECT *, 0.6 * trad + 0.4 * spectral_score AS fin FROM e),
l AS (SELECT *, CASE WHEN fin >= 0.85 THEN 'high_confidence_anomaly' WHEN fin >= 0.7 THEN 'candidate_anomaly' ELSE 'normal_or_weak' END AS level FROM f),
short AS (SELECT DISTINCT {K} FROM spec_points WHERE w = -1 AND (nb < 4 OR ni < 2)
  UNION SELECT DISTINCT {K} FROM fixed_roles WHERE ({K}) NOT IN (SELECT ({K}) FROM spec_points WHERE w = -1))
SELECT {K}, round(trad, 4)::DOUBLE AS traditional_score, round(spectral_score, 4)::DOUBLE AS spectral_score, round(fin, 4)::DOUBLE AS final_score,
  round(maxz, 4)::DOUBLE AS max_abs_z, round(max_rate, 4)::DOUBLE AS max_rate, round(zs, 4)::DOUBLE AS deviation_score,
  round(total_energy, 4)::DOUBLE AS total_energy, round(energy_z, 4)::DOUBLE + 0.0 AS energy_z, round(low_ratio, 4)::DOUBLE AS low_ratio,
  round(mid_ratio, 4)::DOUBLE AS mid_ratio, round(high_ratio, 4)::DOUBLE AS high_ratio, round(dominant_ratio, 4)::DOUBLE AS dominant_ratio,
  round(entropy, 4)::DOUBLE AS entropy, CAST(dominant_index AS INTEGER) AS dominant_index, spectral_class, quality_flag, level,
  concat_ws(', ', component || '.' || kpi, CASE level WHEN 'high_confidence_anomaly' THEN 'shows high-confidence anomaly'
   WHEN 'candidate_anomaly' THEN 'shows candidate anomaly' ELSE 'appears normal or weak' END,
   CASE WHEN trad > 0.5 THEN 'high traditional score (' || printf('%.2f', trad) || ')' END,
   CASE WHEN maxz > 3 THEN 'elevated robust z-score (' || printf('%.2f', maxz) || ')' END,
   CASE WHEN spectral_score > 0.5 THEN 'high spectral score (' || printf('%.2f', spectral_score::DOUBLE) || ')' END,
   CASE spectral_class WHEN 'slow_trend_anomaly' THEN 'suggesting slow trend anomaly' WHEN 'fast_burst_or_jitter_anomaly' THEN 'suggesting burst/jitter anomaly'
    WHEN 'periodic_oscillation_anomaly' THEN 'suggesting periodic oscillation' WHEN 'mixed_spectral_anomaly' THEN 'suggesting mixed spectral anomaly' END) || '.' AS explanation
FROM l UNION ALL
SELECT {K}, {', '.join(['0::DOUBLE'] * 13)}, 0::INTEGER, 'no_strong_spectral_anomaly', 'insufficient_data', 'normal_or_weak',
  component || '.' || kpi || ' has insufficient data for anomaly detection.' FROM short"""


cte("evidence", _evidence_sql())
cte("evidence_trad", _evidence_sql(False))


def arrays(spark, sf_dir):
    return stage(spark, sf_dir, "arrays", lambda: build_arrays(spark, sf_dir))


def evidence(spark, sf_dir, spectral=True):
    return stage(spark, sf_dir, f"evidence_{spectral}", lambda: SP.anomaly_evidence(
        arrays(spark, sf_dir), use_spectral=spectral))


@query("agg8_spectral_features", f"""
SELECT {K}, round(total_energy, 4)::DOUBLE AS total_energy, round(low_ratio, 4)::DOUBLE AS low_ratio, round(mid_ratio, 4)::DOUBLE AS mid_ratio,
  round(high_ratio, 4)::DOUBLE AS high_ratio, CAST(dominant_index AS INTEGER) AS dominant_index, round(dominant_ratio, 4)::DOUBLE AS dominant_ratio,
  round(entropy, 4)::DOUBLE AS entropy FROM spec_features WHERE w = -1""")
def spectral_features(spark, sf_dir):
    return SP.features(build_arrays(spark, sf_dir).filter("size(inc) > 0")).select(
        *SP.KEYS, r("total_energy"), r("low_ratio"), r("mid_ratio"), r("high_ratio"), "dominant_index",
        r("dominant_ratio"), r("entropy"))


_HAS = "(SELECT DISTINCT incident_id, component, kpi FROM spec_points WHERE w = -1 AND nb > 0)"


@query("agg9_baseline_spectral", f"SELECT {K}, " + ", ".join(
    f"round({f}_med, 4)::DOUBLE AS {f}_med, round({f}_mad, 4)::DOUBLE AS {f}_mad" for f in _F) + " FROM spec_base")
def baseline_spectral(spark, sf_dir):
    return SP.baseline_stats(build_arrays(spark, sf_dir).filter("size(inc) > 0 AND size(base) > 0")).select(
        *SP.KEYS, *[r(f"{f}_{s}") for f in _F for s in ("med", "mad")])


@query("agg10_spectral_score", f"""
SELECT {K}, round(energy_z, 4) AS energy_z, round(low_z, 4) AS low_z, round(high_z, 4) AS high_z, round(dominant_z, 4) AS dominant_z,
  round(entropy_z, 4) AS entropy_z, round(spectral_score, 4) AS spectral_score FROM spec_scores""")
def spectral_score(spark, sf_dir):
    return SP.spectral_scores(build_arrays(spark, sf_dir).filter("size(inc) > 0 AND size(base) > 0")).select(
        *SP.KEYS, r("energy_z"), r("low_z"), r("high_z"), r("dominant_z"), r("entropy_z"), r("spectral_score"))


@query("agg11_spectral_class", f"SELECT {K}, spectral_class FROM spec_scores")
def spectral_class(spark, sf_dir):
    return SP.spectral_scores(build_arrays(spark, sf_dir).filter("size(inc) > 0 AND size(base) > 0")).select(
        *SP.KEYS, "spectral_class")


@query("agg12_anomaly_evidence", "SELECT * EXCLUDE (explanation) FROM evidence")
def anomaly_evidence(spark, sf_dir):
    return SP.anomaly_evidence(build_arrays(spark, sf_dir)).drop("explanation")


@query("scl28_explanation", f"SELECT {K}, explanation FROM evidence")
def explanation(spark, sf_dir):
    return evidence(spark, sf_dir).select(*SP.KEYS, "explanation")


@query("agg41_detection_summary", """
WITH c AS (SELECT incident_id, string_agg(spectral_class || '=' || n, ',' ORDER BY spectral_class) AS classes FROM (
  SELECT incident_id, spectral_class, count(*) AS n FROM evidence WHERE final_score > 0.3 GROUP BY ALL) GROUP BY ALL)
SELECT e.incident_id, count(*) AS series, count(*) FILTER (final_score >= 0.85) AS high, count(*) FILTER (final_score >= 0.7) AS candidates,
  coalesce(any_value(c.classes), '') AS classes FROM evidence e LEFT JOIN c ON c.incident_id = e.incident_id GROUP BY e.incident_id""")
def detection_summary(spark, sf_dir):
    s = SP.detection_summary(evidence(spark, sf_dir))
    pairs = F.transform(F.map_entries("classes"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return s.withColumn("classes", F.coalesce(F.array_join(pairs, ","), F.lit("")))


# ------------------------------------------------------------------ edges
cte("cand_edges", """
WITH n AS (SELECT incident_id, component || '.' || kpi AS node, final_score AS s FROM evidence),
s AS (SELECT * FROM n WHERE s >= 0.5 QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY s DESC, node) <= 20),
t AS (SELECT * FROM n WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY s DESC, node) <= 30)
SELECT s.incident_id, s.node AS source, t.node AS target, s.s AS source_score, t.s AS target_score,
  least(1.0, greatest(0.1, 0.5 * (s.s - t.s + 0.5)))::DOUBLE AS prior FROM s JOIN t ON s.incident_id = t.incident_id AND s.node <> t.node""")


@query("join5_candidate_edges", """
SELECT incident_id, source, target, source_score, target_score, round(prior, 6) AS prior FROM cand_edges""")
def candidate_edges(spark, sf_dir):
    return SP.candidate_edges(evidence(spark, sf_dir)).withColumn("prior", S.rounded(F.col("prior"), 6))


cte("node_points", """
SELECT incident_id, component || '.' || kpi AS node, pos, value AS x, n FROM spec_points WHERE w = -1 AND n >= 4""")
cte("pair_points", """
WITH l AS (SELECT e.incident_id, source, target, least(any_value(a.n), any_value(b.n)) AS n FROM cand_edges e
  JOIN (SELECT DISTINCT incident_id, node, n FROM node_points) a ON a.incident_id = e.incident_id AND a.node = source
  JOIN (SELECT DISTINCT incident_id, node, n FROM node_points) b ON b.incident_id = e.incident_id AND b.node = target GROUP BY ALL)
SELECT l.incident_id, source, target, l.n, a.pos, a.x - avg(a.x) OVER w AS dx, b.x - avg(b.x) OVER w AS dy FROM l
JOIN node_points a ON a.incident_id = l.incident_id AND a.node = source AND a.pos < l.n
JOIN node_points b ON b.incident_id = l.incident_id AND b.node = target AND b.pos = a.pos
WINDOW w AS (PARTITION BY l.incident_id, source, target)""")
cte("pair_std", """
SELECT incident_id, source, target, n, sqrt(avg(dx * dx)) AS sx, sqrt(avg(dy * dy)) AS sy FROM pair_points GROUP BY ALL""")
cte("pair_corr", """
WITH c AS (SELECT a.incident_id, a.source, a.target, b.pos - a.pos AS lag, sum(a.dx * b.dy) AS d, count(*) AS m FROM pair_points a
  JOIN pair_points b ON b.incident_id = a.incident_id AND b.source = a.source AND b.target = a.target
  AND abs(b.pos - a.pos) <= greatest(1, a.n // 4) GROUP BY ALL),
v AS (SELECT s.incident_id, s.source, s.target, lag, d / (m * sx * sy + 1e-12) AS corr FROM c JOIN pair_std s USING (incident_id, source, target)
  WHERE m >= 3 AND sx >= 1e-12 AND sy >= 1e-12 AND n >= 3),
w AS (SELECT incident_id, source, target, lag, corr, floor(abs(corr) * 1e9 + 0.5) AS size FROM v)
SELECT s.incident_id, s.source, s.target, coalesce(arg_max(corr, (size, -lag)), 0) AS lag_corr, coalesce(arg_max(lag, (size, -lag)), 0) AS best_lag
FROM pair_std s LEFT JOIN w USING (incident_id, source, target) GROUP BY ALL""")
cte("pair_power", """
SELECT incident_id, source, target, n, k, sum(dx * cos(2 * pi() * k * pos / n)) AS xr, CASE WHEN 2 * k = n THEN 0.0 ELSE -sum(dx * sin(2 * pi() * k * pos / n)) END AS xi,
  sum(dy * cos(2 * pi() * k * pos / n)) AS yr, CASE WHEN 2 * k = n THEN 0.0 ELSE -sum(dy * sin(2 * pi() * k * pos / n)) END AS yi
FROM pair_points, (SELECT unnest(range(1, 721)) AS k) WHERE k <= n // 2 GROUP BY incident_id, source, target, n, k""")
cte("node_power", """
SELECT incident_id, component || '.' || kpi AS node, k, p, n FROM spec_power WHERE w = -1 AND n >= 4""")
cte("pair_shape", """
WITH m AS (SELECT e.incident_id, source, target, a.k, a.p AS pa, b.p AS pb FROM pair_std e
  JOIN node_power a ON a.incident_id = e.incident_id AND a.node = source JOIN node_power b ON b.incident_id = e.incident_id AND b.node = target AND b.k = a.k)
SELECT incident_id, source, target, least(1, greatest(0, (sum(pa * pb) / ((sqrt(sum(pa * pa)) + 1e-12) * (sqrt(sum(pb * pb)) + 1e-12)) + 1) / 2)) AS shape
FROM m GROUP BY ALL""")
cte("node_dominant", """
SELECT incident_id, component || '.' || kpi AS node, dominant_index FROM spec_features WHERE w = -1 AND ni >= 4""")
cte("pair_phase", """
WITH d AS (SELECT incident_id, source, target, any_value(n) AS n, arg_max(k, (floor((xr * xr + xi * xi + yr * yr + yi * yi) * 1e9 + 0.5), -k)) AS k,
  arg_max(atan2(yi, yr) - atan2(xi, xr), (floor((xr * xr + xi * xi + yr * yr + yi * yi) * 1e9 + 0.5), -k)) AS diff FROM pair_power GROUP BY incident_id, source, target),
e AS (SELECT d.*, (diff + pi()) - 2 * pi() * floor((diff + pi()) / (2 * pi())) - pi() AS wr, best_lag FROM d JOIN pair_corr USING (incident_id, source, target)),
x AS (SELECT *, wr / (2 * pi()) * n / k AS expected FROM e)
SELECT incident_id, source, target, CASE WHEN n < 16 THEN 0.5 WHEN expected = 0 THEN CASE WHEN best_lag = 0 THEN 1 ELSE 0 END
  WHEN abs(expected) > 1e-6 AND best_lag / expected > 0 THEN 1 / (1 + abs(best_lag / expected - 1)) ELSE 0 END AS phase FROM x""")
cte("edges_measured", """
SELECT e.*, lag_corr, best_lag, shape, CASE WHEN abs(a.dominant_index - b.dominant_index) <= 1 THEN 1.0 ELSE 0.0 END AS freq_match, phase
FROM cand_edges e JOIN pair_corr USING (incident_id, source, target) JOIN pair_shape USING (incident_id, source, target)
JOIN pair_phase USING (incident_id, source, target)
JOIN node_dominant a ON a.incident_id = e.incident_id AND a.node = source JOIN node_dominant b ON b.incident_id = e.incident_id AND b.node = target""")


def measured(spark, sf_dir):
    return stage(spark, sf_dir, "measured", lambda: SP.edge_measures(
        SP.candidate_edges(evidence(spark, sf_dir)), arrays(spark, sf_dir)))


def _fresh_measured(spark, sf_dir):
    return SP.edge_measures(SP.candidate_edges(evidence(spark, sf_dir)), arrays(spark, sf_dir))


@query("win6_cross_correlation", """
SELECT incident_id, source, target, round(lag_corr, 4)::DOUBLE + 0.0 AS lag_corr, CAST(best_lag AS INTEGER) AS best_lag FROM edges_measured""")
def cross_correlation(spark, sf_dir):
    return _fresh_measured(spark, sf_dir).select("incident_id", "source", "target", r("lag_corr"), "best_lag")


@query("win7_shape_similarity", "SELECT incident_id, source, target, round(shape, 4)::DOUBLE AS shape FROM edges_measured")
def shape_similarity(spark, sf_dir):
    return measured(spark, sf_dir).select("incident_id", "source", "target", r("shape"))


@query("win8_dominant_match", "SELECT incident_id, source, target, freq_match::DOUBLE AS freq_match FROM edges_measured")
def dominant_match(spark, sf_dir):
    return measured(spark, sf_dir).select("incident_id", "source", "target", "freq_match")


@query("win9_phase_consistency", "SELECT incident_id, source, target, round(phase, 4)::DOUBLE AS phase FROM edges_measured")
def phase_consistency(spark, sf_dir):
    return measured(spark, sf_dir).select("incident_id", "source", "target", r("phase"))


def _edges_sql(spectral=True, consistency=True):
    extra = "0.45 * shape + 0.2 * freq_match + 0.2 * phase" if spectral else "0"
    return f"""
WITH a AS (SELECT *, round(prior * (1 + source_score) * greatest(0, lag_corr) * (1 + {extra}), 4) AS raw_weight,
  CASE WHEN source_score < 1e-8 AND target_score < 1e-8 THEN 0 WHEN source_score / (source_score + target_score + 1e-12) >= 0.5
   THEN source_score / (source_score + target_score + 1e-12) ELSE source_score / (source_score + target_score + 1e-12) END AS consistency
  FROM EDGE_SOURCE)
SELECT *, round(raw_weight * {'consistency' if consistency else '1'}, 4) AS weight, round(raw_weight * {'consistency' if consistency else '1'}, 4) >= 0.3 AS keep FROM a"""


cte("edges_refined", _edges_sql().replace("EDGE_SOURCE", "edges_measured"))


def edges(spark, sf_dir):
    return stage(spark, sf_dir, "edges_refined", lambda: SP.weigh_edges(measured(spark, sf_dir)))


@query("grf15_graph_consistency", "SELECT incident_id, source, target, round(consistency, 4)::DOUBLE AS consistency FROM edges_refined")
def graph_consistency(spark, sf_dir):
    return SP.weigh_edges(measured(spark, sf_dir)).select("incident_id", "source", "target", r("consistency"))


@query("grf17_edge_refinement", "SELECT incident_id, source, target, raw_weight::DOUBLE AS raw_weight, weight::DOUBLE AS weight, keep FROM edges_refined")
def edge_refinement(spark, sf_dir):
    return SP.weigh_edges(measured(spark, sf_dir)).select("incident_id", "source", "target", "raw_weight", "weight", "keep")


cte("node_onsets", """
SELECT incident_id, component || '.' || kpi AS node, min(start_ts) AS onset FROM segments_b GROUP BY ALL""")
cte("onset_bonus", """
SELECT *, 1 - (onset - min(onset) OVER w) / greatest(max(onset) OVER w - min(onset) OVER w, 1) AS onset_bonus FROM node_onsets
WINDOW w AS (PARTITION BY incident_id)""")


def node_onsets(spark, sf_dir):
    from sonde.plans.queries_detect import segments
    return segments(spark, sf_dir).groupBy("incident_id", F.concat("component", F.lit("."), "kpi").alias("node")).agg(
        F.min("start_ts").alias("onset"))


@query("win15_onset_bonus", "SELECT incident_id, node, onset, round(onset_bonus, 6)::DOUBLE + 0.0 AS onset_bonus FROM onset_bonus")
def onset_bonus(spark, sf_dir):
    return SP.onset_bonus(node_onsets(spark, sf_dir)).select("incident_id", "node", "onset", r("onset_bonus", 6))


def _ranking_sql(ev, ed, onset=True):
    bonus = "coalesce(onset_bonus, 0)" if onset else "0"
    join = "LEFT JOIN onset_bonus b ON b.incident_id = n.incident_id AND b.node = n.node" if onset else ""
    return f"""
WITH n AS (SELECT incident_id, component || '.' || kpi AS node, final_score AS anomaly, spectral_class FROM {ev}),
o AS (SELECT incident_id, source AS node, sum(weight) AS w FROM {ed} WHERE keep GROUP BY ALL),
i AS (SELECT incident_id, target AS node, sum(weight) AS w FROM {ed} WHERE keep GROUP BY ALL),
s AS (SELECT n.*, coalesce(o.w, 0) AS oe, coalesce(i.w, 0) AS ie, {bonus} AS bonus FROM n
  LEFT JOIN o ON o.incident_id = n.incident_id AND o.node = n.node LEFT JOIN i ON i.incident_id = n.incident_id AND i.node = n.node {join}),
z AS (SELECT *, round(greatest(0, 0.4 * anomaly + 0.35 * oe - 0.2 * ie + 0.05 * bonus), 4) AS root_score FROM s)
SELECT incident_id, node, anomaly, round(oe, 4) AS out_evidence, round(ie, 4) AS in_evidence, bonus AS onset_bonus, root_score, spectral_class,
  concat_ws(', ', 'Node ' || node, CASE WHEN anomaly > 0.7 THEN 'has high anomaly score' WHEN anomaly > 0.4 THEN 'has moderate anomaly score' ELSE 'has low anomaly score' END,
   CASE WHEN oe > 0.5 THEN 'strong outgoing propagation' END, CASE WHEN ie > 0.3 THEN 'significantly affected by others' END,
   CASE WHEN bonus > 0.5 THEN 'early onset time' END,
   CASE WHEN spectral_class <> 'no_strong_spectral_anomaly' THEN 'spectral type: ' || spectral_class END) || '.' AS explanation,
  row_number() OVER (PARTITION BY incident_id ORDER BY root_score DESC, node) AS rank FROM z"""


cte("ranking", _ranking_sql("evidence", "edges_refined"))


def ranking(spark, sf_dir):
    return stage(spark, sf_dir, "ranking", lambda: SP.root_ranking(
        evidence(spark, sf_dir), edges(spark, sf_dir), node_onsets(spark, sf_dir)))


@query("rnk1_spectral_root_ranking", """
SELECT incident_id, node, anomaly, out_evidence::DOUBLE AS out_evidence, in_evidence::DOUBLE AS in_evidence, root_score::DOUBLE AS root_score,
  explanation, CAST(rank AS INTEGER) AS rank FROM ranking""")
def root_ranking(spark, sf_dir):
    return SP.root_ranking(evidence(spark, sf_dir), edges(spark, sf_dir), node_onsets(spark, sf_dir)).select(
        "incident_id", "node", "anomaly", "out_evidence", "in_evidence", "root_score", "explanation", "rank")


# ------------------------------------------------------------------ hypotheses
def _hypotheses_sql(ev, rk, ed, iterations=3, enough=0.3):
    conf = ("round(least(1, greatest(0, CASE {s} WHEN 'validated' THEN 0.9 WHEN 'spectral_confirmed' THEN 0.7 WHEN 'evidence_supported' THEN 0.5 "
            "WHEN 'hypothesized' THEN 0.2 WHEN 'evidence_contradicted' THEN 0.1 WHEN 'spectral_rejected' THEN 0.05 ELSE 0 END "
            "+ least(0.1, 0.02 * f) - least(0.3, 0.05 * a))), 9)")
    reason = "CASE spectral_class " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.REASON_BY_SPECTRAL_CLASS.items()) + " END"
    sql = f"""
WITH n AS (SELECT incident_id, component || '.' || kpi AS node, final_score, spectral_class FROM {ev}),
top5 AS (SELECT * FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY final_score DESC, node) <= 5) WHERE final_score >= 0.1),
h AS (SELECT incident_id, node, {reason} AS reason FROM top5 UNION ALL
  SELECT incident_id, node, NULL FROM {rk} WHERE rank <= 3 AND (incident_id, node) NOT IN (SELECT (incident_id, node) FROM top5)),
o AS (SELECT incident_id, source AS node, avg(weight) AS w FROM {ed} WHERE keep GROUP BY ALL),
i AS (SELECT incident_id, target AS node, avg(weight) AS w FROM {ed} WHERE keep GROUP BY ALL),
r0 AS (SELECT h.*, n.spectral_class, CASE WHEN final_score > 0.5 THEN 1 ELSE 0 END + CASE WHEN o.w > 0.3 THEN 1 ELSE 0 END AS df,
  CASE WHEN final_score < 0.2 THEN 1 ELSE 0 END + CASE WHEN i.w > 0.5 THEN 1 ELSE 0 END AS da,
  n.spectral_class <> 'no_strong_spectral_anomaly' AS conf, 0 AS nf, 0 AS na, 'hypothesized' AS st, 0.0::DOUBLE AS cf, true AS op
  FROM h JOIN n USING (incident_id, node) LEFT JOIN o USING (incident_id, node) LEFT JOIN i USING (incident_id, node))"""
    for k in range(iterations):
        sql += f""",
s{k} AS (SELECT *, nf + df + CASE WHEN conf THEN 1 ELSE 0 END AS f, na + da + CASE WHEN conf THEN 0 ELSE 1 END AS a,
  CASE WHEN conf THEN 'spectral_confirmed' ELSE 'spectral_rejected' END AS s1 FROM r{k}),
t{k} AS (SELECT *, CASE WHEN s1 = 'spectral_confirmed' AND {conf.format(s='s1')} > 0.6 THEN 'validated' ELSE s1 END AS s2 FROM s{k}),
u{k} AS (SELECT *, {conf.format(s='s2')} AS c2 FROM t{k}),
v{k} AS (SELECT *, max(c2) OVER (PARTITION BY incident_id) >= {enough} AS done FROM u{k}),
r{k + 1} AS (SELECT incident_id, node, reason, spectral_class, df, da, conf,
  CASE WHEN NOT op THEN nf WHEN NOT done AND s2 = 'spectral_rejected' THEN 0 ELSE f END AS nf,
  CASE WHEN NOT op THEN na WHEN NOT done AND s2 = 'spectral_rejected' THEN 0 ELSE a END AS na,
  CASE WHEN NOT op THEN st WHEN NOT done AND s2 = 'spectral_rejected' THEN 'hypothesized' ELSE s2 END AS st,
  CASE WHEN NOT op THEN cf WHEN NOT done AND s2 = 'spectral_rejected' THEN 0.0 ELSE c2 END AS cf, op AND NOT done AS op FROM v{k})"""
    return sql + f"""
SELECT incident_id, node, reason, spectral_class, st AS belief_state, nf AS n_for, na AS n_against, cf AS confidence FROM r{iterations}"""


cte("hypotheses", _hypotheses_sql("evidence", "ranking", "edges_refined"))


def hypotheses(spark, sf_dir):
    ev = evidence(spark, sf_dir)
    return H.believe(H.hypothesise(ev, ranking(spark, sf_dir)), ev, edges(spark, sf_dir))


@query("hyp1_belief_states", """
SELECT incident_id, node, reason, belief_state, CAST(n_for AS INTEGER) AS n_for, CAST(n_against AS INTEGER) AS n_against,
  round(confidence, 6)::DOUBLE AS confidence FROM hypotheses""")
def belief_states(spark, sf_dir):
    return hypotheses(spark, sf_dir).select(
        "incident_id", "node", "reason", "belief_state", "n_for", "n_against", r("confidence", 6))


def _rerank_sql(rk, hy):
    return f"""
WITH x AS (SELECT r.*, round(root_score * (1 + coalesce(confidence, 0)), 4) AS new_score FROM {rk} r
  LEFT JOIN (SELECT * FROM {hy} WHERE belief_state IN ('validated', 'spectral_confirmed', 'evidence_supported')) h USING (incident_id, node))
SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY new_score DESC, node) AS new_rank FROM x"""


cte("reranked", _rerank_sql("ranking", "hypotheses"))


@query("hyp2_abductive_rerank", """
SELECT incident_id, node, root_score::DOUBLE AS root_score, new_score::DOUBLE AS new_score, CAST(new_rank AS INTEGER) AS new_rank FROM reranked""")
def abductive_rerank(spark, sf_dir):
    return H.rerank(ranking(spark, sf_dir), hypotheses(spark, sf_dir)).select(
        "incident_id", "node", "root_score", "new_score", "new_rank")


# ------------------------------------------------------------------ support and reflection
cte("log_errors", """
SELECT i.incident_id, component, count(*) AS total_logs, count(*) FILTER (contains(lower(value), 'error') OR contains(lower(value), 'timeout')
 OR contains(lower(value), 'connection reset') OR contains(lower(value), 'cpu') OR contains(lower(value), 'gc')) AS error_count
FROM logs l JOIN incidents i ON l.ts BETWEEN i.start_ts AND i.end_ts GROUP BY ALL HAVING error_count > 0""")
cte("support", """
SELECT incident_id, 'metric' AS agent, component AS node FROM evidence WHERE final_score >= 0.5 GROUP BY ALL
UNION ALL SELECT incident_id, 'log', component FROM log_errors
UNION ALL SELECT i.incident_id, 'trace', e.component FROM event_spans e JOIN incidents i ON e.ts BETWEEN i.start_ts AND i.end_ts
WHERE NOT success GROUP BY ALL""")


def support(spark, sf_dir):
    from sonde.operators.logs import error_profile
    ev = evidence(spark, sf_dir).filter("final_score >= 0.5").select(
        "incident_id", F.lit("metric").alias("agent"), F.col("component").alias("node")).distinct()
    inc = T.incidents(spark, sf_dir)
    lg = error_profile(T.logs(spark, sf_dir), inc).select("incident_id", F.lit("log").alias("agent"), F.col("component").alias("node"))
    tr = WN.window_join(T.event_spans(spark, sf_dir).filter(~F.col("success")), inc).select(
        "incident_id", F.lit("trace").alias("agent"), F.col("component").alias("node")).distinct()
    return ev.unionByName(lg).unionByName(tr)


@query("agg28_verify_support", """
SELECT incident_id, node, count(*) AS support_count, round(count(*) / any_value(n), 4)::DOUBLE AS verification_score,
  string_agg(DISTINCT agent, ',' ORDER BY agent) AS sources FROM support JOIN (SELECT incident_id, count(DISTINCT agent) AS n FROM support GROUP BY ALL) c
USING (incident_id) GROUP BY incident_id, node""")
def verify_support(spark, sf_dir):
    return H.verify_support(support(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


@query("hyp3_reflect", """
WITH m AS (SELECT incident_id, max(final_score) AS mc, count(*) FILTER (final_score >= 0.5) AS sup FROM evidence GROUP BY ALL)
SELECT incident_id, mc AS max_confidence, sup AS supported, root_score::DOUBLE AS root_score, CASE WHEN mc < 0.5 OR sup = 0 THEN 'backtrack'
  WHEN root_score < 0.3 THEN 're_hypothesize' ELSE 'finalize' END AS action FROM m JOIN ranking USING (incident_id) WHERE rank = 1""")
def reflect(spark, sf_dir):
    conf = evidence(spark, sf_dir).groupBy("incident_id").agg(
        F.max("final_score").alias("max_confidence"), F.count_if(F.col("final_score") >= 0.5).alias("supported"))
    return H.reflect(conf, ranking(spark, sf_dir))


# ------------------------------------------------------------------ paths
cte("edge_paths", """
SELECT a.incident_id, a.source || '>' || a.target || '>' || b.target AS path_id, a.source AS n1, a.target AS n2, b.target AS n3
FROM edges_refined a JOIN edges_refined b ON b.incident_id = a.incident_id AND b.source = a.target AND b.target <> a.source""")


@query("grf16_path_score", """
WITH s AS (SELECT incident_id, component || '.' || kpi AS node, final_score AS s FROM evidence)
SELECT p.incident_id, path_id, round((e1.weight + e2.weight) / 2 * greatest(0, 1 - (greatest(0, b.s - a.s) + greatest(0, c.s - b.s))
  / greatest(a.s + b.s + c.s, 1e-12)), 4)::DOUBLE AS path_score FROM edge_paths p
JOIN edges_refined e1 ON e1.incident_id = p.incident_id AND e1.source = n1 AND e1.target = n2
JOIN edges_refined e2 ON e2.incident_id = p.incident_id AND e2.source = n2 AND e2.target = n3
JOIN s a ON a.incident_id = p.incident_id AND a.node = n1 JOIN s b ON b.incident_id = p.incident_id AND b.node = n2
JOIN s c ON c.incident_id = p.incident_id AND c.node = n3""")
def path_score(spark, sf_dir):
    e = edges(spark, sf_dir).select("incident_id", "source", "target", "weight")
    b = e.select("incident_id", F.col("source").alias("target"), F.col("target").alias("third"))
    paths = e.join(b, ["incident_id", "target"]).filter("third <> source").select(
        "incident_id", F.concat_ws(">", "source", "target", "third").alias("path_id"),
        F.array("source", "target", "third").alias("path"))
    nodes = evidence(spark, sf_dir).select(
        "incident_id", F.concat("component", F.lit("."), "kpi").alias("component"), F.col("final_score").alias("score"))
    return SP.path_scores(paths, e, nodes).withColumn("path_score", S.rounded(F.col("path_score"), 4))
