"""Registered queries: log, trace and KPI evidence for reasons, and the choice of a reason."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.functions import fixed as V
from sonde.functions import scalars as S
from sonde.operators import logs as L
from sonde.operators import reason as R
from sonde.operators import windows as WN
from sonde.plans import queries_detect as QD
from sonde.plans.queries_graph import candidates, topology_logs, window_spans
from sonde.plans.queries_sources import category_sql, family_sql, ownership_sql, reason_prior_sql
from sonde.plans.queries_spans import incident_spans
from sonde.plans.registry import cte, query, sql_any, sql_case
from sonde.plans.stages import stage
from sonde.sources import tables as T

REASONS = T.REASONS
C = "incident_id, component"


def r(name, digits=6):
    return S.rounded(F.col(name), digits).alias(name)


# ------------------------------------------------------------------ logs
cte("inc_logs", "SELECT i.incident_id, l.component, l.value FROM logs l JOIN incidents i ON l.ts BETWEEN i.start_ts AND i.end_ts")
cte("short_logs", """
WITH w AS (SELECT i.incident_id, l.component, l.value FROM logs l JOIN short_incidents i ON l.ts BETWEEN i.start_ts AND i.end_ts)
SELECT * FROM w UNION ALL SELECT i.incident_id, l.component, l.value FROM logs l JOIN short_incidents i ON l.ts // 86400 = i.start_ts // 86400
WHERE i.incident_id NOT IN (SELECT incident_id FROM w)""")


@query("agg17_error_profile", """
WITH x AS (SELECT incident_id, component, """ + sql_case(
    [(f"contains(lower(value), '{w}')", f"'{w}'") for w in V.LOG_ERROR_WORDS], "NULL") + """ AS word FROM short_logs),
t AS (SELECT incident_id, component, word, count(*) AS n FROM x GROUP BY ALL)
SELECT incident_id, component, sum(n)::BIGINT AS total_logs, coalesce(sum(n) FILTER (word IS NOT NULL), 0)::BIGINT AS error_count,
  string_agg(word || '=' || n, ',' ORDER BY word) FILTER (word IS NOT NULL) AS error_types,
  round(sum(n) FILTER (word IS NOT NULL) / sum(n), 4)::DOUBLE AS error_ratio, round(least(1, 3.0 * sum(n) FILTER (word IS NOT NULL) / sum(n)), 6)::DOUBLE AS anomaly_score
FROM t GROUP BY ALL HAVING sum(n) FILTER (word IS NOT NULL) > 0""")
def error_profile(spark, sf_dir):
    from sonde.plans.queries_sources import short_incidents
    p = L.error_profile(T.logs(spark, sf_dir), short_incidents(spark, sf_dir))
    words = F.transform(F.array_sort(F.map_entries("error_types")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return p.withColumn("error_types", F.array_join(words, ",")).withColumn("anomaly_score", S.rounded(F.col("anomaly_score"), 6))


_TPL = """regexp_replace(trim(regexp_replace(lower(value), '\\s+', ' ', 'g')), '0x[0-9a-fA-F]+|[a-fA-F0-9]{16,}|\\d+\\.\\d+|\\d+', '<*>', 'g')"""
cte("inc_templates", f"SELECT incident_id, component, {_TPL} AS template, count(*) AS n FROM inc_logs GROUP BY ALL")


def _rule_sql(what):
    chain = []
    for words, wanted, weight in V.LOG_REASON_RULES:
        allowed = [x for x in (wanted or REASONS) if x in REASONS]
        if allowed:
            chain.append((sql_any("template", words), f"'{allowed[0]}'" if what == "reason" else f"{weight}"))
    return sql_case(chain, "NULL")


cte("log_reason", f"""
WITH x AS (SELECT *, {_rule_sql('reason')} AS reason, {_rule_sql('weight')} AS weight FROM inc_templates)
SELECT incident_id, component, reason, sum(weight * n)::DOUBLE AS score FROM x WHERE reason IS NOT NULL GROUP BY ALL""")


def template_counts(spark, sf_dir):
    return stage(spark, sf_dir, "templates", lambda: L.templated(T.logs(spark, sf_dir), T.incidents(spark, sf_dir)))


@query("agg18_log_reason_evidence", "SELECT incident_id, component, reason, round(score, 4)::DOUBLE AS score FROM log_reason")
def log_reason_evidence(spark, sf_dir):
    return L.reason_evidence(L.templated(T.logs(spark, sf_dir), T.incidents(spark, sf_dir)), REASONS).withColumn(
        "score", S.rounded(F.col("score"), 4))


@query("agg18_template_counts", """
SELECT incident_id, template_id, n, CAST(rank AS INTEGER) AS rank FROM (SELECT incident_id, substr(sha1(template), 1, 12) AS template_id, sum(n)::BIGINT AS n,
  row_number() OVER (PARTITION BY incident_id ORDER BY sum(n) DESC, substr(sha1(template), 1, 12)) AS rank FROM inc_templates GROUP BY incident_id, template) WHERE rank <= 50""")
def template_top(spark, sf_dir):
    return L.template_counts(template_counts(spark, sf_dir))


@query("smp3_template_sample", f"""
WITH x AS (SELECT incident_id, substr(sha1(template), 1, 12) AS template_id, sum(n * (1 + CASE WHEN {sql_any('template', V.TEMPLATE_ERROR_WORDS)} THEN 4 ELSE 0 END
  + CASE WHEN {sql_any('template', V.TEMPLATE_RESOURCE_WORDS)} THEN 2 ELSE 0 END))::BIGINT AS weight FROM inc_templates GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY weight DESC, template_id) AS INTEGER) AS rank FROM x
QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY weight DESC, template_id) <= 80""")
def template_sample(spark, sf_dir):
    return L.template_sample(template_counts(spark, sf_dir))


@query("grf8_connection_errors", """
SELECT i.incident_id, component, count(*) AS errors FROM topology_logs t JOIN incidents i ON t.ts BETWEEN i.start_ts AND i.end_ts
WHERE contains(value, 'Communications link failure') GROUP BY ALL""")
def connection_errors(spark, sf_dir):
    from sonde.operators.topology import connection_errors as errors
    return errors(topology_logs(spark, sf_dir), T.incidents(spark, sf_dir))


def _hits(words):
    return " + ".join(f"max(CASE WHEN contains(v, '{w}') THEN 1 ELSE 0 END)" for w in words)


def _log_score(reason):
    low, parts = reason.lower(), ["0.0"]
    for family, ws in V.LOG_FAMILY_WORDS.items():
        if family in low or any(w in low for w in ws):
            parts.append(f"least(1, h_{family} / {max(1, len(ws) / 2)} + bonus)")
    if any(w in low for w in V.GC_WORDS) or "memory" in low:
        parts.append(f"least(1, 0.5 * h_gc / {max(1, len(V.GC_WORDS) / 2)})")
    return f"greatest({', '.join(parts)}, 0)"


cte("log_text_scores", f"""
WITH l AS (SELECT incident_id, component, lower(value) AS v FROM inc_logs),
h AS (SELECT incident_id, component, {', '.join(f'{_hits(ws)} AS h_{f}' for f, ws in V.LOG_FAMILY_WORDS.items())}, {_hits(V.GC_WORDS)} AS h_gc,
  least(0.1 * sum((length(v) - length(replace(v, 'error', ''))) / 5 + (length(v) - length(replace(v, 'fatal', ''))) / 5
   + (length(v) - length(replace(v, 'exception', ''))) / 9), 0.3) AS bonus FROM l GROUP BY ALL)
{' UNION ALL '.join(f"SELECT incident_id, component, '{x}' AS reason, round({_log_score(x)}, 9)::DOUBLE AS score FROM h" for x in REASONS)}""")


def log_text(spark, sf_dir):
    lines = WN.window_join(T.logs(spark, sf_dir), T.incidents(spark, sf_dir))
    return R.log_reason_scores(lines, REASONS)


@query("agg19_log_text_reason", "SELECT incident_id, component, reason, round(score, 6)::DOUBLE AS score FROM log_text_scores")
def log_text_reason(spark, sf_dir):
    return log_text(spark, sf_dir).withColumn("score", S.rounded(F.col("score"), 6))


# ------------------------------------------------------------------ traces
def _trace_score(reason):
    low, parts = reason.lower(), ["0.0"]
    if any(w in low for w in ("latency", "delay", "timeout")):
        parts.append("CASE WHEN cv < 0.5 AND p50 > 500 THEN 0.7 WHEN cv < 0.8 AND mean > 300 THEN 0.5 ELSE 0 END")
    if any(w in low for w in ("packet", "loss")):
        parts.append("CASE WHEN cv > 1 AND p95 / greatest(p05, 1) > 5 THEN 0.6 WHEN cv > 0.8 THEN 0.4 ELSE 0 END")
    if any(w in low for w in ("cpu", "load")):
        parts.append("CASE WHEN n >= 5 AND late > early * 1.3 THEN 0.6 ELSE 0 END")
    if any(w in low for w in ("memory", "oom", "heap")):
        parts.append("CASE WHEN top / greatest(p50, 1) > 5 THEN 0.5 WHEN top / greatest(p50, 1) > 3 THEN 0.3 ELSE 0 END")
    if any(w in low for w in ("db", "connection", "close", "limit")):
        parts.append("CASE WHEN kind IN ('db', 'redis') AND p75 - p25 > mean * 0.5 THEN 0.5 ELSE 0 END")
    return f"greatest({', '.join(parts)}, 0)"


def _trace_cte(source):
    return f"""
WITH d AS (SELECT {C}, duration, row_number() OVER (PARTITION BY {C} ORDER BY duration) - 1 AS i, count(*) OVER (PARTITION BY {C}) AS n FROM {source} WHERE duration > 0),
g AS (SELECT {C}, any_value(n) AS n, avg(duration) AS mean, stddev_pop(duration) / avg(duration) AS cv, max(duration) AS top,
  max(CASE WHEN i = n // 2 THEN duration END) AS p50, max(CASE WHEN i = CAST(floor(n * 0.95::DOUBLE) AS BIGINT) THEN duration END) AS p95,
  max(CASE WHEN i = CAST(floor(n * 0.05::DOUBLE) AS BIGINT) THEN duration END) AS p05, max(CASE WHEN i = CAST(floor(n * 0.75::DOUBLE) AS BIGINT) THEN duration END) AS p75,
  max(CASE WHEN i = CAST(floor(n * 0.25::DOUBLE) AS BIGINT) THEN duration END) AS p25, avg(CASE WHEN i < n // 2 THEN duration END) AS early, avg(CASE WHEN i >= n // 2 THEN duration END) AS late
  FROM d WHERE n >= 3 GROUP BY {C}),
k AS (SELECT g.*, coalesce(ctype, 'service') AS kind FROM g LEFT JOIN component_types USING (component))
{' UNION ALL '.join(f"SELECT incident_id, component, '{x}' AS reason, round({_trace_score(x)}, 9)::DOUBLE AS score FROM k" for x in REASONS)}"""


cte("inc_event_spans", "SELECT i.incident_id, s.* FROM event_spans s JOIN incidents i ON s.ts BETWEEN i.start_ts AND i.end_ts")
cte("trace_reason", _trace_cte("inc_event_spans"))
cte("trace_reason_large", _trace_cte("inc_spans"))


@query("agg20_trace_duration_reason", "SELECT incident_id, component, reason, round(score, 6)::DOUBLE AS score FROM trace_reason_large")
def trace_duration_reason(spark, sf_dir):
    return R.trace_reason_scores(incident_spans(spark, sf_dir), REASONS).withColumn("score", S.rounded(F.col("score"), 6))


def trace_reason(spark, sf_dir):
    return R.trace_reason_scores(window_spans(spark, sf_dir), REASONS)


# ------------------------------------------------------------------ KPI categories, profiles, patterns
def _category_score(reason):
    low = reason.lower()
    for words, source, boosts, other in V.CATEGORY_REASONS:
        if any(w in low for w in words):
            boost = sql_case([(f"kind = '{k}'", b) for k, b in boosts.items()], str(other))
            if isinstance(source, str):
                base = f"c_{source} / tot * CASE WHEN top = '{source}' THEN focus ELSE 0.7 END"
            else:
                base = "(" + " + ".join(f"c_{c} / tot * {w}" for c, w in source) + ")"
            return f"least(1, {base} * {boost})"
    return "0"


cte("category_reason", f"""
WITH s AS (SELECT {C}, {category_sql('kpi')} AS cat, sum(severity) AS s FROM segments_b GROUP BY ALL),
g AS (SELECT {C}, sum(s) AS tot, arg_max(cat, (round(s, 9), cat)) AS top, max(s) / sum(s) * (1 + 0.5 * greatest(0, 3 - count(*)) / 3) AS focus,
  {', '.join(f"coalesce(sum(s) FILTER (cat = '{c}'), 0) AS c_{c}" for c in ('cpu', 'memory', 'network', 'disk', 'db', 'process'))} FROM s GROUP BY ALL HAVING sum(s) > 0),
k AS (SELECT g.*, ctype AS kind FROM g JOIN component_types USING (component))
{' UNION ALL '.join(f"SELECT incident_id, component, '{x}' AS reason, round({_category_score(x)}, 9)::DOUBLE AS score FROM k" for x in REASONS)}""")


@query("agg21_category_reason", "SELECT incident_id, component, reason, round(score, 6)::DOUBLE AS score FROM category_reason")
def category_reason(spark, sf_dir):
    return R.category_reason_scores(QD.segments(spark, sf_dir), REASONS).withColumn("score", S.rounded(F.col("score"), 6))


_FAM = family_sql("lower(kpi || ' metric_container.csv')")
_OWN = ownership_sql("ctype", "lower(kpi || ' metric_container.csv')")
cte("owned_segments", f"""
SELECT s.incident_id, s.component, s.kpi, s.severity, s.reason_hint, {_FAM} AS family, severity * {_OWN} AS owned
FROM segments_b s JOIN component_types USING (component) WHERE severity > 0""")
cte("profiles", f"""
WITH f AS (SELECT {C}, family, sum(owned) AS s FROM owned_segments GROUP BY ALL),
n AS (SELECT incident_id, count(DISTINCT component) AS n FROM segments_b GROUP BY ALL),
i AS (SELECT incident_id, family, 1 + ln((1.0 + any_value(n)) / (1.0 + count(*))) AS idf FROM f JOIN n USING (incident_id) GROUP BY incident_id, family),
l AS (SELECT {C}, max(s * idf) AS l FROM f JOIN i USING (incident_id, family) GROUP BY ALL)
SELECT {C}, round(least(1, l / greatest(max(l) OVER (PARTITION BY incident_id), 1e-9)), 6)::DOUBLE AS local_evidence FROM l""")
cte("reason_rows", "SELECT unnest([" + ", ".join(f"'{x}'" for x in REASONS) + "]) AS reason, unnest(range(7)) AS pos")
cte("reason_parts", f"""
SELECT o.incident_id, o.component, q.reason, owned, severity, CASE WHEN reason_hint = q.reason THEN 1 ELSE 0 END + CASE WHEN rf.rf = o.family THEN 1.0
  WHEN b1.broad = b2.broad THEN 0.45 ELSE 0 END AS m FROM owned_segments o JOIN reason_rows q ON true
  JOIN (SELECT reason, {family_sql('lower(reason)', V.REASON_FAMILIES)} AS rf FROM reason_rows) rf ON rf.reason = q.reason
  LEFT JOIN broad_family b1 ON b1.family = rf.rf LEFT JOIN broad_family b2 ON b2.family = o.family""")
cte("profile_reason", f"""
WITH x AS (SELECT {C}, reason, sum(owned * m) AS raw FROM reason_parts GROUP BY ALL)
SELECT {C}, reason, round(least(1, raw / greatest(max(raw) OVER (PARTITION BY incident_id), 1e-9)), 9)::DOUBLE AS score FROM x""")
cte("keyword_reason", f"""
WITH x AS (SELECT {C}, reason, sum(severity * m) AS raw FROM reason_parts GROUP BY ALL)
SELECT {C}, reason, round(CASE WHEN max(raw) OVER w > 0 THEN least(1, raw / greatest(max(raw) OVER w, 1e-12)) ELSE 0 END, 9)::DOUBLE AS score FROM x WINDOW w AS (PARTITION BY {C})""")
cte("signatures", "SELECT * FROM (VALUES " + ", ".join(
    f"('{x}', '{f}', {w}::DOUBLE)" for x, sig in V.REASON_SIGNATURES.items() if x in REASONS for f, w in sig.items()) + ") AS s(reason, family, w)")
cte("pattern_reason", f"""
WITH f AS (SELECT {C}, {_FAM} AS family, sum(severity) AS s, count(*) AS k FROM segments_b GROUP BY ALL),
o AS (SELECT {C}, family, k, s / greatest(max(s) OVER w, 1e-9) * greatest(0.1, ln((1.0 + sum(k) OVER w) / (1.0 + k))) AS o, count(*) OVER w AS nf FROM f WINDOW w AS (PARTITION BY {C})),
c AS (SELECT DISTINCT {C}, nf FROM o),
m AS (SELECT c.incident_id, c.component, g.reason, any_value(c.nf) AS nf, sum(least(coalesce(o.o, 0), 1) * w) / count(*) AS m, coalesce(sum(k), 0) AS k, count(o.family) AS seen
  FROM c JOIN signatures g ON true LEFT JOIN o ON o.incident_id = c.incident_id AND o.component = c.component AND o.family = g.family GROUP BY c.incident_id, c.component, g.reason)
SELECT {C}, reason, round(least(1, greatest(0, m * (0.6 + 0.4 * CASE WHEN k > 0 THEN 1 / (1 + 0.15 * k) ELSE 0.5 END) * (1 - least(0.3, 0.1 * (nf - seen))))), 9)::DOUBLE AS score FROM m""")


@query("agg24_component_profiles", "SELECT * FROM profiles")
def component_profiles(spark, sf_dir):
    return R.component_profiles(QD.segments(spark, sf_dir), T.METRIC_FILE)


@query("agg24_profile_reasons", "SELECT incident_id, component, reason, round(score, 6)::DOUBLE AS score FROM profile_reason")
def profile_reasons(spark, sf_dir):
    return R.profile_reasons(QD.segments(spark, sf_dir), REASONS, T.METRIC_FILE).withColumn("score", S.rounded(F.col("score"), 6))


@query("agg25_pattern_reason", "SELECT incident_id, component, reason, round(score, 6)::DOUBLE AS score FROM pattern_reason")
def pattern_reason(spark, sf_dir):
    return R.pattern_reasons(QD.segments(spark, sf_dir), REASONS, T.METRIC_FILE).withColumn("score", S.rounded(F.col("score"), 6))


@query("det4_layer_filter_v2", """
WITH e AS (SELECT c.incident_id, c.component, t.ctype AS layer, round(0.65 * c.score + 0.35 * coalesce(local_evidence, c.score), 9) AS ev FROM cands c
  JOIN component_types t USING (component) LEFT JOIN profiles p USING (incident_id, component)),
l AS (SELECT incident_id, layer, max(ev) AS ls, arg_max(component, (ev, component)) AS lb FROM e GROUP BY ALL),
p AS (SELECT incident_id, arg_max(layer, (ls, layer)) AS prim, max(ls) AS best FROM l GROUP BY ALL),
k AS (SELECT e.*, prim FROM e JOIN l USING (incident_id, layer) JOIN p USING (incident_id)
  WHERE ev >= 0.58 * best OR ((layer = prim OR ls >= 0.5 * best) AND component = lb))
SELECT incident_id, component, ev::DOUBLE AS evidence, layer, prim AS "primary", CAST(row_number() OVER w AS INTEGER) AS rank FROM k
WINDOW w AS (PARTITION BY incident_id ORDER BY ev DESC, component) QUALIFY row_number() OVER w <= 12""")
def layer_filter_v2(spark, sf_dir):
    from sonde.operators.detect import layer_filter_weighted
    return layer_filter_weighted(candidates(spark, sf_dir), R.component_profiles(QD.segments(spark, sf_dir), T.METRIC_FILE))


# ------------------------------------------------------------------ choice
cte("hint_reason", f"""
WITH h AS (SELECT {C}, reason_hint AS reason, sum(severity) AS s FROM segments_b WHERE reason_hint IS NOT NULL GROUP BY ALL)
SELECT {C}, reason, CASE WHEN max(s) OVER w > 0 THEN least(1, s / greatest(max(s) OVER w, 1e-12)) ELSE 0 END AS score FROM h WINDOW w AS (PARTITION BY {C})""")
cte("chosen_reason", f"""
WITH x AS (SELECT c.incident_id, c.component, q.reason, q.pos, round(0.35 * coalesce(h.score, 0) + 0.15 * (0.4 * coalesce(l.score, 0) + 0.3 * coalesce(t.score, 0) + 0.3 * coalesce(g.score, 0))
  + 0.45 * {reason_prior_sql('lower(q.reason)', 'ct.ctype')}, 6) AS score FROM cands c JOIN reason_rows q ON true JOIN component_types ct ON ct.component = c.component
  LEFT JOIN hint_reason h ON h.incident_id = c.incident_id AND h.component = c.component AND h.reason = q.reason
  LEFT JOIN log_text_scores l ON l.incident_id = c.incident_id AND l.component = c.component AND l.reason = q.reason
  LEFT JOIN trace_reason t ON t.incident_id = c.incident_id AND t.component = c.component AND t.reason = q.reason
  LEFT JOIN category_reason g ON g.incident_id = c.incident_id AND g.component = c.component AND g.reason = q.reason)
SELECT {C}, arg_max(reason, (score, -pos)) AS reason, max(score) AS reason_score FROM x GROUP BY ALL""")
cte("chosen_reason_v2", f"""
WITH x AS (SELECT c.incident_id, c.component, q.reason, q.pos, CASE WHEN coalesce(p.score, 0) > 0 THEN p.score ELSE 0.5 * greatest(coalesce(k.score, 0), coalesce(f.score, 0)) END AS kpi,
  coalesce(l.score, 0) AS lg, {reason_prior_sql('lower(q.reason)', 'ct.ctype')} AS prior FROM cands c JOIN reason_rows q ON true JOIN component_types ct ON ct.component = c.component
  LEFT JOIN pattern_reason p ON p.incident_id = c.incident_id AND p.component = c.component AND p.reason = q.reason
  LEFT JOIN keyword_reason k ON k.incident_id = c.incident_id AND k.component = c.component AND k.reason = q.reason
  LEFT JOIN profile_reason f ON f.incident_id = c.incident_id AND f.component = c.component AND f.reason = q.reason
  LEFT JOIN log_text_scores l ON l.incident_id = c.incident_id AND l.component = c.component AND l.reason = q.reason),
y AS (SELECT *, 0.1 + 0.25 * (1 - greatest(kpi, lg)) AS w FROM x),
z AS (SELECT *, round((1 - w) * (0.7 * kpi + 0.25 * lg) + w * prior, 6) AS score FROM y)
SELECT {C}, arg_max(reason, (score, -pos)) AS reason, max(score) AS reason_score FROM z GROUP BY ALL""")


def chosen(spark, sf_dir):
    return stage(spark, sf_dir, "chosen_reason", lambda: R.choose_reason(
        candidates(spark, sf_dir), REASONS, R.hint_scores(QD.segments(spark, sf_dir)),
        log_text(spark, sf_dir), trace_reason(spark, sf_dir),
        R.category_reason_scores(QD.segments(spark, sf_dir), REASONS)))


def chosen_v2(spark, sf_dir):
    seg = QD.segments(spark, sf_dir)
    return stage(spark, sf_dir, "chosen_reason_v2", lambda: R.choose_reason_by_pattern(
        candidates(spark, sf_dir), REASONS, R.pattern_reasons(seg, REASONS, T.METRIC_FILE), R.keyword_reasons(seg, REASONS, T.METRIC_FILE),
        R.profile_reasons(seg, REASONS, T.METRIC_FILE), log_text(spark, sf_dir)))


@query("rnk6_reason_choice", "SELECT incident_id, component, reason, reason_score::DOUBLE AS reason_score FROM chosen_reason")
def reason_choice(spark, sf_dir):
    return chosen(spark, sf_dir)


@query("rnk6_reason_choice_v2", "SELECT incident_id, component, reason, reason_score::DOUBLE AS reason_score FROM chosen_reason_v2")
def reason_choice_v2(spark, sf_dir):
    return chosen_v2(spark, sf_dir)
