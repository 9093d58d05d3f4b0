"""Registered queries: case memory and samplers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.functions import scalars as S
from sonde.operators import memory as M
from sonde.operators import sample as SM
from sonde.operators import spans as SP
from sonde.plans import queries_reason as QR
from sonde.plans.queries_sources import _folder
from sonde.plans.registry import cte, query
from sonde.plans.stages import stage
from sonde.sources import tables as T

# ------------------------------------------------------------------ experiences
cte("case_queries", """
SELECT 'q:' || component || ':' || anomaly_type AS query_id, CASE WHEN component = 'c0' THEN 'unseen' ELSE component END AS component,
  CASE WHEN component = 'c0' THEN 'unseen' ELSE anomaly_type END AS anomaly_type, feature, round(avg(weight), 4)::DOUBLE AS weight
FROM patterns WHERE NOT success GROUP BY ALL""")


def case_queries(spark, sf_dir):
    """One query per (component, type) of the failed cases: their mean pattern; one component is unseen."""
    e = T.experiences(spark, sf_dir).filter(~F.col("success"))
    flat = e.select("component", "anomaly_type", F.explode("pattern").alias("feature", "weight"))
    mean = flat.groupBy("component", "anomaly_type", "feature").agg(S.rounded(F.avg("weight"), 4).alias("w"))
    g = mean.groupBy("component", "anomaly_type").agg(F.map_from_entries(F.collect_list(F.struct("feature", "w"))).alias("pattern"))
    new = F.col("component") == "c0"
    return g.select(F.concat(F.lit("q:"), "component", F.lit(":"), "anomaly_type").alias("query_id"),
                    F.when(new, "unseen").otherwise(F.col("component")).alias("component"),
                    F.when(new, "unseen").otherwise(F.col("anomaly_type")).alias("anomaly_type"), "pattern")


cte("relevant", """
WITH q AS (SELECT DISTINCT query_id, component, anomaly_type FROM case_queries),
r AS (SELECT q.query_id, e.case_id, q.component = e.component AS sc, q.anomaly_type = e.anomaly_type AS st FROM q JOIN experiences e ON q.component = e.component OR q.anomaly_type = e.anomaly_type)
SELECT * FROM r UNION ALL SELECT q.query_id, e.case_id, false, false FROM q JOIN experiences e ON true WHERE q.query_id NOT IN (SELECT query_id FROM r)""")


@query("join11_similar_experience_join", "SELECT query_id, case_id FROM relevant")
def similar_join(spark, sf_dir):
    return M.relevant_pairs(case_queries(spark, sf_dir), T.experiences(spark, sf_dir)).select("query_id", "case_id")


_COS = """
qn AS (SELECT query_id, sqrt(sum(weight * weight)) AS n FROM case_queries GROUP BY ALL), en AS (SELECT case_id, sqrt(sum(weight * weight)) AS n FROM patterns GROUP BY ALL),
d AS (SELECT r.query_id, r.case_id, any_value(sc) AS sc, any_value(st) AS st, sum(q.weight * p.weight) AS dot FROM relevant r JOIN case_queries q ON q.query_id = r.query_id
  JOIN patterns p ON p.case_id = r.case_id AND p.feature = q.feature GROUP BY r.query_id, r.case_id)"""


@query("mem1_similar_cases", f"""
WITH {_COS},
s AS (SELECT query_id, case_id, round(least(1, CASE WHEN qn.n >= 1e-12 AND en.n >= 1e-12 THEN dot / (qn.n * en.n) ELSE 0 END + CASE WHEN sc THEN 0.2 ELSE 0 END + CASE WHEN st THEN 0.2 ELSE 0 END), 6)::DOUBLE AS similarity
  FROM d JOIN qn USING (query_id) JOIN en USING (case_id))
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, case_id) AS INTEGER) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, case_id) <= 3""")
def similar_cases(spark, sf_dir):
    return M.similar_cases(case_queries(spark, sf_dir), T.experiences(spark, sf_dir))


@query("agg33_experience_statistics", """
SELECT count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed,
  round(count(*) FILTER (success) / greatest(count(*), 1), 6)::DOUBLE AS success_rate, count(DISTINCT component) AS components, count(DISTINCT reason) AS reasons FROM experiences""")
def statistics(spark, sf_dir):
    return M.statistics(T.experiences(spark, sf_dir))


@query("agg33_type_distribution", "SELECT anomaly_type, count(*) AS n FROM experiences GROUP BY ALL")
def type_distribution(spark, sf_dir):
    return M.type_distribution(T.experiences(spark, sf_dir))


cte("rules", """
WITH k AS (SELECT component, anomaly_type, count(*) FILTER (success) AS ok, count(*) AS sample_count FROM experiences GROUP BY ALL HAVING count(*) FILTER (success) > 0),
r AS (SELECT component, anomaly_type, arg_min(reason, (-n, reason)) AS reason FROM (SELECT component, anomaly_type, reason, count(*) AS n FROM experiences WHERE success GROUP BY ALL) GROUP BY ALL),
c AS (SELECT component, anomaly_type, feature, sum(weight) AS s FROM patterns WHERE success GROUP BY ALL)
SELECT component, anomaly_type, reason, feature, round(s / ok, 4)::DOUBLE AS weight, sample_count, ok / sample_count AS rate, ok / sample_count * least(1, sample_count / 5) AS conf
FROM k JOIN r USING (component, anomaly_type) JOIN c USING (component, anomaly_type) WHERE ok / sample_count * least(1, sample_count / 5) >= 0.7""")


def rules(spark, sf_dir):
    return M.distil_rules(T.experiences(spark, sf_dir))


@query("agg34_rule_distillation", """
SELECT component, anomaly_type, any_value(reason) AS reason, string_agg(feature || '=' || round(weight * 10000)::BIGINT, ',' ORDER BY feature) AS centroid, any_value(sample_count) AS sample_count,
  round(any_value(rate), 4)::DOUBLE AS success_rate, round(any_value(conf), 4)::DOUBLE AS confidence FROM rules GROUP BY component, anomaly_type""".replace("round(weight * 10000)", "floor(weight * 10000 + 0.5)"))
def distil_rules(spark, sf_dir):
    text = F.transform(F.array_sort(F.map_entries("pattern")), lambda e: F.concat(
        e["key"], F.lit("="), F.floor(e["value"] * 10000 + 0.5).cast("string")))
    return rules(spark, sf_dir).withColumn("centroid", F.array_join(text, ",")).drop("pattern")


@query("mem2_best_rule", """
WITH rn AS (SELECT component, anomaly_type, sqrt(sum(weight * weight)) AS n FROM rules GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(weight * weight)) AS n FROM case_queries GROUP BY ALL),
s AS (SELECT q.query_id, r.component, r.anomaly_type, any_value(r.reason) AS reason, round(any_value(round(conf, 4)) * sum(q.weight * r.weight) / greatest(any_value(qn.n) * any_value(rn.n), 1e-300), 6)::DOUBLE AS score
  FROM case_queries q JOIN rules r ON r.anomaly_type = q.anomaly_type AND r.feature = q.feature JOIN rn ON rn.component = r.component AND rn.anomaly_type = r.anomaly_type
  JOIN qn ON qn.query_id = q.query_id GROUP BY q.query_id, r.component, r.anomaly_type)
SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, component) = 1""")
def best_rule(spark, sf_dir):
    return M.best_rule(case_queries(spark, sf_dir), rules(spark, sf_dir))


@query("agg35_frequent_reasons", "SELECT reason, count(*) AS n FROM experiences WHERE success GROUP BY reason ORDER BY n DESC, reason LIMIT 10")
def frequent_reasons(spark, sf_dir):
    e = T.experiences(spark, sf_dir).select(F.when(F.col("success"), 1.0).otherwise(0.0).alias("score"), F.array("reason").alias("reasons"))
    return M.frequent_reasons(e)


# ------------------------------------------------------------------ case retrieval
_TOK = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 2))"
cte("case_tokens", f"SELECT DISTINCT conv_id AS case_id, unnest({_TOK}) AS t FROM conversations")
cte("item_tokens", f"SELECT DISTINCT item_id AS query_id, unnest({_TOK}) AS t FROM benchmark")


def _names(i):
    names = F.array(*[F.lit(c) for c in T.COMPONENTS])
    return F.get(names, (i % 6).cast("int"))


def case_memory(spark, sf_dir):
    c = T.cases(spark, sf_dir)
    i = F.col("case_id")
    return c.withColumn("dataset", F.concat(F.lit("d"), (i % 2).cast("string"))).withColumn("components", F.array(_names(i), _names(i + 1)))


def item_queries(spark, sf_dir):
    b = T.table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    return b.select(i.alias("query_id"), S.tokens(F.col("text")).alias("tokens"), F.concat(F.lit("d"), (i % 2).cast("string")).alias("dataset"),
                    F.array(_names(i)).alias("components"))


@query("mem3_case_retrieval", """
WITH q AS (SELECT item_id AS query_id, item_id % 2 AS d, item_id % 6 AS c FROM benchmark), k AS (SELECT DISTINCT conv_id AS case_id, conv_id % 2 AS d, conv_id % 6 AS c FROM conversations),
n AS (SELECT query_id, count(*) AS n FROM item_tokens GROUP BY ALL), o AS (SELECT query_id, case_id, count(*) AS o FROM item_tokens JOIN case_tokens USING (t) GROUP BY ALL),
s AS (SELECT q.query_id, k.case_id, round(coalesce(o, 0) / greatest(coalesce(n, 0), 1) + CASE WHEN q.d = k.d THEN 0.2 ELSE 0 END + 0.1 * CASE WHEN q.c = k.c OR q.c = (k.c + 1) % 6 THEN 1 ELSE 0 END, 6)::DOUBLE AS score
  FROM q JOIN k ON true LEFT JOIN n ON n.query_id = q.query_id LEFT JOIN o ON o.query_id = q.query_id AND o.case_id = k.case_id)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS INTEGER) AS rank FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) <= 3""")
def case_retrieval(spark, sf_dir):
    return M.retrieve_cases(item_queries(spark, sf_dir), case_memory(spark, sf_dir))


@query("mem4_case_recording", """
SELECT source, case_id, array_to_string(list_sort(list(t)), ' ') AS tokens, score FROM (SELECT case_id, t, CASE WHEN case_id % 4 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS score FROM case_tokens),
  (SELECT unnest(['cases', 'failures']) AS source) WHERE source = 'cases' OR score < 1 GROUP BY source, case_id, score""")
def case_recording(spark, sf_dir):
    def write(path):
        rows = T.cases(spark, sf_dir).withColumn("score", F.when(F.col("case_id") % 4 == 0, 0.5).otherwise(1.0))
        M.record_cases(rows, path)
    path = _folder(spark, sf_dir, "memory", write)
    schema = "case_id BIGINT, tokens ARRAY<STRING>, score DOUBLE"
    read = lambda name: spark.read.schema(schema).json(f"{path}/{name}").withColumn("source", F.lit(name))
    return read("cases").unionByName(read("failures")).withColumn("tokens", F.array_join("tokens", " "))


# ------------------------------------------------------------------ samplers
def trace_table(spark, sf_dir):
    """Traces of the incidents over the large spans: pattern, root and anomaly."""
    def build():
        from sonde.plans.queries_spans import incident_spans
        s = incident_spans(spark, sf_dir)
        score = stage(spark, sf_dir, "trace_scores", lambda: s.groupBy("incident_id", "component").agg(
            S.rounded(F.avg("duration") / 10, 4).alias("score")))
        return SP.trace_profiles(s, score).select(
            "incident_id", "trace_id", "eps", "pattern_id", "root", S.rounded(F.col("anomaly"), 4).alias("anomaly"))
    return stage(spark, sf_dir, "trace_table", build)


cte("trace_anomalies", """
WITH m AS (SELECT incident_id, component, round(avg(duration) / 10, 4)::DOUBLE AS score FROM inc_spans GROUP BY ALL),
p AS (SELECT incident_id, trace_id, component, count(*) FILTER (NOT success) AS f FROM inc_spans GROUP BY ALL)
SELECT incident_id, trace_id, round(sum(score) + 2.0 * sum(f), 4)::DOUBLE AS anomaly FROM p JOIN m USING (incident_id, component) GROUP BY ALL""")


@query("smp1_trace_anomaly", "SELECT t.incident_id, trace_id, anomaly, pattern_id, root FROM trace_anomalies t JOIN trace_patterns USING (incident_id, trace_id) JOIN trace_roots USING (incident_id, trace_id)")
def trace_anomaly(spark, sf_dir):
    return trace_table(spark, sf_dir).select("incident_id", "trace_id", "anomaly", "pattern_id", "root")


def chosen_traces(spark, sf_dir):
    return stage(spark, sf_dir, "chosen_traces", lambda: SM.diverse_traces(trace_table(spark, sf_dir)))


cte("trace_rows", """
SELECT incident_id, trace_id, root, pattern_id, eps, anomaly FROM trace_anomalies JOIN trace_roots USING (incident_id, trace_id) JOIN trace_patterns USING (incident_id, trace_id)
JOIN (SELECT incident_id, trace_id, list(e ORDER BY e) AS eps FROM trace_marks GROUP BY ALL) AS m USING (incident_id, trace_id)""", materialized=True)


def _greedy_sql(pool, keys):
    """Step by step: the best of the first 300 rows left of each group is taken, the others keep their largest overlap."""
    return f"""
WITH RECURSIVE g AS (
  SELECT {keys}, trace_id, eps, anomaly, budget, 0.0::DOUBLE AS nearest, 0 AS k, false AS taken FROM {pool}
  UNION ALL
  SELECT {keys}, trace_id, eps, anomaly, budget, greatest(nearest, CASE WHEN len(eps) + len(best_eps) = 0 THEN 1.0
    ELSE len(list_intersect(eps, best_eps)) / (len(eps) + len(best_eps) - len(list_intersect(eps, best_eps)))::DOUBLE END), k + 1, trace_id = best_id
  FROM (SELECT *, first_value(trace_id) OVER v AS best_id, first_value(eps) OVER v AS best_eps
        FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY anomaly DESC, trace_id) AS pos FROM g WHERE NOT taken AND k < budget)
        WINDOW v AS (PARTITION BY {keys} ORDER BY pos <= 300 DESC, anomaly + 1.0 - nearest DESC, pos)))
SELECT incident_id, trace_id FROM g WHERE taken"""


cte("first_pool", """
SELECT t.*, greatest(1, 160 // r) AS budget FROM trace_rows t JOIN (SELECT incident_id, count(DISTINCT root) AS r FROM trace_rows GROUP BY ALL) USING (incident_id)
QUALIFY row_number() OVER (PARTITION BY incident_id, root ORDER BY anomaly DESC, trace_id) <= 460""", materialized=True)
cte("first_traces", f"""
SELECT * FROM ({_greedy_sql("first_pool", "incident_id, root")}) JOIN trace_rows USING (incident_id, trace_id)
QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY root, anomaly DESC, trace_id) <= 160""", materialized=True)
cte("refill_pool", """
SELECT t.*, budget FROM trace_rows t JOIN (SELECT incident_id, 160 - count(f.trace_id) AS budget FROM trace_rows LEFT JOIN first_traces f USING (incident_id, trace_id) GROUP BY ALL) USING (incident_id)
ANTI JOIN first_traces f ON f.incident_id = t.incident_id AND f.trace_id = t.trace_id WHERE budget > 0
QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY anomaly DESC, t.trace_id) <= 460""", materialized=True)
cte("diverse", f"""
SELECT * FROM first_traces UNION ALL BY NAME SELECT * FROM ({_greedy_sql("refill_pool", "incident_id")}) JOIN trace_rows USING (incident_id, trace_id)""", materialized=True)


@query("smp2_diverse_traces", "SELECT incident_id, trace_id, root, pattern_id, anomaly FROM diverse")
def diverse_traces(spark, sf_dir):
    return SM.diverse_traces(trace_table(spark, sf_dir)).drop("eps")


@query("smp4_sampler_report", f"""
WITH i AS (SELECT incident_id, count(*) AS input_rows FROM inc_spans GROUP BY ALL), a AS (SELECT incident_id, count(DISTINCT pattern_id) AS patterns FROM trace_rows GROUP BY ALL),
g AS (SELECT incident_id, count(DISTINCT pattern_id) AS got, count(*) AS rows, avg((anomaly > 0)::INT) AS hot FROM diverse GROUP BY ALL),
p AS (SELECT incident_id, count(*) / sum(count(*)) OVER (PARTITION BY incident_id) AS p FROM diverse GROUP BY incident_id, pattern_id),
e AS (SELECT incident_id, -sum(p * log2(p + 1e-12)) AS entropy FROM p GROUP BY ALL),
t AS (SELECT incident_id, least(80, count(DISTINCT template)) AS tpl FROM inc_templates GROUP BY ALL)
SELECT i.incident_id, input_rows, coalesce(g.rows, 0) + coalesce(tpl, 0) AS sampled_rows, round(coalesce(got, 0) / greatest(coalesce(patterns, 0), 1), 6)::DOUBLE AS coverage,
  round(coalesce(entropy, 0), 6)::DOUBLE AS entropy, round(coalesce(hot, 0), 6)::DOUBLE AS anomaly_ratio
FROM i LEFT JOIN a USING (incident_id) LEFT JOIN g USING (incident_id) LEFT JOIN e USING (incident_id) LEFT JOIN t USING (incident_id)""")
def sampler_report(spark, sf_dir):
    from sonde.plans.queries_spans import incident_spans
    rows = incident_spans(spark, sf_dir).groupBy("incident_id").agg(F.count("*").alias("input_rows"))

    from sonde.operators.logs import template_sample

    return SM.sampler_report(trace_table(spark, sf_dir), chosen_traces(spark, sf_dir), template_sample(QR.template_counts(spark, sf_dir)), rows)


@query("agg31_pattern_entropy", """
WITH p AS (SELECT incident_id, pattern_id, count(*) AS n FROM trace_patterns GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY incident_id) AS p FROM p)
SELECT incident_id, round(-sum(p * log2(p + 1e-12)), 6)::DOUBLE AS entropy FROM s GROUP BY ALL""")
def pattern_entropy(spark, sf_dir):
    return SM.entropy(trace_table(spark, sf_dir)).withColumn("entropy", S.rounded(F.col("entropy"), 6))


cte("half_hours", """
SELECT row_id AS incident_id, ts - ts % 1800 AS start_ts, ts - ts % 1800 + 1800 AS end_ts FROM records""")


def half_hours(spark, sf_dir):
    return SM.half_hour_windows(T.records(spark, sf_dir).select(F.col("row_id").alias("incident_id"), "ts"))


cte("sampled_rows", """
SELECT h.incident_id, m.component, m.kpi, m.ts, m.value FROM raw_metrics m JOIN half_hours h ON m.ts BETWEEN h.start_ts AND h.end_ts""")


@query("agg32_first_sample", """
SELECT component, kpi, ts // 600 AS slot, arg_min(value, (ts, value)) AS value FROM raw_metrics GROUP BY ALL""")
def first_sample(spark, sf_dir):
    return SM.first_per_interval(T.raw_metrics(spark, sf_dir), ["component", "kpi"], ["value"], 600, ("value",))


@query("smp5_balanced_kpis", """
WITH n AS (SELECT DISTINCT incident_id, kpi FROM sampled_rows),
d AS (SELECT incident_id, kpi FROM n QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY md5('42:' || incident_id || ':' || kpi), kpi) <= 2)
SELECT incident_id, component, kpi, ts // 60 AS slot, round(arg_min(value, (ts, value)), 2)::DOUBLE AS value FROM sampled_rows JOIN d USING (incident_id, kpi) GROUP BY incident_id, component, kpi, ts // 60""")
def balanced_kpis(spark, sf_dir):
    return SM.balanced_kpis(T.raw_metrics(spark, sf_dir), half_hours(spark, sf_dir), 2)


#: KPIs of the tables under the names one system has for them; the last is in no fixed list.
SYSTEM_NAMES = {"cpu_used_percent": "container_cpu_used", "mem_used_percent": "Memory_used_pct", "disk_read_bytes": "Disk_io_util",
                "network_latency_ms": "Sent_queue", "packet_loss_rate": "Dropped_frames"}


@query("smp6_fixed_kpis", f"""
WITH n AS (SELECT incident_id, component, CASE kpi {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in SYSTEM_NAMES.items())} END AS kpi, ts, value FROM sampled_rows)
SELECT incident_id, component, kpi, ts // 60 AS slot, round(arg_min(value, (ts, value)), 2)::DOUBLE AS value FROM n
WHERE kpi IN ('Proc_Used_Pct', 'Sess_Connect', 'Proc_User_Used_Pct', 'On_Off_State', 'tnsping_result_time', 'container_cpu_used', 'Memory_used_pct',
  'Disk_io_util', 'Sent_queue', 'Received_queue') GROUP BY incident_id, component, kpi, ts // 60""")
def fixed_kpis(spark, sf_dir):
    named = T.raw_metrics(spark, sf_dir).replace(SYSTEM_NAMES, subset=["kpi"])
    return SM.fixed_kpis(named, half_hours(spark, sf_dir), "telecom")


@query("smp5_sampled_traces", """
WITH r AS (SELECT h.incident_id, s.* FROM event_spans s JOIN half_hours h ON s.ts BETWEEN h.start_ts AND h.end_ts),
f AS (SELECT DISTINCT incident_id, arg_min(trace_id, (ts, span_id)) AS trace_id FROM r GROUP BY incident_id, ts // 60)
SELECT incident_id, trace_id, span_id, component, duration FROM r WHERE (incident_id, trace_id) IN (SELECT (incident_id, trace_id) FROM f)""")
def sampled_traces(spark, sf_dir):
    return SM.sampled_traces(T.event_spans(spark, sf_dir), half_hours(spark, sf_dir)).select(
        "incident_id", "trace_id", "span_id", "component", "duration")


@query("smp5_sampled_logs", """
SELECT h.incident_id, CAST(floor(l.ts / 12.0) AS BIGINT) AS slot, arg_min(value, (l.ts, log_id)) AS value FROM logs l JOIN half_hours h ON l.ts BETWEEN h.start_ts AND h.end_ts
GROUP BY h.incident_id, CAST(floor(l.ts / 12.0) AS BIGINT)""")
def sampled_logs(spark, sf_dir):
    return SM.sampled_logs(T.logs(spark, sf_dir), half_hours(spark, sf_dir))
