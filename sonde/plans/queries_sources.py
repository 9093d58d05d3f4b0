"""Registered queries: sources, normalisation, scalar rules, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.functions import fixed as V
from sonde.functions import scalars as S
from sonde.operators import tasks as TK
from sonde.plans.registry import cte, query, sql_any, sql_case, sql_list
from sonde.plans.stages import shared_folder
from sonde.sources import tables as T
from sonde.sources import telemetry as TM

_FOLDERS: dict = {}


def _folder(spark, sf_dir, name, write):
    """A folder with files derived from the tables, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _FOLDERS:
        path = f"{shared_folder(spark)}/files-{len(_FOLDERS)}-{name}"
        write(path)
        _FOLDERS[key] = path
    return _FOLDERS[key]


def _raw_text(spark, sf_dir):
    """Events as a metric file would hold them: text, half of the times in milliseconds."""
    m = T.raw_metrics(spark, sf_dir)
    late = m["ts"] % 2 == 1
    return m.select(
        F.when(late, m["ts"] * 1000).otherwise(m["ts"]).cast("string").alias("timestamp"),
        m["component"].alias("cmdb_id"), m["kpi"].alias("kpi_name"),
        F.when(m["ts"] % 7 == 0, F.lit("n/a")).otherwise(m["value"].cast("string")).alias("value"))


cte("raw_text", """
SELECT CAST(CASE WHEN ts % 2 = 1 THEN ts * 1000 ELSE ts END AS VARCHAR) AS timestamp,
       component AS cmdb_id, kpi AS kpi_name,
       CASE WHEN ts % 7 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value
FROM raw_metrics""")
cte("clean_text", """
SELECT cmdb_id AS component, kpi_name AS kpi,
       CAST(CASE WHEN abs(CAST(timestamp AS BIGINT)) >= 10000000000
            THEN CAST(timestamp AS BIGINT) // 1000 ELSE CAST(timestamp AS BIGINT) END AS BIGINT) AS ts,
       TRY_CAST(value AS DOUBLE) AS value
FROM raw_text WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL""")


@query("src1_csv_scan", """
SELECT component, kpi, ts, value, 'd1' AS day, 'metric_container' AS file_name FROM clean_text""")
def csv_scan(spark, sf_dir):
    def write(path):
        _raw_text(spark, sf_dir).write.option("header", True).csv(
            f"{path}/telemetry/d1/metric/metric_container.csv")
    root = _folder(spark, sf_dir, "bank", write)
    return TM.read_metrics(spark, root, "bank", files=["metric_container"])


@query("src2_window_scan", """
SELECT i.incident_id, m.component, m.kpi, m.ts, m.value
FROM raw_metrics m JOIN incidents i ON m.ts BETWEEN i.start_ts AND i.end_ts""")
def window_scan(spark, sf_dir):
    from sonde.operators.windows import window_join
    path = _folder(spark, sf_dir, "parquet", lambda p: TM.write_telemetry(
        T.raw_metrics(spark, sf_dir), p))
    # the days of the incident windows prune partitions, their times prune row groups
    rows = spark.read.parquet(path).withColumn("day", F.col("day").cast("bigint"))
    incidents = T.incidents(spark, sf_dir)
    # sorted files are small for their rows: by their size Spark would broadcast the rows, not the days
    return window_join(TM.scan_windows(rows, incidents), F.broadcast(incidents)).select(
        "incident_id", "component", "kpi", "ts", "value")


@query("src3_labels_tasks_scan", """
SELECT CAST(row_id AS VARCHAR) AS row_id, component, reason, CAST(ts AS VARCHAR) AS timestamp,
       'line one' || chr(10) || 'said "' || reason || '"' AS instruction FROM records""")
def labels_scan(spark, sf_dir):
    def write(path):
        r = T.records(spark, sf_dir)
        r.select("row_id", "component", "reason", r["ts"].alias("timestamp"), F.concat(
            F.lit('line one\nsaid "'), "reason", F.lit('"')).alias("instruction")
        ).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return TM.scan_table(spark, _folder(spark, sf_dir, "labels", write))


@query("src4_day_partitions", "SELECT DISTINCT day FROM raw_metrics")
def day_partitions(spark, sf_dir):
    return T.raw_metrics(spark, sf_dir).select("day").distinct().orderBy("day")


@query("src5_epoch_normalise", """
SELECT timestamp AS raw, CASE WHEN abs(CAST(timestamp AS BIGINT)) >= 10000000000
       THEN CAST(timestamp AS BIGINT) // 1000 ELSE CAST(timestamp AS BIGINT) END AS ts
FROM raw_text""")
def epoch_normalise(spark, sf_dir):
    return _raw_text(spark, sf_dir).select(
        F.col("timestamp").alias("raw"), S.normalise_epoch(F.col("timestamp")).alias("ts"))


@query("src6_numeric_coercion", "SELECT component, kpi, ts, value FROM clean_text")
def numeric_coercion(spark, sf_dir):
    return TM.coerce(_raw_text(spark, sf_dir).select(
        F.col("cmdb_id").alias("component"), F.col("kpi_name").alias("kpi"),
        F.col("timestamp").alias("ts"), "value"))


@query("src7_unify_long_files", """
SELECT component, kpi, ts, value, CASE WHEN component = 'node-1' THEN 'metric_node'
       ELSE 'metric_container' END AS file_name FROM clean_text""")
def unify_long(spark, sf_dir):
    def write(path):
        raw = _raw_text(spark, sf_dir).select(
            F.lit("i").alias("itemid"), F.col("kpi_name").alias("name"), F.lit("b").alias("bomc_id"),
            "timestamp", "value", "cmdb_id")
        for file, rows in (("metric_node", raw.filter("cmdb_id = 'node-1'")),
                           ("metric_container", raw.filter("cmdb_id <> 'node-1'"))):
            rows.write.option("header", True).csv(f"{path}/telemetry/d1/metric/{file}.csv")
    root = _folder(spark, sf_dir, "telecom", write)
    return TM.read_metrics(spark, root, "telecom", files=["metric_container", "metric_node"]).drop("day")


def _hourly(spark, sf_dir):
    m = T.raw_metrics(spark, sf_dir)
    return m.groupBy("component", (F.floor(m["ts"] / 3600) * 3600).alias("hour")).agg(
        F.count_if(m["kpi"] == "cpu_used_percent").alias("rr"),
        F.count_if(m["kpi"] == "packet_loss_rate").alias("sr"),
        F.count("*").alias("cnt"), S.rounded(F.avg("value"), 6).alias("mrt"))


cte("hourly", """
SELECT component, ts // 3600 * 3600 AS hour, count(*) FILTER (kpi = 'cpu_used_percent') AS rr,
       count(*) FILTER (kpi = 'packet_loss_rate') AS sr, count(*) AS cnt,
       round(avg(value), 6) AS mrt
FROM raw_metrics GROUP BY ALL""")
_HOURLY_LONG = """
SELECT component, hour AS ts, kpi, value FROM (
  SELECT component, hour, unnest(['rr', 'sr', 'cnt', 'mrt']) AS kpi,
         unnest([CAST(rr AS DOUBLE), CAST(sr AS DOUBLE), CAST(cnt AS DOUBLE), mrt]) AS value
  FROM hourly)"""


@query("src8_unpivot_fixed", _HOURLY_LONG)
def unpivot_fixed(spark, sf_dir):
    wide = _hourly(spark, sf_dir).select(
        F.lit("d1").alias("day"), F.lit("metric_app").alias("file_name"),
        F.col("hour").alias("timestamp"), F.col("component").alias("tc"), "rr", "sr", "cnt", "mrt")
    return TM.coerce(TM.wide_metrics(wide, "timestamp", "tc", V.METRIC_LAYOUTS["bank"]["metric_app"][2])
                     ).select("component", "ts", "kpi", "value")


@query("src9_unpivot_discovered", _HOURLY_LONG)
def unpivot_discovered(spark, sf_dir):
    wide = _hourly(spark, sf_dir).select(
        F.lit("d1").alias("day"), F.lit("metric_app").alias("file_name"),
        F.col("hour").alias("startTime"), F.col("component").alias("service"),
        F.lit("7").alias("itemid"), F.lit("words only").alias("note"), "rr", "sr", "cnt", "mrt")
    return TM.any_metrics(wide).select("component", "ts", "kpi", "value")


@query("src10_component_from_file", """
SELECT kpi, regexp_replace(replace('metric_' || component || '.csv', 'metric_', ''), '\\.csv$', '') AS component,
       count(*) AS n FROM raw_metrics GROUP BY ALL""")
def component_of_file(spark, sf_dir):
    m = T.raw_metrics(spark, sf_dir).withColumn(
        "file_name", F.concat(F.lit("metric_"), "component", F.lit(".csv")))
    return (m.select("kpi", TM.component_from_file(F.col("file_name")).alias("component"))
            .groupBy("kpi", "component").agg(F.count("*").alias("n")))


cte("span_text", """
SELECT CAST(trace_id AS VARCHAR) AS trace_id, CAST(span_id AS VARCHAR) AS span_id,
       CAST(parent_id AS VARCHAR) AS parent_id, component, ts, duration, success FROM event_spans""")


@query("src11_span_layouts", """
SELECT layout, trace_id, span_id, parent_id, component, ts, duration,
       CASE WHEN layout = 'telecom' THEN success END AS success
FROM span_text, (SELECT unnest(['bank', 'telecom', 'market']) AS layout)""")
def span_layouts(spark, sf_dir):
    e = T.event_spans(spark, sf_dir)
    text = {c: F.col(c).cast("string") for c in ("trace_id", "span_id", "parent_id")}
    bank = e.select((e["ts"] * 1000).alias("timestamp"), e["component"].alias("cmdb_id"),
                    text["parent_id"].alias("parent_id"), text["span_id"].alias("span_id"),
                    text["trace_id"].alias("trace_id"), "duration")
    telecom = e.select((e["ts"] * 1000).alias("startTime"), e["duration"].alias("elapsedTime"),
                       F.when(e["success"], "True").otherwise("FALSE").alias("success"),
                       text["trace_id"].alias("traceId"), text["span_id"].alias("id"),
                       F.coalesce(text["parent_id"], F.lit("None")).alias("pid"),
                       e["component"].alias("cmdb_id"))
    market = e.select((e["ts"] * 1000).alias("timestamp"), e["component"].alias("cmdb_id"),
                      text["span_id"].alias("span_id"), text["trace_id"].alias("trace_id"),
                      "duration", text["parent_id"].alias("parent_span"))
    out = None
    for name, df in (("bank", bank), ("telecom", telecom), ("market", market)):
        part = TM.unify_spans(df).withColumn("layout", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.drop("ds_name", "service_name")


@query("src12_json_append_read", """
SELECT row_id, component, reason, list_aggregate([component, reason], 'string_agg', '|') AS words
FROM records""")
def json_append(spark, sf_dir):
    def write(path):
        r = T.records(spark, sf_dir).withColumn("words", F.array("component", "reason"))
        TM.append_json(r.filter("row_id % 2 = 0"), path)
        TM.append_json(r.filter("row_id % 2 = 1"), path)
    path = _folder(spark, sf_dir, "cases", write)
    schema = "row_id BIGINT, component STRING, reason STRING, ts BIGINT, words ARRAY<STRING>"
    return spark.read.schema(schema).json(path).select(
        "row_id", "component", "reason", F.array_join("words", "|").alias("words"))


@query("src13_case_files", "SELECT CAST(incident_id AS BIGINT) AS case_id, start_ts, end_ts FROM incidents")
def case_files(spark, sf_dir):
    path = _folder(spark, sf_dir, "case-files", lambda p: TM.write_case_files(T.incidents(spark, sf_dir).withColumnRenamed("incident_id", "case_id"), p))
    return spark.read.schema("case_id BIGINT, start_ts BIGINT, end_ts BIGINT").json(path)


def short_incidents(spark, sf_dir):
    """The one-hour windows of all days."""
    hours = T.incidents(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(23).cast("bigint"))).alias("h"))
    start = F.col("start_ts") + 3600 * F.col("h")
    return hours.select((F.col("incident_id") * 24 + F.col("h")).alias("incident_id"), start.alias("start_ts"), (start + 3599).alias("end_ts"))


cte("short_incidents", """
SELECT incident_id * 24 + h AS incident_id, start_ts + 3600 * h AS start_ts, start_ts + 3600 * h + 3599 AS end_ts FROM incidents, unnest(range(24)) AS u(h)""")


def day_files(spark, sf_dir):
    """Files that hold the telemetry of a day: one for each KPI, one of spans, one of logs."""
    day = F.floor(F.col("ts") / 86400).cast("bigint").alias("day")
    kind = lambda df, name, file: df.select(day, F.lit(name).alias("kind"), file.alias("file_name")).distinct()
    return kind(T.raw_metrics(spark, sf_dir), "metric", F.col("kpi")).unionByName(
        kind(T.event_spans(spark, sf_dir), "trace", F.lit("trace_span"))).unionByName(kind(T.logs(spark, sf_dir), "log", F.lit("log_service")))


@query("src14_data_quality", """
WITH series AS (
  SELECT i.incident_id, m.component, m.kpi,
         max(CASE WHEN m.ts BETWEEN i.start_ts AND i.end_ts THEN 1 ELSE 0 END) AS hit
  FROM metrics m JOIN short_incidents i ON m.day = i.start_ts // 86400 GROUP BY ALL),
s AS (SELECT incident_id, count(*) AS metric_series, sum(hit) AS in_window FROM series GROUP BY ALL),
t AS (SELECT i.incident_id, count(*) AS n FROM event_spans e JOIN short_incidents i
      ON e.ts BETWEEN i.start_ts AND i.end_ts GROUP BY ALL),
l AS (SELECT i.incident_id, count(*) AS n FROM logs e JOIN short_incidents i
      ON e.ts BETWEEN i.start_ts AND i.end_ts GROUP BY ALL),
f AS (SELECT day, count(DISTINCT kpi) AS n FROM raw_metrics GROUP BY day),
tf AS (SELECT DISTINCT ts // 86400 AS day FROM event_spans), lf AS (SELECT DISTINCT ts // 86400 AS day FROM logs)
SELECT i.incident_id, coalesce(f.n, 0) AS metric_files, (tf.day IS NOT NULL)::BIGINT AS trace_files, (lf.day IS NOT NULL)::BIGINT AS log_files, coalesce(metric_series, 0) AS metric_series,
       CAST(coalesce(in_window, 0) AS BIGINT) AS series_with_window_rows,
       coalesce(t.n, 0) AS trace_rows, coalesce(l.n, 0) AS log_rows,
       round((CASE WHEN coalesce(f.n, 0) > 0 THEN 0.35 ELSE 0 END) + (CASE WHEN coalesce(metric_series, 0) > 0 THEN 0.35 ELSE 0 END)
           + (CASE WHEN coalesce(in_window, 0) > 0 THEN 0.15 ELSE 0 END)
           + (CASE WHEN tf.day IS NOT NULL THEN 0.1 ELSE 0 END)
           + (CASE WHEN lf.day IS NOT NULL THEN 0.05 ELSE 0 END), 4) + 0.0 AS quality
FROM short_incidents i LEFT JOIN s USING (incident_id) LEFT JOIN t USING (incident_id)
LEFT JOIN l USING (incident_id) LEFT JOIN f ON f.day = i.start_ts // 86400 LEFT JOIN tf ON tf.day = i.start_ts // 86400
LEFT JOIN lf ON lf.day = i.start_ts // 86400""".replace(" AS quality", "::DOUBLE AS quality"))
def data_quality(spark, sf_dir):
    from sonde.operators.stats import data_quality as profile
    return profile(short_incidents(spark, sf_dir), T.raw_metrics(spark, sf_dir),
                   T.event_spans(spark, sf_dir), T.logs(spark, sf_dir), day_files(spark, sf_dir))


_TYPE_ORDER = "CASE ctype WHEN 'db' THEN 0 WHEN 'redis' THEN 1 WHEN 'service' THEN 2 WHEN 'middleware' THEN 3 ELSE 5 END"
cte("component_types", """
SELECT DISTINCT component, CASE
  WHEN starts_with(lower(component), 'os_') OR starts_with(lower(component), 'node-')
       OR lower(component) IN ('host', 'node') THEN 'node'
  WHEN contains(lower(component), 'mysql') OR starts_with(lower(component), 'db') THEN 'db'
  WHEN contains(lower(component), 'redis') THEN 'redis'
  WHEN starts_with(lower(component), 'docker_') OR regexp_matches(lower(component), '-[0-9]+$')
       OR contains(lower(component), '.') THEN 'pod'
  WHEN """ + sql_any("lower(component)", ("tomcat", "apache", "service", "frontend", "cart", "checkout"))
    + """ THEN 'service'
  WHEN starts_with(lower(component), 'mg') OR starts_with(lower(component), 'ig')
       OR """ + sql_any("lower(component)", ("middleware", "gateway")) + """ THEN 'middleware'
  ELSE 'service' END AS ctype
FROM (SELECT component FROM raw_metrics UNION ALL SELECT DISTINCT source FROM documents)""")


@query("src15_component_coverage", f"""
WITH full_day AS (SELECT DISTINCT i.incident_id, m.component FROM raw_metrics m
                  JOIN short_incidents i ON m.day = i.start_ts // 86400),
win AS (SELECT DISTINCT i.incident_id, m.component FROM raw_metrics m
        JOIN short_incidents i ON m.ts BETWEEN i.start_ts AND i.end_ts),
gone AS (SELECT incident_id, component, ctype FROM full_day JOIN component_types USING (component)
         WHERE (incident_id, component) NOT IN (SELECT (incident_id, component) FROM win))
SELECT i.incident_id, (SELECT count(*) FROM full_day f WHERE f.incident_id = i.incident_id) AS day_components,
       (SELECT count(*) FROM win w WHERE w.incident_id = i.incident_id) AS window_components,
       coalesce((SELECT string_agg(component, ',' ORDER BY {_TYPE_ORDER}, component) FROM gone g
                 WHERE g.incident_id = i.incident_id), '') AS only_in_day
FROM short_incidents i""")
def component_coverage(spark, sf_dir):
    from sonde.operators.stats import component_coverage as coverage
    return coverage(short_incidents(spark, sf_dir), T.raw_metrics(spark, sf_dir))


@query("src16_mean_per_timestamp", "SELECT component, kpi, day, ts, round(value, 6) AS value FROM metrics")
def mean_per_timestamp(spark, sf_dir):
    df = TM.mean_per_timestamp(T.raw_metrics(spark, sf_dir), ["component", "kpi", "day"])
    return df.withColumn("value", S.rounded(F.col("value"), 6))


# ------------------------------------------------------------------ scalar rules
@query("scl4_window_expansion", """
SELECT incident_id, start_ts - 10 * 60 AS start_ts, end_ts FROM incidents""")
def window_expansion(spark, sf_dir):
    from sonde.operators.windows import expand_window
    return expand_window(T.incidents(spark, sf_dir), minutes=10)


@query("scl5_local_time", """
SELECT row_id, strftime(make_timestamp((ts + 28800) * 1000000), '%Y-%m-%d %H:%M:%S') AS local_time,
       strftime(make_timestamp((ts + 28800) * 1000000), '%Y_%m_%d') AS local_day FROM records""")
def local_time(spark, sf_dir):
    return T.records(spark, sf_dir).select(
        "row_id", S.local_time(F.col("ts")).alias("local_time"), S.local_day(F.col("ts")).alias("local_day"))


@query("scl6_half_hour_label", """
SELECT row_id, strftime(make_timestamp((ts - ts % 1800 + 28800) * 1000000), '%Y-%m-%d %H:%M:%S') || ' to '
  || strftime(make_timestamp((ts - ts % 1800 + 1800 + 28800) * 1000000), '%Y-%m-%d %H:%M:%S') AS period
FROM records""")
def half_hour_label(spark, sf_dir):
    return T.records(spark, sf_dir).select("row_id", S.half_hour_label(F.col("ts")).alias("period"))


def instructions(spark, sf_dir):
    """Task texts over the failure records: a date, two clocks, a failure count, target words."""
    r = T.records(spark, sf_dir)
    slot = S.half_hour(F.col("ts"))
    per = r.groupBy(slot.alias("slot")).agg(F.count("*").alias("num"))
    day = S._naive(F.col("slot") + V.LOCAL_OFFSET_SECONDS)
    end = F.substring(S.local_time(F.col("slot") + V.HALF_HOUR), 12, 5)
    begin = F.substring(S.local_time(F.col("slot")), 12, 5)
    count = (F.when(F.col("num") == 1, "a single failure was detected")
             .when(F.col("row_id") % 4 == 0, F.concat(F.lit("the number of failures is "), F.col("num").cast("string")))
             .when(F.col("row_id") % 4 == 1, F.concat(F.lit("with "), F.col("num").cast("string"), F.lit(" failures reported")))
             .when(F.col("row_id") % 4 == 2, "where two failures hit").otherwise("with multiple problems"))
    ask = (F.when(F.col("row_id") % 3 == 0, "Identify the root cause component.")
           .when(F.col("row_id") % 3 == 1, "Why did it fail, and what is the occurrence datetime?")
           .otherwise("Diagnose it."))
    index = F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("task_"), (F.col("row_id") % 7 + 1).cast("string"))
                   ).otherwise("custom")
    return (r.withColumn("slot", slot).join(per, "slot").select(
        "row_id", index.alias("task_index"), F.col("slot"),
        F.concat(F.lit("On "), F.date_format(day, "MMMM d, yyyy"), F.lit(",\n from "), begin, F.lit(" to "),
                 end, F.lit(", "), count, F.lit(". "), ask).alias("instruction")))


cte("instructions", """
WITH r AS (SELECT *, ts - ts % 1800 AS slot FROM records),
p AS (SELECT slot, count(*) AS num FROM r GROUP BY ALL)
SELECT row_id, slot,
  CASE WHEN row_id % 2 = 0 THEN 'task_' || CAST(row_id % 7 + 1 AS VARCHAR) ELSE 'custom' END AS task_index,
  'On ' || strftime(make_timestamp((slot + 28800) * 1000000), '%B %-d, %Y') || ',' || chr(10) || ' from '
  || strftime(make_timestamp((slot + 28800) * 1000000), '%H:%M') || ' to '
  || strftime(make_timestamp((slot + 30600) * 1000000), '%H:%M') || ', '
  || CASE WHEN num = 1 THEN 'a single failure was detected'
          WHEN row_id % 4 = 0 THEN 'the number of failures is ' || CAST(num AS VARCHAR)
          WHEN row_id % 4 = 1 THEN 'with ' || CAST(num AS VARCHAR) || ' failures reported'
          WHEN row_id % 4 = 2 THEN 'where two failures hit' ELSE 'with multiple problems' END || '. '
  || CASE row_id % 3 WHEN 0 THEN 'Identify the root cause component.'
          WHEN 1 THEN 'Why did it fail, and what is the occurrence datetime?' ELSE 'Diagnose it.' END AS instruction
FROM r JOIN p USING (slot)""")


@query("scl7_instruction_window", """
SELECT row_id, instruction, slot AS start_ts, slot + 1800 AS end_ts FROM instructions""")
def instruction_window(spark, sf_dir):
    return TK.parse_window(instructions(spark, sf_dir)).select("row_id", "instruction", "start_ts", "end_ts")


@query("scl8_target_fields", """
WITH x AS (SELECT row_id, task_index, lower(instruction) AS low FROM instructions),
f AS (SELECT row_id, CASE task_index
 """ + " ".join(f"WHEN '{k}' THEN '{'|'.join(v)}'" for k, v in V.TASK_FIELDS.items()) + """ END AS fixed_fields,
 concat_ws('|', CASE WHEN contains(low, 'time') OR contains(low, 'occurrence') THEN 'root cause occurrence datetime' END,
  CASE WHEN contains(low, 'component') THEN 'root cause component' END,
  CASE WHEN contains(low, 'reason') OR contains(low, 'why') THEN 'root cause reason' END) AS by_word FROM x)
SELECT row_id, coalesce(fixed_fields, nullif(by_word, ''),
  'root cause occurrence datetime|root cause component|root cause reason') AS target_fields FROM f""")
def target_fields(spark, sf_dir):
    return TK.target_fields(instructions(spark, sf_dir)).select(
        "row_id", F.array_join("target_fields", "|").alias("target_fields"))


@query("scl9_failure_count", r"""
WITH x AS (SELECT row_id, lower(instruction) AS low FROM instructions)
SELECT row_id, CAST(CASE WHEN contains(low, 'single failure') THEN 1
  WHEN regexp_matches(low, '(number of failures is |with )\d+') THEN
   greatest(1, least(3, CAST(regexp_extract(low, '(number of failures is |with )(\d+)', 2) AS INT)))
  WHEN contains(low, 'two failures') THEN 2 WHEN contains(low, 'multiple') THEN 3 ELSE 1 END AS INTEGER) AS failure_count
FROM x""")
def failure_count(spark, sf_dir):
    return TK.failure_count(instructions(spark, sf_dir)).select("row_id", "failure_count")


def _component_names(spark, sf_dir):
    return (T.raw_metrics(spark, sf_dir).select("component").distinct()
            .unionByName(T.table(spark, sf_dir, "documents").select(F.col("source").alias("component")).distinct()))


@query("scl10_component_type", "SELECT component, ctype AS component_type FROM component_types")
def component_type(spark, sf_dir):
    return _component_names(spark, sf_dir).distinct().select(
        "component", S.component_type(F.col("component")).alias("component_type"))


_VARIANTS = ("{c}", "{c}.node-9", "x.{c}.y", "{c}.source", "{c}:8080", "zone/{c}/a")


@query("scl11_component_normalise", """
SELECT raw, CASE WHEN raw = 'checkout' THEN 'checkout-4' ELSE component END AS component, n FROM (
  SELECT component, count(*) AS n, unnest([component, component || '.node-9', 'x.' || component || '.y',
         component || '.source', component || ':8080', 'zone/' || component || '/a',
         replace(component, '-4', '')]) AS raw
  FROM raw_metrics GROUP BY component)""")
def component_normalise(spark, sf_dir):
    c = F.col("component")
    raws = F.array(c, F.concat(c, F.lit(".node-9")), F.concat(F.lit("x."), c, F.lit(".y")),
                   F.concat(c, F.lit(".source")), F.concat(c, F.lit(":8080")),
                   F.concat(F.lit("zone/"), c, F.lit("/a")), F.replace(c, F.lit("-4"), F.lit("")))
    counted = T.raw_metrics(spark, sf_dir).groupBy("component").agg(F.count("*").alias("n"))
    return (counted.select(F.explode(raws).alias("raw"), "n")
            .select("raw", S.normalise_component(F.col("raw"), T.COMPONENTS).alias("component"), "n"))


def _kpis(spark, sf_dir):
    return T.raw_metrics(spark, sf_dir).groupBy("kpi").agg(F.count("*").alias("n"))


@query("scl12_low_sensitive", f"""
SELECT kpi, count(*) AS n, {sql_any("kpi", V.LOW_SENSITIVE_WORDS)} AS low_sensitive FROM raw_metrics GROUP BY kpi""")
def low_sensitive(spark, sf_dir):
    return _kpis(spark, sf_dir).withColumn("low_sensitive", S.is_low_sensitive(F.col("kpi")))


def hint_sql(text, rules, candidates=T.REASONS):
    chain = []
    for words, reasons in rules:
        allowed = [r for r in reasons if r in candidates]
        if allowed:
            chain.append((sql_any(text, words), f"'{allowed[0]}'"))
    return sql_case(chain, "NULL")


@query("scl13_reason_hint", f"""
SELECT kpi, n, {hint_sql("lower(kpi || ' metric_container.csv')", V.REASON_HINT_RULES)} AS hint,
  {hint_sql("lower(kpi || ' metric_container.csv')", V.REASON_HINT_RULES_SHORT)} AS hint_short
FROM (SELECT kpi, count(*) AS n FROM raw_metrics GROUP BY kpi UNION ALL
      SELECT reason, count(*) FROM records GROUP BY reason)""")
def reason_hints(spark, sf_dir):
    names = _kpis(spark, sf_dir).unionByName(
        T.records(spark, sf_dir).groupBy(F.col("reason").alias("kpi")).agg(F.count("*").alias("n")))
    text = F.concat("kpi", F.lit(" "), F.lit(T.METRIC_FILE))
    return (names.withColumn("hint", S.reason_hint(text, T.REASONS))
            .withColumn("hint_short", S.reason_hint(text, T.REASONS, V.REASON_HINT_RULES_SHORT)))


_STEADY = "(q50 >= 85 AND q95 >= 88)"


def saturation_sql(kpi="kpi", value="value", q50="q50", q95="q95"):
    pct = sql_any(kpi, V.PERCENT_WORDS)
    mem = f"({sql_any(kpi, V.MEMORY_WORDS)} AND {pct})"
    cpu = f"(contains({kpi}, 'cpu') AND {pct})"
    free = sql_any(kpi, V.FREE_WORDS)
    steady = f"({q50} >= 85 AND {q95} >= 88)"
    v = value
    return sql_case([
        (f"{free} AND {pct} AND {v} <= 10", f"least(1.0::DOUBLE, 0.25 + (10 - {v}) / 12.0)"),
        (free, "0.0::DOUBLE"),
        (f"{mem} AND {v} >= 95", f"least(1.0::DOUBLE, 0.5 + ({v} - 95) / 10.0)"),
        (f"{mem} AND {v} >= 88 AND NOT {steady}", f"least(1.0::DOUBLE, 0.25 + ({v} - 88) / 12.0)"),
        (f"{mem} AND {v} >= 90 AND {steady}", f"least(0.8::DOUBLE, 0.2 + ({v} - 90) / 15.0)"),
        (f"{cpu} AND {v} >= 90", f"least(1.0::DOUBLE, 0.35 + ({v} - 90) / 10.0)"),
        (f"{cpu} AND {v} >= 85 AND NOT {steady}", f"least(1.0::DOUBLE, 0.2 + ({v} - 85) / 15.0)"),
        (f"{sql_any(kpi, V.BUSY_DISK_WORDS)} AND {v} >= 80", f"least(1.0::DOUBLE, 0.2 + ({v} - 80) / 20.0)"),
    ], "0.0::DOUBLE")


def saturation_open_sql(kpi="kpi", value="value", q50="q50", q95="q95"):
    pct = sql_any(kpi, V.PERCENT_WORDS_NARROW)
    free = sql_any(kpi, V.FREE_WORDS)
    steady = f"({q50} >= 85 AND {q95} >= 88)"
    v = value
    return sql_case([
        (f"{free} AND {pct} AND {v} <= 10", f"least(3.0::DOUBLE, 0.75 + (10 - {v}) / 4.0)"),
        (free, "0.0::DOUBLE"),
        (f"{sql_any(kpi, V.MEMORY_WORDS)} AND {pct} AND {v} >= 88 AND NOT {steady}",
         f"least(4.0::DOUBLE, 0.75 + ({v} - 88) / 4.0)"),
        (f"contains({kpi}, 'cpu') AND {pct} AND {v} >= 85 AND NOT {steady}",
         f"least(3.5::DOUBLE, 0.5 + ({v} - 85) / 5.0)"),
        (f"{sql_any(kpi, V.BUSY_DISK_WORDS)} AND {v} >= 80", f"least(3.0::DOUBLE, 0.5 + ({v} - 80) / 8.0)"),
    ], "0.0::DOUBLE")


@query("scl14_saturation", f"""
SELECT component, kpi, ts, value, round({saturation_sql(q50='value', q95='value')}, 6) + 0.0 AS bounded,
       round({saturation_open_sql(q50='50', q95='80')}, 6) + 0.0 AS open_scale FROM raw_metrics""")
def saturation(spark, sf_dir):
    v = F.col("value")
    return T.raw_metrics(spark, sf_dir).select(
        "component", "kpi", "ts", "value",
        S.rounded(S.saturation_bounded(F.col("kpi"), v, v, v), 6).alias("bounded"),
        S.rounded(S.saturation_open(F.col("kpi"), v, F.lit(50), F.lit(80)), 6).alias("open_scale"))


def category_sql(text):
    rules = []
    for name, words in V.KPI_CATEGORIES:
        if name == "cpu":
            rules.append((f"{sql_any(text, words)} AND {sql_any(text, V.CPU_EXCLUSIONS)}", "'other'"))
        rules.append((sql_any(text, words), f"'{name}'"))
    return sql_case(rules, "'other'")


def family_sql(text, rules=V.SIGNAL_FAMILIES):
    out = []
    for name, groups in rules:
        cond = " AND ".join(sql_any(text, g) for g in groups)
        if name == "db_close" and rules is V.REASON_FAMILIES:
            cond = f"({cond} OR regexp_matches({text}, '\\bclose\\b'))"
        out.append((cond, f"'{name}'"))
    return sql_case(out, "'other'")


_TEXTS = """(SELECT kpi AS txt, count(*) AS n FROM raw_metrics GROUP BY kpi UNION ALL
SELECT reason, count(*) FROM records GROUP BY reason UNION ALL
SELECT value, count(*) FROM logs GROUP BY value)"""


def _texts(spark, sf_dir):
    r, lg = T.records(spark, sf_dir), T.logs(spark, sf_dir)
    return (_kpis(spark, sf_dir).withColumnRenamed("kpi", "txt")
            .unionByName(r.groupBy(F.col("reason").alias("txt")).agg(F.count("*").alias("n")))
            .unionByName(lg.groupBy(F.col("value").alias("txt")).agg(F.count("*").alias("n"))))


@query("scl15_kpi_category", f"SELECT txt, n, {category_sql('lower(txt)')} AS category FROM {_TEXTS}")
def kpi_category(spark, sf_dir):
    return _texts(spark, sf_dir).withColumn("category", S.kpi_category(F.col("txt")))


@query("scl16_families", f"""
SELECT txt, n, {family_sql('lower(txt)')} AS signal_family,
  {family_sql('lower(txt)', V.REASON_FAMILIES)} AS reason_family FROM {_TEXTS}""")
def families(spark, sf_dir):
    return (_texts(spark, sf_dir).withColumn("signal_family", S.signal_family(F.col("txt")))
            .withColumn("reason_family", S.reason_family(F.col("txt"))))


cte("broad_family", "SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{v}')" for k, v in V.BROAD_FAMILY.items()) + ") AS b(family, broad)")
cte("kpi_families", f"SELECT kpi, {family_sql('lower(kpi)')} AS sf FROM (SELECT DISTINCT kpi FROM raw_metrics)")
cte("reason_families", f"""
SELECT reason, {family_sql('lower(reason)', V.REASON_FAMILIES)} AS rf
FROM (SELECT DISTINCT reason FROM records)""")
cte("alignment", """
SELECT reason, kpi, rf, sf, CASE WHEN rf = sf THEN 1.0::DOUBLE WHEN b1.broad = b2.broad THEN 0.45::DOUBLE
       ELSE 0.0::DOUBLE END AS score
FROM reason_families JOIN kpi_families ON true
LEFT JOIN broad_family b1 ON b1.family = rf LEFT JOIN broad_family b2 ON b2.family = sf""")


@query("scl17_family_alignment", "SELECT reason, kpi, score FROM alignment")
def family_alignment(spark, sf_dir):
    # the reasons are a configured list, so the pairing is an array, not a join
    reasons = F.array(*[F.lit(r) for r in T.REASONS])
    pairs = _kpis(spark, sf_dir).select("kpi", F.explode(reasons).alias("reason"))
    return pairs.select("reason", "kpi", S.family_alignment(
        S.reason_family(F.col("reason")), S.signal_family(F.col("kpi"))).alias("score"))


def ownership_sql(kind, text):
    rules = []
    for kinds, words, weight in V.OWNERSHIP_RULES:
        cond = sql_any(text, words)
        rules.append((f"{kind} IN {sql_list(kinds)} AND {cond}" if kinds else cond, f"{weight}::DOUBLE"))
    return sql_case(rules, f"{V.OWNERSHIP_DEFAULT}::DOUBLE")


@query("scl18_ownership_weight", f"""
SELECT component, kpi, count(*) AS n, {ownership_sql('any_value(ctype)', "lower(kpi || ' metric_container.csv')")} AS weight
FROM raw_metrics JOIN component_types USING (component) GROUP BY component, kpi""")
def ownership(spark, sf_dir):
    pairs = T.raw_metrics(spark, sf_dir).groupBy("component", "kpi").agg(F.count("*").alias("n"))
    return pairs.withColumn("weight", S.ownership_weight(
        S.component_type(F.col("component")), F.concat("kpi", F.lit(" "), F.lit(T.METRIC_FILE))))


cte("metric_type_priors", "SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', '{r}', {p}::DOUBLE)" for m, r, p in V.METRIC_TYPE_PRIORS) + ") AS p(mtype, reason, prior)")


def metric_type_sql(text):
    return sql_case([(sql_any(text, w), f"'{n}'") for n, w in V.METRIC_TYPES], "'unknown'")


@query("scl19_metric_type_priors", f"""
SELECT kpi, mtype AS metric_type, reason, prior, round(prior * n, 4) AS weight
FROM (SELECT kpi, count(*) AS n, {metric_type_sql('lower(kpi)')} AS mtype FROM raw_metrics GROUP BY kpi)
JOIN metric_type_priors USING (mtype)""")
def metric_type_priors(spark, sf_dir):
    from sonde.operators.reason import prior_edges
    return prior_edges(_kpis(spark, sf_dir).withColumn("severity", F.col("n").cast("double"))).select(
        "kpi", "metric_type", "reason", "prior", S.rounded(F.col("weight"), 4).alias("weight"))


_TEMPLATE_SQL = """regexp_replace(trim(regexp_replace(lower(value), '\\s+', ' ', 'g')),
       '0x[0-9a-fA-F]+|[a-fA-F0-9]{16,}|\\d+\\.\\d+|\\d+', '<*>', 'g')"""
cte("all_log_lines", "SELECT component, value FROM logs UNION ALL SELECT component, value FROM text_logs")
cte("all_templates", f"""
SELECT component, {_TEMPLATE_SQL} AS template,
       substr(sha1({_TEMPLATE_SQL}), 1, 12) AS template_id FROM all_log_lines""")


@query("scl20_log_template", """
SELECT component, template_id, count(*) AS n, min(length(template)) AS chars FROM all_templates GROUP BY ALL""")
def log_template(spark, sf_dir):
    rows = T.logs(spark, sf_dir).select("component", "value").unionByName(
        T.text_logs(spark, sf_dir).select("component", "value"))
    return (rows.select("component", S.log_template(F.col("value")).alias("template"))
            .select("component", "template", S.template_id(F.col("template")).alias("template_id"))
            .groupBy("component", "template_id")
            .agg(F.count("*").alias("n"), F.min(F.length("template")).cast("bigint").alias("chars")))


def reason_prior_sql(reason, kind):
    return sql_case([(f"{kind} IN {sql_list(kinds)} AND {sql_any(reason, words)}", f"{p}::DOUBLE")
                     for kinds, words, p in V.REASON_PRIORS], f"{V.REASON_PRIOR_DEFAULT}::DOUBLE")


@query("scl21_reason_prior", f"""
SELECT component, reason, count(*) AS n, {reason_prior_sql('lower(reason)', 'any_value(ctype)')} AS prior
FROM records JOIN component_types USING (component) GROUP BY component, reason""")
def reason_priors(spark, sf_dir):
    pairs = T.records(spark, sf_dir).groupBy("component", "reason").agg(F.count("*").alias("n"))
    return pairs.withColumn("prior", S.reason_prior(F.col("reason"), S.component_type(F.col("component"))))


cte("type_priors", "SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', '{t}', {p}::DOUBLE)" for (s, t), p in V.TYPE_PRIORS.items()) + ") AS p(st, tt, prior)")


@query("scl22_type_prior", """
SELECT a.component AS source, b.component AS target, count(*) AS n, coalesce(any_value(prior), 0.45) AS prior
FROM event_spans a JOIN event_spans b ON b.trace_id = a.trace_id AND b.parent_id = a.span_id
JOIN component_types ca ON ca.component = a.component JOIN component_types cb ON cb.component = b.component
LEFT JOIN type_priors ON st = ca.ctype AND tt = cb.ctype GROUP BY ALL""")
def type_priors(spark, sf_dir):
    from sonde.operators.spans import call_pairs
    pairs = call_pairs(T.event_spans(spark, sf_dir), keep_self=True)
    return pairs.select(
        F.col("caller").alias("source"), F.col("callee").alias("target"), F.col("calls").alias("n"),
        S.type_prior(S.component_type(F.col("caller")), S.component_type(F.col("callee"))).alias("prior"))


@query("scl23_sigmoid_clamp", """
SELECT component, kpi, ts, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS sigmoid,
       round(least(1.0, greatest(0.0, value / 100)), 4)::DOUBLE AS clamped FROM raw_metrics""")
def sigmoid_clamp(spark, sf_dir):
    v = F.col("value")
    return T.raw_metrics(spark, sf_dir).select(
        "component", "kpi", "ts", S.rounded(S.sigmoid((v - 50) / 10), 6).alias("sigmoid"),
        S.rounded(S.clamp(v / 100), 4).alias("clamped"))


@query("scl24_tokenise", r"""
SELECT row_id, array_to_string(list_sort(list_distinct(list_filter(
  regexp_split_to_array(lower(instruction), '[^a-z0-9]+'), lambda w: length(w) > 2))), ' ') AS tokens
FROM instructions""")
def tokenise(spark, sf_dir):
    return instructions(spark, sf_dir).select(
        "row_id", F.array_join(F.array_sort(S.tokens(F.col("instruction"))), " ").alias("tokens"))


_SAMPLE_NAMES = "lower(substr(component || ' ' || reason, 1 + row_id % 5))"


@query("scl27_closest_candidate", """
WITH v AS (SELECT DISTINCT row_id % 5 AS cut, substr(reason, 1 + row_id % 5) AS raw FROM records),
c AS (SELECT cut, raw, name, pos, round(1.0 - levenshtein(raw, name)::DOUBLE / greatest(length(raw), length(name), 1), 9) AS score
  FROM v, (SELECT unnest([""" + ", ".join(f"'{r}'" for r in T.REASONS) + """]) AS name,
           unnest(range(7)) AS pos))
SELECT cut, raw, CASE WHEN max(CASE WHEN raw = name THEN 1 ELSE 0 END) = 1 THEN raw
  WHEN max(score) >= 0.3 THEN arg_max(name, (score, -pos)) ELSE 'high CPU usage' END AS coerced
FROM c GROUP BY cut, raw""")
def closest(spark, sf_dir):
    raw = T.records(spark, sf_dir).select(
        (F.col("row_id") % 5).alias("cut"),
        F.expr("substring(reason, cast(1 + row_id % 5 as int))").alias("raw")).distinct()
    return raw.withColumn("coerced", S.closest_candidate(F.col("raw"), T.REASONS))


# ------------------------------------------------------------------ set operations
@query("set1_bag_union", """
SELECT component, kpi, ts, value FROM raw_metrics UNION ALL
SELECT component, 'rr', hour, CAST(rr AS DOUBLE) FROM hourly""")
def bag_union(spark, sf_dir):
    h = _hourly(spark, sf_dir).select(
        "component", F.lit("rr").alias("kpi"), F.col("hour").alias("ts"), F.col("rr").cast("double").alias("value"))
    return T.raw_metrics(spark, sf_dir).drop("day").unionByName(h)


cte("metric_set", """
SELECT DISTINCT i.incident_id, component FROM raw_metrics m JOIN short_incidents i ON ts BETWEEN start_ts AND end_ts""")
cte("failed_set", """
SELECT DISTINCT i.incident_id, component FROM event_spans m JOIN short_incidents i ON ts BETWEEN start_ts AND end_ts
WHERE NOT success""")


def _sets(spark, sf_dir):
    from sonde.operators.windows import window_join
    inc = short_incidents(spark, sf_dir)
    a = window_join(T.raw_metrics(spark, sf_dir), inc).select("incident_id", "component").distinct()
    b = window_join(T.event_spans(spark, sf_dir).filter(~F.col("success")), inc).select(
        "incident_id", "component").distinct()
    return a, b


@query("set2_ordered_union", """
SELECT incident_id, component, min(pos) AS pos FROM (
  SELECT incident_id, component, 1 AS pos FROM failed_set UNION ALL
  SELECT incident_id, component, 2 FROM metric_set) GROUP BY ALL""")
def ordered_union(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    both = b.withColumn("pos", F.lit(1)).unionByName(a.withColumn("pos", F.lit(2)))
    return both.groupBy("incident_id", "component").agg(F.min("pos").alias("pos"))


@query("set3_difference", "SELECT * FROM metric_set EXCEPT SELECT * FROM failed_set")
def difference(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.exceptAll(b)


@query("set4_intersection", "SELECT * FROM metric_set INTERSECT SELECT * FROM failed_set")
def intersection(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.intersect(b)
