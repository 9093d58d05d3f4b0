"""Telemetry files: readers that bring every layout into one long form, and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.functions import fixed as V
from sonde.functions import scalars as S


def first_present(df: DataFrame, names) -> str | None:
    """The first of the alias names that the frame has."""
    return next((n for n in names if n in df.columns), None)


def scan_csv(spark: SparkSession, root: str, kind: str, file: str) -> DataFrame:
    """All days of ``root/telemetry/{day}/{kind}/{file}.csv`` as text, with day and file name.

    Nothing is inferred: the one header line is read, every column stays text and is
    coerced by the caller.
    """
    df = spark.read.option("header", True).csv(f"{root}/telemetry/*/{kind}/{file}.csv")
    path = F.col("_metadata.file_path")
    return df.select(
        "*", F.regexp_extract(path, r"/telemetry/([^/]+)/", 1).alias("day"),
        F.regexp_extract(path, r"([^/]+)\.csv(?:/[^/]*)?$", 1).alias("file_name"))


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """Labels and tasks: quoted CSV whose fields may span lines, read by header name."""
    return (spark.read.option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').csv(path))


def coerce(df: DataFrame) -> DataFrame:
    """Seconds and numbers; rows whose time or value cannot be read are dropped."""
    return (df.withColumn("ts", S.normalise_epoch(F.col("ts")))
            .withColumn("value", F.col("value").try_cast("double"))
            .filter(F.col("value").isNotNull() & ~F.isnan("value"))
            .na.drop(subset=["ts"]))


def component_from_file(file_name):
    """``metric_x`` or ``metric_x.csv`` -> ``x``."""
    return F.replace(F.regexp_replace(file_name, r"\.csv$", ""), F.lit("metric_"), F.lit(""))


def long_metrics(df: DataFrame, time: str, component: str | None, kpi: str) -> DataFrame:
    """Long files: rename to the unified columns; other columns are dropped."""
    comp = F.col(component) if component else component_from_file(F.col("file_name"))
    return df.select("day", "file_name", comp.alias("component"), F.col(kpi).alias("kpi"),
                     F.col(time).alias("ts"), F.col("value"))


def wide_metrics(df: DataFrame, time: str, component: str | None, kpis) -> DataFrame:
    """Wide files: one row per time, component and KPI column."""
    comp = F.col(component) if component else component_from_file(F.col("file_name"))
    keep = df.select("day", "file_name", comp.alias("component"), F.col(time).alias("ts"),
                     *[F.col(k).cast("string").alias(k) for k in kpis])
    return keep.unpivot(["day", "file_name", "component", "ts"], list(kpis), "kpi", "value")


def numeric_columns(df: DataFrame, component: str | None) -> list[str]:
    """Columns that may hold KPIs and have at least one numeric value (one pass, one row back)."""
    names = [c for c in df.columns
             if c != component and c not in V.NEVER_A_KPI and c not in ("day", "file_name")]
    if not names:
        return []
    row = df.agg(*[F.count(F.col(c).try_cast("double")).alias(c) for c in names]).first()
    return [c for c in names if row[c] > 0]


def any_metrics(df: DataFrame) -> DataFrame:
    """Long form of a metric file of unknown layout, by its column names."""
    time = first_present(df, V.TIME_COLUMNS)
    component = first_present(df, V.COMPONENT_COLUMNS)
    kpi = first_present(df, V.KPI_COLUMNS)
    if kpi and "value" in df.columns:
        return coerce(long_metrics(df, time, component, kpi))
    return coerce(wide_metrics(df, time, component, numeric_columns(df, component)))


def read_metrics(spark: SparkSession, root: str, layout: str, files=None) -> DataFrame:
    """All metric files of a layout as one bag of (day, file, component, kpi, ts, value)."""
    parts = []
    for file, (time, component, kpi) in V.METRIC_LAYOUTS[layout].items():
        if files is not None and file not in files:
            continue
        df = scan_csv(spark, root, "metric", file)
        shape = long_metrics if isinstance(kpi, str) else wide_metrics
        parts.append(shape(df, time, component, kpi))
    return coerce(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def unify_spans(df: DataFrame) -> DataFrame:
    """Spans of any layout as (trace, span, parent, component, ts, duration, success, ...)."""
    def pick(names, kind="string"):
        name = first_present(df, names)
        return F.col(name).try_cast(kind) if name else F.lit(None).cast(kind)

    parent = pick(V.PARENT_ID_COLUMNS)
    success = pick(("success",))
    return df.select(
        pick(V.TRACE_ID_COLUMNS).alias("trace_id"), pick(V.SPAN_ID_COLUMNS).alias("span_id"),
        F.when(parent != "None", parent).alias("parent_id"), pick(("cmdb_id",)).alias("component"),
        S.normalise_epoch(pick(V.TIME_COLUMNS)).alias("ts"),
        pick(V.DURATION_COLUMNS, "double").alias("duration"),
        F.when(success.isNotNull(), ~F.lower(success).isin(*V.FAILED_WORDS)).alias("success"),
        pick(("dsName",)).alias("ds_name"), pick(("serviceName",)).alias("service_name"))


def read_spans(spark: SparkSession, root: str, file: str = "trace_span") -> DataFrame:
    return unify_spans(scan_csv(spark, root, "trace", file))


def read_logs(spark: SparkSession, root: str, file: str = "log_service") -> DataFrame:
    df = scan_csv(spark, root, "log", file)
    return df.select("day", "log_id", "log_name", F.col("cmdb_id").alias("component"),
                     S.normalise_epoch(F.col("timestamp")).alias("ts"), "value").na.drop(subset=["ts"])


def dated(df: DataFrame) -> DataFrame:
    """``day`` as the number of the row's day (UTC), which is how the flows join days, in place of the folder's name."""
    return df.withColumn("day", F.floor(F.col("ts") / 86400).cast("bigint"))


def write_telemetry(df: DataFrame, path: str, rows_per_file: int = 8_000_000, group_bytes: int = 16 << 20) -> None:
    """Parquet partitioned by day, in files that each hold a range of (day, ts).

    The number of files comes from the counted rows: one for each ``rows_per_file``, and one
    more at most for each day, instead of tasks times days. Rows are sorted by time, so the footers of the row groups (about ``group_bytes`` each) let a scan skip
    all times it does not ask for. A hot day or hour spans as many ranges as its rows need;
    rows of one time may be cut too, as a digest of the row is the last part of the order.
    Days that are null get their own folder; an empty table is written as one empty folder.
    """
    files = max(1, -(-df.count() // rows_per_file))
    order = [F.col("day"), F.col("ts"), F.xxhash64(*df.columns)]
    (df.repartitionByRange(files, *order).sortWithinPartitions("day", "ts")
     .write.mode("overwrite").option("parquet.block.size", group_bytes).partitionBy("day").parquet(path))


def scan_windows(rows: DataFrame, windows: DataFrame, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """The stored rows that may lie in a window: all times from the first start to the last end.

    The two bounds are scalar subqueries, which Spark hands to the Parquet reader as values:
    row groups whose footers lie outside are not read, and where ``day`` is a number (``dated``)
    other days are not even listed. No windows: no rows.
    """
    # an aggregate and a top row: two aggregates would be merged into one struct, which is not pushed down
    first = windows.agg(F.min(start)).scalar()
    last = windows.select(end).orderBy(F.desc(end)).limit(1).scalar()
    found = rows.filter((F.col("ts") >= first) & (F.col("ts") <= last))
    if dict(rows.dtypes).get("day") in ("int", "bigint"):
        found = found.filter((F.col("day") >= F.floor(first / 86400)) & (F.col("day") <= F.floor(last / 86400)))
    return found


def mean_per_timestamp(df: DataFrame, keys, how: str = "mean") -> DataFrame:
    """One value per series and timestamp."""
    agg = F.max("value") if how == "max" else S.steady_mean(F.col("value"))
    return df.groupBy(*keys, "ts").agg(agg.alias("value"))


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


REPORT = ("query", "answer", "groundtruth", "passed", "failed", "score", "task_index")


def score_report(scored: DataFrame) -> DataFrame:
    """Report rows of scored tasks (instruction, prediction, scoring_points, passed, failed, score, task_index)."""
    return scored.select(F.col("instruction").alias("query"), F.col("prediction").alias("answer"), F.col("scoring_points").alias("groundtruth"),
                         F.to_json("passed").alias("passed"), F.to_json("failed").alias("failed"), "score", "task_index")


def append_report(scored: DataFrame, path: str, compression: str = "none") -> None:
    """Append the report rows to a CSV folder with a header in each file; readers know a compressed file by its name."""
    score_report(scored).write.mode("append").option("header", True).option("escape", '"').option("ignoreTrailingWhiteSpace", False).csv(
        path, compression=compression)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} {'DOUBLE' if c == 'score' else 'STRING'}" for c in REPORT)
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_case_files(cases: DataFrame, path: str, key: str = "case_id") -> None:
    """One JSON folder for each case, named by its key."""
    cases.repartition(key).write.mode("overwrite").partitionBy(key).json(path)


def graph_export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON document per incident with its nodes and edges (bounded by components)."""
    n = nodes.groupBy("incident_id").agg(
        F.array_sort(F.collect_list(F.struct("component", "component_type", "severity"))).alias("nodes"))
    e = edges.groupBy("incident_id").agg(
        F.array_sort(F.collect_list(F.struct("source", "target", "weight", "call_count"))).alias("edges"))
    return n.join(e, "incident_id", "left").select(
        "incident_id", F.to_json(F.struct("nodes", "edges")).alias("graph"))
