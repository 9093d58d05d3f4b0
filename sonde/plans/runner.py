"""From a task table and telemetry folders to answers, scores and a report, in one call.

All tasks are one run of a flow: a task's window, asked fields and number of failures are
read from its instruction, every task is an incident, and its prediction is scored against
its criteria. A task whose window cannot be read gets no prediction and scores 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.functions import fixed as V
from sonde.operators import evaluate as E
from sonde.operators import memory as M
from sonde.operators import tasks as TK
from sonde.plans import flows
from sonde.plans.stages import written
from sonde.sources import telemetry as TM

FLOWS = {"causal": flows.causal_flow, "causal_v2": flows.causal_flow_v2, "evidence": flows.evidence_flow}


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """row_id (the place in the file), task_index, instruction, scoring_points."""
    return TM.scan_table(spark, path).withColumn("row_id", F.monotonically_increasing_id()).select(
        "row_id", "task_index", "instruction", "scoring_points")


def incidents_of(tasks: DataFrame, most: int | None = 3) -> DataFrame:
    """The incidents that tasks ask about; ``most`` failures are answered (None: as many as are asked for)."""
    known = TK.failure_count(TK.target_fields(TK.parse_window(tasks)), most).filter("start_ts IS NOT NULL AND end_ts IS NOT NULL")
    return known.select(F.col("row_id").alias("incident_id"), "start_ts", "end_ts", "failure_count", "target_fields",
                        (F.col("target_fields") == F.array(F.lit(V.FIELD_TIME))).alias("time_only"))


CASE = "case_id STRING, dataset STRING, task_index STRING, tokens ARRAY<STRING>, components ARRAY<STRING>, reasons ARRAY<STRING>, score DOUBLE, prediction STRING"


def past_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The cases of a memory folder; none where nothing has been recorded yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/cases")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(CASE).json(f"{folder}/cases") if there else spark.createDataFrame([], CASE)


def flow_of(metrics: DataFrame, spans: DataFrame, logs: DataFrame, incidents: DataFrame, settings: flows.Settings, flow: str = "causal",
            recover: bool = False, cases: DataFrame | None = None) -> dict[str, DataFrame]:
    """The relations of a flow; ``recover`` tries other settings where needed, ``cases`` feed the evidence flow."""
    if recover and flow != "evidence":
        return flows.recovered(metrics, spans, logs, incidents, settings, FLOWS[flow])
    extra = {"cases": cases} if cases is not None and flow == "evidence" else {}
    return FLOWS[flow](metrics, spans, logs, incidents, settings, **extra)


def answered(tasks: DataFrame, out: dict[str, DataFrame], incidents: DataFrame, settings: flows.Settings) -> DataFrame:
    """The tasks with their ``prediction`` (null where a task names no window) from a flow's relations."""
    if "final" not in out:
        return tasks.withColumn("prediction", F.lit(None).cast("string"))
    found = flows.predict(out["final"], incidents, settings, causes=out.get("causes"), global_time=out.get("global_time"))
    return tasks.join(found.select(F.col("incident_id").alias("row_id"), "prediction"), "row_id", "left")


def run(spark: SparkSession, root: str, layout: str, tasks_path: str, settings: flows.Settings, flow: str = "causal",
        report: str | None = None, most: int | None = 3, recover: bool = False, memory: str | None = None) -> dict[str, DataFrame]:
    """``scored`` tasks, accuracy ``by_difficulty`` and score ``by_task``; appends to the ``report`` folder if given.

    ``memory`` names a folder of past cases: the evidence flow retrieves from it, and every flow
    records its scored answers there, once all of them are made.
    """
    tasks = written(read_tasks(spark, tasks_path), "tasks")
    metrics, spans, logs = map(TM.dated, (TM.read_metrics(spark, root, layout), TM.read_spans(spark, root), TM.read_logs(spark, root)))
    asked = tasks.select(F.col("row_id").alias("incident_id"), "instruction", F.lit(layout).alias("dataset"))
    incidents = written(incidents_of(tasks, most).join(asked, "incident_id"), "incidents")
    cases = past_cases(spark, memory) if memory else None
    out = flow_of(metrics, spans, logs, incidents, settings, flow, recover, cases)
    answers = answered(tasks, out, incidents, settings)
    scored = written(E.score_predictions(answers.withColumn("prediction", F.coalesce("prediction", F.lit("")))), "scored")
    if report:
        TM.append_report(scored, report)
    if memory and "final" in out:
        rows = scored.select(F.col("row_id").alias("incident_id"), F.expr("uuid()").alias("case_id"), "task_index", "instruction",
                             F.lit(layout).alias("dataset"), "prediction", "score")
        M.record_cases(written(flows.cases_of(out["final"], rows), "cases"), memory)
    return {"scored": scored, "by_difficulty": E.accuracy_by_difficulty(scored), "by_task": E.score_by_task(scored)}
