from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sonde.functions import scalars as S
from sonde.operators import tasks as TK


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", expr(F.col("v"))).orderBy("i").collect()]


def test_epoch_seconds_and_milliseconds(spark):
    raw = ["1614841020", "1614841020123", "1614841020.9", "-5.5", "abc", None, "9999999999", "10000000000"]
    assert column(spark, raw, S.normalise_epoch) == [
        1614841020, 1614841020, 1614841020, -5, None, None, 9999999999, 10000000]


def test_local_time_is_free_of_the_session_zone(spark):
    stamps = [0, 1614841020, 1710054000, 1730613600]  # the session zone has clock changes near the last two
    want = [str(datetime(1970, 1, 1) + timedelta(seconds=t + 28800)) for t in stamps]
    assert column(spark, stamps, S.local_time, "bigint") == want
    assert column(spark, want, S.local_to_epoch) == stamps
    assert column(spark, stamps, S.local_day, "bigint") == [w[:10].replace("-", "_") for w in want]


@pytest.mark.parametrize("name,kind", [
    ("os_021", "node"), ("node-3", "node"), ("Mysql02", "db"), ("db_007", "db"), ("Redis01", "redis"), ("docker_004", "pod"),
    ("cartservice-1", "pod"), ("a.b", "pod"), ("Tomcat01", "service"), ("IG02", "middleware"), ("MG01", "middleware"), ("other", "service")])
def test_component_type(spark, name, kind):
    assert column(spark, [name], S.component_type) == [kind]


def test_normalise_component(spark):
    known = ["Tomcat01", "adservice-0", "adservice-1", "frontend", "node-5", "front"]
    raw = ["adservice", "Tomcat01", "Tomcat01.x.y", "x.Tomcat01.y", "frontend-grpc", "adservice.ts:8088", "frontend.b:80",
           "ns/node-5/eth", "zz frontend zz", "unknown"]
    assert column(spark, raw, lambda c: S.normalise_component(c, known)) == [
        "adservice-0", "Tomcat01", "Tomcat01", "Tomcat01", "frontend", "adservice-0", "frontend", "node-5", "frontend", "unknown"]


def test_closest_candidate(spark):
    names = ["high CPU usage", "network latency"]
    assert column(spark, ["network latency", "netwrk latncy", "high cpu", "@@@"], lambda c: S.closest_candidate(c, names)) == [
        "network latency", "network latency", "high CPU usage", "high CPU usage"]


def test_reason_hint_takes_the_first_rule_with_a_candidate(spark):
    reasons = ["high CPU usage", "network packet loss", "high disk space usage"]
    assert column(spark, ["JVM_CPULoad", "TCP-FIN-WAIT", "MEMUsed", "rows"], lambda c: S.reason_hint(c, reasons)) == [
        "high CPU usage", "network packet loss", "high disk space usage", None]


def test_template_masks_numbers_and_ids(spark):
    lines = ["Error  at 0xFF in 12.5 ms\tid deadbeefdeadbeef1", "plain"]
    assert column(spark, lines, S.log_template) == ["error at <*> in <*> ms id <*>", "plain"]


def test_families(spark):
    assert column(spark, ["JVM_Heap_used", "sr_rate", "packet_in", "disk_space_free", "mysql_client", "x"], S.signal_family) == [
        "jvm_memory", "network_loss", "network_loss", "disk_space", "db_connection", "other"]
    # "connection" holds "io": the disk rule comes first
    assert column(spark, ["db connection limit", "db close", "will close now", "closed", "network delay"], S.reason_family) == [
        "disk_io", "db_close", "db_close", "other", "network_latency"]


def test_instruction_parsing(spark):
    rows = [("task_3", "On March 4, 2021, within the time range of 14:30 to 15:00, a single failure was detected."),
            ("x", "On march 4, 2021 between 11:30 PM and 12:10 AM, 2 failures were seen. Why? Which component?"),
            ("x", "no date 10:00 to 11:00"), ("x", "On April 31, 2021, 10:00 to 11:00 three failures"), ("x", "multiple issues")]
    df = spark.createDataFrame(rows, "task_index string, instruction string")
    out = TK.failure_count(TK.target_fields(TK.parse_window(df))).collect()
    base = int((datetime(2021, 3, 4) - datetime(1970, 1, 1)).total_seconds()) - 28800
    assert (out[0].start_ts, out[0].end_ts, out[0].failure_count) == (base + 14.5 * 3600, base + 15 * 3600, 1)
    assert out[0].target_fields == ["root cause component"]
    assert (out[1].start_ts, out[1].end_ts, out[1].failure_count) == (base + 23.5 * 3600, base + 86400 + 600, 2)
    assert out[1].target_fields == ["root cause component", "root cause reason"]
    assert out[2].start_ts is None and out[3].start_ts is None
    assert out[3].failure_count == 3 and out[4].failure_count == 3
    assert len(out[4].target_fields) == 3


def test_failure_count_without_a_cut(spark):
    said = ["The number of failures is 12.", "five failures occurred", "0 failures were reported", "multiple failures", "one failure", "why?"]
    tasks = spark.createDataFrame(list(enumerate(said)), "i int, instruction string")
    for most, want in ((None, [12, 5, 1, 3, 1, 1]), (3, [3, 3, 1, 3, 1, 1]), (2, [2, 2, 1, 2, 1, 1])):
        assert [r["failure_count"] for r in TK.failure_count(tasks, most).orderBy("i").collect()] == want
