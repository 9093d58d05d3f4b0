"""The clustered telemetry store: few files, and a window scan that reads its row groups only."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sonde.operators.windows import window_join
from sonde.sources import telemetry as TM

DAY = 86400
ROWS = 400_000


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Four days in 40 shuffled tasks; the last day holds over half of the rows."""
    path = str(tmp_path_factory.mktemp("store") / "metrics")
    i = F.col("id")
    day = F.least(i % 9, F.lit(3))
    rows = spark.range(ROWS, numPartitions=40).select(
        day.alias("day"), F.concat(F.lit("c"), (i % 7).cast("string")).alias("component"), F.lit("cpu").alias("kpi"),
        (day * DAY + F.pmod(F.xxhash64("id"), F.lit(DAY))).alias("ts"), F.rand(1).alias("value"))
    TM.write_telemetry(rows, path, rows_per_file=50_000, group_bytes=1 << 18)
    return path


def read(spark, df):
    """Rows that the scans of ``df`` decode (bytes miss what Parquet reads on its own threads), and its rows."""
    context = spark.sparkContext
    before = {s.stageId() for s in stages(context)}
    rows = df.collect()
    return sum(s.inputRecords() for s in stages(context) if s.stageId() not in before), rows


def stages(context):
    context._jsc.sc().listenerBus().waitUntilEmpty()
    found = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


def test_files_hold_ranges_of_time(store):
    files = glob.glob(f"{store}/day=*/*.parquet")
    assert ROWS // 50_000 <= len(files) <= ROWS // 50_000 + 4
    spans, cut = {}, 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.to_arrow_schema().get_field_index("ts")
        groups = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        assert all(a.max <= b.min for a, b in zip(groups, groups[1:]))
        cut += len(groups) > 1
        spans.setdefault(f.split("day=")[1].split("/")[0], []).append((groups[0].min, groups[-1].max))
    assert cut >= ROWS // 50_000 - 1  # only short pieces at the end of a day are one row group
    for ranges in spans.values():
        ranges.sort()
        assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_window_scan_reads_matching_row_groups(spark, store):
    rows = spark.read.parquet(store).withColumn("day", F.col("day").cast("bigint"))
    windows = spark.createDataFrame([(1, 3 * DAY + 40_000, 3 * DAY + 41_800), (2, 3 * DAY + 41_000, 3 * DAY + 42_000)], "incident_id int, start_ts long, end_ts long")
    wanted = rows.filter(F.col("ts").between(3 * DAY + 40_000, 3 * DAY + 41_800)).count() + rows.filter(
        F.col("ts").between(3 * DAY + 41_000, 3 * DAY + 42_000)).count()
    whole, _ = read(spark, rows.filter("day = 3").agg(F.max("ts"), F.max("value"), F.max("component"), F.max("kpi")))
    part, found = read(spark, window_join(TM.scan_windows(rows, windows), windows))
    assert len(found) == wanted > 4000
    assert 0 < part < whole / 5
    assert TM.scan_windows(rows, windows.limit(0)).count() == 0


def test_store_of_hot_times_nulls_and_nothing(spark, tmp_path):
    """One time holds most rows: it is cut over several files; rows without a time or day are kept."""
    i = F.col("id")
    hot = spark.range(30_000).select(F.when(i % 50 > 0, 5).cast("long").alias("day"), F.when(i % 10 > 0, 5 * DAY + 7).alias("ts"), i.alias("value"))
    TM.write_telemetry(hot, f"{tmp_path}/hot", rows_per_file=3000)
    back = spark.read.parquet(f"{tmp_path}/hot")
    assert sorted(tuple(r) for r in back.select("value").collect()) == [(n,) for n in range(30_000)]
    assert back.filter("day IS NULL").count() == 600 and back.filter("ts IS NULL").count() == 3000
    sizes = [r[0] for r in back.groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(sizes) >= 8 and max(sizes) < 6000
    TM.write_telemetry(hot.limit(0), f"{tmp_path}/none")
