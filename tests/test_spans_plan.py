"""The large spans are grouped by hash, not sorted, and keep the meaning of the smallest flag."""

from pyspark.sql import functions as F

from sonde.sources import tables as T


def test_spans_by_hash(spark, tmp_path):
    flags = [["R"], ["R", "A"], ["S"], ["S", "R"], ["N"], [None], [None, "R"], [None, "S"], ["R", "R"], ["", "R"]]
    rows = [(i, 1, 5, 1.0, f) for i, group in enumerate(flags) for f in group]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_returnflag string").withColumn(
        "l_shipdate", F.lit("1995-01-05 00:00:00").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "lineitem.parquet"))
    spans = T.spans(spark, str(tmp_path))
    assert "SortAggregate" not in spans._jdf.queryExecution().executedPlan().toString()
    smallest = [min((f for f in group if f is not None), default=None) for group in flags]
    assert {r.trace_id: r.success for r in spans.collect()} == {i: None if m is None else m != "R" for i, m in enumerate(smallest)}
