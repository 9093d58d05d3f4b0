"""The trace table in one pass equals what its three single operators say, and shuffles the spans seldom."""

from sonde.operators import spans as SP

SPANS = "incident_id long, trace_id long, span_id long, parent_id long, component string, duration double, success boolean"
ROWS = [
    (1, 1, 1, None, "a", 1.0, True), (1, 1, 2, 1, "b", 2.0, False), (1, 1, 3, 2, "a", 1.0, None), (1, 1, 4, 1, "b", 2.0, False),
    (1, 2, 7, 6, "c", 5.0, True),  # its parent is missing and nothing failed: no mark
    (1, 3, 8, 7, "c", 5.0, False),  # a parent of another trace; one failure
    (1, 4, 1, 2, "d", None, True), (1, 4, 2, 1, "a", 1.0, True),  # a cycle
    (1, 5, 1, None, "b", 1.0, True), (1, 5, 1, None, "a", 1.0, True), (1, 5, 2, 1, "c", 1.0, True),  # an id twice
    (1, 6, 1, None, None, 1.0, True), (1, 6, 2, 1, "c", 1.0, True), (1, 6, 3, 2, None, 1.0, False),  # no component
    (2, 1, 2, 1, "b", 3.0, True), (2, 1, 3, 2, "b", 3.0, True),  # a trace cut by its incident
]


def test_profiles_equal_single_operators(spark):
    spans = spark.createDataFrame(ROWS, SPANS)
    scores = spark.createDataFrame([(1, "a", 0.25), (1, "b", 1.5), (2, "b", 4.0)], "incident_id long, component string, score double")
    keys = ["incident_id", "trace_id"]
    wanted = SP.fingerprints(spans).join(SP.roots(spans), keys).join(SP.trace_anomaly(spans, scores), keys)
    found = SP.trace_profiles(spans, scores)
    columns = [*keys, "eps", "pattern_id", "root", "anomaly"]
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted(map(tuple, wanted.select(*columns).collect()), key=str)
    assert {(r.incident_id, r.trace_id) for r in found.collect()} == {(1, 1), (1, 3), (1, 4), (1, 5), (1, 6), (2, 1)}


def test_trace_table_shuffles_spans_seldom(spark, tmp_path, monkeypatch):
    """Parents, joined rows (where no side is broadcast: spans too) and traces: before there were nine."""
    from sonde.plans import queries_cases as QC
    from sonde.plans import queries_spans as QP
    spark.createDataFrame(ROWS, SPANS).write.parquet(str(tmp_path / "spans"))
    monkeypatch.setattr(QP, "incident_spans", lambda *a: spark.read.parquet(str(tmp_path / "spans")))
    built = {}

    def stage(spark, sf_dir, name, build):
        built[name] = build()
        built[name].write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))
    monkeypatch.setattr(QC, "stage", stage)
    QC.trace_table(spark, "unused")
    plan = built["trace_table"]._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange hashpartitioning") <= 4


def test_incident_spans_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Only the grouping of the lines moves them: the windows are few, and known to be."""
    from sonde.plans import queries_spans as QP
    spark.range(50000).selectExpr("id div 4 AS l_orderkey", "cast(id % 4 AS int) AS l_linenumber", "id % 7 AS l_suppkey", "1.0D AS l_quantity", "'N' AS l_returnflag",
                                  "timestamp_ntz'1995-01-05 00:00:00' + make_dt_interval(cast(id % 900 AS int)) AS l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    built = {}

    def stage(spark, sf_dir, name, build):
        built[name] = build()
        built[name].write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))
    monkeypatch.setattr(QP, "stage", stage)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        rows = QP.incident_spans(spark, str(tmp_path))
        plan = built["incident_spans"]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1
    assert rows.count() == 50000
