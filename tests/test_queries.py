"""Registered queries against their SQL checks on the smallest tables."""

import os

import pytest

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables absent")
CHOSEN = (
    "src1_csv_scan", "src2_window_scan", "src7_unify_long_files", "src9_unpivot_discovered", "src11_span_layouts", "src14_data_quality",
    "scl5_local_time", "scl7_instruction_window", "scl11_component_normalise", "scl16_families", "scl20_log_template", "agg1_day_thresholds",
    "win2_fill_missing", "agg7_traditional_score", "agg12_anomaly_evidence", "det1_segments_a", "det2_segments_b", "det3_candidate_set",
    "join2_span_self_join", "agg13_span_statistics", "agg16_trace_evidence", "smp1_trace_fingerprint", "agg18_log_reason_evidence",
    "agg20_trace_duration_reason", "win4_lagged_correlation", "grf5_causal_edge_weight", "grf10_bottleneck_influence", "grf12_explain_score",
    "rnk1_spectral_root_ranking", "hyp1_belief_states", "rnk4_final_blend", "rnk9_select_causes", "rnk10_evidence_ranking",
    "scl25_prediction_json", "mem1_similar_cases", "smp5_balanced_kpis", "chk1_score_predictions", "chk4_task_generation",
)


@pytest.fixture(scope="module")
def con():
    from compare import duck
    return duck(SF_DIR)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, name):
    import __spark_entry__ as entry
    from compare import compare
    status, message = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert status == "ok", message


def test_registry():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 180


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).columns == ["incident_id", "component", "score", "first_ts", "kpis", "rank"]
