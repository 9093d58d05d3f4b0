"""Every cap can be lifted: None gives all rows, ranked; a hot key spans several tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonde.functions import spectrum
from sonde.operators import detect, hypotheses, logs, rank, spans, spectral
from sonde.operators.windows import top_k


def test_ranks_of_a_hot_key(spark):
    """A third of the rows in one key, ties and null values: the ranks of a plain sort."""
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else rng.choice(["a", "b", None]), rng.choice([None, 1.5, 2.5, rng.random()]), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, v double, i int").repartition(7)
    found = top_k(df, ["k"], [F.desc("v"), "i"], None)
    assert found.columns == ["k", "v", "i", "rank"]
    got = {r["i"]: (r["k"], r["rank"]) for r in found.collect()}
    for key in ("hot", "a", "b", None):
        plain = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [got[r[2]] for r in plain] == [(key, n + 1) for n in range(len(plain))]
    assert top_k(df.limit(0), ["k"], ["i"], None).count() == 0


def evidence(spark, n=60):
    return spark.createDataFrame([(1, f"c{i:02}", "cpu", 1 - i / 200, "none") for i in range(n)],
                                 "incident_id int, component string, kpi string, final_score double, spectral_class string")


def test_caps_of_detectors(spark):
    scores = spark.createDataFrame([(1, f"c{i}", 0.06 + i / 1000) for i in range(50)], "incident_id int, component string, score double")
    assert detect.candidates(scores).count() == 30 and detect.candidates(scores, keep=None).count() == 50
    profiles = scores.select("incident_id", "component", F.lit(0.9).alias("local_evidence"))
    assert detect.layer_filter_weighted(scores, profiles).count() == 12
    assert detect.layer_filter_weighted(scores, profiles, top=None).count() == 50
    points = spark.createDataFrame([(1, f"c{i}", "cpu", 100 * j, 50.0 + j, 10.0, "up", 60.0, 0.5 + i / 500, "r") for i in range(100) for j in range(2)],
                                   "incident_id int, component string, kpi string, ts long, value double, threshold double, "
                                   "direction string, median_gap double, score double, reason_hint string")
    assert detect.segments_a(points).count() == 80 and detect.segments_a(points, None).count() == 100


def test_caps_of_logs_and_spans(spark):
    counts = spark.createDataFrame([(1, "c", f"word {chr(97 + i // 26)}{chr(97 + i % 26)} timeout", 1 + i) for i in range(120)],
                                   "incident_id int, component string, template string, n long")
    assert logs.template_counts(counts).count() == 50 and logs.template_counts(counts, None).count() == 120
    assert logs.template_sample(counts).count() == 80 and logs.template_sample(counts, None).count() == 120
    calls = spark.createDataFrame([(1, f"t{i}", c) for i in range(70) for c in "ab"], "incident_id int, trace_id string, component string")
    assert spans.call_chains(calls).count() == 50 and spans.call_chains(calls, None).count() == 70


def test_caps_of_nodes_and_rankings(spark):
    found = evidence(spark)
    assert spectral.candidate_edges(found).count() == 20 * 29
    assert spectral.candidate_edges(found, None, None).count() == 60 * 59
    ranking = found.select("incident_id", F.lit("x.cpu").alias("node"), F.lit(9).alias("rank"))
    assert hypotheses.hypothesise(found, ranking).count() == 5 and hypotheses.hypothesise(found, ranking, None).count() == 60
    nodes = found.select("incident_id", "component", F.col("final_score").alias("score"), F.lit(5).alias("first_ts"))
    local = nodes.select("incident_id", "component", F.col("score").alias("evidence"))
    edges = spark.createDataFrame([], "incident_id int, source string, target string")
    alone = nodes.select("incident_id", "component", F.lit(0.0).alias("unexplained"))
    kept = rank.intervention_ranking_v2(nodes, local, edges, alone).filter("kept").count()
    assert kept == 12 and rank.intervention_ranking_v2(nodes, local, edges, alone, None).filter("kept").count() == 60
    best = rank.intervention_ranking_v2(nodes, local, edges, alone)
    reasons = nodes.select("incident_id", "component", F.lit("r").alias("reason"), F.lit(0.1).alias("reason_score"))
    context = nodes.select("incident_id", "component", F.lit(0.1).alias("discounted"))
    quality = nodes.select("incident_id", F.lit(0.5).alias("quality")).distinct()
    assert rank.final_blend(best, reasons, context, quality).count() == 4
    assert rank.final_blend(best, reasons, context, quality, None).count() == 60


def plain_lag(x, y, reach):
    """Every lag summed by itself."""
    n, dx, dy = len(x), x - x.mean(), y - y.mean()
    sx, sy = np.sqrt((dx * dx).mean()), np.sqrt((dy * dy).mean())
    found = []
    for k in range(-reach, reach + 1):
        if n - abs(k) >= 3:
            a, b = (dx[:n - k], dy[k:]) if k >= 0 else (dx[-k:], dy[:n + k])
            found.append((k, float((a * b).sum() / ((n - abs(k)) * sx * sy + 1e-12))))
    return max(found, key=lambda f: (np.floor(abs(f[1]) * 1e9 + 0.5), -f[0])) if found and min(sx, sy) >= 1e-12 else (0, 0.0)


@pytest.mark.parametrize("n", [2, 3, 4, 7, 24, 60, 301])
def test_lag_equals_every_lag_summed(n):
    rng = np.random.default_rng(n)
    x = np.concatenate((rng.normal(size=(20, n)), np.tile(np.arange(n) % 3, (3, 1)), np.ones((1, n))))
    y = np.concatenate((np.roll(x[:20], 2, axis=1), np.tile(np.arange(n) % 3, (3, 1)), np.ones((1, n))))
    for reach in (1, max(1, n // 4)):
        corr, lag = spectrum._lag(x, y, reach)
        for row in range(len(x)):
            k, c = plain_lag(x[row], y[row], reach)
            assert corr[row] == pytest.approx(c, abs=1e-12) and (lag[row] == k or c == 0)


def test_lag_of_a_long_series():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2, 100_000)).cumsum(axis=1) * 0.01 + rng.normal(size=(2, 100_000))
    y = np.concatenate((np.zeros((2, 17_000)), x[:, :-17_000]), axis=1)
    corr, lag = spectrum._lag(x, y, 25_000)
    assert lag.tolist() == [17_000, 17_000] and (np.abs(corr) > 0.5).all()
