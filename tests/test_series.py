import numpy as np
import pytest
from pyspark.sql import functions as F

from sonde.functions import spectrum as X
from sonde.operators import spectral as SP
from sonde.operators import stats as ST
from sonde.operators import windows as WN


def frame(spark, pairs):
    rows = [(1, f"c{i}", "k", [float(v) for v in inc], [float(v) for v in base]) for i, (inc, base) in enumerate(pairs)]
    return spark.createDataFrame(rows, "incident_id int, component string, kpi string, inc array<double>, base array<double>")


def plain_features(x):
    p = np.abs(np.fft.rfft(x - np.mean(x)))[1:] ** 2
    n, e = len(p), p.sum()
    third = max(1, n // 3)
    q = p[p > 0] / e
    return {"total_energy": e, "low_ratio": p[:third].sum() / e, "mid_ratio": p[third:2 * third].sum() / e,
            "high_ratio": p[2 * third:].sum() / e, "dominant_index": p.argmax(), "dominant_ratio": p.max() / e,
            "entropy": -(q * np.log2(q)).sum()}


def test_features_of_known_signals(spark):
    rng = np.random.default_rng(1)
    t = np.arange(60)
    signals = [rng.normal(50, 10, 60), t * 1.0 + rng.normal(0, 1, 60), 10 * np.sin(2 * np.pi * t / 5), np.where(t % 2, 5.0, -5.0), rng.normal(size=7)]
    rows = SP.features(frame(spark, [(s, s) for s in signals])).orderBy("component").collect()
    for s, r in zip(signals, rows):
        for name, want in plain_features(s).items():
            assert r[name] == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert r.low_ratio + r.mid_ratio + r.high_ratio == pytest.approx(1.0)
    assert rows[1].low_ratio > 0.9 and rows[3].high_ratio > 0.9 and rows[2].dominant_index == 11


def test_two_days_of_minutes(spark):
    x = np.random.default_rng(2).normal(50, 10, 2880)
    row = SP.features(frame(spark, [(x, x)])).first()
    for name, want in plain_features(x).items():
        assert row[name] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_silent_and_short_series(spark):
    out = SP.spectral_scores(frame(spark, [([5.0] * 10, [5.0] * 30), ([1.0, 2.0], [1.0]), ([3.0], [1.0, 2.0])])).orderBy("component").collect()
    assert out[0].total_energy == 0 and out[0].spectral_class == "no_strong_spectral_anomaly"
    assert all(r.spectral_score is not None for r in out)


def test_traditional_scores(spark):
    rng = np.random.default_rng(42)
    base, normal, shifted = rng.normal(50, 10, 100), rng.normal(50, 10, 30), rng.normal(80, 10, 30)
    out = ST.traditional_scores(frame(spark, [(normal, base), (shifted, base), ([1.0, 2.0], [0.0] * 5)])).orderBy("component").collect()
    med = np.median(base)
    mad = np.median(np.abs(base - med))
    assert out[1].max_abs_z == pytest.approx(np.abs(shifted - med).max() / (1.4826 * mad + 1e-8))
    assert out[1].q99 == pytest.approx(np.quantile(base, 0.99))
    assert out[1].traditional_score > out[0].traditional_score
    assert out[2].threshold_score == 0.0  # threshold not above zero


def test_evidence_flags(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(50, 5, 90)
    hit = np.concatenate([rng.normal(50, 5, 10), rng.normal(150, 5, 10), rng.normal(50, 5, 10)])
    df = frame(spark, [(hit, base), (hit[:5], base), (hit, base[:3])])
    r = SP.anomaly_evidence(df).orderBy("component").collect()
    assert r[0].final_score > 0.5 and r[0].quality_flag == "ok" and "c0.k" in r[0].explanation
    assert r[1].quality_flag == "too_short_for_spectral" and r[1].spectral_score == 0.0
    assert r[2].quality_flag == "insufficient_data" and r[2].final_score == 0.0


def test_pair_measures_find_the_lag(spark):
    rng = np.random.default_rng(5)
    src = rng.normal(size=60)
    lagged, other = np.roll(src, 5), rng.normal(size=50)
    df = spark.createDataFrame([(0, src.tolist(), lagged.tolist()), (1, src.tolist(), other.tolist()), (2, [1.0] * 8, src[:8].tolist())],
                               "i int, x array<double>, y array<double>")
    m = [r.m for r in df.select("i", X.pair_measures("x", "y").alias("m")).orderBy("i").collect()]
    assert m[0].best_lag == 5 and m[0].lag_corr > 0.8 and m[0].shape > 0.9 and m[0].freq_match == 1.0
    assert abs(m[1].lag_corr) < m[0].lag_corr
    assert m[2].lag_corr == 0.0 and m[2].phase == 0.5


def test_resample_and_fill(spark):
    rows = [("a", "k", 0, 0, 1.0), ("a", "k", 0, 30, 3.0), ("a", "k", 0, 200, 8.0)]
    df = spark.createDataFrame(rows, "component string, kpi string, day long, ts long, value double")
    bins = WN.resample(df, 60)
    assert [(r.ts, r.value) for r in bins.orderBy("ts").collect()] == [(0, 2.0), (60, None), (120, None), (180, 8.0)]
    assert [r.value for r in WN.fill_missing(bins).orderBy("ts").collect()] == [2.0, 4.0, 6.0, 8.0]
    assert [r.value for r in WN.fill_missing(bins, "ffill").orderBy("ts").collect()] == [2.0, 2.0, 2.0, 8.0]
    assert [r.value for r in WN.fill_missing(bins, "zero").orderBy("ts").collect()] == [2.0, 0.0, 0.0, 8.0]
    gaps = bins.withColumn("value", F.when(F.col("ts") == 60, 4.0))
    assert [r.value for r in WN.fill_missing(gaps).orderBy("ts").collect()] == [4.0] * 4


def test_window_join_meets_each_pair_once(spark):
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(int(t),) for t in rng.integers(0, 20000, 500)], "ts long")
    wins = spark.createDataFrame([(i, int(s), int(s + w)) for i, (s, w) in enumerate(zip(rng.integers(0, 18000, 20), rng.integers(0, 7000, 20)))],
                                 "incident_id int, start_ts long, end_ts long")
    got = WN.window_join(rows, wins).groupBy("incident_id").count().collect()
    ts = [r.ts for r in rows.collect()]
    want = {w.incident_id: sum(w.start_ts <= t <= w.end_ts for t in ts) for w in wins.collect()}
    assert {r["incident_id"]: r["count"] for r in got} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_exact_percentiles(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {"hot": rng.lognormal(3, 2, 30000), "ties": rng.integers(0, 4, 5000).astype(float), "one": np.array([4.0]), "two": np.array([1.0, 2.0]),
              **{f"g{n}": rng.normal(size=n) for n in (3, 10, 55, 100, 999, 1000, 1001)}}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    probs = {"a": 0.05, "b": 0.5, "c": 0.95, "d": 0.99}
    for r in ST.exact_percentiles(df, ["k"], "v", probs).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(groups[r.k], p), rel=1e-12), (r.k, p)
    for r in ST.exact_percentiles(df, ["k"], "v", probs, interpolate=False).collect():
        s = np.sort(groups[r.k])
        for name, p in probs.items():
            assert r[name] == s[min(len(s) - 1, int(np.floor(len(s) * p)))], (r.k, p)


def test_day_thresholds_edge_series(spark):
    rows = [("one", "k", 0, 5, 3.0)] + [("flat", "k", 0, t, 7.0) for t in range(0, 600, 60)] + [("dup", "k", 0, 1, 1.0), ("dup", "k", 0, 1, 3.0), ("dup", "k", 0, 61, 4.0)]
    df = spark.createDataFrame(rows, "component string, kpi string, day long, ts long, value double")
    out = {r.component: r for r in ST.day_thresholds(df).collect()}
    assert out["one"].std == 0.0 and out["one"].median_gap == 60 and out["one"].scale == pytest.approx(0.15)
    assert out["flat"].scale == pytest.approx(0.35) and out["dup"].n == 2 and out["dup"].median == 3.0
    assert {r.component for r in ST.drop_dead_series(ST.day_thresholds(df)).collect()} == {"dup"}
