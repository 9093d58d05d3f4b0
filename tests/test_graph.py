import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonde.operators import detect as DT
from sonde.operators import graph as G
from sonde.operators import hypotheses as H
from sonde.operators import rank as RK
from sonde.operators import spans as SP
from sonde.operators import spectral as X

EDGES = [("a", "b", 0.9), ("b", "c", 0.4), ("a", "c", 0.3), ("c", "a", 0.8), ("c", "d", 0.7), ("d", "e", 0.6), ("e", "f", 0.5), ("f", "g", 0.9), ("g", "h", 0.95)]
NODES = sorted({n for e in EDGES for n in e[:2]} | {"alone"})


def edges(spark):
    return spark.createDataFrame([(1, s, t, w) for s, t, w in EDGES], "incident_id int, source string, target string, weight double")


def nodes(spark, scores=None):
    rows = [(1, n, (scores or {}).get(n, 0.5), 100 + i, i + 1) for i, n in enumerate(NODES)]
    return spark.createDataFrame(rows, "incident_id int, component string, score double, first_ts long, rank int")


def widest(origin, depth):
    best = {origin: 1.0}
    frontier = {origin: 1.0}
    for _ in range(depth):
        nxt = {}
        for n, s in frontier.items():
            for a, b, w in EDGES:
                if a == n:
                    nxt[b] = max(nxt.get(b, 0.0), min(s, w))
        for n, s in nxt.items():
            best[n] = max(best.get(n, 0.0), s)
        frontier = nxt
    return best


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_influence_on_a_cyclic_graph(spark, depth):
    got = {(r.origin, r.node): r.strength for r in G.influence(edges(spark), nodes(spark), depth).collect()}
    want = {(o, n): s for o in NODES for n, s in widest(o, depth).items()}
    assert got == pytest.approx(want)


def test_reach_and_distances(spark):
    every = spark.createDataFrame([(1, n) for n in NODES], "incident_id int, component string")
    reach = {(r.origin, r.node) for r in G.reach_from(edges(spark), every).collect()}
    assert {(r.origin, r.node) for r in G.reach_from(edges(spark), every.filter("component IN ('a', 'alone')")).collect()} == {x for x in reach if x[0] == "a"}
    assert reach == {(o, n) for o in NODES for a, b, _ in EDGES if a == o for n in widest(b, 20)}
    calls = spark.createDataFrame([(1, "a", "b", 1), (1, "b", "c", 1), (1, "a", "x", 1), (1, "x", "c", 1), (1, "z", "y", 1)],
                                  "incident_id int, caller string, callee string, calls long")
    own = spark.createDataFrame([(1, "a"), (1, "c")], "incident_id int, component string")
    pick = lambda mode: {r.component for r in G.select_nodes(calls, own, mode).collect()}
    assert pick("none") == {"a", "c"} and pick("direct") == {"a", "b", "c", "x"} and pick("full_path") == {"a", "b", "c", "x"}


def test_calls_need_a_parent_in_the_same_trace(spark):
    rows = [("t1", "1", None, "a"), ("t1", "2", "1", "b"), ("t1", "3", "1", "b"), ("t1", "4", "9", "c"), ("t2", "5", "1", "c"),
            ("t1", "2", "1", "z"), ("t1", "6", "2", "b")]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, component string")
    got = {(r.caller, r.callee): r.calls for r in SP.call_pairs(df).collect()}
    assert got == {("a", "b"): 2, ("a", "z"): 1}


def test_graph_consistency_and_path(spark):
    e = spark.createDataFrame([(1, "A", "B", 0.8), (1, "B", "C", 0.5)], "incident_id int, source string, target string, weight double")
    n = spark.createDataFrame([(1, "A", 0.9), (1, "B", 0.6), (1, "C", 0.3)], "incident_id int, component string, score double")
    paths = spark.createDataFrame([(1, "down", ["A", "B", "C"]), (1, "up", ["C", "B", "A"]), (1, "short", ["A"])], "incident_id int, path_id string, path array<string>")
    got = {r.path_id: r.path_score for r in X.path_scores(paths, e, n).collect()}
    assert got == pytest.approx({"down": 0.65, "up": 0.0, "short": 0.0})
    c = spark.createDataFrame([(0.9, 0.6), (0.3, 0.6), (0.0, 0.0)], "s double, t double").select(X.graph_consistency(F.col("s"), F.col("t")).alias("c"))
    assert [r.c for r in c.collect()] == pytest.approx([0.6, 1 / 3, 0.0])


def test_isolated_nodes_point_to_later_ones(spark):
    rows = [(1, "db_1", 0.9, 100), (1, "a", 0.5, 160), (1, "b", 0.5, 50)]
    n = spark.createDataFrame(rows, "incident_id int, component string, score double, first_ts long")
    e = spark.createDataFrame([(1, "a", "b", 0.4)], "incident_id int, source string, target string, weight double")
    got = [(r.source, r.target, r.weight) for r in G.isolated_edges(e, n).collect()]
    assert got == [("db_1", "a", pytest.approx(0.40 / 1.5 + 0.35 * 0.55 + 0.25, abs=1e-6))]


def test_lag_scores_know_the_direction(spark):
    import numpy as np
    x = np.random.default_rng(0).random(40)
    rows = [(1, "s", "t", i, float(x[i]), float(x[i - 2]) if i >= 2 else 0.0) for i in range(40)] + [(1, "f", "t", i, 1.0, float(x[i])) for i in range(5)]
    df = spark.createDataFrame(rows, "incident_id int, source string, target string, ts long, x double, y double")
    got = {r.source: r for r in G.lag_scores(df).collect()}
    assert got["s"].lag_corr > 0.99 and got["s"].lead_score > 0.6
    assert got["f"].lag_corr == 0.0 and got["f"].lead_score == 0.5


def test_belief_states(spark):
    ev = spark.createDataFrame([(1, "a", "k", 0.9, "slow_trend_anomaly"), (1, "b", "k", 0.15, "no_strong_spectral_anomaly"), (2, "c", "k", 0.12, "no_strong_spectral_anomaly")],
                               "incident_id int, component string, kpi string, final_score double, spectral_class string")
    ed = spark.createDataFrame([(1, "a.k", "b.k", 0.6, True)], "incident_id int, source string, target string, weight double, keep boolean")
    rk = spark.createDataFrame([(1, "a.k", 0.5, 1), (1, "b.k", 0.1, 2), (2, "c.k", 0.1, 1)], "incident_id int, node string, root_score double, rank int")
    hy = H.believe(H.hypothesise(ev, rk), ev, ed)
    got = {r.node: r for r in hy.collect()}
    assert got["a.k"].belief_state == "validated" and got["a.k"].confidence == pytest.approx(0.9 + 0.06)
    assert got["b.k"].belief_state == "spectral_rejected" and got["b.k"].n_against == 3
    # nothing convincing: the hypothesis is sent back after every round
    assert got["c.k"].belief_state == "hypothesized" and got["c.k"].confidence == 0.0
    new = {r.node: r.new_score for r in H.rerank(rk, hy).collect()}
    assert new["a.k"] == pytest.approx(0.98) and new["b.k"] == 0.1


def test_select_causes_keeps_a_gap_and_fills_up(spark):
    rows = [(1, "a", 0, 0.9, "a"), (1, "b", 100, 0.8, "b"), (1, "c", 700, 0.7, "c"), (1, "d", 710, 0.6, "d")]
    cand = spark.createDataFrame(rows, "incident_id int, component string, ts long, score double, key string")
    inc = spark.createDataFrame([(1, 0, 1800, 3)], "incident_id int, start_ts long, end_ts long, failure_count int")
    got = [(r.component, r.position) for r in RK.select_causes(cand, inc).orderBy("position").collect()]
    assert got == [("a", 1), ("b", 2), ("c", 3)]  # b only fills the place that the gap left open


def plain_causes(rows, start, end, n, fill):
    gap, chosen = max(60.0, (end - start) / (2.0 * n)), []
    order = sorted(rows, key=lambda r: (r[2], r[3], -r[1]), reverse=True)
    for r in order:
        if len(chosen) < n and all(abs(r[1] - c[1]) >= gap for c in chosen):
            chosen.append(r)
    for r in order:
        if fill and len(chosen) < n and r not in chosen:
            chosen.append(r)
    return sorted((r[1], r[0]) for r in chosen)


def test_select_causes_for_any_number(spark):
    rng = np.random.default_rng(5)
    rows, inc, expected = [], [], {}
    for i in range(12):
        n = int(rng.integers(1, 8))
        mine = list({(f"c{rng.integers(0, 6)}", int(rng.integers(0, 1800))): None for _ in range(int(rng.integers(1, 15)))})
        mine = [(c, t, round(float(rng.random()), 3), f"{c}.{t}") for c, t in mine]
        rows += [(i, *r) for r in mine]
        inc.append((i, 0, 1800, n))
        expected[i] = (mine, n)
    cand = spark.createDataFrame(rows, "incident_id int, component string, ts long, score double, key string")
    frame = spark.createDataFrame(inc, "incident_id int, start_ts long, end_ts long, failure_count int")
    for fill in (True, False):
        got = {}
        for r in RK.select_causes(cand, frame, fill_up=fill).orderBy("incident_id", "position").collect():
            got.setdefault(r.incident_id, []).append((r.ts, r.component))
        assert {i: sorted(v) for i, v in got.items()} == {i: plain_causes(m, 0, 1800, n, fill) for i, (m, n) in expected.items()}


def test_onset_rules(spark):
    late = [0.1] * 14 + [0.2, 0.9, 0.95, 0.4]
    cases = [[0.1, 0.35, 0.1, 0.4, 0.2], [0.1, 0.31], [0.1, 0.2], [0.0, 0.1, 0.9, 1.0], [0.5], late]
    rows = [(1, "c", f"k{i}", j * 10, 1.0, d, "high", 1.0, 10) for i, c in enumerate(cases) for j, d in enumerate(c)]
    points = spark.createDataFrame(rows, "incident_id int, component string, kpi string, ts long, value double, deviation double, "
                                         "direction string, threshold double, median_gap long")
    out = DT.segments_b(points, [], beta=-1.0, min_points=1).orderBy("kpi").collect()
    assert [r.sustained_ts for r in out] == [30, 10, 0, 20, 0, 150] and [len(r.points) for r in out] == [min(10, len(c)) for c in cases]

    def steep(c):
        if len(c) == 1:
            return 0
        first = next(i for i, d in enumerate(c) if d >= 0.5 * max(c))
        best, at = 0.0, first
        for i in range(max(0, first - 2), min(len(c) - 1, first + 3)):
            if c[i + 1] - c[i] > best:
                best, at = c[i + 1] - c[i], i
        return at * 10

    assert [r.steepest_ts for r in out] == [steep(c) for c in cases]


def test_widest_paths_of_all_small_graphs_agree_with_enumeration():
    def paths(o, d, seen):
        yield [o]
        if d:
            for a, b, _ in EDGES:
                if a == o:
                    for p in paths(b, d - 1, seen):
                        yield [o, *p]
    w = {(a, b): x for a, b, x in EDGES}
    for o in NODES:
        best = {}
        for p in paths(o, 4, ()):
            s = min([w[x] for x in itertools.pairwise(p)], default=1.0)
            best[p[-1]] = max(best.get(p[-1], 0), s)
        assert best == widest(o, 4)


def test_five_hundred_causes(spark):
    """The rounds follow how far the best rows lie apart, not how many are asked for; the plan stays small."""
    rng = np.random.default_rng(6)
    mine = list({(f"c{rng.integers(0, 9)}", int(rng.integers(0, 86_400))): None for _ in range(3000)})
    mine = [(c, t, round(float(rng.random()), 2), f"{c}.{t}") for c, t in mine]
    cand = spark.createDataFrame([(1, *r) for r in mine], "incident_id int, component string, ts long, score double, key string")
    inc = spark.createDataFrame([(1, 0, 86_400, 500)], "incident_id int, start_ts long, end_ts long, failure_count int")
    for fill in (True, False):
        found = RK.select_causes(cand, inc, fill_up=fill)
        assert found._jdf.queryExecution().analyzed().toString().count("\n") < 60
        assert sorted((r.ts, r.component) for r in found.collect()) == plain_causes(mine, 0, 86_400, 500, fill)


def test_packed_graphs_agree_with_plain_walks(spark):
    """Random graphs of several incidents, with cycles, loops, repeated edges and marked components outside the graph."""
    rng = np.random.default_rng(8)
    rows, own = [], []
    for i in range(6):
        n, m = int(rng.integers(1, 12)), int(rng.integers(0, 25))
        rows += [(i, f"n{rng.integers(0, n)}", f"n{rng.integers(0, n)}", float(rng.integers(0, 9)) / 10) for _ in range(m)]
        own += [(i, f"n{k}") for k in range(0, n + 2, 2)]
    rows += [(None, "x", "y", 0.5), (0, None, "n0", 0.5)]
    e = spark.createDataFrame(rows, "incident_id int, source string, target string, weight double")
    o = spark.createDataFrame(own + own[:3] + [(None, "x"), (99, "lost")], "incident_id int, component string")
    rows = [r for r in rows if None not in r]
    strength, reach, inside = {}, set(), set()
    for i in {i for i, _ in own} | {99}:
        mine = [r[1:] for r in rows if r[0] == i]
        marked = sorted({c for j, c in own if j == i}) if i != 99 else ["lost"]
        hops = {}
        for c in marked:
            state = {c: 1.0}
            for _ in range(3):
                for t, s in [(t, min(state[a], w)) for a, t, w in mine if a in state]:
                    state[t] = max(state.get(t, -1.0), s)
            strength.update({(i, c, k): v for k, v in state.items()})
            seen, front = set(), {c}
            while front:
                front = {t for a, t, _ in mine if a in front} - seen
                seen |= front
            reach |= {(i, c, k) for k in seen}
            hops[c], d, front = {c: 0}, 0, {c}
            while front:
                d += 1
                front = ({t for a, t, _ in mine if a in front} | {a for a, t, _ in mine if t in front}) - set(hops[c])
                hops[c].update(dict.fromkeys(front, d))
        inside |= {(i, v) for s in marked for t in marked if t in hops[s] for v in hops[s] if v in hops[t] and hops[s][v] + hops[t][v] == hops[s][t]}
    got = [(r.incident_id, r.origin, r.node, r.strength) for r in G.influence(e, o, 3).collect()]
    assert len(got) == len(strength) and {g[:3]: g[3] for g in got} == pytest.approx(strength)
    assert sorted((r.incident_id, r.origin, r.node) for r in G.reach_from(e, o).collect()) == sorted(reach)
    known = {(i, c) for i, c, _ in strength if (i, c, c) in strength} & ({*own} | {(99, "lost")})
    counts = {(r.incident_id, r.component): r.reach for r in G.reach_counts(e, o).collect()}
    assert counts == {k: sum(1 for i, c, v in reach if (i, c) == k and v != c and (i, v) in known) for k in known}
    calls = e.withColumnsRenamed({"source": "caller", "target": "callee"})
    assert sorted((r.incident_id, r.component) for r in G.between(calls, o).collect()) == sorted(inside)
    assert G.influence(e.limit(0), o.limit(0)).count() == G.reach_counts(e, o.limit(0)).count() == 0


def test_wide_graph_in_blocks(spark, monkeypatch):
    """A graph of 900 components in a ring with chords: the blocks change nothing, and no reached pair is shuffled."""
    n = 900
    rows = [(1, f"n{i}", f"n{(i + 1) % n}", 0.5) for i in range(n)] + [(1, f"n{i}", f"n{(i * 7) % n}", 0.9) for i in range(n)]
    e = spark.createDataFrame(rows, "incident_id int, source string, target string, weight double")
    o = spark.createDataFrame([(1, f"n{i}") for i in range(n)], "incident_id int, component string")
    assert {r.reach for r in G.reach_counts(e, o).collect()} == {n - 1}
    assert len(G._blocks(900, 1800)) == 1 and len(G._blocks(9000, 1800)) == 5
    whole = {(r.origin, r.node): r.strength for r in G.influence(e, o, 4).collect()}
    # with one value a block every origin and every wanted node is a block of its own
    some = o.filter("component IN ('n0', 'n5', 'n77')")
    real = G._blocks
    monkeypatch.setattr(G, "_blocks", lambda k, width: [slice(i, i + 1) for i in range(k)])
    assert {(r.origin, r.node): r.strength for r in G.influence(e, some, 4).collect()} == {k: v for k, v in whole.items() if k[0] in ("n0", "n5", "n77")}
    monkeypatch.setattr(G, "_blocks", real)
