import itertools
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sonde.functions import fixed as V
from sonde.operators import evaluate as E
from sonde.operators import memory as M
from sonde.operators import sample as SM
from sonde.operators import tasks as TK


def answer(n, t=None, c=None, r=None):
    parts = [f'"root cause {k}": "{v}"' for k, v in (("occurrence datetime", t), ("component", c), ("reason", r)) if v]
    return f'"{n}": {{{", ".join(parts)}}}'


def text(*entries):
    return "{" + ",\n ".join(entries) + "}"


def criteria(*rows):
    out = []
    for i, (t, c, r) in enumerate(rows):
        idx = "only" if len(rows) == 1 else f"{i + 1}-th"
        out += [f"The {idx} root cause occurrence time is within 1 minutes (i.e., <=1min) of {t}"] * bool(t)
        out += [f"The {idx} predicted root cause component is {c}"] * bool(c)
        out += [f"The {idx} predicted root cause reason is {r}"] * bool(r)
    return "\n".join(out) + "\n"


def run(spark, *cases):
    df = spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(cases)], "i int, prediction string, scoring_points string")
    return E.score_predictions(df).orderBy("i").collect()


def test_scoring(spark):
    t = "2021-03-04 14:30:00"
    out = run(
        spark,
        (text(answer(1, "2021-03-04 14:31:00", "A", "x")), criteria((t, "A", "y"))),
        (text(answer(1, c="B"), answer(2, c="A")), criteria((None, "A", None), (None, "B", None))),
        (text(answer(1, c="A"), answer(2, c="B")), criteria((None, "A", None))),
        (text(answer(1, c="A")), ""),
        ('{"1": {"root cause component": "A", "root cause occurrence datetime": "2021-03-04 14:30:00"}}', criteria((t, "A", None))),
        (text(answer(1, "not a time", "A")), criteria((t, "A", None))),
        ("nothing", criteria((t, "A", None))))
    assert [r.score for r in out] == [0.67, 1.0, 0.0, None, 0.0, 0.5, 0.0]
    assert out[0].passed == [t, "A"][::-1] and out[0].failed == ["y"]
    assert out[1].passed == ["A", "B"] and sorted(out[2].failed) == ["A"]


def sparse(gain):
    return [{j: g for j, g in enumerate(row) if g} for row in gain]


def test_first_best_order_among_all_orders():
    random.seed(8)
    for _ in range(400):
        n = random.randint(1, 5)
        gain = [[random.choice((0, 0, 1, 2, 3)) for _ in range(n)] for _ in range(n)]
        best = max(itertools.permutations(range(n)), key=lambda p: (sum(gain[i][p[i]] for i in range(n)), tuple(-j for j in p)))
        assert tuple(E.first_order(sparse(gain))) == best
    many = np.random.default_rng(0).integers(0, 4, (40, 40))
    assert sorted(E.first_order(sparse(many.tolist()))) == list(range(40))


def test_five_causes(spark):
    rows = [(f"2021-03-04 14:{10 * i:02d}:00", "ABCDE"[i], "vwxyz"[i]) for i in range(5)]
    out = run(spark, (text(*[answer(i + 1, *r) for i, r in enumerate(rows[::-1])]), criteria(*rows)),
              (text(*[answer(i + 1, *r) for i, r in enumerate(rows[:4])]), criteria(*rows)))
    assert [r.score for r in out] == [1.0, 0.0] and len(out[0].passed) == 15 and not out[0].failed


def test_large_tasks_match_all_orders(spark):
    random.seed(3)
    for n in (3, 5, 6):
        pred = [(f"2021-03-04 1{random.randint(0, 3)}:00:00", random.choice("ABC"), random.choice("xyz")) for _ in range(n)]
        want = [(f"2021-03-04 1{random.randint(0, 3)}:00:00", random.choice("ABC"), random.choice("xyz")) for _ in range(n)]
        row = run(spark, (text(*[answer(i + 1, *p) for i, p in enumerate(pred)]), criteria(*want)))[0]
        best, passed = -1, None
        for perm in itertools.permutations(pred):
            got = [w[k] for p, w in zip(perm, want) for k in (1, 2, 0) if p[k] == w[k]]
            if len(got) > best:
                best, passed = len(got), got
        assert row.passed == passed
        assert row.score == pytest.approx(round(best / (3 * n), 2))


def test_assignment_matches_enumeration():
    rng = np.random.default_rng(0)
    for n in range(1, 7):
        for _ in range(20):
            g = rng.integers(0, 4, (n, n))
            column, u, v = E.matching(sparse(g.tolist()))
            assert all(u[i] + v[j] >= g[i, j] for i in range(n) for j in range(n)) and min(u + v) >= 0
            assert sum(g[i, column[i]] for i in range(n) if column[i] >= 0) == sum(u) + sum(v) == max(sum(g[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_fourteen_hundred_answers_of_a_half_hour(spark):
    """Few components and reasons, times that crowd: a bounded time, and the total of the answers put back in order."""
    rng = random.Random(4)
    want = [(f"2021-03-04 14:{rng.randrange(30):02d}:{rng.randrange(60):02d}", rng.choice("ABCDEFGHIJKL"), rng.choice("rstuvwxyz")) for _ in range(1400)]
    start = time.time()
    row = run(spark, (text(*[answer(i + 1, *p) for i, p in enumerate(rng.sample(want, len(want)))]), criteria(*want)))[0]
    assert row.score == 1.0 and len(row.passed) == 4200 and time.time() - start < 90


def test_alignment_refuses_unequal_lengths(spark):
    a = spark.createDataFrame([(0, "p"), (1, "q")], "row_id int, prediction string")
    b = spark.createDataFrame([(0, "s"), (1, "t")], "row_id int, scoring_points string")
    assert E.align(a, b).count() == 2
    with pytest.raises(Exception, match="differ in length"):
        E.align(a, b.limit(1)).collect()


@pytest.mark.parametrize("pool", [300, 7, None])
def test_greedy_sample_is_the_plain_one(spark, pool):
    random.seed(1)
    rows = [(1, f"t{i:04d}", random.choice("rs"), f"p{i % 7}", sorted(random.sample("abcdefgh", random.randint(1, 4))), float(random.randint(0, 3))) for i in range(420)]
    df = spark.createDataFrame(rows, "incident_id int, trace_id string, root string, pattern_id string, eps array<string>, anomaly double")

    def plain(items, budget):
        left, out = sorted(items, key=lambda x: (-x[5], x[1])), []
        while left and len(out) < budget:
            def score(x):
                near = max((len(set(x[4]) & set(s[4])) / len(set(x[4]) | set(s[4])) for s in out), default=0.0)
                return x[5] + 1.0 - near
            best = max(range(min(pool or len(left), len(left))), key=lambda j: (score(left[j]), -j))
            out.append(left.pop(best))
        return out

    budget = 21
    chosen = [x for root in "rs" for x in plain([r for r in rows if r[2] == root], budget // 2)]
    ids = {x[1] for x in chosen}
    chosen += plain([r for r in rows if r[1] not in ids], budget - len(chosen))
    got = {r.trace_id for r in SM.diverse_traces(df, budget, pool).collect()}
    assert got == {x[1] for x in chosen} and len(got) == budget


def test_similar_cases(spark):
    store = spark.createDataFrame([(1, "a", "t", "r", {"x": 1.0, "y": 1.0}, True), (2, "b", "t", "r", {"x": -1.0}, True), (3, "c", "u", "r", {"z": 2.0}, False)],
                                  "case_id long, component string, anomaly_type string, reason string, pattern map<string,double>, success boolean")
    q = spark.createDataFrame([("q1", "a", "t", {"x": 2.0, "y": 2.0}), ("q2", "new", "new", {"z": 1.0}), ("q3", "c", "zz", {})],
                              "query_id string, component string, anomaly_type string, pattern map<string,double>")
    got = {(r.query_id, r.case_id): r.similarity for r in M.similar_cases(q, store).collect()}
    assert got == pytest.approx({("q1", 1): 1.0, ("q1", 2): 0.2 - 1 / 2 ** 0.5, ("q2", 1): 0.0, ("q2", 2): 0.0, ("q2", 3): 1.0, ("q3", 3): 0.2}, abs=1e-6)


def test_criteria_of_a_hot_half_hour(spark):
    """Over half of 1,500 failures in one half hour, ties in time: rows by number, one text per task type that occurs."""
    rows = [(i, (7 if i % 5 < 3 else 50 + i % 200) * 1800 + (i * 37 % 1800) // 60, f"c{i % 9}", None if i == 11 else f"r{i % 4}") for i in range(1500)]
    df = spark.createDataFrame(rows, "row_id long, ts long, component string, reason string").repartition(6)
    got = {(r.slot, r.position): r for r in TK.criteria(df).collect()}
    per: dict = {}
    for r in rows:
        per.setdefault(r[1] // 1800 * 1800, []).append(r)
    texts = {r.row_id: r for r in TK.generate_tasks(df).collect()}
    assert len(got) == len(texts) == 1500 and len(per[7 * 1800]) == 900
    for slot, inside in per.items():
        for place, r in enumerate(sorted(inside, key=lambda x: (x[1], x[0])), 1):
            row = got[slot, place]
            assert (row.row_id, row.ts, row.component, row.reason) == r
            assert row.idx == (f"{place}-th" if len(inside) > 1 else "only")
            assert texts[r[0]].num == len(inside)
            found = re.findall(V.COMPONENT_CRITERION_RE, texts[r[0]].scoring_points)
            if found:
                assert found == [x[2] for x in sorted(inside, key=lambda x: (x[1], x[0]))]
    lines = TK.criteria_lines(TK.task_rows(df), TK.criteria(df))
    assert lines.count() <= 7 * 1500 and lines.groupBy("slot", "task_index", "position").count().filter("count > 1").count() == 0
    assert TK.criteria(df.limit(0)).count() == TK.generate_tasks(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows, direct", [(7, 0), (4096, 0), (4096, 50_000)])
def test_similar_cases_equal_full_scan(spark, rows, direct):
    """Hot component, alike cases, negative weights, empty and null patterns, null components and types."""
    rng = random.Random(3)

    def pattern():
        return {f"f{i}": rng.choice([-1.0, 0.5, 1.0, 2.0, rng.random()]) for i in rng.sample(range(12), rng.randint(1, 5))}

    alike = [pattern() for _ in range(6)]
    store = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", None]), rng.choice(["t", "u", None]),
              rng.choice([pattern(), rng.choice(alike), rng.choice(alike), {}, None])) for i in range(400)]
    asked = [(f"q{i}", rng.choice(["hot", "a", "new", None]), rng.choice(["t", "new", None]), rng.choice([pattern(), rng.choice(alike)])) for i in range(25)]
    asked += [("empty", "hot", "t", {}), ("null", None, None, None), ("alone", "new", "new", alike[0])]

    def score(q, c):
        a, b = q[3] or {}, c[3] or {}
        na, nb = (sum(v * v for v in m.values()) ** 0.5 for m in (a, b))
        cos = sum(v * b.get(f, 0.0) for f, v in a.items()) / (na * nb) if na and nb else 0.0
        same = [x is not None and x == y for x, y in zip(q[1:3], c[1:3])]
        return any(same), round(min(1.0, cos + 0.2 * same[0] + 0.2 * same[1]), 6)

    q = spark.createDataFrame(asked, "query_id string, component string, anomaly_type string, pattern map<string,double>")
    s = spark.createDataFrame(store, "case_id long, component string, anomaly_type string, pattern map<string,double>").repartition(5)
    everything, pairs = {}, set()
    for x in asked:
        met = [(c[0], score(x, c)) for c in store]
        kept = [m for m in met if m[1][0]] or met
        pairs |= {(x[0], c) for c, _ in kept}
        everything[x[0]] = sorted(((v, c) for c, (_, v) in kept), key=lambda r: (-r[0], r[1]))
    assert {tuple(r) for r in M.relevant_pairs(q, s).collect()} == pairs
    for k in (3, None):
        got = {}
        for r in M.similar_cases(q, s, k, rows, direct).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.similarity, r.case_id)
        for name, want in everything.items():
            # scores that differ by rounding alone may swap ties
            assert [got[name][i + 1][0] for i in range(len(got[name]))] == pytest.approx([v for v, _ in want[:k]], abs=2e-6)
            assert len({c for _, c in got[name].values()}) == len(want[:k])
            assert all(abs(v - dict((c, w) for w, c in want)[c]) < 2e-6 for v, c in got[name].values())
    assert M.similar_cases(q, s.limit(0), direct=direct).count() == M.similar_cases(q.limit(0), s, direct=direct).count() == 0


def test_blocks_out_of_reach_are_not_scored(spark):
    """20,000 cases of one component in 20 shapes: a query scores the blocks of its own shape only."""
    i = F.col("id")
    store = spark.range(20_000).select(i.alias("case_id"), F.lit("c").alias("component"), F.lit("t").alias("anomaly_type"), F.create_map(
        F.concat(F.lit("f"), (i % 20).cast("string")), F.lit(1.0), F.lit("rest"), (i % 7) / 1000).alias("pattern"))
    queries = spark.createDataFrame([("q", "c", "t", {"f4": 1.0})], "query_id string, component string, anomaly_type string, pattern map<string,double>")
    blocks = M.case_blocks(store, 100)
    sizes = blocks.groupBy("block").count().agg(F.max("count"), F.sum("count"), F.count("*")).first()
    assert sizes[0] < 200 and sizes[1] == 20_000 and sizes[2] >= 190
    near = M.block_bounds(blocks).filter(F.try_element_at("most", F.lit("f4")) > 0.5)
    assert near.agg(F.sum("n")).first()[0] == 1000
    found = M.similar_cases(queries, store, 3, 100, direct=0).orderBy("rank").collect()
    # full likeness and both bonuses: at most 1, so the first ids of the shape
    assert [(r.case_id, r.similarity) for r in found] == [(4, 1.0), (24, 1.0), (44, 1.0)]


@pytest.mark.parametrize("rare", [0, 12, 1000])
def test_case_retrieval_equals_full_scan(spark, rare):
    random.seed(9)
    words = [f"w{i}" for i in range(30)]
    # most cases hold "common"; components and dataset of many cases are alike, some are missing
    case = [(i, sorted(random.sample(words, 4)) + (["common"] if i % 5 else []), [f"c{i % 4}"], f"d{i % 3}") for i in range(60)]
    case += [(90, None, None, None), (91, [], ["c1", "c2", "c1"], "d0"), (92, ["w1", "w1", "w2"], [], None)]
    query = [(f"q{i}", sorted(random.sample(words, 3)) + ["common"] * (i % 2) if i else ["none"], [f"c{i}"], f"d{i % 4}") for i in range(8)]
    query += [("all", words, ["c0", "c1", "c3"], "d1"), ("null", None, None, None), ("common", ["common"], [], "d9"), ("two", ["w1", "w1", "w2"], ["c2"], None)]
    schema = "{} , tokens array<string>, components array<string>, dataset string"
    got = M.retrieve_cases(spark.createDataFrame(query, schema.format("query_id string")), spark.createDataFrame(case, schema.format("case_id long")), rare=rare)
    want = {}
    for name, tokens, comps, dataset in query:
        tokens, comps = set(tokens or ()), set(comps or ())
        scored = [(-round(len(tokens & set(c[1] or ())) / max(1, len(tokens)) + (0.2 if dataset and dataset == c[3] else 0) + 0.1 * len(comps & set(c[2] or ())), 6), c[0]) for c in case]
        want |= {(name, cid): (-s, place) for place, (s, cid) in enumerate(sorted(scored)[:3], 1) if s < 0}
    found = {(r.query_id, r.case_id): (r.score, r["rank"]) for r in got.collect()}
    assert found.keys() == want.keys() and all(found[x] == pytest.approx(want[x]) for x in want)


def test_cases_that_all_hold_a_token(spark):
    """20,000 cases hold one token; the rare words decide."""
    cases = spark.range(20_000).select(F.col("id").alias("case_id"), F.array(F.lit("common"), F.concat(F.lit("w"), (F.col("id") % 5000).cast("string"))).alias("tokens"),
                                       F.array(F.lit("c")).alias("components"), F.lit("d").alias("dataset"))
    queries = spark.range(200).select(F.concat(F.lit("q"), "id").alias("query_id"), F.array(F.lit("common"), F.concat(F.lit("w"), F.col("id").cast("string"))).alias("tokens"),
                                      F.array(F.lit("c")).alias("components"), F.lit("d").alias("dataset"))
    got = {}
    out = M.retrieve_cases(queries, cases)
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.case_id, r.score))
    assert all(sorted(got[f"q{i}"]) == [(1, i, pytest.approx(1.3)), (2, i + 5000, pytest.approx(1.3)), (3, i + 10000, pytest.approx(1.3))] for i in range(200))
    assert M.retrieve_cases(queries, cases.limit(0)).count() == M.retrieve_cases(queries.limit(0), cases).count() == 0


def test_first_per_interval_skips_nulls(spark):
    df = spark.createDataFrame([(1, 0, None, "a"), (1, 5, 2.0, "b"), (1, 61, 3.0, None)], "k int, ts long, v double, s string")
    got = [(r.slot, r.v, r.s) for r in SM.first_per_interval(df, ["k"], ["v", "s"], 60).orderBy("slot").collect()]
    assert got == [(0, 2.0, "a"), (1, 3.0, None)]


def test_pick_setting(spark):
    df = spark.createDataFrame(pd.DataFrame({"incident_id": [1, 1, 2, 2], "setting": [0, 1, 0, 1], "candidates": [0, 4, 0, 50]}))
    assert {(r.incident_id, r.setting) for r in E.pick_setting(df).collect()} == {(1, 1), (2, 1)}
    assert F is not None
