"""Causal graphs per incident as plain edge tables: weights, paths, influence, explanation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonde.functions import scalars as S

EDGE = ["incident_id", "source", "target"]


def causal_pairs(calls: DataFrame) -> DataFrame:
    """Reverse calls: a fault in the callee spreads to the caller."""
    return calls.filter("caller <> callee").select(
        "incident_id", F.col("callee").alias("source"), F.col("caller").alias("target"), F.col("calls").alias("call_count"))


# ------------------------------------------------------------------ series of an edge
def aligned(edges: DataFrame, intensity: DataFrame) -> DataFrame:
    """Full outer join of both ends' intensity on the timestamp, missing values zero.

    Built as a bag union and a grouping, so one shuffle by edge and time replaces the outer
    join of two large sides.
    """
    return _outer(_both_ends(edges, intensity))


def _both_ends(edges: DataFrame, intensity: DataFrame) -> DataFrame:
    """Bag of both ends' intensity, that of the other end zero."""
    e = edges.select(*EDGE)
    x = e.join(intensity.withColumnRenamed("component", "source"), ["incident_id", "source"]).select(
        *EDGE, "ts", F.col("intensity").alias("x"), F.lit(0.0).alias("y"))
    y = e.join(intensity.withColumnRenamed("component", "target"), ["incident_id", "target"]).select(
        *EDGE, "ts", F.lit(0.0).alias("x"), F.col("intensity").alias("y"))
    return x.unionByName(y)


def _outer(ends: DataFrame) -> DataFrame:
    return ends.groupBy(*EDGE, "ts").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def lag_scores(merged: DataFrame, max_lag: int = 5) -> DataFrame:
    """Lagged correlation and directional lead score per edge, by row shift.

    All shifts are ``lead`` columns of one window and all correlations one aggregation.
    Lags with fewer than three pairs or a flat side do not count.
    """
    return _lag_choice(_lag_correlations(merged, max_lag), max_lag)


def edge_lag_scores(edges: DataFrame, intensity: DataFrame, max_lag: int = 5) -> DataFrame:
    """:func:`lag_scores` of the :func:`aligned` series of every edge.

    An edge and its reverse have the same series with their sides changed, so a pair's series is
    built and correlated once; its correlations forward are those backward of the reverse. The
    pair's rows meet in one shuffle and one sort, which the series' windows use too. ``intensity``
    has one row per component and time, so a time has at most one row of each end.
    """
    lags = [k for k in range(max_lag + 1) if k]
    own = edges.select(*EDGE).distinct()
    pair = own.select("incident_id", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
    w = W.partitionBy(*EDGE).orderBy("ts")
    both = F.lead("ts").over(w) == F.col("ts")
    merged = _both_ends(pair, intensity).repartition(*EDGE).select(
        *EDGE, "ts", *[F.when(both, F.col(c) + F.lead(c).over(w)).otherwise(F.col(c)).alias(c) for c in ("x", "y")],
        F.coalesce(F.lag("ts").over(w) == F.col("ts"), F.lit(False)).alias("_second")).filter("NOT _second")
    found = _lag_correlations(merged, max_lag)
    same = [F.col("_n"), F.col("_c0")]
    straight = F.struct("source", "target", *same, *[F.col(f"_{d}{k}") for d in "fr" for k in lags])
    turned = F.struct(F.col("target").alias("source"), F.col("source").alias("target"), *same, *[
        F.col(f"_{b}{k}").alias(f"_{a}{k}") for a, b in ("fr", "rf") for k in lags])
    each = F.when(F.col("source") == F.col("target"), F.array(straight)).otherwise(F.array(straight, turned))
    return _lag_choice(found.select("incident_id", F.inline(each)).join(own, EDGE, "left_semi"), max_lag)


def _lag_correlations(merged: DataFrame, max_lag: int) -> DataFrame:
    """Rows of a series and its correlations: at once, x before y and y before x by every lag."""
    w = W.partitionBy(*EDGE).orderBy("ts")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # in order too: one sort, and a mean that reruns repeat
    lags = range(max_lag + 1)
    df = merged.select(*EDGE, *[(F.lead(c, k).over(w) - F.avg(c).over(whole)).alias(f"_{c}{k}") for c in ("x", "y") for k in lags])
    sums = {}

    def total(name, c):
        sums[name] = F.coalesce(F.sum(c), F.lit(0.0)).alias(name)
        return F.col(name)

    def corr(a: str, b: str, k: int):
        # over the rows that still have a partner; sums of centred values, no gathering
        u, v, key = F.when(F.col(b).isNotNull(), F.col(a)), F.col(b), f"{a}{b}"
        n = F.col("_n") - k
        su, sv = total(f"{key}_u", u), total(f"{key}_v", v)
        vu = F.greatest(n * total(f"{key}_uu", u * u) - su * su, F.lit(0.0))
        vv = F.greatest(n * total(f"{key}_vv", v * v) - sv * sv, F.lit(0.0))
        spread = F.sqrt(vu * vv)
        both = F.abs(n * total(f"{key}_uv", u * v) - su * sv)
        return F.when((n >= 3) & (spread >= 1e-12 * n), both / F.greatest(spread, F.lit(1e-300))).otherwise(0.0)

    parts = {"_c0": corr("_x0", "_y0", 0), **{f"_f{k}": corr("_x0", f"_y{k}", k) for k in lags if k},
             **{f"_r{k}": corr("_y0", f"_x{k}", k) for k in lags if k}}
    return df.groupBy(*EDGE).agg(F.count("*").alias("_n"), *sums.values()).select(
        *EDGE, "_n", *[c.alias(name) for name, c in parts.items()])


def _lag_choice(g: DataFrame, max_lag: int) -> DataFrame:
    lags = range(max_lag + 1)
    forward = F.greatest(*[F.col(f"_f{k}") for k in lags if k])
    back = F.greatest(*[F.col(f"_r{k}") for k in lags if k])
    total = forward + back
    enough = F.col("_n") >= 3
    return g.select(
        *EDGE, F.col("_n").alias("rows"),
        F.when(enough, S.clamp(F.greatest("_c0", forward))).otherwise(0.0).alias("lag_corr"),
        F.when(enough & (total >= 1e-6), S.clamp((forward - back + total) / F.greatest(2.0 * total, F.lit(1e-12)))
               ).otherwise(0.5).alias("lead_score"))


def time_precedence(source_ts, target_ts, unknown: float = 0.5):
    dt = target_ts - source_ts
    return (F.when(dt.isNull(), unknown).when(dt > 0, 1.0 / (1.0 + F.greatest(dt, F.lit(0)) / 60.0))
            .when(dt == 0, 0.5).otherwise(0.1))


def onset_choice(first: DataFrame, resolutions: DataFrame, kpi_onsets: DataFrame, sizes=(60, 300, 900)) -> DataFrame:
    """Onset per component: finest resolution, then earliest KPI onset, then first segment."""
    by_size = resolutions.groupBy("incident_id", "component").agg(*[
        F.min(F.when(F.col("resolution") == s, F.col("onset"))).alias(f"_o{s}") for s in sizes])
    kpi = kpi_onsets.groupBy("incident_id", "component").agg(F.min("onset").alias("_kpi"))
    keys = ["incident_id", "component"]
    return first.join(by_size, keys, "left").join(kpi, keys, "left").select(
        *keys, F.coalesce(*[F.col(f"_o{s}") for s in sizes], "_kpi", "first_ts").alias("onset"))


def _ends(edges: DataFrame, nodes: DataFrame, column: str, names=("source_ts", "target_ts")) -> DataFrame:
    """Attach a node column to both ends of every edge."""
    for end, name in zip(("source", "target"), names):
        edges = edges.join(nodes.select("incident_id", F.col("component").alias(end), F.col(column).alias(name)),
                           ["incident_id", end], "left")
    return edges


def weigh(pairs: DataFrame, lags: DataFrame, onsets: DataFrame) -> DataFrame:
    """Edge weight v1: time .35, correlation .25, lead .15, type prior .25, blended by call reliability."""
    df = _ends(pairs, onsets, "onset").join(lags.drop("rows"), EDGE, "left")
    df = (df.withColumn("s_time", time_precedence(F.col("source_ts"), F.col("target_ts")))
          .withColumn("s_corr", F.coalesce("lag_corr", F.lit(0.0)))
          .withColumn("s_lead", F.coalesce("lead_score", F.lit(0.5)))
          .withColumn("s_prior", S.type_prior(S.component_type(F.col("source")), S.component_type(F.col("target"))))
          .withColumn("reliability", 1.0 - F.exp(-F.col("call_count") / 5.0)))
    blend = 0.35 * F.col("s_time") + 0.25 * F.col("s_corr") + 0.15 * F.col("s_lead") + 0.25 * F.col("s_prior")
    weight = S.clamp(F.col("reliability") * blend + (1.0 - F.col("reliability")) * F.col("s_prior"))
    return df.withColumn("weight", S.rounded(weight, 6)).select(
        *EDGE, "call_count", "s_time", "s_corr", "s_lead", "s_prior", "reliability", "weight")


def merge_calls(trace: DataFrame, log: DataFrame) -> DataFrame:
    """Trace and log calls of one incident: the larger count wins, both are kept."""
    keys = ["incident_id", "caller", "callee"]
    both = trace.select(*keys, F.col("calls").alias("trace_calls"), F.lit(0).cast("bigint").alias("log_calls")).unionByName(
        log.select(*keys, F.lit(0).cast("bigint").alias("trace_calls"), F.col("calls").alias("log_calls")))
    merged = both.groupBy(*keys).agg(F.sum("trace_calls").alias("trace_calls"), F.sum("log_calls").alias("log_calls"))
    return merged.withColumn("calls", F.greatest("trace_calls", "log_calls"))


def weigh_with_logs(merged: DataFrame, lags: DataFrame, first: DataFrame) -> DataFrame:
    """Edge weight v2: no lead term; log-only and inferred edges are capped and anchored lower."""
    pairs = merged.filter("caller <> callee").select(
        "incident_id", F.col("callee").alias("source"), F.col("caller").alias("target"),
        F.col("calls").alias("call_count"), "trace_calls", "log_calls")
    df = _ends(pairs, first, "first_ts").join(lags.select(*EDGE, "rows", "lag_corr"), EDGE, "left")
    t = time_precedence(F.col("source_ts"), F.col("target_ts"), unknown=1e-5)
    c = F.when(F.coalesce("rows", F.lit(0)) >= 3, F.col("lag_corr")).otherwise(1e-5)
    p = S.type_prior(S.component_type(F.col("source")), S.component_type(F.col("target")))
    df = df.withColumn("_t", t).withColumn("_c", c).withColumn("_p", p)
    support = F.greatest("_t", "_c")
    blend = 0.35 * F.col("_t") + 0.30 * F.col("_c") + 0.35 * F.col("_p")
    traced, logged = F.col("trace_calls") > 0, F.col("log_calls") > 0
    r = (F.when(traced, 1.0 - F.exp(-F.col("trace_calls") / 5.0))
         .when(logged, F.least(F.lit(0.55), 0.20 + 0.30 * support))
         .otherwise(F.least(F.lit(0.45), 0.10 + 0.30 * support)))
    anchor = F.col("_p") * F.when(traced, 1.0).when(logged, 0.50).otherwise(0.35)
    weight = (r * blend + (1.0 - r) * anchor) * F.when(traced & logged, 1.05).otherwise(1.0)
    kind = F.when(traced & logged, "confirmed").when(traced, "trace").when(logged, "log").otherwise("inferred")
    return df.withColumn("weight", S.rounded(S.clamp(weight), 6)).withColumn("evidence", kind).select(
        *EDGE, "call_count", "evidence", "weight")


def infer_missing(calls: DataFrame, candidates: DataFrame) -> DataFrame:
    """Add low-confidence calls to databases, caches (5) and nodes (3) that no call mentions.

    Candidates per incident are capped at 30 upstream, so the pairing is bounded.
    """
    typed = candidates.select("incident_id", "component", S.component_type(F.col("component")).alias("kind"))
    seen = calls.select("incident_id", F.explode(F.array("caller", "callee")).alias("component")).distinct()
    lonely = typed.join(seen, ["incident_id", "component"], "left_anti").filter(F.col("kind").isin("db", "redis", "node")).select(
        "incident_id", F.col("component").alias("callee"), F.col("kind").alias("callee_kind"))
    callers = typed.filter(F.col("kind").isin("service", "pod", "db", "redis")).select(
        "incident_id", F.col("component").alias("caller"), F.col("kind").alias("caller_kind"))
    allowed = F.col("caller_kind").isin("service", "pod") | (F.col("callee_kind") == "node")
    extra = callers.join(lonely, "incident_id").filter(allowed & (F.col("caller") != F.col("callee"))).select(
        "incident_id", "caller", "callee", F.when(F.col("callee_kind") == "node", 3).otherwise(5).cast("bigint").alias("calls"))
    return calls.select("incident_id", "caller", "callee", "calls").unionByName(extra).groupBy(
        "incident_id", "caller", "callee").agg(F.sum("calls").alias("calls"))


def isolated_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from anomalous nodes without any edge to later anomalous nodes that have one.

    ``nodes`` holds the candidates (at most 30 per incident) with score and first_ts.
    """
    ends = edges.select("incident_id", F.explode(F.array("source", "target")).alias("component")).distinct()
    keys = ["incident_id", "component"]
    alone = nodes.join(ends, keys, "left_anti").select(
        "incident_id", F.col("component").alias("source"), F.col("score").alias("_s1"), F.col("first_ts").alias("_t1"))
    tied = nodes.join(ends, keys, "left_semi").select(
        "incident_id", F.col("component").alias("target"), F.col("score").alias("_s2"), F.col("first_ts").alias("_t2"))
    dt = F.col("_t2") - F.col("_t1")
    prior = S.type_prior(S.component_type(F.col("source")), S.component_type(F.col("target")))
    weight = S.clamp(0.40 / (1.0 + dt / 120.0) + 0.35 * prior
                     + 0.25 * F.least(F.lit(1.0), F.col("_s1") / F.greatest(F.col("_s2"), F.lit(0.01))))
    return alone.join(tied, "incident_id").filter(dt > 0).withColumn("weight", S.rounded(weight, 6)).filter(
        "weight >= 0.15").select(*EDGE, "weight")


# ------------------------------------------------------------------ nodes and paths
def _per_graph(edges: DataFrame, marked: DataFrame, work, fields: str) -> DataFrame:
    """``work(src, dst, weight, own, names)`` on the packed graph of every incident, lazily, in one shuffle.

    An incident is one group: its edges (source, target, weight; bounded by its component pairs,
    as calls are counted per pair before) and its marked components. Components are numbered in
    ``names``; ``work`` returns columns after ``incident_id``. Null incidents and ends belong to no graph.
    """
    kind = edges.schema["incident_id"].dataType.simpleString()
    e = edges.select(*EDGE, F.col("weight").cast("double")).dropna(subset=EDGE)
    m = marked.select(F.col("incident_id").cast(kind), "component").dropna().distinct()

    def graph(key, links, own):
        codes, names = pd.factorize(np.concatenate([links["source"], links["target"], own["component"]]))
        n = len(links)
        columns = work(codes[:n], codes[n:2 * n], links["weight"].to_numpy(), codes[2 * n:], names)
        return pd.DataFrame({"incident_id": [key[0]] * len(columns[0]), **{f.split()[0]: c for f, c in zip(fields.split(", "), columns)}})

    return e.groupBy("incident_id").cogroup(m.groupBy("incident_id")).applyInPandas(graph, f"incident_id {kind}, {fields}")


def _arriving(src: np.ndarray, dst: np.ndarray):
    """Edges in the order of their targets: that order, the targets and where the edges of each begin."""
    order = np.argsort(dst, kind="stable")
    ends, starts = np.unique(dst[order], return_index=True)
    return order, src[order], ends, starts


def _blocks(n: int, width: int):
    """Slices of ``n`` rows of ``width`` values that hold four million values each."""
    step = max(1, 4_000_000 // max(1, width))
    return [slice(i, min(n, i + step)) for i in range(0, n, step)]


def influence(edges: DataFrame, nodes: DataFrame, depth: int = 6) -> DataFrame:
    """Largest bottleneck weight from every node to every node over paths of at most ``depth`` edges.

    The packed graph of an incident takes all its origins, in blocks, through one (max, min)
    step per edge of depth; the empty path has strength 1. An edge without weight does not narrow a path.
    """
    def widest(src, dst, weight, own, names):
        order, src, ends, starts = _arriving(src, dst)
        weight = np.where(np.isnan(weight), np.inf, weight)[order]
        found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        for block in _blocks(len(own), max(len(src), len(names))):
            state = np.full((block.stop - block.start, len(names)), -np.inf)
            state[np.arange(len(state)), own[block]] = 1.0
            for _ in range(depth if len(src) else 0):
                came = np.maximum.reduceat(np.minimum(state[:, src], weight), starts, axis=1)
                state[:, ends] = np.maximum(state[:, ends], came)
            row, node = np.nonzero(state > -np.inf)
            found.append((own[block][row], node, state[row, node]))
        origin, node, strength = map(np.concatenate, zip(*found))
        return names[origin], names[node], strength

    return _per_graph(edges, nodes, widest, "origin string, node string, strength double")


def _closure(src: np.ndarray, dst: np.ndarray, n: int, wanted: np.ndarray):
    """Blocks (wanted nodes, reach): ``reach[a, b]`` whether a path of one edge or more leads from a to wanted node b.

    Sets of wanted nodes are bits; every edge hands the set of its target back to its source until nothing changes.
    """
    order, src, ends, starts = _arriving(dst, src)  # by source
    for block in _blocks(len(wanted), max(len(src), n)):
        here = wanted[block]
        itself = np.zeros((n, len(here)), bool)
        itself[here, np.arange(len(here))] = True
        itself = np.packbits(itself, axis=1)
        reach, grown = np.zeros_like(itself), len(src) > 0
        while grown:
            came = np.bitwise_or.reduceat((reach | itself)[src], starts, axis=0)
            grown = not np.array_equal(came, reach[ends])
            reach[ends] = came
        yield here, np.unpackbits(reach, axis=1, count=len(here)).astype(bool)


def reach_from(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """(incident, origin, node) of the nodes that directed paths reach from the given components."""
    def reached(src, dst, _, own, names):
        found = [(np.empty(0, int), np.empty(0, int))]
        for here, reach in _closure(src, dst, len(names), np.arange(len(names))):
            row, node = np.nonzero(reach[own])
            found.append((own[row], here[node]))
        origin, node = map(np.concatenate, zip(*found))
        return names[origin], names[node]

    return _per_graph(edges.withColumn("weight", F.lit(1.0)), origins, reached, "origin string, node string")


def reach_counts(edges: DataFrame, known: DataFrame) -> DataFrame:
    """How many other known components directed paths reach from each known one; no reached pair becomes a row."""
    def counted(src, dst, _, own, names):
        count = np.zeros(len(own), np.int64)
        for here, reach in _closure(src, dst, len(names), own):
            count += (reach[own] & (own[:, None] != here)).sum(axis=1)
        return names[own], count

    return _per_graph(edges.withColumn("weight", F.lit(1.0)), known, counted, "component string, reach bigint")


def between(calls: DataFrame, own: DataFrame) -> DataFrame:
    """Components on any shortest undirected path between two of the given components, ends included.

    Distances stay inside the packed graph of an incident: one row of them per given component.
    """
    def on_path(src, dst, _, own, names):
        order, near, ends, starts = _arriving(np.concatenate([src, dst]), np.concatenate([dst, src]))
        far = np.iinfo(np.int32).max // 4
        hops = np.full((len(own), len(names)), far, np.int32)
        for block in _blocks(len(own), max(len(near), len(names))):
            state = hops[block]
            state[np.arange(len(state)), own[block]] = 0
            for hop in range(1, len(names)):
                came = np.logical_or.reduceat(state[:, near] == hop - 1, starts, axis=1) & (state[:, ends] == far) if len(near) else np.zeros((1, 1), bool)
                if not came.any():
                    break
                row, node = np.nonzero(came)
                state[row, ends[node]] = hop
        inside = np.zeros(len(names), bool)
        for i in range(len(own)):
            for block in _blocks(len(own), len(names)):
                whole = hops[i, own[block]][:, None]
                inside |= ((hops[i] + hops[block] == whole) & (whole < far)).any(axis=0)
        return (names[inside],)

    links = calls.select("incident_id", F.col("caller").alias("source"), F.col("callee").alias("target"), F.lit(1.0).alias("weight"))
    return _per_graph(links, own, on_path, "component string")


def select_nodes(calls: DataFrame, refined: DataFrame, mode: str = "direct") -> DataFrame:
    """Graph nodes: the refined candidates, their direct neighbours, or all shortest paths between them."""
    own = refined.select("incident_id", "component").distinct()
    if mode == "none":
        return own
    if mode not in ("direct", "full_path"):
        raise ValueError(f"unknown expansion {mode}")
    keys = ["incident_id", "component"]
    a = calls.select("incident_id", F.col("caller").alias("component"), F.col("callee").alias("other"))
    b = calls.select("incident_id", F.col("callee").alias("component"), F.col("caller").alias("other"))
    near = a.unionByName(b).join(own, keys, "left_semi").select("incident_id", F.col("other").alias("component"))
    nodes = own.unionByName(near).distinct()
    if mode == "direct":
        return nodes
    return nodes.unionByName(between(calls, own)).distinct()


def restrict(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    for end in ("source", "target"):
        edges = edges.join(nodes.select("incident_id", F.col("component").alias(end)), ["incident_id", end], "left_semi")
    return edges


# ------------------------------------------------------------------ scores on the graph
def topology_score(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """0.40 reach of anomalous nodes + 0.35 out-degree share - 0.25 weight share from anomalous parents.

    ``nodes`` are the anomalous components with their score; a node outside the graph gets 0.5.
    """
    keys = ["incident_id", "component"]
    known = nodes.select(*keys)
    total = known.groupBy("incident_id").agg(F.count("*").alias("_all"))
    reach = reach_counts(edges, known).withColumnRenamed("reach", "_reach")
    out = edges.groupBy("incident_id", F.col("source").alias("component")).agg(
        F.count("*").alias("_out"), F.sum("weight").alias("_ow"))
    marked = edges.join(known.select("incident_id", F.col("component").alias("source"), F.lit(1).alias("_hot")),
                        ["incident_id", "source"], "left")
    inc = marked.groupBy("incident_id", F.col("target").alias("component")).agg(
        F.count("*").alias("_in"), F.sum("weight").alias("_iw"),
        F.sum(F.when(F.col("_hot") == 1, F.col("weight")).otherwise(0.0)).alias("_hw"))
    df = known.join(reach, keys, "left").join(out, keys, "left").join(inc, keys, "left").join(total, "incident_id")
    inside = F.col("_out").isNotNull() | F.col("_in").isNotNull()
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = S.clamp(0.40 * z("_reach") / F.col("_all") + 0.35 * z("_out") / (z("_out") + z("_in") + 1e-9)
                    - 0.25 * z("_hw") / (z("_iw") + z("_ow") + 1e-9))
    return df.select(*keys, F.when(inside, score).otherwise(0.5).alias("topology_score"))


def explain_score(strengths: DataFrame, edges: DataFrame, nodes: DataFrame,
                  anomalies: DataFrame | None = None) -> DataFrame:
    """Severity-weighted influence on other anomalies, discounted by earlier candidates that reach them.

    ``nodes`` are the candidates with score and rank, ``anomalies`` all anomalous components
    (default: the candidates). The competitors of a candidate are those of smaller rank with
    an influence above 0.1 on the same target.
    """
    hot = nodes if anomalies is None else anomalies
    reach = (strengths.filter("strength > 0")
             .join(hot.select("incident_id", F.col("component").alias("node"), F.col("score").alias("severity")), ["incident_id", "node"])
             .join(nodes.select("incident_id", F.col("component").alias("origin"), "rank"), ["incident_id", "origin"]))
    w = W.partitionBy("incident_id", "node").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    ranked = reach.withColumn("_rivals", F.coalesce(F.sum((F.col("strength") > 0.1).cast("int")).over(w), F.lit(0)))
    part = ranked.filter("origin <> node").withColumn(
        "_factor", F.greatest(F.lit(0.7), 1.0 - 0.075 * F.col("_rivals"))).groupBy(
        "incident_id", F.col("origin").alias("component")).agg(
        F.sum(F.col("severity") * F.col("strength") * F.col("_factor")).alias("_num"), F.sum("severity").alias("_den"))
    own = nodes.select("incident_id", "component", "score").join(
        hot.groupBy("incident_id").agg(F.max("score").alias("_max")), "incident_id")
    out = edges.select("incident_id", F.col("source").alias("component"), F.lit(True).alias("_has")).distinct()
    keys = ["incident_id", "component"]
    raw = F.when(F.col("_max") > 0, F.col("score") / F.col("_max")).otherwise(0.0)
    value = F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")).when(F.col("_has"), raw * 0.3).otherwise(raw * 0.6)
    return own.join(part, keys, "left").join(out, keys, "left").select(
        *keys, S.rounded(S.clamp(value), 6).alias("explain_score"))


def unexplained_score(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Share of a candidate's severity that earlier anomalous parents do not explain, times severity."""
    side = lambda role, c: nodes.select(
        "incident_id", F.col("component").alias(role), F.col("score").alias(f"{c}_score"), F.col("first_ts").alias(f"{c}_ts"))
    hot = edges.select(*EDGE, "weight").join(side("source", "p").filter("p_score > 0"), ["incident_id", "source"])
    parents = hot.groupBy("incident_id", F.col("target").alias("source")).agg(F.count("*").alias("_grand"))
    part = (hot.join(side("target", "c"), ["incident_id", "target"]).filter("p_ts < c_ts")
            .join(parents, ["incident_id", "source"], "left")
            .groupBy("incident_id", F.col("target").alias("component")).agg(
        F.sum(F.col("p_score") * F.col("weight") / (1.0 + 0.3 * F.coalesce("_grand", F.lit(0)))).alias("_up")))
    ratio = F.least(F.lit(1.0), F.col("_up") / F.greatest(F.col("score"), F.lit(1e-6)))
    value = (F.when(F.col("score") <= 0, 0.0).when(F.col("_up").isNull(), F.least(F.lit(1.0), F.col("score")))
             .otherwise(S.clamp((1.0 - ratio) * F.col("score"))))
    return nodes.join(part, ["incident_id", "component"], "left").select(
        "incident_id", "component", S.rounded(value, 6).alias("unexplained"))


def contextual_score(strengths: DataFrame, edges: DataFrame, nodes: DataFrame, with_edges: float = 0.3,
                     without: float = 0.6) -> DataFrame:
    """Share of each reachable anomaly a candidate explains against its other anomalous parents.

    A candidate that reaches no anomaly gets its relative severity times ``with_edges`` when it
    has outgoing edges, else times ``without``.
    """
    keys = ["incident_id", "component"]
    sev = nodes.select("incident_id", F.col("component").alias("node"), F.col("score").alias("_sy"))
    hot = edges.select(*EDGE, "weight").join(
        nodes.select("incident_id", F.col("component").alias("source"), F.col("score").alias("_sz")), ["incident_id", "source"])
    pull = hot.groupBy("incident_id", F.col("target").alias("node")).agg(F.sum(F.col("weight") * F.col("_sz")).alias("_all"))
    own_pull = hot.select("incident_id", F.col("source").alias("origin"), F.col("target").alias("node"),
                          (F.col("weight") * F.col("_sz")).alias("_own"))
    star = nodes.select("incident_id", F.col("component").alias("origin"), F.col("score").alias("_sx"))
    df = (strengths.filter("strength > 0 AND origin <> node").join(star, ["incident_id", "origin"])
          .join(sev, ["incident_id", "node"]).join(pull, ["incident_id", "node"], "left")
          .join(own_pull, ["incident_id", "origin", "node"], "left"))
    mine = F.col("strength") * F.col("_sx")
    total = mine + F.coalesce("_all", F.lit(0.0)) - F.coalesce("_own", F.lit(0.0))
    ratio = F.when(total > 1e-9, F.least(F.lit(1.0), mine / F.greatest(total, F.lit(1e-12)))).otherwise(0.0)
    part = df.groupBy("incident_id", F.col("origin").alias("component")).agg(
        F.sum(F.col("_sy") * ratio).alias("_num"), F.sum("_sy").alias("_den"))
    own = nodes.select(*keys, "score").withColumn("_max", F.max("score").over(W.partitionBy("incident_id")))
    out = edges.select("incident_id", F.col("source").alias("component"), F.lit(True).alias("_has")).distinct()
    raw = F.when(F.col("_max") > 0, F.col("score") / F.col("_max")).otherwise(0.0)
    value = (F.when(F.col("score") <= 0, 0.0).when(F.col("_den") > 1e-9, F.col("_num") / F.col("_den"))
             .when(F.col("_has"), raw * with_edges).otherwise(raw * without))
    return own.join(part, keys, "left").join(out, keys, "left").select(
        *keys, S.rounded(S.clamp(value), 6).alias("contextual"))


def downstream_discount(scores: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Contextual score times 1 - 0.7 * share of incoming edges that come from anomalous nodes."""
    hot = nodes.select("incident_id", F.col("component").alias("source"), F.lit(1).alias("_hot"))
    share = edges.join(hot, ["incident_id", "source"], "left").groupBy(
        "incident_id", F.col("target").alias("component")).agg((F.count("_hot") / F.count("*")).alias("_share"))
    return scores.join(share, ["incident_id", "component"], "left").select(
        "incident_id", "component", "contextual",
        S.rounded(S.clamp(F.col("contextual") * (1.0 - 0.7 * F.coalesce("_share", F.lit(0.0)))), 6).alias("discounted"))


def graph_quality(nodes: DataFrame, edges: DataFrame, refined: DataFrame) -> DataFrame:
    """Quality of an incident's graph: coverage, edge weight, a causal source, and presence of edges."""
    n = nodes.select("incident_id", "component").distinct()
    covered = refined.select("incident_id", "component").join(
        n.withColumn("_in", F.lit(1)), ["incident_id", "component"], "left").groupBy("incident_id").agg(
        (F.count("_in") / F.count("*")).alias("_coverage"))
    e = edges.groupBy("incident_id").agg(F.count("*").alias("_edges"), F.avg("weight").alias("_avg"))
    sources = n.join(edges.select("incident_id", F.col("target").alias("component")), ["incident_id", "component"], "left_anti"
                     ).groupBy("incident_id").agg(F.count("*").alias("_sources"))
    df = n.groupBy("incident_id").agg(F.count("*").alias("_nodes")).join(covered, "incident_id", "left").join(
        e, "incident_id", "left").join(sources, "incident_id", "left")
    base = 0.35 + 0.35 * F.coalesce("_coverage", F.lit(0.0))
    bonus = F.least(F.lit(0.30), 0.10 + 0.05 * F.col("_edges")) * F.least(F.lit(1.0), F.col("_avg"))
    own = F.when(F.col("_edges").isNull(), base * 0.5).otherwise(
        (base + bonus) * F.when(F.col("_sources").isNull(), 0.9).otherwise(1.0))
    valid = F.when(F.col("_edges").isNotNull(), 0.85).otherwise(0.45)
    return df.select("incident_id", S.rounded(0.6 * F.least(F.lit(1.0), own) + 0.4 * valid, 6).alias("quality"))
