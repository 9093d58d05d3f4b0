"""The three analysis flows, from telemetry and incidents to ranked causes.

Each flow takes relations in the unified form and returns DataFrames for all incidents:

``metrics``    component, kpi, day, ts, value
``spans``      trace_id, span_id, parent_id, component, ts, duration, success
``logs``       log_id, component, ts, value (and log_name where known)
``incidents``  incident_id, start_ts, end_ts, failure_count, time_only

Stages that several later steps read are written once to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.functions import scalars as S
from sonde.operators import detect as D
from sonde.operators import graph as G
from sonde.operators import hypotheses as H
from sonde.operators import logs as L
from sonde.operators import memory as M
from sonde.operators import rank as RK
from sonde.operators import reason as R
from sonde.operators import spans as SP
from sonde.operators import spectral as X
from sonde.operators import stats as ST
from sonde.operators import topology as TP
from sonde.operators import windows as WN
from sonde.plans.stages import written
from sonde.sources.telemetry import mean_per_timestamp

KEYS = ["incident_id", "component"]


@dataclass(frozen=True)
class Settings:
    """Configured candidates and tunable thresholds of a flow."""

    components: tuple
    reasons: tuple
    interval: int = 60
    high: float = 0.95
    low: float = 0.05
    beta: float = 0.5
    min_points: int = 2
    cut: float = 0.05
    keep: int = 30
    top: int = 4
    depth: int = 6
    expand: str = "direct"
    infer_dependencies: bool = False
    resolutions: tuple = (60, 300, 900)
    file_name: str = ""
    spectral: bool = True
    abductive: bool = True
    widen: int = 0  # minutes before the window that the detection of segments sees too
    extra: dict = field(default_factory=dict)


def _inside(rows: DataFrame, incidents: DataFrame) -> DataFrame:
    """Rows of the incident windows, written once because several steps read them."""
    return written(WN.window_join(rows, incidents.select("incident_id", "start_ts", "end_ts")).drop("start_ts", "end_ts"), "inside")


def spectral_flow(metrics: DataFrame, incidents: DataFrame, s: Settings, spans: DataFrame | None = None,
                  logs: DataFrame | None = None) -> dict[str, DataFrame]:
    """Resample, score in the time and frequency domain, validate edges, rank, re-rank by hypotheses.

    Slow components of ``spans`` and error lines of ``logs``, where given, report beside the
    metrics and the ranking: ``verified`` counts the reports that name a component,
    ``reflection`` says whether an incident's answer stands.
    """
    window = incidents.select("incident_id", "start_ts", "end_ts")
    arrays = written(ST.scored_arrays(WN.resampled_filled(metrics, s.interval), window), "arrays")
    evidence = written(X.anomaly_evidence(arrays, use_spectral=s.spectral), "evidence")
    edges = written(X.weigh_edges(X.edge_measures(X.candidate_edges(evidence), arrays)), "edges")
    ranking = written(X.root_ranking(evidence, edges), "ranking")
    out = {"evidence": evidence, "edges": edges, "ranking": ranking}
    out["reports"] = written(_spectral_reports(evidence, ranking, spans, logs, incidents), "reports")
    out["verified"] = written(H.verify_support(out["reports"].filter("supports").select(
        "incident_id", "agent", F.col("component").alias("node"))), "verified")
    out["reflection"] = H.reflect(_standing(out["reports"], out["verified"]), ranking)
    if s.abductive:
        out["hypotheses"] = H.believe(H.hypothesise(evidence, ranking), evidence, edges)
        out["ranking"] = H.rerank(ranking, out["hypotheses"])
    return out


def _spectral_reports(evidence: DataFrame, ranking: DataFrame, spans: DataFrame | None, logs: DataFrame | None,
                      incidents: DataFrame) -> DataFrame:
    """What each source of evidence says of a component: its best score and whether that supports it.

    Metrics and the ranking support above 0.3; a slow or failing component is supported as such.
    """
    node = F.concat("component", F.lit("."), "kpi")
    ranked = ranking.select("incident_id", "node", "root_score").join(
        evidence.select(*KEYS, node.alias("node")), ["incident_id", "node"])
    parts = [evidence.select(F.lit("metric").alias("agent"), *KEYS, F.col("final_score").alias("score"), (F.col("final_score") > 0.3).alias("supports")),
             ranked.select(F.lit("causal").alias("agent"), *KEYS, F.col("root_score").alias("score"), (F.col("root_score") > 0.3).alias("supports"))]
    if spans is not None:
        parts.append(SP.latency_outliers(SP.component_statistics(_inside(spans, incidents))).select(
            F.lit("trace").alias("agent"), *KEYS, F.col("anomaly_score").alias("score"), F.lit(True).alias("supports")))
    if logs is not None:
        parts.append(L.error_profile(logs, incidents.select("incident_id", "start_ts", "end_ts")).select(
            F.lit("log").alias("agent"), *KEYS, F.col("anomaly_score").alias("score"), F.lit(True).alias("supports")))
    return reduce(DataFrame.unionByName, parts).groupBy("agent", *KEYS).agg(
        F.max("score").alias("score"), F.max("supports").alias("supports"))


def _standing(reports: DataFrame, verified: DataFrame) -> DataFrame:
    """Best confidence of an incident's reports, its verification among them, and how many components have support."""
    checked = verified.groupBy("incident_id").agg(F.max("verification_score").alias("_verified"), F.count("*").alias("supported"))
    return reports.groupBy("incident_id").agg(F.max("score").alias("_best")).join(checked, "incident_id", "left").select(
        "incident_id", S.rounded(F.greatest("_best", F.coalesce("_verified", F.lit(0.0))), 4).alias("max_confidence"),
        F.coalesce("supported", F.lit(0)).alias("supported"))


def _detect(metrics: DataFrame, incidents: DataFrame, s: Settings, baseline: bool):
    stats = written(ST.day_thresholds(metrics, s.high, s.low), "stats")
    window = incidents.select("incident_id", "start_ts", "end_ts")
    points = written(D.points_b(metrics, stats, WN.expand_window(window, s.widen), 1800 if baseline else None), "points")
    segments = written(D.segments_b(points, list(s.reasons), s.beta, s.min_points, s.file_name), "segments")
    return stats, window, points, segments


def causal_flow(metrics: DataFrame, spans: DataFrame, logs: DataFrame, incidents: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Version 1: segments, ratio severity, layer filter, causal graph, influence, reasons, blend."""
    stats, window, points, segments = _detect(metrics, incidents, s, baseline=True)
    scores = written(D.severity_ratio(segments), "scores")
    cands = written(D.candidates(scores, s.cut, s.keep), "candidates")
    refined = written(cands.join(D.layer_filter(cands).filter("refined").select(*KEYS), KEYS, "left_semi"), "refined")
    inside = _inside(spans, incidents)
    calls = SP.component_calls(inside, s.components, ["incident_id"])
    if s.infer_dependencies:
        calls = G.infer_missing(calls, refined)
    calls = written(calls, "calls")
    nodes = written(G.select_nodes(calls, refined, s.expand), "nodes")
    pairs = G.restrict(G.causal_pairs(calls), nodes)
    lags = G.edge_lag_scores(pairs, D.intensity(points))
    onset = G.onset_choice(scores, WN.multi_resolution_onset(
        mean_per_timestamp(metrics, ["component", "kpi", "day"]), stats, window, s.resolutions), D.kpi_onsets(segments), s.resolutions)
    edges = written(G.weigh(pairs, lags, onset), "edges")
    strengths = written(G.influence(edges, cands, s.depth), "strengths")
    quality = G.graph_quality(nodes, edges, refined)
    ranking = written(RK.intervention_ranking(refined.drop("rank"), G.explain_score(strengths, edges, refined, cands)), "ranking")
    contextual = G.downstream_discount(G.contextual_score(strengths, edges, cands), edges, cands)
    reasons = R.choose_reason(cands, list(s.reasons), R.hint_scores(segments), R.log_reason_scores(WN.window_join(logs, window), list(s.reasons)),
                              R.trace_reason_scores(inside, list(s.reasons)), R.category_reason_scores(segments, list(s.reasons)))
    final = RK.final_blend(ranking, reasons, contextual, quality, s.top)
    times = RK.root_time(segments, window)
    ranked = final.join(times, KEYS, "left").select(*KEYS, "reason", F.col("root_ts").alias("ts"), F.col("combined").alias("score"), F.col("final_rank").alias("rank"))
    return {"segments": segments, "candidates": cands, "refined": refined, "nodes": nodes, "edges": edges, "ranking": ranking,
            "quality": quality, "confidence": RK.top_confidence(ranking, quality), "final": ranked}


def causal_flow_v2(metrics: DataFrame, spans: DataFrame, logs: DataFrame, incidents: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Version 2: rarity-weighted severity, evidence profiles, log topology, unexplained share, several causes."""
    stats, window, points, segments = _detect(metrics, incidents, s, baseline=False)
    reasons = list(s.reasons)
    scores = written(D.severity_idf(segments), "scores")
    cands = written(D.candidates(scores, s.cut, s.keep), "candidates")
    profiles = R.component_profiles(segments, s.file_name)
    refined = written(D.layer_filter_weighted(cands, profiles, top=s.top), "refined")
    # a window is too short to show who calls whom: the skeleton takes the whole day
    day = WN.window_join(spans, WN.whole_days(incidents)).drop("start_ts", "end_ts")
    calls = G.merge_calls(SP.component_calls(day, s.components, ["incident_id"]), TP.mine_calls(logs, window, s.components))
    calls = written(calls, "calls")
    lags = G.edge_lag_scores(G.causal_pairs(calls), D.intensity(points))
    edges = written(G.weigh_with_logs(calls, lags, scores), "edges")
    extra = G.isolated_edges(edges, cands).withColumn("call_count", F.lit(0).cast("bigint")).withColumn("evidence", F.lit("metric"))
    edges = written(edges.unionByName(extra), "edges-all")
    nodes = cands.join(refined.select(*KEYS), KEYS, "left_semi").drop("rank")
    ranking = written(RK.intervention_ranking_v2(nodes, refined.select(*KEYS, "evidence"), edges, G.unexplained_score(edges, cands), s.top), "ranking")
    log = R.log_reason_scores(WN.window_join(logs, window), reasons)
    chosen = written(R.choose_reason_by_pattern(nodes, reasons, R.pattern_reasons(segments, reasons, s.file_name),
                                                R.keyword_reasons(segments, reasons, s.file_name), R.profile_reasons(segments, reasons, s.file_name), log), "reasons")
    final = written(RK.final_blend_v2(ranking, chosen), "final")
    times = RK.root_time_v2(segments, window, chosen, s.file_name)
    own = final.join(times, KEYS).select(*KEYS, F.col("root_ts").alias("ts"), F.col("final_score").alias("score"), F.col("component").alias("key"))
    seg = segments.join(final.select(*KEYS, "final_score"), KEYS).select(
        *KEYS, F.col("steepest_ts").alias("ts"), F.round(F.col("final_score") * (0.75 + 0.25 * F.col("severity")), 9).alias("score"),
        F.concat("component", F.lit("."), "kpi").alias("key"))
    several = incidents.filter(~(F.col("time_only") & (F.col("failure_count") > 1)))
    only_times = incidents.filter(F.col("time_only") & (F.col("failure_count") > 1))
    causes = RK.select_causes(own.unionByName(seg), several).unionByName(RK.time_causes(segments, ranking.filter("kept"), only_times)).join(
        chosen.select(*KEYS, "reason"), KEYS, "left")
    ranked = final.join(times, KEYS, "left").select(*KEYS, "reason", F.col("root_ts").alias("ts"), F.col("final_score").alias("score"), F.col("final_rank").alias("rank"))
    return {"segments": segments, "candidates": cands, "refined": refined, "edges": edges, "ranking": ranking, "final": ranked, "causes": causes,
            "global_time": RK.onset_clusters(segments, window, ranking.filter("kept"))}


def _detected(metrics: DataFrame, incidents: DataFrame, s: Settings, number: int) -> DataFrame:
    """(incident_id, setting, candidates): components above the cut, zero where there is none, without the flow's cap."""
    segments = _detect(metrics, incidents, s, baseline=True)[3]
    n = D.candidates(D.severity_ratio(segments), s.cut, None).groupBy("incident_id").agg(F.count("*").alias("candidates"))
    return written(incidents.select("incident_id").join(n, "incident_id", "left").na.fill(0, ["candidates"]).withColumn("setting", F.lit(number)), "detected")


def recovery_settings(s: Settings) -> tuple[list[Settings], list[Settings]]:
    """What to try where the given settings find no candidate, and where they find too many."""
    wide = replace(s, widen=max(10, s.widen))
    few, last = [wide], wide
    for high in (0.90, 0.85):
        if high < s.high:
            last = replace(last, high=high, low=round(1.0 - high, 2), beta=max(0.25, round(last.beta - 0.15, 2)))
            few.append(last)
    high = max(0.99, s.high)
    return few, [replace(s, high=high, low=round(1.0 - high, 2), min_points=s.min_points + 1)]


def recovered(metrics: DataFrame, spans: DataFrame, logs: DataFrame, incidents: DataFrame, s: Settings, flow=causal_flow) -> dict[str, DataFrame]:
    """Run ``flow`` with ``s``, and once more with other settings for the incidents that need them.

    An incident without candidates is tried with a wider window, then with lower thresholds; one
    with more than ``s.keep`` with higher ones. Only such incidents are tried again, the first
    setting that leaves 1 to ``s.keep`` candidates counts (else the one given). ``setting`` in the
    result tells which: 0 the given ones, then those of ``recovery_settings`` in order.
    """
    few, many = recovery_settings(s)
    settings, most = [s, *few, *many], s.keep if s.keep is not None else 2**31 - 1
    counts = [_detected(metrics, incidents, s, 0)]
    open_rows = {True: counts[0].filter("candidates = 0"), False: counts[0].filter(F.col("candidates") > most)}
    for number, other in enumerate(settings[1:], 1):
        need = open_rows[number <= len(few)].select("incident_id")
        if need.isEmpty():
            continue
        found = _detected(metrics, written(incidents.join(need, "incident_id", "left_semi"), "again"), other, number)
        counts.append(found)
        open_rows[number <= len(few)] = found.filter(~F.col("candidates").between(1, most))
    tried = reduce(DataFrame.unionByName, counts)
    fit = tried.filter(F.col("candidates").between(1, most)).groupBy("incident_id").agg(F.min("setting").alias("setting"))
    chosen = written(incidents.select("incident_id").join(fit, "incident_id", "left").na.fill(0, ["setting"]), "settings")
    used = sorted(r.setting for r in chosen.select("setting").distinct().collect())  # at most one row a setting
    runs = [flow(metrics, spans, logs, written(incidents.join(chosen.filter(F.col("setting") == k), "incident_id", "left_semi"), "incidents"), settings[k])
            for k in used]
    out = {name: reduce(lambda a, b: a.unionByName(b), [r[name] for r in runs]) for name in (runs[0] if runs else ())}
    return {**out, "setting": chosen, "tried": tried}


def evidence_flow(metrics: DataFrame, spans: DataFrame, logs: DataFrame, incidents: DataFrame, s: Settings,
                  memory: DataFrame | None = None, cases: DataFrame | None = None, past: int = 3) -> dict[str, DataFrame]:
    """Evidence graph: metric segments, trace and log evidence, priors and past cases summed and ranked.

    ``memory`` holds (incident_id, kind, name) of retrieved cases. With ``cases`` (case_id, dataset,
    tokens, components, reasons) the flow retrieves the ``past`` best of each incident itself;
    ``incidents`` then carry instruction and dataset.
    """
    window = incidents.select("incident_id", "start_ts", "end_ts")
    reasons = list(s.reasons)
    segments = written(D.segments_a(D.points_a(metrics, ST.day_thresholds(metrics), window, reasons, s.file_name)), "segments")
    own = segments.groupBy(*KEYS).agg(F.sum("severity").alias("score"))
    trace = written(SP.trace_evidence(_inside(spans, incidents), own), "trace")
    log = written(L.reason_evidence(L.templated(logs, window), reasons), "log")
    prior = R.prior_edges(segments.select(*KEYS, "kpi", "severity")).withColumnRenamed("weight", "score").filter(F.col("reason").isin(*reasons))

    def part(df, kind, name):
        return df.filter(F.col(name).isNotNull()).select("incident_id", F.lit(kind).alias("kind"), F.col(name).alias("name"), "score")

    seg = segments.withColumn("score", F.col("severity"))
    metric = part(seg, "component", "component").unionByName(part(seg, "reason", "reason_hint"))
    logged = part(log, "component", "component").unionByName(part(log, "reason", "reason"))
    if cases is not None:
        found = recalled(segments, incidents, cases, s, past)
        memory = found if memory is None else memory.unionByName(found)
    known = (memory if memory is not None else part(seg, "component", "component").limit(0)).withColumn("score", F.lit(0.5))
    total = written(RK.accumulate(metric, part(prior, "reason", "reason"), part(trace, "component", "component"), logged, known), "accumulated")
    local = seg.filter("reason_hint IS NOT NULL").select(*KEYS, F.col("reason_hint").alias("reason"), "score").unionByName(
        prior.select(*KEYS, "reason", "score")).groupBy(*KEYS, "reason").agg(F.sum("score").alias("score"))
    pick = lambda kind, name: total.filter(F.col("kind") == kind).select("incident_id", F.col("name").alias(name), "score")
    ranked = written(RK.evidence_ranking(segments, pick("component", "component"), local, pick("reason", "reason"), incidents,
                                         s.components[0], reasons[0]), "answers")
    confidence = RK.report_confidence(segments, trace, log, window)
    return {"segments": segments, "accumulated": total, "final": ranked, "confidence": confidence,
            "notes": RK.recheck_notes(confidence), "conflict": RK.conflict(own, trace)}


def recalled(segments: DataFrame, incidents: DataFrame, cases: DataFrame, s: Settings, k: int = 3) -> DataFrame:
    """(incident_id, kind, name) of the candidate components and reasons of each incident's ``k`` best past cases."""
    own = segments.groupBy("incident_id").agg(F.collect_set("component").alias("components"))
    asked = incidents.select("incident_id", "dataset", S.tokens(F.coalesce("instruction", F.lit(""))).alias("tokens")).join(own, "incident_id", "left")
    asked = asked.withColumn("components", F.coalesce("components", F.array().cast("array<string>"))).withColumnRenamed("incident_id", "query_id")
    best = M.retrieve_cases(asked, cases.select("case_id", "dataset", "tokens", "components"), k)
    held = best.select(F.col("query_id").alias("incident_id"), "case_id").join(cases.select("case_id", "components", "reasons"), "case_id")
    names = [held.select("incident_id", F.lit(kind).alias("kind"), F.explode(f"{kind}s").alias("name")).filter(F.col("name").isin(*known))
             for kind, known in (("component", s.components), ("reason", s.reasons))]
    return names[0].unionByName(names[1])


def cases_of(final: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows for the case memory: ``answers`` hold incident_id, case_id, dataset, task_index, instruction, prediction and score."""
    best = final.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("rank", "component", "reason"))).alias("_best"))
    return answers.join(best, "incident_id", "left").select(
        "case_id", "dataset", "task_index", F.array_sort(S.tokens(F.coalesce("instruction", F.lit("")))).alias("tokens"),
        *[F.coalesce(F.array_compact(f"_best.{c}"), F.array().cast("array<string>")).alias(f"{c}s") for c in ("component", "reason")], "score", "prediction")


def predict(final: DataFrame, incidents: DataFrame, s: Settings, fields: str = "target_fields", causes: DataFrame | None = None,
            global_time: DataFrame | None = None) -> DataFrame:
    """Prediction text per incident, completed and constrained to the candidates.

    Where several failures are asked for, the spaced ``causes`` of a flow answer; what they
    leave open, and single failures, come from the ranked rows of ``final``. An incident that
    asks for one time and nothing else takes it from ``global_time``, if given.
    """
    if global_time is not None:
        alone = incidents.filter(F.col("time_only") & (F.col("failure_count") == 1)).select("incident_id")
        final = (final.join(global_time.select("incident_id", "global_ts").join(alone, "incident_id", "left_semi"), "incident_id", "left")
                 .withColumn("ts", F.coalesce("global_ts", "ts")).drop("global_ts"))
    given = (final.limit(0).withColumnRenamed("rank", "position") if causes is None else
             causes.join(incidents.filter("failure_count > 1").select("incident_id"), "incident_id", "left_semi"))
    given = given.select("incident_id", "position", "component", "reason", "ts")
    answers = RK.complete_answers(incidents, given, final, s.components, s.reasons)
    return RK.render_predictions(answers.join(incidents.select("incident_id", fields), "incident_id"), fields)
