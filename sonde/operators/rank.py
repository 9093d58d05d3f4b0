"""Root-cause rankings, onset times, selection of several causes, completion of answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonde.functions import fixed as V
from sonde.functions import scalars as S
from sonde.operators.windows import top_k
from sonde.plans.stages import written

KEYS = ["incident_id", "component"]


def direct_prior(component):
    kind = S.component_type(component)
    return S.first_match([(kind == k, p) for k, p in V.DIRECT_TYPE_PRIOR.items()], V.DIRECT_TYPE_PRIOR_DEFAULT)


def _ranked(df: DataFrame, score: str, name: str = "rank") -> DataFrame:
    w = W.partitionBy("incident_id").orderBy(F.desc(score), "component")
    return df.withColumn(name, F.row_number().over(w))


def intervention_ranking(nodes: DataFrame, explain: DataFrame) -> DataFrame:
    """v1: mean of three weightings of explanation, type prior, earliness and severity, with softmax."""
    w = W.partitionBy("incident_id")
    df = nodes.select(*KEYS, "score", "first_ts").join(explain, KEYS).withColumn(
        "early", F.exp(-(F.col("first_ts") - F.min("first_ts").over(w)) / 300.0)).withColumn("prior", direct_prior(F.col("component")))
    mixes = ((0.40, 0.30, 0.15, 0.15), (0.10, 0.20, 0.20, 0.50), (0.15, 0.50, 0.15, 0.20))
    parts = ("explain_score", "prior", "early", "score")
    total = reduce(lambda a, b: a + b, [sum((F.col(c) * m for c, m in zip(parts, mix)), F.lit(0.0)) for mix in mixes])
    return softmax(_ranked(df.withColumn("root_score", S.rounded(S.clamp(total / 3.0), 6)), "root_score"))


def softmax(ranking: DataFrame, kappa: float = 5.0) -> DataFrame:
    """Share of each candidate under a softmax shifted by the best score."""
    w = W.partitionBy("incident_id")
    e = F.exp(kappa * (F.col("root_score") - F.max("root_score").over(w)))
    df = ranking.withColumn("_e", e)
    return df.withColumn("probability", S.rounded(F.col("_e") / F.sum("_e").over(w), 6)).drop("_e")


def top_confidence(ranking: DataFrame, quality: DataFrame) -> DataFrame:
    """0.50 best + 0.30 margin to the second + 0.20 graph quality per incident."""
    g = ranking.groupBy("incident_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("root_score"))).alias("_a"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("root_score"))), F.lit(0.0)).alias("_b"))
    score = 0.50 * F.col("_a") + 0.30 * F.greatest(F.lit(0.0), F.col("_a") - F.col("_b")) + 0.20 * F.coalesce("quality", F.lit(0.0))
    return g.join(quality, "incident_id", "left").select("incident_id", S.rounded(score, 6).alias("confidence"))


def intervention_ranking_v2(nodes: DataFrame, evidence: DataFrame, edges: DataFrame, unexplained: DataFrame, top: int | None = 4) -> DataFrame:
    """v2: .35 evidence + .20 source + .20 earliness + .25 unexplained; adaptive number kept (top None: all)."""
    hot = nodes.select("incident_id", F.col("component").alias("source"), F.col("score").alias("_p"))
    parents = edges.join(hot, ["incident_id", "source"]).groupBy("incident_id", F.col("target").alias("component")).agg(F.max("_p").alias("_pmax"))
    w = W.partitionBy("incident_id")
    df = (nodes.select(*KEYS, "score", "first_ts").join(evidence.select(*KEYS, "evidence"), KEYS, "left")
          .join(parents, KEYS, "left").join(unexplained, KEYS, "left"))
    source = F.when(F.col("_pmax").isNull(), 0.85).otherwise(
        F.greatest(F.lit(0.15), 0.50 * F.col("score") / F.greatest(F.col("_pmax"), F.lit(0.01))))
    early = F.exp(-(F.col("first_ts") - F.min("first_ts").over(w)) / 300.0)
    score = (0.35 * F.coalesce("evidence", "score") + 0.20 * source + 0.20 * early + 0.25 * F.coalesce("unexplained", F.lit(0.0)))
    ranked = _ranked(df.withColumn("root_score", S.rounded(S.clamp(score), 6)), "root_score")
    kept = F.lit(True) if top is None else F.col("rank") <= F.greatest(F.lit(top), F.ceil(F.sqrt(F.count("*").over(w))) + top)
    return ranked.withColumn("kept", kept).select(*KEYS, "score", "first_ts", "root_score", "rank", "kept")


def final_blend(ranking: DataFrame, reasons: DataFrame, contextual: DataFrame, quality: DataFrame, top: int | None = 4) -> DataFrame:
    """v1 blend over the best ``top`` candidates (None: all) with its two promotions.

    A candidate whose graph-free score beats that of the leader by more than 0.10 is promoted;
    then an infrastructure leader gives way to the best service or pod within 0.15.
    """
    w = W.partitionBy("incident_id")
    best = ranking if top is None else ranking.filter(F.col("rank") <= top)
    df = (best.join(reasons, KEYS, "left").join(contextual.select(*KEYS, "discounted"), KEYS, "left")
          .join(quality, "incident_id", "left").na.fill(0.0, ["reason_score", "discounted", "quality"]))
    lo, hi = F.min("first_ts").over(w), F.max("first_ts").over(w)
    early = 1.0 - (F.col("first_ts") - lo) / F.greatest(hi - lo, F.lit(1))
    bonus = 0.0005 * (F.count("*").over(w) - F.col("rank") + 1)
    df = df.withColumn("early", early).withColumn("graph_free", S.rounded(
        0.35 * F.col("score") + 0.25 * F.col("early") + 0.20 * F.col("reason_score") + 0.20 * direct_prior(F.col("component")), 6))
    df = df.withColumn("combined", S.rounded(
        0.10 * F.col("score") + 0.10 * F.col("early") + 0.25 * F.col("reason_score") + 0.20 * F.col("root_score")
        + 0.25 * F.col("graph_free") + 0.05 * F.col("discounted") + 0.05 * F.col("quality") + bonus, 6))
    lead = W.partitionBy("incident_id").orderBy(F.desc("combined"), "component")
    whole = lead.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = (df.withColumn("_lead_gf", F.first("graph_free").over(whole)).withColumn("_lead", F.first("combined").over(whole))
          .withColumn("_lead_c", F.first("component").over(whole))
          .withColumn("_gf", F.row_number().over(W.partitionBy("incident_id").orderBy(F.desc("graph_free"), F.desc("combined"), "component"))))
    promoted = (F.col("_gf") == 1) & (F.col("component") != F.col("_lead_c")) & (F.col("graph_free") > F.col("_lead_gf") + 0.10)
    df = df.withColumn("combined", F.when(promoted, F.greatest("combined", F.col("_lead") + 0.01)).otherwise(F.col("combined")))
    kind = S.component_type(F.col("component"))
    df = (df.withColumn("_lead", F.first("combined").over(whole)).withColumn("_lead_k", F.first(kind).over(whole))
          .withColumn("_pos", F.row_number().over(lead)).withColumn(
        "_near", (F.col("_pos") > 1) & kind.isin("service", "pod") & (F.col("_lead") - F.col("combined") < 0.15)))
    first_near = F.min(F.when(F.col("_near"), F.col("_pos"))).over(w)
    df = df.withColumn("combined", F.when(
        F.col("_lead_k").isin("middleware", "db", "redis") & (F.col("_pos") == first_near), F.col("_lead") + 0.01).otherwise(F.col("combined")))
    df = df.withColumn("combined", S.rounded(F.col("combined"), 6))
    return _ranked(df, "combined", "final_rank").select(
        *KEYS, "reason", "reason_score", "root_score", "graph_free", "combined", "final_rank")


def final_blend_v2(ranking: DataFrame, reasons: DataFrame) -> DataFrame:
    """0.65 root score + 0.35 reason score."""
    df = ranking.filter("kept").join(reasons, KEYS, "left").na.fill(0.0, ["reason_score"])
    score = S.rounded(S.clamp(0.65 * F.col("root_score") + 0.35 * F.col("reason_score")), 6)
    return _ranked(df.withColumn("final_score", score), "final_score", "final_rank").select(
        *KEYS, "reason", "reason_score", "root_score", "final_score", "final_rank")


# ------------------------------------------------------------------ times
def root_time(onsets: DataFrame, incidents: DataFrame) -> DataFrame:
    """v1: onset of the latest segment shorter than 75% of the window, else of the worst."""
    df = onsets.join(incidents.select("incident_id", (F.col("end_ts") - F.col("start_ts")).alias("_len")), "incident_id")
    short = (F.col("end_ts") - F.col("start_ts")) < 0.75 * F.col("_len")
    order = F.struct(short.cast("int"), F.when(short, F.col("end_ts").cast("double")).otherwise(F.col("severity")),
                     F.col("severity"), F.col("kpi"), F.col("start_ts"))
    return df.groupBy(*KEYS).agg(F.max_by("sustained_ts", order).alias("root_ts"))


def root_time_v2(onsets: DataFrame, incidents: DataFrame, reasons: DataFrame, file_name: str = "") -> DataFrame:
    """v2: onset of the segment best by severity * (.55 match + .30 compactness + .15)."""
    df = (onsets.join(incidents.select("incident_id", (F.col("end_ts") - F.col("start_ts")).alias("_len")), "incident_id")
          .join(reasons.select(*KEYS, "reason"), KEYS))
    length = F.col("end_ts") - F.col("start_ts")
    match = F.greatest(S.family_alignment(S.reason_family(F.col("reason")), S.signal_family(F.concat("kpi", F.lit(f" {file_name}")))),
                       F.when(F.col("reason_hint") == F.col("reason"), 1.0).otherwise(0.0))
    compact = 1.0 - F.least(F.lit(1.0), length / F.greatest("_len", F.lit(1)))
    score = F.when(length >= 0.85 * F.col("_len"), F.col("severity") * 0.1).otherwise(
        F.col("severity") * (0.55 * match + 0.30 * compact + 0.15))
    df = df.withColumn("_score", F.round(score, 9))
    return df.groupBy(*KEYS).agg(F.max_by("steepest_ts", F.struct("_score", "kpi", "start_ts")).alias("root_ts"))


def global_root_time(onsets: DataFrame, incidents: DataFrame, top: DataFrame) -> DataFrame:
    """Latest onset among the short segments of the best candidates."""
    df = onsets.join(incidents.select("incident_id", (F.col("end_ts") - F.col("start_ts")).alias("_len")), "incident_id").join(
        top.select(*KEYS), KEYS, "left_semi")
    return df.filter((F.col("end_ts") - F.col("start_ts")) < 0.75 * F.col("_len")).groupBy("incident_id").agg(
        F.max("sustained_ts").alias("global_ts"))


def onset_clusters(onsets: DataFrame, incidents: DataFrame, top: DataFrame, min_length: int = 60) -> DataFrame:
    """Time where several components start: the best cluster of onsets and its upper median.

    The reach is three times 5% of the window (at least 30 s). Instead of pairing all onsets,
    each is summed over a range window of its incident; component and type counts come from
    one pass per component, whose list is bounded by the candidates.
    """
    inc = incidents.select("incident_id", (F.col("end_ts") - F.col("start_ts")).alias("_len"))
    rows = onsets.join(inc, "incident_id").join(top.select(*KEYS), KEYS, "left_semi").withColumn(
        "_dur", F.col("end_ts") - F.col("start_ts")).filter((F.col("_dur") < 0.85 * F.col("_len")) & (F.col("_dur") >= min_length))
    reach = 3 * F.greatest(F.lit(30), F.floor(F.col("_len") / 20))
    # onsets meet in slots as wide as the reach: three slots hold every neighbour
    points = rows.select("incident_id", "component", "severity", "_dur", "_len", F.col("steepest_ts").alias("ts"), reach.alias("_r"))
    slotted = points.withColumn("_slot", F.floor(F.col("ts") / F.col("_r")))
    compact = slotted.groupBy("incident_id", "_slot", "ts", "component").agg(
        F.sum("severity").alias("_s"), F.sum("_dur").alias("_d"), F.count("*").alias("_n"))
    around = compact.withColumn("_slot", F.explode(F.array(F.col("_slot") - 1, F.col("_slot"), F.col("_slot") + 1))).select(
        "incident_id", "_slot", F.col("ts").alias("o_ts"), F.col("component").alias("o_component"), "_s", "_d", "_n")
    centres = slotted.select("incident_id", "_slot", "ts", "_r", "_len").distinct()
    near = centres.join(around, ["incident_id", "_slot"]).filter(F.abs(F.col("ts") - F.col("o_ts")) <= F.col("_r"))
    cluster = near.groupBy("incident_id", "ts", "_r", "_len").agg(
        F.count_distinct(S.component_type(F.col("o_component"))).alias("types"), F.count_distinct("o_component").alias("components"),
        F.sum("_n").alias("size"), (F.sum("_s") / F.sum("_n")).alias("_sev"), (F.sum("_d") / F.sum("_n")).alias("_dur"))
    score = F.col("types") * F.col("components") * F.col("_sev") * F.least(
        F.lit(2.0), 1.0 + F.col("_dur") / F.greatest(F.col("_len"), F.lit(1)))
    best = top_k(cluster.withColumn("cluster_score", S.rounded(score, 6)), ["incident_id"], [F.desc("cluster_score"), "ts"], 1)
    members = (points.select("incident_id", F.col("ts").alias("o_ts")).join(best, "incident_id")
               .filter(F.abs(F.col("o_ts") - F.col("ts")) <= F.col("_r")))
    w = W.partitionBy("incident_id")
    ranked = members.withColumn("_i", F.row_number().over(w.orderBy("o_ts")) - 1).withColumn("_m", F.count("*").over(w))
    return ranked.filter(F.col("_i") == F.floor(F.col("_m") / 2)).select(
        "incident_id", F.col("o_ts").alias("global_ts"), "types", "components", "size", "cluster_score")


#: Units of a time scaled so that two times of an incident exclude each other within ``1 << 40`` of them.
_NEAR = 1 << 40


def spaced(pool: DataFrame) -> DataFrame:
    """The rows of ``pool`` (incident_id, _row, _at, ...) that a greedy choice by ``_row`` would take, best first and apart.

    A row that is the best within its distance will be taken whatever happens elsewhere, so
    a round takes all of these and drops what lies near them. The rows left shrink with every
    round; a round is written, so the plan does not grow with the number of answers.
    """
    near = W.partitionBy("incident_id").orderBy("_at").rangeBetween(-_NEAR, _NEAR)
    left, chosen = pool, None
    while True:
        best = left.withColumn("_best", F.max("_row").over(near).eqNullSafe(F.col("_row")))
        marked = written(best.withColumn("_lost", F.max("_best").over(near)), "spaced")
        taken = marked.filter("_best").select(pool.columns)
        chosen = taken if chosen is None else chosen.unionByName(taken)
        left = marked.filter("NOT _lost").select(pool.columns)
        if left.isEmpty():
            return chosen


def select_causes(candidates: DataFrame, incidents: DataFrame, fill_up: bool = True) -> DataFrame:
    """``failure_count`` causes per incident, best first, at least ``max(60, window / 2n)`` seconds apart.

    ``candidates`` holds (incident_id, component, ts, score, key); ``incidents`` the window and
    failure_count. The best rows that keep their distance from better ones are taken; what is
    then missing is filled with the best rows not taken yet (``fill_up``).
    """
    gap = F.greatest(F.lit(60.0), (F.col("end_ts") - F.col("start_ts")) / (2.0 * F.col("failure_count")))
    inc = incidents.filter("failure_count >= 1").select("incident_id", "failure_count", "start_ts", gap.alias("_gap"))
    pick = F.struct("score", "key", (-F.col("ts")).alias("_late"), "component")
    unique = candidates.filter("ts IS NOT NULL").groupBy("incident_id", "component", "ts").agg(
        F.max(F.struct("score", "key")).alias("b")).select("incident_id", "component", "ts", "b.*")
    # whole seconds: times are too near up to ceil(gap) - 1, half a second above which is one unit
    place = F.floor((F.col("ts") - F.col("start_ts")) * float(_NEAR) / (F.ceil("_gap") - 0.5))
    pool = written(unique.join(inc, "incident_id").select("incident_id", "failure_count", pick.alias("_row"), place.alias("_at")), "causes")
    best = W.partitionBy("incident_id").orderBy(F.desc("_row"))
    first = written(spaced(pool).withColumn("pick", F.row_number().over(best)).filter(F.col("pick") <= F.col("failure_count")), "chosen")
    both = first.select("incident_id", "pick", "_row")
    if fill_up:
        have = first.groupBy("incident_id").agg(F.count("*").alias("_have"))
        rest = (pool.join(first.select("incident_id", "_row"), ["incident_id", "_row"], "left_anti")
                .join(have, "incident_id").filter(F.col("_have") < F.col("failure_count")))
        order = W.partitionBy("incident_id").orderBy(F.desc("_row.score"), F.desc("_row.key"), F.desc("_row._late"))
        fill = rest.withColumn("pick", F.col("_have") + F.row_number().over(order)).filter(F.col("pick") <= F.col("failure_count"))
        both = both.unionByName(fill.select("incident_id", F.col("pick").cast("int"), "_row"))
    w = W.partitionBy("incident_id").orderBy("ts", "pick")
    return both.select("incident_id", "pick", "_row.component", (-F.col("_row._late")).alias("ts"), "_row.score").withColumn(
        "position", F.row_number().over(w)).select("incident_id", "component", "ts", "score", "position")


def time_causes(onsets: DataFrame, ranking: DataFrame, incidents: DataFrame) -> DataFrame:
    """Onset times for incidents that ask for several times only.

    Segments below 75% of the window compete by root score times severity (at least 0.1); the
    best that keep their distance are taken and nothing is filled up.
    """
    seg = onsets.join(incidents.select("incident_id", (F.col("end_ts") - F.col("start_ts")).alias("_len")), "incident_id").filter(
        (F.col("end_ts") - F.col("start_ts")) < 0.75 * F.col("_len"))
    pool = seg.join(ranking.select(*KEYS, "root_score"), KEYS).select(
        *KEYS, F.col("steepest_ts").alias("ts"), F.round(F.col("root_score") * F.greatest(F.lit(0.1), "severity"), 9).alias("score"),
        F.concat("component", F.lit("."), "kpi").alias("key"))
    return select_causes(pool, incidents, fill_up=False)


# ------------------------------------------------------------------ answers
def evidence_ranking(segments: DataFrame, components: DataFrame, component_reasons: DataFrame, reasons: DataFrame,
                     incidents: DataFrame, default_component: str, default_reason: str) -> DataFrame:
    """Evidence-graph answer: best components with best reason and worst segment; a fallback row if none.

    ``incidents`` carries failure_count and time_only. Time-only incidents rank segments by
    severity + min(3, duration / 180) + 1.5 with a hint, one per component.
    """
    inc = incidents.select("incident_id", "start_ts", "failure_count", "time_only")
    local = component_reasons.groupBy(*KEYS).agg(
        F.max_by(F.struct("reason", "score"), F.struct(F.round("score", 9), F.col("reason"))).alias("b")).select(
        *KEYS, F.col("b.reason").alias("_r"), F.col("b.score").alias("_rs"))
    common = reasons.groupBy("incident_id").agg(F.max_by("reason", F.struct(F.round("score", 9), F.col("reason"))).alias("_any"))
    seg = segments.withColumn("seg_score", S.rounded(
        F.col("severity") + F.least(F.lit(3.0), (F.col("end_ts") - F.col("start_ts")) / 180.0)
        + F.when(F.col("reason_hint").isNotNull(), 1.5).otherwise(0.0), 4))
    worst = segments.groupBy(*KEYS).agg(F.max_by("start_ts", F.struct("severity", "kpi", -F.col("start_ts"))).alias("_ts"))
    by_time = seg.groupBy(*KEYS).agg(F.max("seg_score").alias("score"),
                                     F.max_by("start_ts", F.struct("seg_score", "kpi", -F.col("start_ts"))).alias("_ts"))
    full = components.join(worst, KEYS, "left").select(*KEYS, "score", "_ts").withColumn("_t", F.lit(False))
    rows = full.unionByName(by_time.withColumn("_t", F.lit(True))).join(inc, "incident_id").filter(F.col("_t") == F.col("time_only"))
    rows = rows.join(local, KEYS, "left").join(common, "incident_id", "left").select(
        *KEYS, F.coalesce("_r", "_any", F.lit(default_reason)).alias("reason"), F.coalesce("_ts", "start_ts").alias("ts"),
        F.col("score").alias("_base"), S.rounded(F.col("score") + F.when(F.col("_t"), 0.0).otherwise(F.coalesce("_rs", F.lit(0.0))), 4).alias("score"),
        "failure_count")
    w = W.partitionBy("incident_id").orderBy(F.desc(F.round("_base", 9)), "component")
    best = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("failure_count"))
    none = inc.join(best, "incident_id", "left_anti").join(common, "incident_id", "left").select(
        "incident_id", F.lit(default_component).alias("component"), F.coalesce("_any", F.lit(default_reason)).alias("reason"),
        F.col("start_ts").alias("ts"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    return best.select("incident_id", "component", "reason", "ts", "score", "rank").unionByName(none)


def fallback_prediction(incidents: DataFrame, scores: DataFrame, segments: DataFrame, default_component: str,
                        default_reason: str) -> DataFrame:
    """Highest-scored component with its worst segment's hint and start; defaults where there is none."""
    top = scores.groupBy("incident_id").agg(F.max_by("component", F.struct(F.col("score"), F.col("component"))).alias("component"))
    first = segments.groupBy(*KEYS).agg(F.max_by(F.struct("reason_hint", "start_ts"),
                                                 F.struct("severity", "kpi", -F.col("start_ts"))).alias("b"))
    df = incidents.select("incident_id", F.col("start_ts").alias("_start")).join(top, "incident_id", "left").join(first, KEYS, "left")
    return df.select("incident_id", F.coalesce("component", F.lit(default_component)).alias("component"),
                     F.coalesce(F.col("b.reason_hint"), F.lit(default_reason)).alias("reason"),
                     F.coalesce(F.col("b.start_ts"), F.col("_start")).alias("ts"))


def complete_answers(incidents: DataFrame, given: DataFrame, ranked: DataFrame, components, reasons) -> DataFrame:
    """Rows 1 .. failure_count per incident: given fields, else the i-th (or last) candidate, else the window start.

    ``given`` holds (incident_id, position, component, reason, ts) with nulls where absent.
    """
    n = ranked.groupBy("incident_id").agg(F.max("rank").alias("_n"))
    rows = incidents.select("incident_id", "start_ts", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("failure_count")))).alias("position"))
    rows = rows.join(n, "incident_id", "left").withColumn("rank", F.least("position", "_n"))
    cand = ranked.select("incident_id", "rank", *[F.col(c).alias(f"_{c}") for c in ("component", "reason", "ts")])
    df = rows.join(given, ["incident_id", "position"], "left").join(cand, ["incident_id", "rank"], "left")
    value = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}"), F.lit(""))
    return df.select("incident_id", "position", S.closest_candidate(value("component"), components).alias("component"),
                     S.closest_candidate(value("reason"), reasons).alias("reason"), F.coalesce("ts", "_ts", "start_ts").alias("ts"))


def render_predictions(answers: DataFrame, fields) -> DataFrame:
    """JSON text per incident with the target fields only, in fixed order.

    ``fields`` is an array column name with the incident's target fields.
    """
    def entry(x):
        part = lambda name, value: F.when(F.array_contains(x["f"], name), F.concat(
            F.lit(f'"{name}": "'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"')))
        body = F.concat_ws(", ", part(V.FIELD_TIME, S.local_time(x["ts"])), part(V.FIELD_COMPONENT, x["component"]),
                           part(V.FIELD_REASON, x["reason"]))
        return F.concat(F.lit('"'), x["position"].cast("string"), F.lit('": {'), body, F.lit("}"))

    g = answers.groupBy("incident_id").agg(F.array_sort(F.collect_list(
        F.struct("position", "ts", "component", "reason", F.col(fields).alias("f")))).alias("a"))
    return g.select("incident_id", F.concat(F.lit("{"), F.array_join(F.transform("a", entry), ", "), F.lit("}")).alias("prediction"))


def conflict(metric: DataFrame, trace: DataFrame, top: int = 5) -> DataFrame:
    """Whether the best metric and the best trace components of an incident share none."""
    order = [F.desc(F.round("score", 9)), "component"]
    a = top_k(metric, ["incident_id"], order, top).select(*KEYS)
    b = top_k(trace, ["incident_id"], order, top).select(*KEYS)
    both = a.join(b, KEYS, "left_semi").groupBy("incident_id").agg(F.count("*").alias("_shared"))
    ids = a.select("incident_id").distinct().join(b.select("incident_id").distinct(), "incident_id")
    return ids.join(both, "incident_id", "left").select(
        "incident_id", F.coalesce("_shared", F.lit(0)).alias("shared"), (F.coalesce("_shared", F.lit(0)) == 0).alias("conflict"))


def report_confidence(segments: DataFrame, trace: DataFrame, log: DataFrame, incidents: DataFrame) -> DataFrame:
    """Confidence of the metric, trace and log reports of an incident; 0.05 without evidence."""
    best = top_k(segments, ["incident_id"], [F.desc("severity"), "component", "kpi", "start_ts"], 5, "_k").groupBy(
        "incident_id").agg((F.sum("severity") / 25.0).alias("metric"))
    t = trace.groupBy("incident_id").agg((F.sum("score") / 15.0).alias("trace"))
    lg = log.groupBy("incident_id").agg((F.sum("score") / 20.0).alias("log"))
    df = incidents.select("incident_id")
    for part in (best, t, lg):
        df = df.join(part, "incident_id", "left")
    return df.select("incident_id", *[S.rounded(F.coalesce(F.least(F.lit(1.0), F.col(c)), F.lit(0.05)), 6).alias(c)
                                      for c in ("metric", "trace", "log")])


def recheck_notes(confidence: DataFrame) -> DataFrame:
    """Notes for weak metric, trace or log evidence."""
    notes = F.array_compact(F.array(
        F.when(F.col("metric") < 0.15, "metric confidence is low"),
        F.when(F.col("trace") <= 0.05, "trace report is empty"),
        F.when(F.col("log") < 0.1, "log evidence is weak")))
    return confidence.select("incident_id", F.when(F.size(notes) > 0, notes).otherwise(F.array(F.lit("no recheck needed"))).alias("notes"))


def accumulate(metric: DataFrame, prior: DataFrame, trace: DataFrame, log: DataFrame, memory: DataFrame) -> DataFrame:
    """Component and reason scores summed over all evidence; trace counts 1.2 times, a past case 0.5.

    Each input holds (incident_id, kind, name, score) with kind 'component' or 'reason'.
    """
    cols = ["incident_id", "kind", "name", "score"]
    weighted = [metric.select(*cols), prior.select(*cols), log.select(*cols),
                trace.withColumn("score", F.col("score") * 1.2).select(*cols),
                memory.withColumn("score", F.lit(0.5)).select(*cols)]
    return reduce(lambda a, b: a.unionByName(b), weighted).groupBy("incident_id", "kind", "name").agg(F.sum("score").alias("score"))
