"""Reason evidence from KPIs, logs and trace durations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.functions import fixed as V
from sonde.functions import scalars as S


def prior_edges(kpis: DataFrame) -> DataFrame:
    """One row per KPI and reason its metric type supports, weight = prior * severity.

    The priors are a fixed short list, so they are exploded from a literal.
    """
    table = F.array(*[
        F.struct(F.lit(m).alias("metric_type"), F.lit(r).alias("reason"), F.lit(p).alias("prior"))
        for m, r, p in V.METRIC_TYPE_PRIORS])
    typed = kpis.withColumn("_type", S.metric_type(F.col("kpi")))
    rows = typed.withColumn("_p", F.explode(F.filter(table, lambda x: x["metric_type"] == F.col("_type"))))
    return rows.select(*[c for c in kpis.columns], "_p.*").withColumn(
        "weight", F.col("prior") * F.col("severity"))


def _reason_array(reasons, expression):
    """Array of struct(reason, score) over the configured reasons; a score per reason at plan time."""
    return F.array(*[F.struct(F.lit(x).alias("reason"), F.round(expression(x), 9).alias("score")) for x in reasons])


def _spread(df: DataFrame, keys, reasons, expression) -> DataFrame:
    return df.select(*keys, F.explode(_reason_array(reasons, expression)).alias("_r")).select(*keys, "_r.*")


KEYS = ["incident_id", "component"]


# ------------------------------------------------------------------ logs
def log_reason_scores(lines: DataFrame, reasons) -> DataFrame:
    """Score of each reason from the key words in a component's log lines.

    Every line of the window counts, not only the first ones of a file. Word presence and word counts are aggregated line by line with partial
    sums, so no text is ever gathered.
    """
    low = F.lower("value")
    words = sorted({w for ws in V.LOG_FAMILY_WORDS.values() for w in ws} | set(V.GC_WORDS))
    name = {w: f"_w{i}" for i, w in enumerate(words)}
    count = sum((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w) for w in V.LOG_LEVEL_WORDS)
    g = lines.groupBy(*KEYS).agg(
        *[F.max(F.contains(low, F.lit(w)).cast("int")).alias(name[w]) for w in words], F.sum(count).alias("_errors"))
    bonus = F.least(F.col("_errors") * 0.1, F.lit(0.3))

    def hits(ws):
        return sum((F.col(name[w]) for w in ws), F.lit(0))

    def score(reason: str):
        text = reason.lower()
        parts = [F.lit(0.0)]
        for family, ws in V.LOG_FAMILY_WORDS.items():
            if family in text or any(w in text for w in ws):
                parts.append(F.least(F.lit(1.0), hits(ws) / max(1, len(ws) / 2) + bonus))
        if any(w in text for w in V.GC_WORDS) or "memory" in text:
            parts.append(F.least(F.lit(1.0), 0.5 * hits(V.GC_WORDS) / max(1, len(V.GC_WORDS) / 2)))
        return F.greatest(*parts, F.lit(0.0))

    return _spread(g, KEYS, reasons, score)


# ------------------------------------------------------------------ traces
def trace_reason_scores(spans: DataFrame, reasons) -> DataFrame:
    """Score of each reason from the shape of a component's span durations.

    Order statistics are exact and need no sorted list; the sum of the lower half follows
    from what lies below the middle element.
    """
    from sonde.operators.stats import exact_percentiles
    rows = spans.filter("duration > 0").select(*KEYS, F.col("duration").cast("double").alias("duration"))
    basic = rows.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.avg("duration").alias("mean"), F.stddev_pop("duration").alias("std"),
        F.max("duration").alias("top"), F.sum("duration").alias("total")).filter("n >= 3")
    q = exact_percentiles(rows, KEYS, "duration", {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95},
                          interpolate=False)
    stat = basic.join(q, KEYS)
    half = F.floor(F.col("n") / 2)
    below = rows.join(stat.select(*KEYS, "p50"), KEYS).groupBy(*KEYS).agg(
        F.sum(F.when(F.col("duration") < F.col("p50"), F.col("duration")).otherwise(0.0)).alias("_s"),
        F.count_if(F.col("duration") < F.col("p50")).alias("_c"))
    df = stat.join(below, KEYS).withColumn("first", F.col("_s") + (half - F.col("_c")) * F.col("p50"))
    df = (df.withColumn("cv", F.col("std") / F.col("mean")).withColumn("kind", S.component_type(F.col("component")))
          .withColumn("late", (F.col("total") - F.col("first")) / (F.col("n") - half)).withColumn("early", F.col("first") / half))
    cv, zero = F.col("cv"), F.lit(0.0)

    def score(reason: str):
        text, parts = reason.lower(), [zero, zero]
        if any(w in text for w in ("latency", "delay", "timeout")):
            parts.append(F.when((cv < 0.5) & (F.col("p50") > 500), 0.7).when((cv < 0.8) & (F.col("mean") > 300), 0.5).otherwise(zero))
        if any(w in text for w in ("packet", "loss")):
            parts.append(F.when((cv > 1.0) & (F.col("p95") / F.greatest("p05", F.lit(1.0)) > 5), 0.6).when(cv > 0.8, 0.4).otherwise(zero))
        if any(w in text for w in ("cpu", "load")):
            parts.append(F.when((F.col("n") >= 5) & (F.col("late") > F.col("early") * 1.3), 0.6).otherwise(zero))
        if any(w in text for w in ("memory", "oom", "heap")):
            ratio = F.col("top") / F.greatest("p50", F.lit(1.0))
            parts.append(F.when(ratio > 5, 0.5).when(ratio > 3, 0.3).otherwise(zero))
        if any(w in text for w in ("db", "connection", "close", "limit")):
            parts.append(F.when(F.col("kind").isin("db", "redis") & (F.col("p75") - F.col("p25") > F.col("mean") * 0.5), 0.5).otherwise(zero))
        return F.greatest(*parts)

    return _spread(df, KEYS, reasons, score)


# ------------------------------------------------------------------ KPI categories
def category_reason_scores(segments: DataFrame, reasons) -> DataFrame:
    """Score of each reason from the share of severity per KPI category of a component."""
    names = ("cpu", "memory", "network", "disk", "db", "process", "other")
    per = segments.groupBy(*KEYS, S.kpi_category(F.col("kpi")).alias("cat")).agg(F.sum("severity").alias("s"))
    g = per.groupBy(*KEYS).agg(
        F.sum("s").alias("_all"), F.max("s").alias("_max"), F.count("*").alias("_n"),
        F.max_by("cat", F.struct(F.round("s", 9), F.col("cat"))).alias("_top"),
        *[F.sum(F.when(F.col("cat") == c, F.col("s")).otherwise(0.0)).alias(f"_{c}") for c in names]).filter("_all > 0")
    focus = F.col("_max") / F.col("_all") * (1.0 + 0.5 * F.greatest(F.lit(0), 3 - F.col("_n")) / 3.0)
    kind = S.component_type(F.col("component"))
    share = lambda c: F.col(f"_{c}") / F.col("_all")

    def score(reason: str):
        text = reason.lower()
        for words, source, boosts, other in V.CATEGORY_REASONS:
            if any(w in text for w in words):
                boost = S.first_match([(kind == k, b) for k, b in boosts.items()], other)
                if isinstance(source, str):
                    base = share(source) * F.when(F.col("_top") == source, focus).otherwise(0.7)
                else:
                    base = sum((share(c) * w for c, w in source), F.lit(0.0))
                return F.least(F.lit(1.0), base * boost)
        return F.lit(0.0)

    return _spread(g, KEYS, reasons, score)


# ------------------------------------------------------------------ profiles and patterns
def _with_family(segments: DataFrame, file_name: str = "") -> DataFrame:
    return segments.withColumn("_family", S.signal_family(F.concat("kpi", F.lit(f" {file_name}"))))


def _reason_parts(segments: DataFrame, reasons, severity, file_name: str) -> DataFrame:
    """(incident, component, reason, part): hinted severity plus severity times family alignment."""
    family = F.col("_family")
    parts = F.array(*[F.struct(F.lit(x).alias("reason"), (F.col("_mass") * (
        F.when(F.col("reason_hint") == x, 1.0).otherwise(0.0)
        + S.family_alignment(S.reason_family(F.lit(x)), family))).alias("part")) for x in reasons])
    # the family is computed per KPI once, then paired with the reasons
    rows = _with_family(segments.filter("severity > 0"), file_name).withColumn("_mass", severity).groupBy(
        *KEYS, "_family", "reason_hint").agg(F.sum("_mass").alias("_mass"))
    return rows.select(*KEYS, F.explode(parts).alias("p")).select(*KEYS, "p.*")


def component_profiles(segments: DataFrame, file_name: str = "") -> DataFrame:
    """Local evidence of a component: best family severity, ownership- and rarity-weighted, by the incident's best."""
    text = F.concat("kpi", F.lit(f" {file_name}"))
    owned = F.col("severity") * S.ownership_weight(S.component_type(F.col("component")), text)
    fam = segments.filter("severity > 0").groupBy(*KEYS, S.signal_family(text).alias("family")).agg(F.sum(owned).alias("s"))
    n = segments.groupBy("incident_id").agg(F.count_distinct("component").alias("_n"))
    df = fam.groupBy("incident_id", "family").agg(F.count("*").alias("_df")).join(n, "incident_id").withColumn(
        "_idf", 1.0 + F.log((1.0 + F.col("_n")) / (1.0 + F.col("_df"))))
    local = fam.join(df, ["incident_id", "family"]).groupBy(*KEYS).agg(F.max(F.col("s") * F.col("_idf")).alias("_l"))
    best = local.groupBy("incident_id").agg(F.max("_l").alias("_b"))
    return local.join(best, "incident_id").select(*KEYS, S.rounded(
        F.least(F.lit(1.0), F.col("_l") / F.greatest(F.col("_b"), F.lit(1e-9))), 6).alias("local_evidence"))


def profile_reasons(segments: DataFrame, reasons, file_name: str = "") -> DataFrame:
    """Reason evidence of a component relative to the largest of the incident."""
    text = F.concat("kpi", F.lit(f" {file_name}"))
    owned = F.col("severity") * S.ownership_weight(S.component_type(F.col("component")), text)
    raw = _reason_parts(segments, reasons, owned, file_name).groupBy(*KEYS, "reason").agg(F.sum("part").alias("_raw"))
    best = raw.groupBy("incident_id").agg(F.max("_raw").alias("_b"))
    return raw.join(best, "incident_id").select(*KEYS, "reason", F.round(
        F.least(F.lit(1.0), F.col("_raw") / F.greatest(F.col("_b"), F.lit(1e-9))), 9).alias("score"))


def keyword_reasons(segments: DataFrame, reasons, file_name: str = "") -> DataFrame:
    """Hint and alignment evidence relative to the component's own largest."""
    raw = _reason_parts(segments, reasons, F.col("severity"), file_name).groupBy(*KEYS, "reason").agg(F.sum("part").alias("_raw"))
    best = raw.groupBy(*KEYS).agg(F.max("_raw").alias("_b"))
    return raw.join(best, KEYS).select(*KEYS, "reason", F.round(F.when(
        F.col("_b") > 0, F.least(F.lit(1.0), F.col("_raw") / F.greatest(F.col("_b"), F.lit(1e-12)))).otherwise(0.0), 9).alias("score"))


def pattern_reasons(segments: DataFrame, reasons, file_name: str = "") -> DataFrame:
    """How well the observed KPI families of a component match each reason's signature."""
    fam = _with_family(segments, file_name).groupBy(*KEYS, "_family").agg(
        F.sum("severity").alias("s"), F.count("*").alias("k"))
    names = sorted({f for sig in V.REASON_SIGNATURES.values() for f in sig} | {n for n, _ in V.SIGNAL_FAMILIES} | {"other"})
    tot = fam.groupBy(*KEYS).agg(F.max("s").alias("_max"), F.sum("k").alias("_k"))
    idf = F.greatest(F.lit(0.1), F.log((1.0 + F.col("_k")) / (1.0 + F.col("k"))))
    obs = fam.join(tot, KEYS).withColumn("o", F.col("s") / F.greatest("_max", F.lit(1e-9)) * idf)
    at = lambda c, f: F.sum(F.when(F.col("_family") == f, F.col(c)).otherwise(0)).alias(f"_{c}_{f}")
    g = obs.groupBy(*KEYS).agg(F.count("*").alias("_n"), *[at("o", f) for f in names], *[at("k", f) for f in names])
    by_lower = {k.lower(): v for k, v in V.REASON_SIGNATURES.items() if k == k.lower()}

    def score(reason: str):
        sig = by_lower.get(reason.lower()) or V.REASON_SIGNATURES.get(reason)
        if not sig:
            own = S.reason_family(F.lit(reason))
            return S.first_match([(own == f, F.col(f"_o_{f}")) for f in names], 0.0)
        match = sum((F.least(F.col(f"_o_{f}"), F.lit(1.0)) * w for f, w in sig.items()), F.lit(0.0)) / len(sig)
        kpis = sum((F.col(f"_k_{f}") for f in sig), F.lit(0))
        specific = F.when(kpis > 0, 1.0 / (1.0 + 0.15 * kpis)).otherwise(0.5)
        seen = sum((F.when(F.col(f"_k_{f}") > 0, 1).otherwise(0) for f in sig), F.lit(0))
        penalty = F.least(F.lit(0.30), 0.10 * (F.col("_n") - seen))
        return S.clamp(match * (0.6 + 0.4 * specific) * (1.0 - penalty))

    return _spread(g, KEYS, reasons, score)


# ------------------------------------------------------------------ choice
def _all_reasons(components: DataFrame, reasons) -> DataFrame:
    return components.select(*KEYS, F.explode(F.array(*[
        F.struct(F.lit(i).alias("order"), F.lit(x).alias("reason")) for i, x in enumerate(reasons)])).alias("_r")).select(*KEYS, "_r.*")


def _attach(df: DataFrame, scores: DataFrame, name: str) -> DataFrame:
    joined = df.join(scores.select(*KEYS, "reason", F.col("score").alias(name)), [*KEYS, "reason"], "left")
    return joined.na.fill(0.0, [name])


def hint_scores(segments: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """KPI evidence of v1: hinted severity by the component's largest, with the connection-state adjustment.

    Connection-state KPIs next to interface KPIs (anomalous, or present in ``series``) speak
    for latency and halve packet loss.
    """
    raw = segments.filter("reason_hint IS NOT NULL").groupBy(*KEYS, F.col("reason_hint").alias("reason")).agg(F.sum("severity").alias("_s"))
    best = raw.groupBy(*KEYS).agg(F.max("_s").alias("_b"))
    base = raw.join(best, KEYS).select(*KEYS, "reason", F.when(
        F.col("_b") > 0, F.least(F.lit(1.0), F.col("_s") / F.greatest("_b", F.lit(1e-12)))).otherwise(0.0).alias("score"))
    low = F.lower("kpi")
    state = S.has_any(low, V.CONNECTION_STATE_WORDS)
    names = segments.select(*KEYS, "kpi")
    if series is not None:
        names = names.unionByName(series.select(*KEYS, "kpi"))
    nic = names.filter(S.has_any(low, V.INTERFACE_WORDS)).select(*KEYS).distinct()
    tcp = segments.filter(state).groupBy(*KEYS).agg(F.least(F.lit(1.0), F.sum("severity") * 0.9).alias("_t")).join(nic, KEYS, "left_semi")
    lifted = tcp.select(*KEYS, F.lit("network latency").alias("reason"), F.col("_t").alias("score"))
    halved = base.join(tcp, KEYS, "left").select(*KEYS, "reason", F.when(
        F.col("_t").isNotNull() & (F.col("reason") == "network packet loss"), F.col("score") * 0.5).otherwise(F.col("score")).alias("score"))
    return halved.unionByName(lifted).groupBy(*KEYS, "reason").agg(F.max("score").alias("score"))


def choose_reason(components: DataFrame, reasons, kpi: DataFrame, log: DataFrame, trace: DataFrame,
                  category: DataFrame) -> DataFrame:
    """Best reason v1: .35 KPI + .15 (.4 log + .3 trace + .3 category) + .45 type prior."""
    df = _all_reasons(components, reasons)
    for scores, name in ((kpi, "_kpi"), (log, "_log"), (trace, "_trace"), (category, "_cat")):
        df = _attach(df, scores, name)
    w = V.REASON_WEIGHTS
    prior = S.reason_prior(F.col("reason"), S.component_type(F.col("component")))
    score = (w["kpi"] * F.col("_kpi") + w["observed"] * (0.4 * F.col("_log") + 0.3 * F.col("_trace") + 0.3 * F.col("_cat"))
             + w["prior"] * prior)
    return _best(df.withColumn("score", S.rounded(score, 6)))


def choose_reason_by_pattern(components: DataFrame, reasons, pattern: DataFrame, keyword: DataFrame, profile: DataFrame,
                             log: DataFrame) -> DataFrame:
    """Best reason v2: pattern evidence, else half of keyword or profile, with a reliability-dependent prior."""
    df = _all_reasons(components, reasons)
    for scores, name in ((pattern, "_pattern"), (keyword, "_keyword"), (profile, "_profile"), (log, "_log")):
        df = _attach(df, scores, name)
    kpi = F.when(F.col("_pattern") > 0, F.col("_pattern")).otherwise(0.5 * F.greatest("_keyword", "_profile"))
    df = df.withColumn("_kpi", kpi)
    prior = S.reason_prior(F.col("reason"), S.component_type(F.col("component")))
    weight = 0.10 + 0.25 * (1.0 - F.greatest("_kpi", "_log"))
    score = (1.0 - weight) * (0.70 * F.col("_kpi") + 0.25 * F.col("_log")) + weight * prior
    return _best(df.withColumn("score", S.rounded(score, 6)))


def _best(df: DataFrame) -> DataFrame:
    """First best reason in configured order per component."""
    pick = F.max_by(F.struct("reason", "score"), F.struct(F.col("score"), -F.col("order")))
    return df.groupBy(*KEYS).agg(pick.alias("b")).select(*KEYS, F.col("b.reason").alias("reason"), F.col("b.score").alias("reason_score"))
