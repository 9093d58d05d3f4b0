"""Scalar rules as Spark column expressions (JVM side, no Python in the rows)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonde.functions import fixed as V


def rounded(c: Column, digits: int) -> Column:
    """Round; the nudge makes exact ties go up whatever the order of a distributed sum was."""
    return F.round(c + F.lit(1e-9), digits) + F.lit(0.0)


def steady_mean(c: Column) -> Column:
    """Mean of a group of doubles whose last bit does not depend on the order in which tasks add them.

    Equal values have that value as their mean; others are added as decimals. Plain sums remain only
    for values too small or too large for 18 decimals, where the bits lost would be more than those won.
    """
    low, high = F.min(c), F.max(c)
    exact = F.try_avg(c.try_cast("decimal(38,18)")).cast("double")
    fits = (F.count(c.try_cast("decimal(38,18)")) == F.count(c)) & (F.greatest(F.abs(low), F.abs(high)) >= 1e-3)
    return F.when(low == high, low).when(fits, F.coalesce(exact, F.avg(c))).otherwise(F.avg(c))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def has_any(text: Column, words) -> Column:
    """True when the text holds at least one of the words (one expression, however many words)."""
    words = list(words)
    if len(words) == 1:
        return F.contains(text, F.lit(words[0]))
    return text.rlike("|".join(re.escape(w) for w in words))


def first_match(rules, default=None) -> Column:
    """``rules`` is a list of (condition, value); the first true condition gives the value."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


# ------------------------------------------------------------------ time
def epoch_of_naive(ts: Column) -> Column:
    """Epoch seconds of a zone-less timestamp, independent of the session zone."""
    return (
        F.unix_date(F.to_date(ts)).cast("bigint") * 86400
        + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    )


def normalise_epoch(raw: Column) -> Column:
    """Seconds since the epoch; values that look like milliseconds are divided; junk is null."""
    n = raw.try_cast("double")
    whole = F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("bigint")
    return F.when(F.abs(whole) >= V.MILLISECOND_FLOOR, F.floor(whole / F.lit(1000)).cast("bigint")
                  ).otherwise(whole)


def _naive(seconds: Column) -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def local_time(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` at UTC+8, whatever the session zone is."""
    return _naive(ts + V.LOCAL_OFFSET_SECONDS).cast("string")


def local_day(ts: Column) -> Column:
    """Day folder name, ``yyyy_MM_dd`` at UTC+8."""
    return F.replace(F.substring(local_time(ts), 1, 10), F.lit("-"), F.lit("_"))


def local_to_epoch(text: Column) -> Column:
    """Inverse of :func:`local_time`; null when the text is no such time."""
    t = text.try_cast("timestamp_ntz")
    return epoch_of_naive(t) - V.LOCAL_OFFSET_SECONDS


def half_hour(ts: Column) -> Column:
    return F.floor(ts / V.HALF_HOUR).cast("bigint") * V.HALF_HOUR


def half_hour_label(ts: Column) -> Column:
    start = half_hour(ts)
    return F.concat(local_time(start), F.lit(" to "), local_time(start + V.HALF_HOUR))


# ------------------------------------------------------------------ components
def component_type(component: Column) -> Column:
    low = F.lower(component)
    starts = lambda prefixes: reduce(lambda a, b: a | b, [low.startswith(p) for p in prefixes])
    return first_match([
        (starts(V.NODE_PREFIXES) | low.isin(*V.NODE_NAMES), "node"),
        (F.contains(low, F.lit(V.DB_WORD)) | low.startswith(V.DB_PREFIX), "db"),
        (F.contains(low, F.lit(V.REDIS_WORD)), "redis"),
        (low.startswith(V.POD_PREFIX) | low.rlike(V.POD_SUFFIX_RE) | F.contains(low, F.lit(V.POD_MARK)), "pod"),
        (has_any(low, V.SERVICE_WORDS), "service"),
        (starts(V.MIDDLEWARE_PREFIXES) | has_any(low, V.MIDDLEWARE_WORDS), "middleware"),
    ], "service")


def type_prior(source_type: Column, target_type: Column) -> Column:
    """Propagation prior of a (source type, target type) pair from the fixed table."""
    table = F.create_map(*[
        F.lit(x) for (s, t), p in V.TYPE_PRIORS.items() for x in (f"{s}>{t}", p)])
    return F.coalesce(
        F.try_element_at(table, F.concat(source_type, F.lit(">"), target_type)),
        F.lit(V.TYPE_PRIOR_DEFAULT))


def reason_prior(reason: Column, kind: Column) -> Column:
    low = F.lower(reason)
    return first_match(
        [(kind.isin(*kinds) & has_any(low, words), p) for kinds, words, p in V.REASON_PRIORS],
        V.REASON_PRIOR_DEFAULT)


# ------------------------------------------------------------------ KPIs
def is_low_sensitive(kpi: Column) -> Column:
    return has_any(F.lower(kpi), V.LOW_SENSITIVE_WORDS)


#: What the name of a KPI tells, in the order of the bits of :func:`kpi_traits`.
KPI_TRAITS = (
    ("low_sensitive", lambda low: has_any(low, V.LOW_SENSITIVE_WORDS)),
    ("percent", lambda low: has_any(low, V.PERCENT_WORDS)),
    ("percent_narrow", lambda low: has_any(low, V.PERCENT_WORDS_NARROW)),
    ("free", lambda low: has_any(low, V.FREE_WORDS)),
    ("memory", lambda low: has_any(low, V.MEMORY_WORDS)),
    ("cpu", lambda low: F.contains(low, F.lit("cpu"))),
    ("cpu_util", lambda low: F.contains(low, F.lit("cpu")) & has_any(low, ("util", "percent", "pct"))),
    ("busy_disk", lambda low: has_any(low, V.BUSY_DISK_WORDS)),
    ("agent", lambda low: F.contains(low, F.lit("zabbix_agentd"))),
)


def kpi_traits(kpi: Column) -> Column:
    """All word tests of a KPI's name as bits of one int, so that rows need none of their own; none for null."""
    low = F.lower(kpi)
    bits = [F.when(test(low), 1 << i).otherwise(0) for i, (_, test) in enumerate(KPI_TRAITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def has_trait(traits: Column, name: str) -> Column:
    i = [n for n, _ in KPI_TRAITS].index(name)
    return traits.bitwiseAND(F.lit(1 << i)) != 0


def saturation_bounded(kpi: Column, value: Column, median: Column, high: Column, traits: Column | None = None) -> Column:
    """Absolute saturation of percent KPIs, at most 1. ``traits`` are those of the KPI, where they are known."""
    traits = kpi_traits(kpi) if traits is None else traits
    percent = has_trait(traits, "percent")
    steady = (median >= 85) & (high >= 88)
    free = has_trait(traits, "free")
    memory = has_trait(traits, "memory") & percent
    cpu = has_trait(traits, "cpu") & percent
    return first_match([
        (free & percent & (value <= 10), F.least(F.lit(1.0), 0.25 + (10.0 - value) / 12.0)),
        (free, 0.0),
        (memory & (value >= 95), F.least(F.lit(1.0), 0.50 + (value - 95.0) / 10.0)),
        (memory & (value >= 88) & ~steady, F.least(F.lit(1.0), 0.25 + (value - 88.0) / 12.0)),
        (memory & (value >= 90) & steady, F.least(F.lit(0.8), 0.20 + (value - 90.0) / 15.0)),
        (cpu & (value >= 90), F.least(F.lit(1.0), 0.35 + (value - 90.0) / 10.0)),
        (cpu & (value >= 85) & ~steady, F.least(F.lit(1.0), 0.20 + (value - 85.0) / 15.0)),
        (has_trait(traits, "busy_disk") & (value >= 80),
         F.least(F.lit(1.0), 0.20 + (value - 80.0) / 20.0)),
    ], 0.0)


def saturation_open(kpi: Column, value: Column, median: Column, high: Column, traits: Column | None = None) -> Column:
    """Absolute saturation on the z-like scale of segment detector A (up to 4). ``traits`` are those of the KPI, where known."""
    traits = kpi_traits(kpi) if traits is None else traits
    percent = has_trait(traits, "percent_narrow")
    steady = (median >= 85) & (high >= 88)
    free = has_trait(traits, "free")
    return first_match([
        (free & percent & (value <= 10), F.least(F.lit(3.0), 0.75 + (10.0 - value) / 4.0)),
        (free, 0.0),
        (has_trait(traits, "memory") & percent & (value >= 88) & ~steady,
         F.least(F.lit(4.0), 0.75 + (value - 88.0) / 4.0)),
        (has_trait(traits, "cpu") & percent & (value >= 85) & ~steady,
         F.least(F.lit(3.5), 0.5 + (value - 85.0) / 5.0)),
        (has_trait(traits, "busy_disk") & (value >= 80),
         F.least(F.lit(3.0), 0.5 + (value - 80.0) / 8.0)),
    ], 0.0)


def kpi_category(kpi: Column) -> Column:
    low = F.lower(kpi)
    rules = []
    for name, words in V.KPI_CATEGORIES:
        if name == "cpu":
            rules.append((has_any(low, words) & has_any(low, V.CPU_EXCLUSIONS), "other"))
        rules.append((has_any(low, words), name))
    return first_match(rules, "other")


def reason_hint(text: Column, candidates, rules=V.REASON_HINT_RULES) -> Column:
    """Reason of the first rule with a matching key word and a candidate reason.

    ``candidates`` is the (small, configured) list of allowed reasons.
    """
    low = F.lower(text)
    chain = []
    for words, reasons in rules:
        allowed = [r for r in reasons if r in candidates]
        if allowed:
            chain.append((has_any(low, words), allowed[0]))
    return first_match(chain, F.lit(None).cast("string")) if chain else F.lit(None).cast("string")


# ------------------------------------------------------------------ text
def log_template(value: Column) -> Column:
    """Lower-cased, space-compacted message with numbers and hex ids masked."""
    flat = F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))
    return F.regexp_replace(flat, V.TEMPLATE_RE, V.TEMPLATE_MARK)


def template_id(template: Column) -> Column:
    return F.substring(F.sha1(F.encode(template, "UTF-8")), 1, 12)


def tokens(text: Column) -> Column:
    """Distinct lower-case alphanumeric tokens longer than two characters."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


# ------------------------------------------------------------------ evidence families
def _families(low: Column, rules) -> Column:
    return first_match(
        [(reduce(lambda a, b: a & b, [has_any(low, g) for g in groups]), name)
         for name, groups in rules], "other")


def signal_family(text: Column) -> Column:
    return _families(F.lower(text), V.SIGNAL_FAMILIES)


def reason_family(reason: Column) -> Column:
    low = F.lower(reason)
    rules = []
    for name, groups in V.REASON_FAMILIES:
        hit = reduce(lambda a, b: a & b, [has_any(low, g) for g in groups])
        rules.append((hit | low.rlike(V.CLOSE_WORD_RE) if name == "db_close" else hit, name))
    return first_match(rules, "other")


def broad_family(family: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in V.BROAD_FAMILY.items() for x in kv])
    return F.try_element_at(table, family)


def family_alignment(reason_fam: Column, signal_fam: Column) -> Column:
    same_broad = broad_family(reason_fam) == broad_family(signal_fam)
    return F.when(reason_fam == signal_fam, 1.0).when(same_broad, 0.45).otherwise(0.0)


def ownership_weight(kind: Column, text: Column) -> Column:
    low = F.lower(text)
    rules = []
    for kinds, words, weight in V.OWNERSHIP_RULES:
        hit = has_any(low, words)
        rules.append((kind.isin(*kinds) & hit if kinds else hit, weight))
    return first_match(rules, V.OWNERSHIP_DEFAULT)


def metric_type(kpi: Column) -> Column:
    low = F.lower(kpi)
    return first_match([(has_any(low, words), name) for name, words in V.METRIC_TYPES], "unknown")


# ------------------------------------------------------------------ candidate lists
def normalise_component(raw: Column, candidates) -> Column:
    """Map a raw component id to a candidate of the (configured) list, else keep it.

    Rules in order: pod of the same service, exact, dotted halves, suffix strip,
    head before a colon, name-N inside, candidate inside (longest, then by name).
    """
    value = F.trim(raw)
    known = sorted({c.strip() for c in candidates if c.strip()})
    pods = [c for c in known if re.search(r"-\d+$", c)]
    first_pod: dict[str, str] = {}
    for c in pods:
        for i in (m.start() for m in re.finditer("-", c)):
            first_pod.setdefault(c[:i], c)
    exact = _lookup({c: c for c in known})
    pod_of = _lookup(first_pod)

    def pod(name: Column) -> Column:
        return F.when(~name.rlike(r"-\d+$"), pod_of(name))

    steps = [pod(value), exact(value)]
    left = F.substring_index(value, ".", 1)
    right = F.substring_index(F.substring(value, F.length(left) + 2, F.length(value)), ".", 1)
    dotted = F.contains(value, F.lit("."))
    steps += [F.when(dotted, exact(left)), F.when(dotted, exact(right))]
    service = value
    for suffix in V.COMPONENT_SUFFIXES:
        found = F.contains(service, F.lit(suffix))
        head = F.substring_index(service, suffix, 1)
        steps += [F.when(found, pod(head)), F.when(found, exact(head))]
        service = F.when(found, head).otherwise(service)
    steps.append(F.when(F.contains(value, F.lit(":")), exact(
        F.substring_index(F.substring_index(value, ":", 1), ".", 1))))
    steps.append(exact(F.regexp_extract(value, r"([A-Za-z][A-Za-z0-9_-]+-\d+)", 1)))
    inside = [c for c in sorted(known, key=lambda c: (-len(c), c))]
    steps += [F.when(F.contains(value, F.lit(c)), c) for c in inside]
    return F.coalesce(*steps, value)


def _lookup(table: dict[str, str]):
    if not table:
        return lambda key: F.lit(None).cast("string")
    literal = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return lambda key: F.try_element_at(literal, key)


def closest_candidate(value: Column, candidates) -> Column:
    """Exact candidate, else the most similar one (edit distance ratio >= 0.3), else the first."""
    names = list(candidates)

    def ratio(name: str) -> Column:
        longest = F.greatest(F.length(value), F.lit(len(name)), F.lit(1))
        return F.lit(1.0) - F.levenshtein(value, F.lit(name)) / longest

    scored = F.array(*[
        F.struct(F.round(ratio(n), 9).alias("score"), F.lit(-i).alias("order"),
                 F.lit(n).alias("name")) for i, n in enumerate(names)])
    best = F.array_max(scored)
    return (F.when(value.isin(*names), value)
            .when(best["score"] >= 0.3, best["name"]).otherwise(names[0]))
