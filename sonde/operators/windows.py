"""Incident windows, resampling, filling, segmentation and onsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonde.functions import fixed as V
from sonde.plans.stages import written

DAY = 86400
SERIES = ("component", "kpi")


def whole_days(incidents: DataFrame) -> DataFrame:
    """The windows widened to the local days (UTC+8) that they touch."""
    start = lambda ts: F.floor((ts + V.LOCAL_OFFSET_SECONDS) / 86400).cast("bigint") * 86400 - V.LOCAL_OFFSET_SECONDS
    return incidents.select("incident_id", start(F.col("start_ts")).alias("start_ts"), (start(F.col("end_ts")) + 86399).alias("end_ts"))


def window_join(rows: DataFrame, windows: DataFrame, start: str = "start_ts", end: str = "end_ts",
                keys=(), width: int = V.HALF_HOUR, ts: str = "ts") -> DataFrame:
    """Rows with ``start <= ts <= end`` of each window, as an equi-join on time slots.

    A window is exploded into the slots it touches and every row lies in one slot, so a
    pair meets once. When the rows carry ``day`` it joins too, which prunes day
    partitions at run time. The strategy (broadcast of the windows or a shuffle with
    skew splitting) is left to the sizes Spark measures.
    """
    slots = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    right = windows.withColumn("_slot", F.explode(slots))
    on = ["_slot", *keys]
    if "day" in rows.columns:
        right = right.withColumn("day", F.floor(F.col("_slot") * width / DAY).cast("bigint"))
        on.append("day")
    left = rows.withColumn("_slot", F.floor(F.col(ts) / width))
    return left.join(right, on).filter(F.col(ts).between(F.col(start), F.col(end))).drop("_slot")


def expand_window(incidents: DataFrame, minutes: int) -> DataFrame:
    return incidents.withColumn("start_ts", F.col("start_ts") - minutes * 60)


def baseline_window(incidents: DataFrame, multiplier: int = 3) -> DataFrame:
    """Add the half-open baseline ``[base_start, start_ts)`` of ``multiplier`` window lengths."""
    length = F.col("end_ts") - F.col("start_ts")
    return incidents.withColumn("base_start", F.col("start_ts") - multiplier * length)


def with_roles(rows: DataFrame, incidents: DataFrame, multiplier: int = 3) -> DataFrame:
    """Rows of baseline and incident with ``role`` 'b' or 'i'."""
    wide = baseline_window(incidents, multiplier)
    joined = window_join(rows, wide, start="base_start")
    return joined.withColumn("role", F.when(F.col("ts") < F.col("start_ts"), "b").otherwise("i"))


def resample(rows: DataFrame, width: int = 60, keys=(*SERIES, "day")) -> DataFrame:
    """Mean per bin with empty bins present as null, from the first to the last bin of a day.

    One shuffle: the bins and the gap filling share the partitioning by series-day, whose
    size is bounded by the bins of a day.
    """
    binned = rows.groupBy(*keys, (F.floor(F.col("ts") / width) * width).alias("ts")).agg(
        F.avg("value").alias("value"))
    w = W.partitionBy(*keys).orderBy("ts")
    nxt = F.coalesce(F.lead("ts").over(w) - width, F.col("ts"))
    filled = (binned.withColumn("_next", nxt).select(
        *keys, "value", F.col("ts").alias("_own"),
        F.explode(F.sequence(F.col("ts"), F.col("_next"), F.lit(width).cast("bigint"))).alias("ts")))
    return filled.select(*keys, "ts", F.when(F.col("ts") == F.col("_own"), F.col("value")).alias("value"))


def fill_missing(rows: DataFrame, method: str = "linear", keys=(*SERIES, "day")) -> DataFrame:
    """Fill null values of an ordered series: linear by row position, last value, or zero.

    Leading and trailing gaps take the nearest value, whatever the method.
    """
    w = W.partitionBy(*keys).orderBy("ts")
    back = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = w.rowsBetween(W.currentRow, W.unboundedFollowing)
    last = F.last("value", ignorenulls=True).over(back)
    first = F.first("value", ignorenulls=True).over(ahead)
    if method == "zero":
        return rows.withColumn("value", F.coalesce("value", F.lit(0.0)))
    if method == "ffill":
        return rows.withColumn("value", F.coalesce("value", last, first))
    pos = rows.withColumn("_pos", F.row_number().over(w))
    known = F.when(F.col("value").isNotNull(), F.col("_pos"))
    p0 = F.last(known, ignorenulls=True).over(back)
    p1 = F.first(known, ignorenulls=True).over(ahead)
    marked = pos.select("*", last.alias("_v0"), first.alias("_v1"), p0.alias("_p0"), p1.alias("_p1"))
    linear = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (
        (F.col("_pos") - F.col("_p0")) / F.nullif(F.col("_p1") - F.col("_p0"), F.lit(0)))
    return marked.withColumn("value", F.coalesce("value", linear, "_v0", "_v1")).select(*rows.columns)


def resampled_filled(rows: DataFrame, width: int = 60) -> DataFrame:
    """Resampled and linearly filled series, with a mark on the bins that were empty."""
    return fill_missing(resample(rows, width).withColumn("empty", F.col("value").isNull()))


def normalise(rows: DataFrame, method: str = "minmax", keys=(*SERIES, "day")) -> DataFrame:
    """Min-max or z-score (population deviation) per series; zero when the spread is nil.

    The statistics are aggregated with partial sums and joined back.
    """
    stats = rows.groupBy(*keys).agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.avg("value").alias("_m"),
        F.stddev_pop("value").alias("_s"))
    centre, spread = (("_lo", F.col("_hi") - F.col("_lo")) if method == "minmax"
                      else ("_m", F.col("_s")))
    return (rows.join(stats, list(keys))
            .withColumn("normalised", F.when(spread < 1e-12, 0.0).otherwise(
                (F.col("value") - F.col(centre)) / F.nullif(spread, F.lit(0.0))))
            .drop("_lo", "_hi", "_m", "_s"))


def islands(points: DataFrame, keys, gap) -> DataFrame:
    """Number runs of points whose neighbours are at most ``gap`` seconds apart."""
    w = W.partitionBy(*keys).orderBy("ts")
    new = F.when(F.col("ts") - F.lag("ts").over(w) <= gap, 0).otherwise(1)
    return points.withColumn("_new", new).withColumn(
        "island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_new")


def multi_resolution_onset(rows: DataFrame, stats: DataFrame, incidents: DataFrame,
                           sizes=(60, 300, 900)) -> DataFrame:
    """Earliest window start per component and window size whose mean exceeds 0.9 of P95.

    Windows of a size start every half size from the incident start and lie wholly inside
    the incident; a row falls into at most two of them.
    """
    inside = window_join(rows, incidents).join(
        stats.select(*SERIES, "day", "high"), [*SERIES, "day"])
    rel = F.col("ts") - F.col("start_ts")

    def windows(size: int):
        step = size // 2
        k = F.floor(rel / step)
        inner = F.filter(F.array(k - 2, k - 1, k), lambda x: (x >= 0) & (rel < x * step + size)
                         & (x * step + size <= F.col("end_ts") - F.col("start_ts")))
        return F.transform(inner, lambda x: F.struct(F.lit(size).alias("resolution"), (F.col("start_ts") + x * step).alias("onset")))

    return (inside.select("incident_id", *SERIES, "day", "high", "value", F.inline(F.concat(*[windows(s) for s in sizes])))
            .groupBy("incident_id", *SERIES, "day", "high", "resolution", "onset").agg(F.avg("value").alias("m"))
            .filter(F.col("m") > F.col("high") * 0.9)
            .groupBy("incident_id", "component", "resolution").agg(F.min("onset").alias("onset")))


def top_k(df: DataFrame, keys, order, k: int | None, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each key; Spark cuts each partition before the shuffle. None: all rows, ranked."""
    if k is None:
        return ranked(df, keys, order, name)
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def ranked(df: DataFrame, keys, order, name: str = "rank") -> DataFrame:
    """Every row with its rank in its key, however many rows a key has.

    Rows are dealt into ranges of (key, order), so a key with many rows spans several
    tasks; a row's rank is its place in its range after the rows of the ranges before.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = written(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select(*[F.col(k).alias(f"_base_{k}") for k in keys], F.col("_range").alias("_base_range"),
                         F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    same = F.col("_range") == F.col("_base_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_base_{k}"))
    place = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order))
    return (dealt.withColumn(name, place).join(bases, same)
            .withColumn(name, (F.col(name) + F.col("_base")).cast("int")).select(*df.columns, name))
