"""Time series of an object: robust deviations, clusters of flags, and intervals from states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def deltas(series: DataFrame, key: str, time: str, value: str, tie: str) -> DataFrame:
    """With delta and spacing (days) from the value before."""
    w = Window.partitionBy(key).orderBy(time, tie)
    return series.withColumn("delta", F.col(value) - F.lag(value).over(w)).withColumn(
        "spacing", F.timestamp_diff("MICROSECOND", F.lag(time).over(w), F.col(time)) / 86400e6
    )


def mad_sigma(d: DataFrame, key: str) -> DataFrame:
    """key, n, sigma (1.4826 times the median absolute deviation of delta), median_spacing."""
    med = d.groupBy(key).agg(F.median("delta").alias("m"), F.median("spacing").alias("median_spacing"), F.count("*").alias("n"))
    dev = d.join(med, key).groupBy(key).agg(F.median(F.abs(F.col("delta") - F.col("m"))).alias("mad"))
    return med.join(dev, key).select(key, "n", (F.col("mad") * 1.4826).alias("sigma"), "median_spacing")


def flag_clusters(d: DataFrame, key: str, time: str, tie: str, threshold: float) -> DataFrame:
    """Flagged deltas (beyond threshold sigmas, at least 8 values) chained while the gap to the flag before is small enough.

    One row for each cluster: when it starts, how many flags it has, and the event, the time of its largest delta.
    """
    f = d.join(mad_sigma(d, key), key)
    f = f.where((F.col("n") >= 8) & (F.col("sigma") >= 1e-12) & (F.abs("delta") > threshold * F.col("sigma")))
    w = Window.partitionBy(key).orderBy(time, tie)
    gap = F.timestamp_diff("MICROSECOND", F.lag(time).over(w), F.col(time)) / 86400e6
    fresh = F.coalesce(gap > F.greatest(F.lit(2.0), 5 * F.col("median_spacing")), F.lit(True)).cast("int")
    f = f.withColumn("_fresh", fresh)
    f = f.withColumn("cluster", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first_largest = F.min_by(time, F.struct(-F.abs("delta"), F.col(time), F.col(tie)))
    return f.groupBy(key, "cluster").agg(F.min(time).alias("cluster_start"), F.count("*").alias("n_flags"), first_largest.alias("event_time"))


def group_periods(states: DataFrame, key: str, time: str, state: str, tie: str, stop) -> DataFrame:
    """Maximal runs of a true state as [start, stop): a run lasts until the state changes, the last one until `stop`."""
    w = Window.partitionBy(key).orderBy(time, tie)
    change = (F.col(state) != F.coalesce(F.lag(state).over(w), ~F.col(state))).cast("int")
    s = states.withColumn("_c", change)
    s = s.withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = s.groupBy(key, "_run").agg(F.min(time).alias("start"), F.first(state).alias("on"))
    nxt = F.lead("start").over(Window.partitionBy(key).orderBy("_run"))
    return runs.withColumn("stop", F.coalesce(nxt, stop)).where("on").select(key, "start", "stop")


def merge_periods(periods: DataFrame, key: str) -> DataFrame:
    """Periods joined where one starts exactly when the one before stops."""
    w = Window.partitionBy(key).orderBy("start", "stop")
    fresh = F.coalesce(F.col("start") != F.lag("stop").over(w), F.lit(True)).cast("int")
    p = periods.withColumn("_f", fresh).withColumn("_g", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy(key, "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_g")


def complement(periods: DataFrame, key: str, start, stop) -> DataFrame:
    """What periods leave of [start, stop) for each key that has any."""
    w = Window.partitionBy(key).orderBy("start", "stop")
    before = periods.select(key, F.coalesce(F.lag("stop").over(w), start).alias("a"), F.col("start").alias("b"))
    after = periods.groupBy(key).agg(F.max("stop").alias("a")).select(key, "a", stop.alias("b"))
    return before.unionByName(after).where("a < b").select(key, F.col("a").alias("start"), F.col("b").alias("stop"))


def passes(events: DataFrame, key: str, start, stop, minimum: float | None = None) -> DataFrame:
    """Rise, culmination and set events (key, time, kind 0, 1, 2, elevation, tie) paired to passes.

    A set without a rise starts at the window's start, a rise without a set ends at its stop; the last culmination before
    the set gives the peak, and without one the rise does.
    """
    w = Window.partitionBy(key).orderBy("time", "tie")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumn("_sets", F.coalesce(F.sum((F.col("kind") == 2).cast("int")).over(upto), F.lit(0)))
    g = e.groupBy(key, "_sets").agg(
        F.max(F.when(F.col("kind") == 0, F.col("time"))).alias("rise"),
        F.max_by("time", F.when(F.col("kind") == 1, F.struct("time", "tie"))).alias("top"),
        F.max_by("elevation", F.when(F.col("kind") == 1, F.struct("time", "tie"))).alias("top_elevation"),
        F.max(F.when(F.col("kind") == 2, F.col("time"))).alias("down"),
    )
    g = g.where("rise is not null or down is not null")
    out = g.select(
        key,
        F.coalesce("rise", start).alias("start"),
        F.coalesce("down", stop).alias("stop"),
        F.coalesce("top", "rise", start).alias("peak_time"),
        F.col("top_elevation").alias("peak_elevation"),
    )
    return out if minimum is None else out.where(F.col("peak_elevation") >= minimum)
