"""Revolution numbers: at an instant, their bounds in time, and the objects that match one."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitlake.functions import frames as fr
from orbitlake.functions import tle


def rev_or_time(text: str) -> int | datetime:
    """Whole numbers are revolutions, ISO 8601 text is an instant; anything else is an error."""
    try:
        return int(text)
    except ValueError:
        return datetime.fromisoformat(text)


def _nearest(sets: DataFrame, miss: Column, key: str, tie: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(miss, *tie)
    return sets.where(miss.isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _with_rate(sets: DataFrame) -> DataFrame:
    return sets.withColumns({"rate": tle.nodal_rate(F.col("mm"), F.col("ecc"), F.col("inc")), "phase": tle.rev_phase(F.col("aop"), F.col("ma"))})


def rev_bounds(sets: DataFrame, target: int, key: str = "norad", tie: tuple[str, ...] = ("epoch", "id")) -> DataFrame:
    """Per object, from its set of the nearest revolution number: days from that epoch to the start and end of a revolution."""
    best = _with_rate(_nearest(sets, F.abs(F.col("revnum") - target), key, tie))
    at = lambda n: fr.rev_days(F.col("revnum"), F.col("phase"), F.col("rate"), F.col("ndot"), F.lit(float(n)))
    return best.withColumns({"start_days": at(target), "stop_days": at(target + 1)})


def revs_at(sets: DataFrame, t: Column, key: str = "norad", tie: tuple[str, ...] = ("epoch", "id")) -> DataFrame:
    """Per object, from its set nearest to an instant (one column, or a literal): days from its epoch, and the revolution then."""
    gap = F.abs(F.timestamp_diff("MICROSECOND", F.col("epoch"), t))
    best = _with_rate(_nearest(sets.withColumn("_t", t), gap, key, tie)).withColumn("days", F.timestamp_diff("MICROSECOND", F.col("epoch"), F.col("_t")) / 86400e6)
    return best.withColumn("rev", fr.rev_at(F.col("revnum"), F.col("phase"), F.col("rate"), F.col("ndot"), F.col("days"))).drop("_t")


def match(sets: DataFrame, target: int, t: Column, tolerance: float = 1.0, key: str = "norad") -> DataFrame:
    """Objects whose whole revolution at an instant is within a tolerance of one; miss is signed. Order by abs(miss)."""
    return revs_at(sets, t, key).where(F.abs(F.floor("rev") - target) <= tolerance).withColumn("miss", F.col("rev") - target)


def refine(bounds: DataFrame, crossings: DataFrame, key: str, within_seconds: float) -> DataFrame:
    """Each bound moved to the nearest crossing, of two as near the earlier; start and stop stay where none is within reach.

    bounds: key, start, stop, one row a key; crossings: key, time.
    """
    reach = int(within_seconds * 1e6)
    c = crossings.select(F.col(key).alias("_k"), F.col("time").alias("_c"))
    off = lambda b: F.abs(F.timestamp_diff("MICROSECOND", F.col(b), F.col("_c")))
    near = bounds.join(c, (F.col(key) == F.col("_k")) & ((off("start") <= reach) | (off("stop") <= reach)), "left")
    pick = lambda b: F.min(F.when(off(b) <= reach, F.struct(off(b).alias("d"), F.col("_c").alias("c"))))
    g = near.groupBy(*bounds.columns).agg(pick("start").alias("_a"), pick("stop").alias("_b"))
    same = [F.col(x) for x in bounds.columns if x not in ("start", "stop")]
    return g.select(*same, F.coalesce("_a.c", "start").alias("start"), F.coalesce("_b.c", "stop").alias("stop"))
