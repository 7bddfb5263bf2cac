"""Closest approach from a Doppler curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def closest_approach(curve: DataFrame, key: str, time: str, shift: str, tie: str) -> DataFrame:
    """key, tca: where the shift first changes sign, by linear interpolation cut to microseconds, else where it is least."""
    w = Window.partitionBy(key).orderBy(time, tie)
    c = curve.withColumn("_d2", F.lead(shift).over(w)).withColumn("_t2", F.lead(time).over(w))
    crosses = F.coalesce(F.col(shift) * F.col("_d2") < 0, F.lit(False))
    part = F.col(shift) / (F.col(shift) - F.col("_d2"))
    at = F.when(crosses, F.timestamp_add("MICROSECOND", F.floor(F.timestamp_diff("MICROSECOND", F.col(time), F.col("_t2")) * part), F.col(time))).otherwise(F.col(time))
    order = F.struct((~crosses).alias("a"), F.when(crosses, F.lit(0.0)).otherwise(F.abs(shift)).alias("b"), F.col(time).alias("c"), F.col(tie).alias("d"))
    return c.withColumn("_at", at).withColumn("_o", order).groupBy(key).agg(F.min_by("_at", "_o").alias("tca"))
