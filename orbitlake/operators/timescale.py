"""UT1 and UTC: the Earth's rotation against the clocks, from a table of UT1-UTC by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitlake.operators import switching

#: A difference that changes by more than this between two entries holds a leap second.
LEAP = 0.5


def with_ut1(samples: DataFrame, table: DataFrame, time: str = "t", out: str = "ut1_utc") -> DataFrame:
    """samples with UT1-UTC in seconds at their time (UTC), linear between the entries of the table (utc timestamp, ut1_utc seconds).

    An as-of join: entries are windows until the next one, and samples meet those of their day. Between two entries with a leap
    second the earlier one's course goes on up to it. After the last entry its value holds; before the first, and without a
    time, it is null. Of entries for one instant the greatest holds.
    """
    w = Window.orderBy("utc")  # a row a day, so a few tens of thousands
    t = table.select(F.col("utc").cast("timestamp_ntz").alias("utc"), F.col("ut1_utc").cast("double").alias("_a")).groupBy("utc").agg(F.max("_a").alias("_a"))
    t = t.select("utc", "_a", F.lead("_a").over(w).alias("_b"), F.lead("utc").over(w).alias("_n"))
    held = t.select(F.lit(0).alias("_key"), F.col("utc").alias("valid_from"), F.coalesce("_n", F.to_timestamp_ntz(F.lit(switching.TIME_MAX))).alias("valid_to"), "_a", "_b", "_n")
    d = switching.assign(samples.withColumn("_key", F.lit(0)), held, "_key", time, "left")
    micros = lambda a, b: F.timestamp_diff("MICROSECOND", a, b)
    part = micros(F.col("valid_from"), F.col(time)) / micros(F.col("valid_from"), F.col("_n"))
    step = F.col("_b") - F.col("_a")
    smooth = step - F.when(step > LEAP, 1.0).when(step < -LEAP, -1.0).otherwise(0.0)
    value = F.when(F.col("_n").isNull(), F.col("_a")).otherwise(F.col("_a") + smooth * part)
    return d.withColumn(out, value).select(*samples.columns, out)


def utc_to_ut1(t: Column, difference: Column) -> Column:
    """The reading of a UT1 clock, to the microsecond."""
    return F.timestamp_add("MICROSECOND", F.round(difference * 1e6).cast("long"), t)


def ut1_to_utc(t: Column, difference: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.round(-difference * 1e6).cast("long"), t)
