"""Which element set holds when: switching windows, their join with samples, and windows cut at switches.

A window is half open, [valid_from, valid_to); the windows of an object tile all time. Ties in epoch go by the tiebreak
column, and the last of a tied run wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The span of two-digit years.
TIME_MIN, TIME_MAX = "1957-01-01 00:00:00", "2056-12-31 23:59:59.999999"


def _bound(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


def _micros(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b)


def _order(key: str, epoch: str, tie: list[str]):
    return Window.partitionBy(key).orderBy(epoch, *tie)


def epoch_windows(sets: DataFrame, key: str = "norad", epoch: str = "epoch", tie: tuple[str, ...] = ()) -> DataFrame:
    """Each set from its epoch to the next; the first from the beginning of time. One shuffle, by key."""
    w = _order(key, epoch, list(tie))
    first = F.row_number().over(w) == 1
    return sets.withColumn("valid_from", F.when(first, _bound(TIME_MIN)).otherwise(F.col(epoch))).withColumn(
        "valid_to", F.coalesce(F.lead(epoch).over(w), _bound(TIME_MAX))
    )


def _middle(a: Column, b: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.bround(_micros(a, b) / F.lit(2.0)).cast("long"), a)


def midpoint_windows(sets: DataFrame, key: str = "norad", epoch: str = "epoch", tie: tuple[str, ...] = ()) -> DataFrame:
    """Each set while it is the nearest in time; a sample right between two gets the later."""
    w = _order(key, epoch, list(tie))
    e = F.col(epoch)
    return sets.withColumn("valid_from", F.coalesce(_middle(F.lag(epoch).over(w), e), _bound(TIME_MIN))).withColumn(
        "valid_to", F.coalesce(_middle(e, F.lead(epoch).over(w)), _bound(TIME_MAX))
    )


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"epoch": epoch_windows, "midpoint": midpoint_windows}


def windows(sets: DataFrame, method: str | Callable[[DataFrame], DataFrame] = "midpoint", **columns) -> DataFrame:
    """Windows by a named strategy or by the caller's own, a function of the sets."""
    if callable(method):
        return method(sets)
    if method not in STRATEGIES:
        raise ValueError(f"unknown switching method {method!r}; one of {sorted(STRATEGIES)}")
    return STRATEGIES[method](sets, **columns)


def prefilter(sets: DataFrame, start: Column, stop: Column, key: str = "norad", epoch: str = "epoch") -> DataFrame:
    """Sets that can hold in [start, stop): those inside, the last before and the first from stop on. Partial aggregates only."""
    e = F.col(epoch)
    around = sets.groupBy(F.col(key).alias("_k")).agg(F.max(F.when(e < start, e)).alias("_lo"), F.min(F.when(e >= stop, e)).alias("_hi"))
    kept = sets.join(around, sets[key] == F.col("_k")).where((e >= F.coalesce("_lo", _bound(TIME_MIN))) & (e <= F.coalesce("_hi", _bound(TIME_MAX))))
    return kept.drop("_k", "_lo", "_hi")


def _day(c: str | Column) -> Column:
    return F.unix_date(F.to_date(c))


def _by_day(held: DataFrame, days: DataFrame) -> DataFrame:
    """Windows with a row for each day that they touch, `_day`, inside the one row of days (_lo, _hi).

    The windows of an object tile time, so it has as many rows as it has windows and days together.
    """
    first, last = F.greatest(_day("valid_from"), F.col("_lo")), F.least(_day(F.timestamp_add("MICROSECOND", F.lit(-1), F.col("valid_to"))), F.col("_hi"))
    inside = held.crossJoin(F.broadcast(days)).withColumn("_day", F.when(first <= last, F.sequence(first, last)))
    return inside.where("_day is not null").withColumn("_day", F.explode("_day")).drop("_lo", "_hi")


def assign(samples: DataFrame, held: DataFrame, on: str = "norad", time: str = "t", how: str = "inner") -> DataFrame:
    """Each sample with the window that holds at its time.

    Windows are exploded to the days that they touch between the first sample and the last, and object and day are equi keys,
    so a sample meets the windows of its day alone and a busy object spreads over tasks by day. A stream, whose last sample
    isn't known, joins by the object with a residual range.
    """
    h = held.withColumnRenamed(on, "_on")
    if samples.isStreaming:
        s, h = samples.alias("s"), h.alias("h")
        same = F.col(f"s.{on}") == F.col("_on")
    else:
        h = _by_day(h, samples.agg(_day(F.min(time)).alias("_lo"), _day(F.max(time)).alias("_hi"))).alias("h")
        s = samples.withColumn("_at", _day(time)).alias("s")
        same = (F.col(f"s.{on}") == F.col("_on")) & (F.col("_at") == F.col("_day"))
    return s.join(h, same & (F.col(f"s.{time}") >= F.col("valid_from")) & (F.col(f"s.{time}") < F.col("valid_to")), how).drop("_on", "_at", "_day")


def split(spans: DataFrame, held: DataFrame, on: str = "norad") -> DataFrame:
    """Spans (on, start, stop) cut where the window changes. Both sides are exploded to days and meet on the first day that they share."""
    until = F.timestamp_add("MICROSECOND", F.lit(-1), F.col("stop"))
    days = spans.agg(_day(F.min("start")).alias("_lo"), _day(F.max("stop")).alias("_hi"))
    s = spans.where("start < stop").withColumn("_at", F.explode(F.sequence(_day("start"), _day(until)))).withColumnRenamed(on, "_own")
    h = _by_day(held.withColumnRenamed(on, "_on"), days)
    first = F.greatest(_day("start"), _day("valid_from"))
    cut = s.join(h, (F.col("_own") == F.col("_on")) & (F.col("_at") == F.col("_day")) & (F.col("_at") == first) & (F.col("valid_from") < F.col("stop")) & (F.col("valid_to") > F.col("start")))
    cut = cut.withColumn("sub_start", F.greatest("start", "valid_from")).withColumn("sub_stop", F.least("stop", "valid_to"))
    return cut.drop("_on", "_at", "_day").withColumnRenamed("_own", on)
