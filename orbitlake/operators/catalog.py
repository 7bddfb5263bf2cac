"""The element-set catalog: idempotent ingest, top-1 lookups, summaries and incremental output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_rows(batch: DataFrame, stored: DataFrame | None, keys: tuple[str, ...] = ("epoch", "line_hash"), order: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a batch that aren't stored: the first of each key, by `order`."""
    first = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or keys)))).where("_n = 1").drop("_n")
    return first if stored is None else first.join(stored.select(*keys), list(keys), "left_anti")


def last_wins(batch: DataFrame, key: str, order: Column) -> DataFrame:
    """The last record of each key in a batch."""
    return batch.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where("_n = 1").drop("_n")


def missing_metadata(tle: DataFrame, metadata: DataFrame, key: str = "tle_id") -> DataFrame:
    return tle.join(metadata.select(key), key, "left_anti")


def latest_per_object(sets: DataFrame, day: Column | None = None, key: str = "norad", epoch: str = "epoch", ident: str = "id") -> DataFrame:
    """The last set of each object, of each day if one is given; partial top-1 before the shuffle."""
    parts = [F.col(key)] + ([day] if day is not None else [])
    w = Window.partitionBy(*parts).orderBy(F.col(epoch).desc(), F.col(ident).desc())
    return sets.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def boundary(sets: DataFrame, start: Column, end: Column, latest: bool = True, key: str = "norad", epoch: str = "epoch", ident: str = "id") -> DataFrame:
    """The last or first set of each object in [start, end], both ends included."""
    e, i = F.col(epoch), F.col(ident)
    w = Window.partitionBy(key).orderBy(*((e.desc(), i.desc()) if latest else (e.asc(), i.asc())))
    return sets.where((e >= start) & (e <= end)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def nearest(sets: DataFrame, center: Column, days: int, key: str = "norad", epoch: str = "epoch", ident: str = "id") -> DataFrame:
    """The set of each object nearest to an instant, at most so many days away; of two as near, the earlier."""
    e = F.col(epoch)
    gap = F.abs(F.timestamp_diff("MICROSECOND", center, e))
    late = (e > center).cast("int")
    # before the centre the last row of an epoch, after it the first
    ident_order = F.when(e > center, F.col(ident)).otherwise(-F.col(ident))
    w = Window.partitionBy(key).orderBy(gap, late, ident_order)
    return sets.where(gap <= days * 86400_000_000).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def summary(sets: DataFrame, key: str = "norad", epoch: str = "epoch", tie: tuple[str, ...] = ("id",)) -> DataFrame:
    """Per object: sets, distinct epochs, first, last, span, sets a day, and the intervals between sets in days."""
    w = Window.partitionBy(key).orderBy(epoch, *tie)
    gap = F.timestamp_diff("MICROSECOND", F.lag(epoch).over(w), F.col(epoch)) / 86400e6
    g = sets.withColumn("_gap", gap).groupBy(key)
    out = g.agg(
        F.count("*").alias("n_sets"),
        F.count_distinct(epoch).alias("n_epochs"),
        F.min(epoch).alias("first_epoch"),
        F.max(epoch).alias("last_epoch"),
        F.round(F.min("_gap"), 2).alias("min_gap"),
        F.round(F.max("_gap"), 2).alias("max_gap"),
        F.round(F.avg("_gap"), 2).alias("mean_gap"),
        F.round(F.median("_gap"), 2).alias("median_gap"),
    )
    span = F.timestamp_diff("MICROSECOND", F.col("first_epoch"), F.col("last_epoch")) / 86400e6
    return out.withColumn("span_days", F.round(span, 2)).withColumn("per_day", F.when(span > 0, F.round(F.col("n_sets") / span, 2)))


def gaps(sets: DataFrame, days: float, key: str = "norad", epoch: str = "epoch", tie: tuple[str, ...] = ("id",)) -> DataFrame:
    """Intervals between consecutive sets that are longer than so many days."""
    w = Window.partitionBy(key).orderBy(epoch, *tie)
    g = sets.select(key, F.lag(epoch).over(w).alias("gap_start"), F.col(epoch).alias("gap_end"))
    d = F.timestamp_diff("MICROSECOND", F.col("gap_start"), F.col("gap_end")) / 86400e6
    return g.where(d > days).withColumn("gap_days", F.round(d, 2))


def dates_to_write(sets: DataFrame, as_of: Column, window_days: int = 60, lookback_days: int = 7, epoch: str = "epoch", created: str = "created") -> DataFrame:
    """Days within the trailing window, and days that got rows lately."""
    e, c = F.to_date(epoch), F.col(created)
    recent = sets.where((e > F.date_sub(F.to_date(as_of), window_days)) & (e <= F.to_date(as_of))).select(e.alias("epoch_date"))
    late = sets.where(c >= F.timestamp_add("DAY", F.lit(-lookback_days), as_of)).select(e.alias("epoch_date"))
    return recent.unionByName(late).distinct()


def output_actions(new: DataFrame, state: DataFrame, key: str = "norad") -> DataFrame:
    """What to do with each object's file: create, append, rewrite or nothing.

    new: key, epoch, created; state: key, tail_epoch, written_at. A row later than the tail is new; one that isn't, but was
    created since the file was written, is late and has the file written again.
    """
    j = new.join(state, key, "left")
    is_new = F.col("epoch") > F.col("tail_epoch")
    late = ~is_new & (F.col("created") >= F.col("written_at"))
    g = j.groupBy(key).agg(F.max(F.col("tail_epoch").isNull()).alias("absent"), F.max(late).alias("late"), F.sum(is_new.cast("int")).alias("n_new"))
    action = F.when(F.col("absent"), "create").when(F.col("late"), "rewrite").when(F.col("n_new") > 0, "append").otherwise("keep")
    return g.select(key, action.alias("action"), F.coalesce("n_new", F.lit(0)).alias("n_new"))


def verify_counts(files: DataFrame, sets: DataFrame, key: str = "norad") -> DataFrame:
    """files: key, lines. Objects whose file hasn't two lines for each row, or that have only one of both."""
    rows = sets.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    j = files.join(rows, key, "full")
    problem = F.when(F.col("lines").isNull(), "missing").when(F.col("rows").isNull(), "orphan").when(F.col("lines") != 2 * F.col("rows"), "count")
    return j.withColumn("problem", problem).where("problem is not null").select(key, "lines", "rows", "problem")
