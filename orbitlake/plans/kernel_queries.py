"""Queries whose states come from the propagation kernel; rows only, their physics is tested."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitlake.operators import events, geometry, propagate, switching
from orbitlake.plans.catalog_queries import _events, elements, query, table

_SITE = (28.5, -80.65, 0.0, 5.0)
_SETS = ("norad", "epoch", "mm", "ecc", "inc", "raan", "aop", "ma", "bstar", "valid_from", "valid_to")


def samples(spark, sf_dir):
    """The click times of each user with the element set that holds then."""
    held = switching.midpoint_windows(elements(spark, sf_dir), tie=("id",)).select("id", *_SETS)
    asked = _events(spark, sf_dir, "click").select("event_id", F.col("user_id").cast("int").alias("norad"), F.col("ts").alias("t"))
    return switching.assign(asked, held).select("event_id", "id", "t", *_SETS[:9])


def _group(spark, sf_dir, *groups):
    return propagate.generate(samples(spark, sf_dir), groups)


@query()
def sgp4_state(spark, sf_dir):
    return propagate.with_states(samples(spark, sf_dir)).select("event_id", "id", "t", "x", "y", "z", "vx", "vy", "vz", "err")


@query()
def generate_all(spark, sf_dir):
    sites = spark.createDataFrame([("ksc", 28.5, -80.65, 0.0), ("north", 69.0, 20.0, 500.0)], "name string, lat double, lon double, alt double")
    return propagate.generate(samples(spark, sf_dir), sites=sites)


@query()
def sunlight(spark, sf_dir):
    return _group(spark, sf_dir, "sunlight").select("event_id", "sun")


@query()
def beta(spark, sf_dir):
    return _group(spark, sf_dir, "beta").select("event_id", "beta")


@query()
def local_solar_time(spark, sf_dir):
    return _group(spark, sf_dir, "lst").select("event_id", "lst")


def spans(spark, sf_dir):
    """Each object over the whole span of the events."""
    lim = table(spark, sf_dir, "events").agg(F.min("ts").cast("timestamp_ntz").alias("start"), F.max("ts").cast("timestamp_ntz").alias("stop"))
    return elements(spark, sf_dir).select("norad").where("norad is not null").distinct().crossJoin(F.broadcast(lim)).select(F.col("norad").cast("long").alias("span"), "norad", "start", "stop")


def windows(spark, sf_dir):
    """Each span cut where another element set of its object becomes the nearest; id is the set's."""
    held = switching.midpoint_windows(elements(spark, sf_dir).drop("line1", "line2"), tie=("id",)).select("id", *_SETS)
    return switching.split(spans(spark, sf_dir), held).select("span", "id", "norad", F.col("sub_start").alias("start"), F.col("sub_stop").alias("stop"), *_SETS[1:9])


def _by_set(spark, sf_dir):
    return windows(spark, sf_dir).withColumn("span", F.col("id"))


@query()
def nodes(spark, sf_dir):
    """By element set: where another set takes over, the object may change sides without a crossing."""
    return events.node_crossings(_by_set(spark, sf_dir))


@query()
def object_nodes(spark, sf_dir):
    """By object: directions alternate where the element set changes too."""
    return events.node_crossings(windows(spark, sf_dir))


@query()
def sunlit(spark, sf_dir):
    return events.find_periods(windows(spark, sf_dir), "sunlit", peaks=False)


@query()
def eclipse(spark, sf_dir):
    return events.find_periods(windows(spark, sf_dir), "sunlit", invert=True, peaks=False)


@query()
def ascending(spark, sf_dir):
    return events.find_periods(windows(spark, sf_dir), "ascending", peaks=False)


@query()
def descending(spark, sf_dir):
    return events.find_periods(windows(spark, sf_dir), "ascending", invert=True, peaks=False)


@query()
def passes(spark, sf_dir):
    """With true rises and sets, whatever set holds at them."""
    return events.find_passes(windows(spark, sf_dir), _SITE)


@query()
def switch_tca(spark, sf_dir):
    held = geometry.tca_windows(elements(spark, sf_dir).drop("line1", "line2")).select("id", *_SETS)
    asked = _events(spark, sf_dir, "view").select(F.col("event_id").alias("view_id"), F.col("user_id").cast("int").alias("norad"), F.col("ts").alias("t"))
    return switching.assign(asked, held).select("view_id", "id")


@query()
def visibility_ring(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), ((F.col("s_suppkey") * 37 % 160) - 80).alias("lat"), ((F.col("s_suppkey") * 53 % 360) - 180).alias("lon"), F.lit(0).alias("alt"), F.lit(500_000).alias("sat_alt"), F.lit(5).alias("min_el")
    )
    return geometry.visibility_rings(s, 36)


@query()
def doppler_geolocate(spark, sf_dir):
    """Each pass over a site, from a Doppler curve that the site would measure; a curve is of one element set."""
    found = events.find_passes(_by_set(spark, sf_dir), _SITE, keep=("epoch", *_SETS[2:9]))
    curves = geometry.pass_curves(found.withColumn("pass_id", F.xxhash64("span", "start")), _SITE[:3])
    return geometry.geolocate_passes(curves.where(F.size("minutes") >= 3)).drop("residuals")


@query()
def mag_enu(spark, sf_dir):
    """The main field, as far as degree 3, at each state's own time and place."""
    return _group(spark, sf_dir, "mag_enu", "mag_total").where("err = 0").select("event_id", "b_east", "b_north", "b_up", "b_total")
