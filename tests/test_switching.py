"""Windows joined with samples and spans against bisection, and the join's keys."""

import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from orbitlake.operators import switching

ZERO = dt.datetime(2024, 1, 1)
SETS, SAMPLES = "norad int, id long, epoch timestamp_ntz", "norad int, n long, t timestamp_ntz"


def at(minutes):
    return ZERO + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def data():
    r = random.Random(3)
    sets = [(o, 1000 * o + k, at(r.randrange(0, 60 * 24 * 90, 30))) for o in range(6) for k in range(40)] + [(7, 7000, at(5)), (None, 1, at(9))]
    samples = [(o, 10_000 * o + k, at(r.randrange(-60 * 24 * 40, 60 * 24 * 130, 15))) for o in range(8) for k in range(300)]
    return sets, samples + [(1, -1, None), (None, -2, at(3)), (1, -3, dt.datetime(1950, 1, 1)), (2, -4, dt.datetime(2099, 1, 1))]


def holding(sets, o, t):
    """The last set that began by t, else the first."""
    own = sorted((e, i) for k, i, e in sets if k == o)
    if o is None or not own or t is None or not dt.datetime(1957, 1, 1) <= t < dt.datetime(2056, 12, 31):
        return None
    k = bisect.bisect_right([e for e, _ in own], t)
    return own[max(k - 1, 0)][1]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_assign_equals_bisection(spark, data, how):
    sets, samples = data
    held = switching.epoch_windows(spark.createDataFrame(sets, SETS), tie=("id",))
    got = switching.assign(spark.createDataFrame(samples, SAMPLES), held, how=how)
    assert {"_day", "_at", "_on", "_lo", "_hi"}.isdisjoint(got.columns)
    want = {n: holding(sets, o, t) for o, n, t in samples}
    rows = got.select("n", "id").collect()
    assert {r["n"]: r["id"] for r in rows} == {n: i for n, i in want.items() if how == "left" or i is not None}
    assert len(rows) == len({r["n"] for r in rows})


def test_gaps_and_overlaps_of_own_windows(spark):
    """A strategy of the caller's: windows that leave a gap, overlap and last for years."""
    held = [(1, 1, at(0), at(10)), (1, 2, at(5), at(60 * 24 * 2000)), (1, 3, at(60 * 24 * 3), at(60 * 24 * 3)), (1, 4, at(-500_000), at(-400_000))]
    samples = [(1, k, at(m)) for k, m in enumerate([-1, 0, 5, 9, 10, 60 * 24 * 3, 60 * 24 * 1999, 60 * 24 * 2000, -450_000])]
    got = switching.assign(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(held, "norad int, id long, valid_from timestamp_ntz, valid_to timestamp_ntz"))
    assert sorted((r["n"], r["id"]) for r in got.collect()) == sorted((n, i) for _, n, t in samples for _, i, a, b in held if a <= t < b)


def test_split_equals_pairs(spark, data):
    sets, _ = data
    r = random.Random(4)
    spans = [(r.randrange(8), k, *(at(m) for m in sorted(r.sample(range(-60 * 24 * 20, 60 * 24 * 120), 2)))) for k in range(60)] + [(1, 99, at(5), at(5)), (2, 98, at(9), at(3))]
    held = switching.midpoint_windows(spark.createDataFrame(sets, SETS), tie=("id",))
    got = switching.split(spark.createDataFrame(spans, "norad int, span long, start timestamp_ntz, stop timestamp_ntz"), held)
    rows = [(o, i, a, b) for o, i, a, b in held.select("norad", "id", "valid_from", "valid_to").collect()]
    want = sorted((s, i, max(a, x), min(b, y)) for o, s, x, y in spans for k, i, a, b in rows if k == o and x < y and a < y and b > x)
    assert sorted((x["span"], x["id"], x["sub_start"], x["sub_stop"]) for x in got.collect()) == want
    assert set(got.columns) == {"norad", "span", "start", "stop", "id", "epoch", "valid_from", "valid_to", "sub_start", "sub_stop"}


def test_a_busy_object_is_joined_by_day(spark):
    """One object with 100,000 sets and a million times: rows of a day meet, not all rows."""
    minutes = lambda c, step: F.timestamp_add("MINUTE", (F.col("id") * step).cast("long"), F.lit(ZERO).cast("timestamp_ntz")).alias(c)
    sets = spark.range(100_000).select(F.lit(1).alias("norad"), "id", minutes("epoch", 30))
    samples = spark.range(1_000_000).select(F.lit(1).alias("norad"), F.col("id").alias("n"), minutes("t", 3))
    held = switching.epoch_windows(sets).withColumnRenamed("id", "set")
    got = switching.assign(samples, held)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_day" in next(x for x in plan.splitlines() if "Join Inner" in x)
    count, wrong = got.agg(F.count("*"), F.sum((F.col("set") != F.floor(F.col("n") / 10)).cast("int"))).first()
    assert (count, wrong) == (1_000_000, 0)
