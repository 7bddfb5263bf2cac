"""Passes with their true rise and set, crossings where element sets change, and positions from Doppler curves."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitlake.kernels import neldermead
from orbitlake.operators import events, geometry
from orbitlake.plans import kernel_queries as k

SF = "/root/testdata/sf0.001"
SITE = (28.5, -80.65, 0.0, 5.0)
ISS = {"mm": 15.49560532, "ecc": 0.0006703, "inc": 51.64, "raan": 208.9163, "aop": 30.5502, "ma": 329.5947, "bstar": 1.027e-4}
ZERO = dt.datetime(2024, 1, 1)
SCHEMA = "span long, start timestamp_ntz, stop timestamp_ntz, epoch timestamp_ntz, " + ", ".join(f"{c} double" for c in ISS) + ", name string"


def spans(spark, *rows):
    """Rows of span, start and stop in minutes, name, and changes of the elements."""
    at = lambda m: ZERO + dt.timedelta(minutes=m)
    return spark.createDataFrame([(s, at(a), at(b), ZERO, *(ISS | own).values(), name) for s, a, b, name, own in rows], SCHEMA)


def minutes(t):
    return (t - ZERO).total_seconds() / 60


@pytest.fixture(scope="module")
def day(spark):
    return sorted(events.find_passes(spans(spark, (0, 0, 1440, "a", {})), SITE).collect(), key=lambda r: r["start"])


def same(a, b):
    return all(abs((a[c] - b[c]).total_seconds()) < 0.02 for c in ("start", "stop", "peak_time")) and a["peak_elevation"] == pytest.approx(b["peak_elevation"], abs=1e-6)


def test_a_pass_that_the_span_cuts_has_its_true_rise_and_set(spark, day):
    assert len(day) >= 4
    for n, p in enumerate(day[1:-1]):
        middle, end = minutes(p["start"]) + 1, minutes(p["stop"]) - 1
        got = events.find_passes(spans(spark, (1, middle, middle + 0.5, "rise is before", {}), (2, middle - 60, end, "set is after", {})), SITE, keep=("name",)).collect()
        one = [r for r in got if r["span"] == 1]
        assert len(one) == 1 and same(one[0], p) and one[0]["name"] == "rise is before"
        assert any(same(r, p) for r in got if r["span"] == 2)
        if n == 1:
            break


def test_windows_of_one_set_find_each_pass_once(spark, day):
    """Cuts inside and right beside passes: the window that holds the culmination has the pass."""
    cuts = sorted({0, 1440} | {minutes(p[c]) for p in day for c in ("start", "peak_time")} | {minutes(p["stop"]) - 0.3 for p in day})
    got = sorted(events.find_passes(spans(spark, *((5, a, b, f"{a}", {}) for a, b in zip(cuts, cuts[1:], strict=False))), SITE, keep=("name",)).collect(), key=lambda r: r["start"])
    assert len(got) == len(day) and all(same(a, b) for a, b in zip(got, day, strict=True))
    for r in got:
        window = next((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if f"{a}" == r["name"])
        assert window[0] - 0.001 <= minutes(r["peak_time"]) <= window[1] + 0.001


def test_neighbouring_sets_that_disagree_by_seconds_give_one_pass(spark, day):
    p = day[1]
    cut = minutes(p["peak_time"])
    for shift in (0.3, -0.3):  # degrees along the orbit: some seconds
        got = events.find_passes(spans(spark, (1, 0, cut, "a", {}), (1, cut, 1440, "b", {"ma": ISS["ma"] + shift})), SITE, keep=("name",)).collect()
        near = [r for r in got if abs((r["peak_time"] - p["peak_time"]).total_seconds()) < 60]
        assert len(near) == 1 and len(got) == len(day)


def test_peaks_are_refined(spark, day):
    rows = [(n, minutes(p["peak_time"]) + s, minutes(p["peak_time"]) + s + 1, "x", {}) for n, p in enumerate(day) for s in (-0.02, 0.02)]
    for n, p in enumerate(day):
        a, b, c = (events._Pieces("pass", False, SITE, *(np.zeros(1, int),) * 3, np.zeros(1), np.zeros(1), np.array([2460310.5]), [np.array([x]) for x in ISS.values()]).state(np.zeros(1, int), np.array([minutes(p["peak_time"]) + s]))[0][0] for s in (-0.01, 0, 0.01))
        assert b >= a - 1e-9 and b >= c - 1e-9
    assert rows


def test_always_in_view(spark):
    """A geostationary satellite over the site's meridian: no rise and no set, so the span is what there is."""
    geo = {"mm": 1.00273, "ecc": 0.0001, "inc": 0.02, "raan": 0.0, "aop": 0.0, "bstar": 0.0}
    cut = [0, 300, 700, 2000]
    for ma in range(0, 360, 30):
        got = events.find_passes(spans(spark, *((1, a, b, "g", geo | {"ma": float(ma)}) for a, b in zip(cut, cut[1:], strict=False))), SITE).collect()
        assert len(got) <= 1
        if got:
            assert (minutes(got[0]["start"]), minutes(got[0]["stop"])) == (0, 2000)
            break
    else:
        pytest.fail("in view from nowhere")


def test_nothing_for_empty_spans_and_nulls(spark):
    rows = spans(spark, (1, 10, 10, "a", {}), (2, 10, 5, "a", {}), (3, 0, 1440, "a", {"ma": None}), (4, 0, 1440, None, {}))
    got = events.find_passes(rows, SITE, keep=("name",)).collect()
    assert {r["span"] for r in got} == {4} and {r["name"] for r in got} == {None}
    assert events.find_passes(rows.limit(0), SITE).collect() == []


def alternates(rows):
    by = {}
    for r in rows:
        by.setdefault(r["span"], []).append((r["time"], r["ascending"]))
    return all(a[1] != b[1] for v in by.values() for a, b in zip(sorted(v), sorted(v)[1:], strict=False))


def test_crossings_alternate_by_object(spark):
    rows = k.object_nodes(spark, SF).collect()
    assert rows and alternates(rows) and {r["span"] for r in rows} == {r["span"] for r in k.windows(spark, SF).where("inc > 0").select("span").distinct().collect()}


def test_a_crossing_that_a_switch_loses_or_doubles(spark):
    one = sorted(events.node_crossings(spans(spark, (1, 0, 1440, "a", {}))).collect(), key=lambda r: r["time"])
    assert alternates(one) and len(one) > 25
    at = minutes(one[10]["time"])
    for shift in (0.4, -0.4, 0.0):  # the later set crosses some seconds earlier or later
        for off in (-0.05, -1e-4, 0.0, 1e-4, 0.05):
            cut = at + off
            got = sorted(events.node_crossings(spans(spark, (1, 0, cut, "a", {}), (1, cut, 1440, "b", {"ma": ISS["ma"] + shift}))).collect(), key=lambda r: r["time"])
            assert alternates(got) and len(got) == len(one)
            assert all(abs((a["time"] - b["time"]).total_seconds()) < 8 and a["ascending"] == b["ascending"] for a, b in zip(got, one, strict=True))


def test_simplex_finds_many_minima_at_once():
    r = np.random.default_rng(2)
    goal = r.uniform(-3, 3, (50, 2))
    f = lambda rows, p: 100 * ((p[:, 1] - goal[rows, 1]) - (p[:, 0] - goal[rows, 0]) ** 2) ** 2 + (p[:, 0] - goal[rows, 0]) ** 2
    x, v, ok = neldermead.minimise_all(f, goal + r.uniform(-2, 2, (50, 2)), step=0.5, xtol=1e-8, rounds=2000)
    assert ok.all() and np.abs(x - goal).max() < 1e-5 and v.max() < 1e-9
    for k_ in range(3):  # each as it is alone
        one = neldermead.minimise_all(lambda rows, p, k_=k_: f(np.full(len(p), k_), p), x[k_ : k_ + 1] + 0.5, step=0.5)
        assert np.abs(one[0][0] - goal[k_]).max() < 1e-2
    assert neldermead.minimise_all(f, np.zeros((0, 2)))[0].shape == (0, 2)


def test_geolocation_of_passes(spark, day):
    p = events.find_passes(spans(spark, (0, 0, 4 * 1440, "a", {})), SITE, keep=("epoch", *ISS)).withColumn("pass_id", F.xxhash64("span", "start"))
    curves = geometry.pass_curves(p, SITE[:3], 15.0).withColumn("doppler", F.transform("doppler", lambda x: x * -0.4))
    got = geometry.geolocate_passes(curves).collect()
    by = {}
    for r in got:
        by.setdefault(r["pass_id"], []).append(r)
    near = [min(abs(r["lat"] - 28.5) + abs(r["lon"] + 80.65) for r in v) < 0.05 for v in by.values()]
    assert len(by) > 12 and sum(near) >= 0.95 * len(near)
    assert all(len(v) == 2 and v[0]["rms"] <= v[1]["rms"] for v in by.values())
    best = [min(v, key=lambda r: abs(r["lat"] - 28.5)) for v in by.values()]
    assert np.median([r["scale"] for r in best]) == pytest.approx(-0.4, abs=1e-3)
    # single measurements in any order, and a place to begin at
    one = curves.select("pass_id", "jd", *ISS, F.explode(F.arrays_zip("minutes", "doppler")).alias("m")).select("pass_id", "jd", *ISS, "m.minutes", "m.doppler").orderBy(F.rand(1))
    again = geometry.geolocate(one.withColumns({"lat0": F.lit(27.0), "lon0": F.lit(-80.0)})).collect()
    assert sum(abs(r["lat"] - 28.5) + abs(r["lon"] + 80.65) < 0.05 for r in again) >= 0.9 * len(by)


def test_passes_without_enough_measurements(spark):
    rows = [(1, [0.0, 1.0], [5.0, 6.0]), (2, None, [1.0]), (3, [0.0, 1.0, 2.0], [1.0, None, 2.0]), (4, [0.0, 1.0, 2.0], [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 2460310.5, *ISS.values()) for r in rows], "pass_id long, minutes array<double>, doppler array<double>, jd double, " + ", ".join(f"{c} double" for c in ISS))
    got = geometry.geolocate_passes(df).collect()
    assert sorted(r["pass_id"] for r in got) == [1, 2, 3, 4] and all(r["lat"] is None and not r["converged"] for r in got)
