"""Groups of columns: the registry, the magnetic field against its potential, and coefficient files."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitlake.kernels import field
from orbitlake.operators import magnetic, propagate
from orbitlake.plans import kernel_queries as k

SF = "/root/testdata/sf0.001"


def schmidt(n, m, x):
    """P(n, m) at x by the derivative formula, Schmidt semi-normalised."""
    d = np.polynomial.Polynomial([-1, 0, 1]) ** n
    d = d.deriv(n + m) / (2**n * math.factorial(n))
    size = math.sqrt((2 if m else 1) * math.factorial(n - m) / math.factorial(n + m))
    return size * (1 - x * x) ** (m / 2) * d(x)


def potential(xyz, g, h):
    r = np.linalg.norm(xyz)
    ph = math.atan2(xyz[1], xyz[0])
    return sum(
        field.RADIUS * (field.RADIUS / r) ** (n + 1) * (g[n, m] * math.cos(m * ph) + h[n, m] * math.sin(m * ph)) * schmidt(n, m, xyz[2] / r)
        for n in range(1, len(g)) for m in range(n + 1)
    )


def test_degree_13_is_the_gradient_of_the_potential():
    r = np.random.default_rng(4)
    g, h = r.normal(0, 1000, (14, 14)), r.normal(0, 1000, (14, 14))
    for lat, lon, alt in ((0.0, 0.0, 0.0), (51.6, -40.0, 420.0), (-83.0, 170.0, 800.0), (12.0, 99.0, 35786.0)):
        la, lo, e2 = math.radians(lat), math.radians(lon), 1 / 298.257223563 * (2 - 1 / 298.257223563)
        n = 6378.137 / math.sqrt(1 - e2 * math.sin(la) ** 2)
        at = np.array([(n + alt) * math.cos(la) * math.cos(lo), (n + alt) * math.cos(la) * math.sin(lo), (n * (1 - e2) + alt) * math.sin(la)])
        b = np.array([-(potential(at + d, g, h) - potential(at - d, g, h)) / 0.1 for d in 0.05 * np.eye(3)])
        axes = np.array([[-math.sin(lo), math.cos(lo), 0], [-math.sin(la) * math.cos(lo), -math.sin(la) * math.sin(lo), math.cos(la)], [math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)]])
        model = field.Model([(2020.0, i, j, g[i, j], h[i, j]) for i in range(1, 14) for j in range(i + 1)])
        got = np.ravel(model.enu(at[None], np.array([lat]), np.array([2020.0])))
        h_free = np.abs(h[:, 0]).sum()
        assert h_free > 0 and np.abs(got - axes @ b).max() < 1e-3 * max(1.0, np.abs(b).max() / 1000)


def test_the_main_field_is_that_of_the_earth():
    """Known features: its strength near the poles and at the equator, and where it points."""
    model = magnetic.model_of(None)
    at = lambda lat, lon: np.array([[6371.2 * math.cos(math.radians(lat)) * math.cos(math.radians(lon)), 6371.2 * math.cos(math.radians(lat)) * math.sin(math.radians(lon)), 6371.2 * math.sin(math.radians(lat))]])
    b = {p: np.ravel(model.enu(at(*p), np.array([float(p[0])]), np.array([2020.0]))) for p in ((86, -160), (0, 0), (-64, 136), (-26, -56))}
    assert b[86, -160][2] < -50_000 and b[-64, 136][2] > 50_000
    assert b[0, 0][1] > 20_000 and np.linalg.norm(b[-26, -56]) < 27_000  # the weakest field, over South America


def test_coefficients_of_a_file(spark, tmp_path):
    p = tmp_path / "c.txt"
    p.write_text("# a heading\nc/s deg ord one two SV\ng/h n m 2010.0 2020.0 20-25\ng 1 0 -100.0 -200.0 10.0\ng 1 1 5 6 0\nh 1 1 7.5 8.5 -2\n")
    rows = sorted(tuple(r) for r in magnetic.read_coefficients(spark, str(p)).select("epoch", "n", "m", "g", "h").collect())
    assert rows == [(2010.0, 1, 0, -100.0, 0.0), (2010.0, 1, 1, 5.0, 7.5), (2020.0, 1, 0, -200.0, 0.0), (2020.0, 1, 1, 6.0, 8.5), (2025.0, 1, 0, -150.0, 0.0), (2025.0, 1, 1, 6.0, -1.5)]
    times = [dt.datetime(2010, 1, 1), dt.datetime(2015, 1, 1), dt.datetime(2020, 1, 1), dt.datetime(2025, 1, 1), None]
    states = spark.createDataFrame([(t, 6371.2, 0.0, 0.0, 0.0) for t in times], "t timestamp_ntz, rx double, ry double, rz double, lat double")
    table = magnetic.read_coefficients(spark, str(p))
    north = [r["b_north"] for r in magnetic.with_field(states, table).collect()]
    assert north[:4] == pytest.approx([100.0, 150.0, 200.0, 150.0], abs=0.02) and north[4] is None
    fixed = magnetic.with_field(states, table, epoch=F.lit("2010-01-01").cast("timestamp_ntz")).collect()
    assert all(r["b_north"] == pytest.approx(100.0) for r in fixed)
    with pytest.raises(ValueError):
        magnetic.model_of([(2020.0, 41, 0, 1.0, 0.0)])
    with pytest.raises(ValueError):
        magnetic.model_of([])


def test_all_eleven_groups(spark):
    d = propagate.generate(k.samples(spark, SF), coefficients=[(2020.0, 1, 0, -29000.0, 0.0), (2020.0, 1, 1, -1500.0, 4700.0)])
    assert len(propagate.GROUPS) == 11 and {c for g in propagate.GROUPS for c in propagate.REGISTRY[g].columns if c[0] != "_"} <= set(d.columns)
    rows = d.where("err = 0").limit(50).collect()
    assert rows
    for r in rows:
        assert r["b_total"] == pytest.approx(math.sqrt(r["b_east"] ** 2 + r["b_north"] ** 2 + r["b_up"] ** 2)) == pytest.approx(math.sqrt(r["b_x"] ** 2 + r["b_y"] ** 2 + r["b_z"] ** 2))


def test_a_group_of_the_users_own(spark):
    @propagate.register("perigee_height", ("keplerian",), ("perigee_height",), replace=True)
    def perigee_height(d, request):
        return d.withColumn("perigee_height", F.col("coe.sma") * (1 - F.col("coe.ecc")) - 6378.137)

    @propagate.register("hours", (), ("hours",), replace=True)
    def hours(d, request):
        return d.withColumn("hours", F.hour(request.time))

    try:
        d = propagate.generate(k.samples(spark, SF), ("hours", "perigee_height", "lla"))
        assert d.columns[-5:] == ["hours", "perigee_height", "lat", "lon", "alt"] and "coe" not in d.columns
        assert all(r["perigee_height"] < r["alt"] + 30 and r["hours"] == r["t"].hour for r in d.where("err = 0").limit(30).collect())
        with pytest.raises(ValueError):
            propagate.register("lla")(hours)
        with pytest.raises(ValueError):
            propagate.generate(k.samples(spark, SF), ("nothing",))
        propagate.register("a_", ("b_",), replace=True)(hours), propagate.register("b_", ("a_",), replace=True)(hours)
        with pytest.raises(ValueError):
            propagate.resolved(("a_",))
    finally:
        for name in ("perigee_height", "hours", "a_", "b_"):
            propagate.REGISTRY.pop(name, None)
    assert propagate.resolved(("lst",)) == ["_day", "_sidereal", "ecef", "lla", "_sun", "lst"]


UT1 = [("2016-12-30", -0.40), ("2016-12-31", -0.41), ("2017-01-01", 0.589), ("2017-01-02", 0.588), ("2017-01-05", 0.585)]


def ut1(spark):
    return spark.createDataFrame(UT1, "day string, ut1_utc double").select(F.col("day").cast("timestamp_ntz").alias("utc"), "ut1_utc")


def test_ut1_between_the_entries_and_over_a_leap_second(spark):
    from orbitlake.operators import timescale

    asked = {"2016-12-29 00:00:00": None, "2016-12-30 00:00:00": -0.40, "2016-12-30 12:00:00": -0.405, "2016-12-31 18:00:00": -0.41075, "2017-01-01 00:00:00": 0.589, "2017-01-03 12:00:00": 0.5865, "2019-06-01 00:00:00": 0.585}
    times = spark.createDataFrame([(t, 7.0) for t in [*asked, None]], "s string, _key double").select(F.col("s").cast("timestamp_ntz").alias("t"), "s", "_key")
    got = timescale.with_ut1(times.drop("_key"), ut1(spark)).collect()
    assert len(got) == len(asked) + 1
    for r in got:
        want = asked.get(r["s"])
        assert r["ut1_utc"] is None if want is None else r["ut1_utc"] == pytest.approx(want, abs=1e-9)
    shifted = times.limit(1).select(timescale.utc_to_ut1(F.col("t"), F.lit(-0.4)).alias("a")).select("a", timescale.ut1_to_utc(F.col("a"), F.lit(-0.4)).alias("b")).first()
    assert shifted["a"] == dt.datetime(2016, 12, 28, 23, 59, 59, 600000) and shifted["b"] == dt.datetime(2016, 12, 29)


def test_strict_time_turns_the_earth_as_the_table_says(spark):
    """Earth-fixed places move by the angle of UT1-UTC, inertial ones don't."""
    epoch = dt.datetime(2017, 1, 2)
    e = dict(zip(("mm", "ecc", "inc", "raan", "aop", "ma", "bstar"), (15.49560532, 0.0006703, 51.64, 208.9163, 30.5502, 329.5947, 1.027e-4), strict=True))
    s = spark.createDataFrame([(k, epoch, epoch + dt.timedelta(minutes=13 * k), *e.values()) for k in range(10)], "k int, epoch timestamp_ntz, t timestamp_ntz, " + ", ".join(f"{c} double" for c in e))
    plain = {r["k"]: r for r in propagate.generate(s, ("eci", "lla", "beta")).collect()}
    strict = propagate.generate(s, ("eci", "lla", "beta"), ut1=ut1(spark))
    assert "_ut1_utc" not in strict.columns
    for r in strict.collect():
        p = plain[r["k"]]
        turn = (p["lon"] - r["lon"] + 180) % 360 - 180
        assert turn == pytest.approx(0.588 * 360 / 86164.1, abs=2e-5) and (r["x"], r["lat"], r["beta"]) == pytest.approx((p["x"], p["lat"], p["beta"]))
    early = propagate.generate(s.withColumn("t", F.lit("2016-01-01").cast("timestamp_ntz")), ("eci", "lla"), ut1=ut1(spark)).first()
    assert early["lon"] is None and early["x"] is not None
