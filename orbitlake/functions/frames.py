"""Closed-form astrodynamics as Column expressions. UT1 and UTC are taken as one scale; positions in km unless named.

Every intermediate is a Column, so a chain of these stays inside whole-stage code generation. What is used many times, as
in an iteration, gets a projection of its own: nested expressions would double with each step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Time base, the ellipsoid, rotation, radii of the illumination model, light and the astronomical unit.
JD_1957 = 2435839.5
WGS84_A, WGS84_F = 6378.137, 1 / 298.257223563
EARTH_RATE = 7.292115146706979e-5  # rad/s
MU = 398600.4418
R_EARTH, R_SUN = 6371.0, 696340.0
AU_KM = 149597870.7
LIGHT = 299792458.0  # m/s
PI = 3.141592653589793
Vec = tuple[Column, Column, Column]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def wrap(x: Column, full: float) -> Column:
    """In [0, full)."""
    return x - full * F.floor(x / full)


def clip(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def jday(t: Column) -> tuple[Column, Column]:
    """Julian day of the midnight or noon-free day start, and the fraction since."""
    days = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1957-01-01 00:00:00")), t) / F.lit(86400e6)
    whole = F.floor(days)
    return whole + JD_1957, days - whole


def gmst_hours(jd: Column, frac: Column) -> Column:
    """Mean sidereal time (IAU 1982 polynomial), hours."""
    t = ((jd - 2451545.0) + frac) / 36525.0
    s = 67310.54841 + (876600.0 * 3600.0 + 8640184.812866) * t + 0.093104 * t * t - 6.2e-6 * t * t * t
    return wrap(s, 86400.0) / 3600.0


def sun(jd: Column, frac: Column) -> tuple[Vec, Column]:
    """Geocentric Sun (low-precision series of the Astronomical Almanac), km, mean equator of date; right ascension in hours."""
    n = (jd - 2451545.0) + frac
    g = F.radians(357.528 + 0.9856003 * n)
    lam = F.radians(280.460 + 0.9856474 * n + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    eps = F.radians(23.439 - 4e-7 * n)
    r = (1.00014 - 0.01671 * F.cos(g) - 0.00014 * F.cos(2 * g)) * AU_KM
    v = (r * F.cos(lam), r * F.cos(eps) * F.sin(lam), r * F.sin(eps) * F.sin(lam))
    return v, wrap(F.degrees(F.atan2(v[1], v[0])) / 15.0, 24.0)


def with_kepler(df: DataFrame, ma: Column, ecc: Column, out: str = "ea", rounds: int = 8) -> DataFrame:
    """With the eccentric anomaly by Newton steps of a fixed number, radians; each step is a projection of its own."""
    df = df.withColumn("_m", ma).withColumn(out, F.col("_m") + ecc * F.sin("_m"))
    e = F.col(out)
    for _ in range(rounds):
        df = df.withColumn(out, e - (e - ecc * F.sin(e) - F.col("_m")) / (1 - ecc * F.cos(e)))
    return df.drop("_m")


def perifocal(sma: Column, ecc: Column, ea: Column, inc: Column, raan: Column, aop: Column) -> tuple[Vec, Vec]:
    """Two-body position and velocity, km and km/s, from radians."""
    b = F.sqrt(1 - ecc * ecc)
    x, y = sma * (F.cos(ea) - ecc), sma * b * F.sin(ea)
    rate = F.sqrt(F.lit(MU) * sma) / (sma * (1 - ecc * F.cos(ea)))
    vx, vy = -rate * F.sin(ea), rate * b * F.cos(ea)
    co, so, cw, sw, ci, si = F.cos(raan), F.sin(raan), F.cos(aop), F.sin(aop), F.cos(inc), F.sin(inc)
    p = (co * cw - so * sw * ci, so * cw + co * sw * ci, sw * si)
    q = (-co * sw - so * cw * ci, -so * sw + co * cw * ci, cw * si)
    return tuple(x * p[k] + y * q[k] for k in range(3)), tuple(vx * p[k] + vy * q[k] for k in range(3))


def to_ecef(r: Vec, v: Vec, gmst: Column) -> tuple[Vec, Vec]:
    """Rotated by sidereal time (hours); the velocity is relative to the rotating Earth."""
    a = gmst * (PI / 12.0)
    c, s = F.cos(a), F.sin(a)
    x, y = c * r[0] + s * r[1], c * r[1] - s * r[0]
    vx, vy = c * v[0] + s * v[1], c * v[1] - s * v[0]
    return (x, y, r[2]), (vx + EARTH_RATE * y, vy - EARTH_RATE * x, v[2])


# Main terms of the IAU 1980 nutation. Multiples of the Moon's and the Sun's anomaly, the Moon's argument of latitude, its
# elongation and its node; then longitude, its rate a century, obliquity and its rate, in 0.0001 arc seconds.
NUTATION = (
    (0, 0, 0, 0, 1, -171996, -174.2, 92025, 8.9),
    (0, 0, 2, -2, 2, -13187, -1.6, 5736, -3.1),
    (0, 0, 2, 0, 2, -2274, -0.2, 977, -0.5),
    (0, 0, 0, 0, 2, 2062, 0.2, -895, 0.5),
    (0, 1, 0, 0, 0, 1426, -3.4, 54, -0.1),
    (1, 0, 0, 0, 0, 712, 0.1, -7, 0.0),
    (0, 1, 2, -2, 2, -517, 1.2, 224, -0.6),
    (0, 0, 2, 0, 1, -386, -0.4, 200, 0.0),
    (1, 0, 2, 0, 2, -301, 0.0, 129, -0.1),
    (0, -1, 2, -2, 2, 217, -0.5, -95, 0.3),
    (1, 0, 0, -2, 0, -158, 0.0, -1, 0.0),
    (0, 0, 2, -2, 1, 129, 0.1, -70, 0.0),
    (-1, 0, 2, 0, 2, 123, 0.0, -53, 0.0),
)
# Those five arguments in degrees, and the angles of precession and the mean obliquity in arc seconds, by powers of centuries.
DELAUNAY = (
    (134.96298139, 477198.8673981, 0.0086972),
    (357.52772333, 35999.05034, -0.0001603),
    (93.27191028, 483202.0175381, -0.0036825),
    (297.85036306, 445267.11148, -0.0019142),
    (125.04452222, -1934.1362608, 0.0020708),
)
ZETA, THETA, Z_ANGLE = (0.0, 2306.2181, 0.30188, 0.017998), (0.0, 2004.3109, -0.42665, -0.041833), (0.0, 2306.2181, 1.09468, 0.018203)
OBLIQUITY = (84381.448, -46.815, -0.00059, 0.001813)
ARC_SECOND = PI / 648000.0


def _poly(c: tuple[float, ...], t: Column) -> Column:
    out = F.lit(c[-1])
    for k in reversed(c[:-1]):
        out = out * t + k
    return out


def _turn(r: Vec, axis: int, c: Column, s: Column) -> Vec:
    """Coordinates in a frame turned about an axis (0, 1, 2) by the angle of that cosine and sine."""
    i, j = (axis + 1) % 3, (axis + 2) % 3
    out = list(r)
    out[i], out[j] = c * r[i] + s * r[j], c * r[j] - s * r[i]
    return tuple(out)


def with_inertial(df: DataFrame, r: Vec, v: Vec, jd: Column, frac: Column, names: tuple[str, ...]) -> DataFrame:
    """With the state turned from the true equator and mean equinox of date to the equator and equinox of J2000.

    Equation of the equinoxes, nutation of 13 terms and IAU 1976 precession: some metres from the celestial reference frame
    for a low orbit. Each angle and each turn is a projection of its own.
    """
    kept = df.columns
    t = F.col("_tc")
    df = df.withColumn("_tc", ((jd - 2451545.0) + frac) / 36525.0)
    df = df.withColumns({f"_a{k}": F.radians(_poly(c, t)) for k, c in enumerate(DELAUNAY)})
    args = [sum((n * F.col(f"_a{k}") for k, n in enumerate(row[:5]) if n), F.lit(0.0)) for row in NUTATION]
    df = df.withColumns({f"_n{k}": a for k, a in enumerate(args)})
    psi = sum(((row[5] + row[6] * t) * F.sin(f"_n{k}") for k, row in enumerate(NUTATION)), F.lit(0.0))
    eps = sum(((row[7] + row[8] * t) * F.cos(f"_n{k}") for k, row in enumerate(NUTATION)), F.lit(0.0))
    df = df.withColumns({"_dpsi": psi * (1e-4 * ARC_SECOND), "_deps": eps * (1e-4 * ARC_SECOND), "_e0": _poly(OBLIQUITY, t) * ARC_SECOND})
    # each turn: axis and angle
    turns = (
        (2, -F.col("_dpsi") * F.cos("_e0")), (0, F.col("_e0") + F.col("_deps")), (2, F.col("_dpsi")), (0, -F.col("_e0")),
        (2, _poly(Z_ANGLE, t) * ARC_SECOND), (1, -_poly(THETA, t) * ARC_SECOND), (2, _poly(ZETA, t) * ARC_SECOND),
    )
    df = df.withColumns({f"_c{k}": F.cos(a) for k, (_, a) in enumerate(turns)} | {f"_s{k}": F.sin(a) for k, (_, a) in enumerate(turns)})
    own = tuple(f"_q{k}" for k in range(6))
    df = df.withColumns(dict(zip(own, (*r, *v), strict=True)))
    for k, (axis, _) in enumerate(turns):
        c, s = F.col(f"_c{k}"), F.col(f"_s{k}")
        now = tuple(F.col(q) for q in own)
        df = df.withColumns(dict(zip(own, (*_turn(now[:3], axis, c, s), *_turn(now[3:], axis, c, s)), strict=True)))
    same = [c for c in kept if c not in names]
    return df.select(*same, *(F.col(q).alias(n) for q, n in zip(own, names, strict=True)))


def with_geodetic(df: DataFrame, r: Vec, rounds: int = 5) -> DataFrame:
    """With lat and lon in degrees and alt in km, by a fixed number of iterations, each a projection of its own."""
    e2 = WGS84_F * (2 - WGS84_F)
    df = df.withColumn("_p", F.sqrt(r[0] * r[0] + r[1] * r[1])).withColumn("_l", F.atan2(r[2], F.col("_p") * (1 - e2)))
    for _ in range(rounds):
        df = df.withColumn("_s", F.sin("_l"))
        df = df.withColumn("_l", F.atan2(r[2] + e2 * WGS84_A / F.sqrt(1 - e2 * F.col("_s") * F.col("_s")) * F.col("_s"), F.col("_p")))
    df = df.withColumn("_s", F.sin("_l")).withColumn("_n", WGS84_A / F.sqrt(1 - e2 * F.col("_s") * F.col("_s")))
    alt = F.col("_p") * F.cos("_l") + r[2] * F.col("_s") - WGS84_A * WGS84_A / F.col("_n")
    return df.withColumn("alt", alt).withColumn("lon", F.degrees(F.atan2(r[1], r[0]))).withColumn("lat", F.degrees("_l")).drop("_p", "_l", "_s", "_n")


def site_ecef(lat: Column, lon: Column, alt_km: Column) -> Vec:
    e2 = WGS84_F * (2 - WGS84_F)
    la, lo = F.radians(lat), F.radians(lon)
    n = WGS84_A / F.sqrt(1 - e2 * F.sin(la) * F.sin(la))
    return (n + alt_km) * F.cos(la) * F.cos(lo), (n + alt_km) * F.cos(la) * F.sin(lo), (n * (1 - e2) + alt_km) * F.sin(la)


def range_rate(r: Vec, v: Vec, site: Vec) -> tuple[Column, Column]:
    """Range and its rate between an Earth-fixed state and a site, in the state's units."""
    d = tuple(r[k] - site[k] for k in range(3))
    n = norm(d)
    return n, dot(d, v) / n


def elevation(r: Vec, site: Vec, lat: Column, lon: Column) -> Column:
    """Degrees above the site's horizon, without refraction."""
    la, lo = F.radians(lat), F.radians(lon)
    d = tuple(r[k] - site[k] for k in range(3))
    up = (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))
    return F.degrees(F.asin(clip(dot(d, up) / norm(d))))


def doppler(rate_ms: Column, frequency: Column) -> Column:
    return -frequency * rate_ms / LIGHT


def with_osculating(df: DataFrame, r: Vec, v: Vec) -> DataFrame:
    """With a struct `coe` of osculating elements: lengths in km, angles in degrees, mean motion in degrees a day."""
    h = cross(r, v)
    df = df.withColumns({"_hx": h[0], "_hy": h[1], "_hz": h[2], "_r": norm(r), "_rv": dot(r, v), "_v2": dot(v, v)})
    hv, rn, rv = tuple(F.col(c) for c in ("_hx", "_hy", "_hz")), F.col("_r"), F.col("_rv")
    e = tuple(((F.col("_v2") - MU / rn) * r[k] - rv * v[k]) / MU for k in range(3))
    df = df.withColumns({"_h": norm(hv), "_e": norm(e), "_a": 1 / (2 / rn - F.col("_v2") / MU), "_o": F.atan2(hv[0], -hv[1])})
    hn, ecc, o = F.col("_h"), F.col("_e"), F.col("_o")
    node = (F.cos(o), F.sin(o), F.lit(0.0))
    # argument of latitude from the node, true anomaly from perigee
    df = df.withColumns({"_u": F.atan2(dot(r, cross(tuple(c / hn for c in hv), node)), dot(r, node)), "_t": F.atan2(rv * hn / (rn * MU), hn * hn / (rn * MU) - 1)})
    t, u, a = F.col("_t"), F.col("_u"), F.col("_a")
    df = df.withColumn("_ea", 2 * F.atan2(F.sqrt(1 - ecc) * F.sin(t / 2), F.sqrt(1 + ecc) * F.cos(t / 2)))
    df = df.withColumn("_ma", F.col("_ea") - ecc * F.sin("_ea"))
    deg = lambda c: wrap(F.degrees(c), 360.0)
    w = u - t
    fields = {
        "sma": a, "ecc": ecc, "inc": F.degrees(F.acos(clip(hv[2] / hn))), "raan": deg(o), "aop": deg(w), "ta": deg(t), "ma": deg(F.col("_ma")), "ea": deg(F.col("_ea")),
        "arglat": deg(u), "tlon": deg(o + u), "mlon": deg(o + w + F.col("_ma")), "lonper": deg(o + w), "mm_deg_day": F.degrees(F.sqrt(F.lit(MU) / (a * a * a))) * 86400.0,
    }
    out = df.withColumn("coe", F.struct(*(c.alias(n) for n, c in fields.items())))
    return out.drop("_hx", "_hy", "_hz", "_r", "_rv", "_v2", "_h", "_e", "_a", "_o", "_u", "_t", "_ea", "_ma")


def equinoctial(sma: Column, ecc: Column, inc: Column, raan: Column, aop: Column, ta: Column) -> dict[str, Column]:
    """Modified equinoctial elements from degrees; the true longitude isn't wrapped."""
    t = F.tan(F.radians(inc) / 2)
    w = F.radians(raan + aop)
    o = F.radians(raan)
    return {"p": sma * (1 - ecc * ecc), "f": ecc * F.cos(w), "g": ecc * F.sin(w), "h": t * F.cos(o), "k": t * F.sin(o), "l_deg": raan + aop + ta}


def sunlight(r: Vec, s: Vec) -> Column:
    """0 in the umbra, 1 in the penumbra, 2 in sunlight, by apparent discs of a spherical Earth and the Sun."""
    rn = norm(r)
    to_sun = tuple(s[k] - r[k] for k in range(3))
    earth, disc = F.asin(clip(F.lit(R_EARTH) / rn)), F.asin(clip(F.lit(R_SUN) / norm(to_sun)))
    apart = F.acos(clip(-dot(r, to_sun) / (rn * norm(to_sun))))
    return F.when(apart >= earth + disc, 2).when(apart <= earth - disc, 0).otherwise(1).cast("tinyint")


def beta_angle(r: Vec, v: Vec, s: Vec) -> Column:
    h = cross(r, v)
    return 90.0 - F.degrees(F.acos(clip(dot(h, s) / (norm(h) * norm(s)))))


def local_solar_time(lon: Column, gmst: Column, sun_ra: Column) -> Column:
    return wrap(gmst + lon / 15.0 - sun_ra + 12.0, 24.0)


def enu_to_ecef(east: Column, north: Column, up: Column, lat: Column, lon: Column) -> Vec:
    la, lo = F.radians(lat), F.radians(lon)
    x = -F.sin(lo) * east - F.sin(la) * F.cos(lo) * north + F.cos(la) * F.cos(lo) * up
    y = F.cos(lo) * east - F.sin(la) * F.sin(lo) * north + F.cos(la) * F.sin(lo) * up
    return x, y, F.cos(la) * north + F.sin(la) * up


def node_solar_time(raan: Column, sun_ra: Column) -> Column:
    """Local time of the ascending node, hours in [0, 24)."""
    return wrap(raan / 15.0 - sun_ra + 12.0, 24.0)


def geo_longitude(raan: Column, aop: Column, ma: Column, gmst: Column) -> Column:
    """Mean longitude over the Earth, in [-180, 180)."""
    return wrap(raan + aop + ma - gmst * 15.0 + 180.0, 360.0) - 180.0


def rev_at(rev: Column, phase: Column, n: Column, half_ndot: Column, days: Column) -> Column:
    return rev + phase + n * days + half_ndot * days * days


def rev_days(rev: Column, phase: Column, n: Column, half_ndot: Column, target: Column) -> Column:
    """Days from epoch until a revolution number is reached; linear where the quadratic has no use or no root."""
    d = target - rev - phase
    disc = n * n + 4 * half_ndot * d
    safe = F.when((F.abs(half_ndot) >= 1e-12) & (disc >= 0), (F.sqrt(F.greatest(disc, F.lit(0.0))) - n) / (2 * half_ndot))
    return F.coalesce(safe, d / n)
