"""Queries of closed-form astrodynamics, on two-body states of the element catalog."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from orbitlake.functions import frames as fr
from orbitlake.functions import tle
from orbitlake.plans.catalog_queries import CAT, QUERIES, ORACLE, _events, elements, query, table  # noqa: F401

PI = "3.141592653589793::DOUBLE"
DEG = f"(180e0::DOUBLE / {PI})"

#: Epoch states: Kepler's equation by the same number of Newton steps, then rotations.
_NEWTON = "".join(f", k{i + 1} AS (SELECT *, e{i} - (e{i} - ecc * sin(e{i}) - m) / (1 - ecc * cos(e{i})) AS e{i + 1} FROM k{i})" for i in range(8))
STATE = CAT + f"""
, k0 AS (SELECT id, norad, epoch, revnum, mm, sma, ecc, radians(inc) AS i, radians(raan) AS o, radians(aop) AS w, radians(ma) AS m, inc, raan, aop, ma,
         radians(ma) + ecc * sin(radians(ma)) AS e0 FROM el){_NEWTON},
pf AS (SELECT *, e8 AS ea, sma * (cos(e8) - ecc) AS px, sma * sqrt(1 - ecc * ecc) * sin(e8) AS py,
       sqrt(398600.4418::DOUBLE * sma) / (sma * (1 - ecc * cos(e8))) AS rate FROM k8),
st AS (SELECT *, px * (cos(o) * cos(w) - sin(o) * sin(w) * cos(i)) + py * (-cos(o) * sin(w) - sin(o) * cos(w) * cos(i)) AS x,
  px * (sin(o) * cos(w) + cos(o) * sin(w) * cos(i)) + py * (-sin(o) * sin(w) + cos(o) * cos(w) * cos(i)) AS y, px * sin(w) * sin(i) + py * cos(w) * sin(i) AS z,
  -rate * sin(ea) * (cos(o) * cos(w) - sin(o) * sin(w) * cos(i)) + rate * sqrt(1 - ecc * ecc) * cos(ea) * (-cos(o) * sin(w) - sin(o) * cos(w) * cos(i)) AS vx,
  -rate * sin(ea) * (sin(o) * cos(w) + cos(o) * sin(w) * cos(i)) + rate * sqrt(1 - ecc * ecc) * cos(ea) * (-sin(o) * sin(w) + cos(o) * cos(w) * cos(i)) AS vy,
  -rate * sin(ea) * sin(w) * sin(i) + rate * sqrt(1 - ecc * ecc) * cos(ea) * cos(w) * sin(i) AS vz FROM pf),
jt AS (SELECT *, date_diff('microsecond', TIMESTAMP '1957-01-01', epoch) / 86400e6::DOUBLE AS d57 FROM st),
jj AS (SELECT *, floor(d57) + 2435839.5::DOUBLE AS jd, d57 - floor(d57) AS fr FROM jt),
jg AS (SELECT *, (jd - 2451545e0 + fr) / 36525e0 AS tc FROM jj),
gm AS (SELECT *, 67310.54841::DOUBLE + (876600e0 * 3600e0 + 8640184.812866::DOUBLE) * tc + 0.093104::DOUBLE * tc * tc - 6.2e-6::DOUBLE * tc * tc * tc AS gs FROM jg),
g AS (SELECT *, (gs - 86400e0 * floor(gs / 86400e0)) / 3600e0 AS gmst FROM gm),
ef AS (SELECT *, cos(gmst * {PI} / 12e0) * x + sin(gmst * {PI} / 12e0) * y AS rx, cos(gmst * {PI} / 12e0) * y - sin(gmst * {PI} / 12e0) * x AS ry FROM g),
ec AS (SELECT *, cos(gmst * {PI} / 12e0) * vx + sin(gmst * {PI} / 12e0) * vy + 7.292115146706979e-5::DOUBLE * ry AS ux,
  cos(gmst * {PI} / 12e0) * vy - sin(gmst * {PI} / 12e0) * vx - 7.292115146706979e-5::DOUBLE * rx AS uy FROM ef)
"""
_E2 = "(1 / 298.257223563::DOUBLE * (2 - 1 / 298.257223563::DOUBLE))"
_LAT = "".join(
    f", la{i + 1} AS (SELECT *, atan2(z + {_E2} * 6378.137::DOUBLE / sqrt(1 - {_E2} * sin(l{i}) * sin(l{i})) * sin(l{i}), p) AS l{i + 1} FROM la{i})" for i in range(5)
)
GEO = STATE + f", la0 AS (SELECT *, sqrt(rx * rx + ry * ry) AS p, atan2(z, sqrt(rx * rx + ry * ry) * (1 - {_E2})) AS l0 FROM ec){_LAT}"
GEO += f""", geo AS (SELECT *, degrees(l5) AS lat, degrees(atan2(ry, rx)) AS lon,
  p * cos(l5) + z * sin(l5) - 6378.137::DOUBLE * 6378.137::DOUBLE / (6378.137::DOUBLE / sqrt(1 - {_E2} * sin(l5) * sin(l5))) AS alt FROM la5)
"""


def states(spark, sf_dir):
    """Two-body states at epoch; each step in a projection of its own, so nothing is computed twice."""
    e = elements(spark, sf_dir)
    e = fr.with_kepler(e, F.radians("ma"), F.col("ecc"))
    r, v = fr.perifocal(F.col("sma"), F.col("ecc"), F.col("ea"), F.radians("inc"), F.radians("raan"), F.radians("aop"))
    e = e.select("*", *(c.alias(n) for c, n in zip((*r, *v), ("x", "y", "z", "vx", "vy", "vz"), strict=True)))
    jd, frac = fr.jday(F.col("epoch"))
    e = e.withColumn("jd", jd).withColumn("fr", frac)
    return e.withColumn("gmst", fr.gmst_hours(F.col("jd"), F.col("fr")))



def _vec(*names):
    return tuple(F.col(n) for n in names)


def fixed(spark, sf_dir):
    s = states(spark, sf_dir)
    r, v = fr.to_ecef(_vec("x", "y", "z"), _vec("vx", "vy", "vz"), F.col("gmst"))
    return s.select("*", r[0].alias("rx"), r[1].alias("ry"), v[0].alias("ux"), v[1].alias("uy"))


def _rounded(df, digits, *names, **more):
    return df.select("id", *(F.round(n, digits).alias(n) for n in names), *(F.round(c, digits).alias(n) for n, c in more.items()))


def _r(digits, *names):
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


@query(STATE + "SELECT id, jd, round(fr, 9) AS frac FROM g")
def jday(spark, sf_dir):
    return states(spark, sf_dir).select("id", "jd", F.round("fr", 9).alias("frac"))


@query(STATE + f"SELECT id, {_r(6, 'gmst')} FROM g")
def gmst(spark, sf_dir):
    return _rounded(states(spark, sf_dir), 6, "gmst")


@query(STATE + f"SELECT id, {_r(4, 'x', 'y', 'z')}, {_r(7, 'vx', 'vy', 'vz')} FROM g")
def kepler_state(spark, sf_dir):
    s = states(spark, sf_dir)
    return s.select("id", *(F.round(c, 4).alias(c) for c in ("x", "y", "z")), *(F.round(c, 7).alias(c) for c in ("vx", "vy", "vz")))


@query(STATE + f"SELECT id, {_r(4, 'rx', 'ry', 'z')}, {_r(6, 'ux', 'uy', 'vz')} FROM ec")
def ecef_rotate(spark, sf_dir):
    s = fixed(spark, sf_dir)
    return s.select("id", *(F.round(c, 4).alias(c) for c in ("rx", "ry", "z")), *(F.round(c, 6).alias(c) for c in ("ux", "uy", "vz")))


def _geodetic(spark, sf_dir):
    return fr.with_geodetic(fixed(spark, sf_dir), _vec("rx", "ry", "z"))


@query(GEO + f"SELECT id, {_r(6, 'lat', 'lon')}, {_r(4, 'alt')} FROM geo")
def geodetic(spark, sf_dir):
    return _geodetic(spark, sf_dir).select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("alt", 4).alias("alt"))


@query(STATE + f"""SELECT id, {_r(4, 'sma')}, {_r(7, 'ecc')}, {_r(5, 'inc')}, round(sqrt(398600.4418::DOUBLE / (sma * sma * sma)) * {DEG} * 86400e0, 5) AS mm_deg_day,
  round(ma, 3) AS ma FROM g WHERE ecc > 0.001""")
def osculating(spark, sf_dir):
    s = fr.with_osculating(states(spark, sf_dir).where("ecc > 0.001"), _vec("x", "y", "z"), _vec("vx", "vy", "vz"))
    return s.select("id", *(F.round(F.col(f"coe.{c}"), d).alias(c) for c, d in (("sma", 4), ("ecc", 7), ("inc", 5), ("mm_deg_day", 5), ("ma", 3))))


@query(CAT + """SELECT id, round(sma * (1 - ecc * ecc), 5) AS p, round(ecc * cos(radians(raan + aop)), 9) AS f, round(ecc * sin(radians(raan + aop)), 9) AS g,
  round(tan(radians(inc) / 2) * cos(radians(raan)), 8) AS h, round(tan(radians(inc) / 2) * sin(radians(raan)), 8) AS k, round(raan + aop + ma, 6) AS l_deg FROM el WHERE inc < 170""")
def equinoctial(spark, sf_dir):
    q = fr.equinoctial(*(F.col(c) for c in ("sma", "ecc", "inc", "raan", "aop", "ma")))
    digits = {"p": 5, "f": 9, "g": 9, "h": 8, "k": 8, "l_deg": 6}
    return elements(spark, sf_dir).where("inc < 170").select("id", *(F.round(q[c], d).alias(c) for c, d in digits.items()))


@query(GEO + f""", b AS (SELECT *, 20000 * cos(l5) AS n, 1000 * sin(radians(lon)) AS e, -40000 * sin(l5) AS u FROM geo)
SELECT id, round(-sin(radians(lon)) * e - sin(radians(lat)) * cos(radians(lon)) * n + cos(radians(lat)) * cos(radians(lon)) * u, 4) AS bx,
  round(cos(radians(lon)) * e - sin(radians(lat)) * sin(radians(lon)) * n + cos(radians(lat)) * sin(radians(lon)) * u, 4) AS "by",
  round(cos(radians(lat)) * n + sin(radians(lat)) * u, 4) AS bz FROM b""")
def mag_rotate(spark, sf_dir):
    la, lo = F.radians("lat"), F.radians("lon")
    b = fr.enu_to_ecef(1000 * F.sin(lo), 20000 * F.cos(la), -40000 * F.sin(la), F.col("lat"), F.col("lon"))
    return _geodetic(spark, sf_dir).select("id", *(F.round(c, 4).alias(n) for c, n in zip(b, ("bx", "by", "bz"), strict=True)))


_SITE = {"ksc": (28.5, -80.65, 0.0), "north": (69.0, 20.0, 0.5)}
_SITE_SQL = ", site AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for n, (a, b, c) in _SITE.items()) + f""") t(name, slat, slon, salt)),
sx AS (SELECT *, 6378.137::DOUBLE / sqrt(1 - {_E2} * sin(radians(slat)) * sin(radians(slat))) AS n FROM site),
sy AS (SELECT name, slat, slon, (n + salt) * cos(radians(slat)) * cos(radians(slon)) AS sx, (n + salt) * cos(radians(slat)) * sin(radians(slon)) AS sy,
  (n * (1 - {_E2}) + salt) * sin(radians(slat)) AS sz FROM sx),
rr AS (SELECT id, norad, epoch, name, sqrt((rx - sx) * (rx - sx) + (ry - sy) * (ry - sy) + (z - sz) * (z - sz)) AS rho,
  (rx - sx) * ux + (ry - sy) * uy + (z - sz) * vz AS q FROM ec, sy)
"""


def _ranges(spark, sf_dir):
    sites = spark.createDataFrame([(n, *map(float, p)) for n, p in _SITE.items()], "name string, slat double, slon double, salt double")
    s = fixed(spark, sf_dir).crossJoin(F.broadcast(sites))  # as many sites as the caller names
    site = fr.site_ecef(F.col("slat"), F.col("slon"), F.col("salt"))
    rho, rate = fr.range_rate(_vec("rx", "ry", "z"), _vec("ux", "uy", "vz"), site)
    return s.select("id", "norad", "epoch", "name", rho.alias("rho"), rate.alias("rate"))


@query(STATE + _SITE_SQL + "SELECT id, name, round(rho, 4) AS rho, round(q / rho, 6) AS rate FROM rr")
def site_range(spark, sf_dir):
    return _ranges(spark, sf_dir).select("id", "name", F.round("rho", 4).alias("rho"), F.round("rate", 6).alias("rate"))


@query(STATE + _SITE_SQL + "SELECT id, name, round(-437e6::DOUBLE * (q / rho * 1000e0) / 299792458e0, 2) AS shift FROM rr")
def doppler(spark, sf_dir):
    return _ranges(spark, sf_dir).select("id", "name", F.round(fr.doppler(F.col("rate") * 1000.0, F.lit(437e6)), 2).alias("shift"))


@query("""WITH d AS (SELECT user_id, event_id, ts, value - 50 AS d, lead(value - 50) OVER w AS d2, lead(ts) OVER w AS t2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, d * d2 < 0 AS cross_ FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY NOT coalesce(cross_, false), CASE WHEN coalesce(cross_, false) THEN 0 ELSE abs(d) END, ts, event_id) AS k FROM c)
SELECT user_id, CASE WHEN coalesce(cross_, false) THEN ts + to_microseconds(floor(date_diff('microsecond', ts, t2) * (d / (d - d2)))::BIGINT) ELSE ts END AS tca FROM f WHERE k = 1""")
def doppler_tca(spark, sf_dir):
    from orbitlake.operators.doppler import closest_approach

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("value") - 50).alias("d"))
    return closest_approach(e, "user_id", "ts", "d", "event_id")


_REV = CAT + """, q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
w AS (SELECT id, norad, epoch, mm, aop, ma, revnum, CASE WHEN row_number() OVER o = 1 THEN TIMESTAMP '1957-01-01' ELSE epoch END AS a,
  coalesce(lead(epoch) OVER o, TIMESTAMP '2056-12-31 23:59:59.999999') AS b FROM el WINDOW o AS (PARTITION BY norad ORDER BY epoch, id)),
j AS (SELECT q.event_id, w.*, date_diff('microsecond', w.epoch, q.ts) / 86400e6::DOUBLE AS days FROM q JOIN w ON q.user_id = w.norad AND q.ts >= a AND q.ts < b),
v AS (SELECT *, revnum + (aop + ma) / 360e0 + mm * days + 1e-5::DOUBLE * days * days AS rev FROM j)
"""


def _revs(spark, sf_dir):
    from orbitlake.operators import switching

    held = switching.epoch_windows(elements(spark, sf_dir), tie=("id",))
    asked = _events(spark, sf_dir, "error").select("event_id", F.col("user_id").cast("int").alias("norad"), F.col("ts").alias("t"))
    j = switching.assign(asked, held.select("id", "norad", "epoch", "mm", "aop", "ma", "revnum", "valid_from", "valid_to"))
    days = F.timestamp_diff("MICROSECOND", F.col("epoch"), F.col("t")) / 86400e6
    j = j.withColumn("days", days).withColumn("phase", tle.rev_phase(F.col("aop"), F.col("ma")))
    return j.withColumn("rev", fr.rev_at(F.col("revnum"), F.col("phase"), F.col("mm"), F.lit(1e-5), F.col("days")))


@query(_REV + "SELECT event_id, round(rev, 6) AS rev FROM v")
def rev_at(spark, sf_dir):
    return _revs(spark, sf_dir).select("event_id", F.round("rev", 6).alias("rev"))


@query(_REV + """SELECT event_id, round((sqrt(mm * mm + 4e-5::DOUBLE * (floor(rev) - revnum - (aop + ma) / 360e0)) - mm) / 2e-5::DOUBLE, 4) AS start_days,
  round((sqrt(mm * mm + 4e-5::DOUBLE * (floor(rev) + 1 - revnum - (aop + ma) / 360e0)) - mm) / 2e-5::DOUBLE, 4) AS stop_days FROM v""")
def rev_bounds(spark, sf_dir):
    r = _revs(spark, sf_dir)
    at = lambda k: F.round(fr.rev_days(F.col("revnum"), F.col("phase"), F.col("mm"), F.lit(1e-5), F.floor("rev") + k), 4)
    return r.select("event_id", at(0).alias("start_days"), at(1).alias("stop_days"))


@query(_REV + "SELECT event_id, id, round(abs(rev - 5000), 5) AS miss FROM v WHERE abs(floor(rev) - 5000) <= 2000")
def rev_match(spark, sf_dir):
    r = _revs(spark, sf_dir).where(F.abs(F.floor("rev") - 5000) <= 2000)
    return r.select("event_id", "id", F.round(F.abs(F.col("rev") - 5000), 5).alias("miss"))


@query(STATE + "SELECT id, round(x_ - 360e0 * floor(x_ / 360e0) - 180e0, 5) AS lon FROM (SELECT id, raan + aop + ma - gmst * 15e0 + 180e0 AS x_ FROM g)")
def geo_longitude(spark, sf_dir):
    s = states(spark, sf_dir)
    return s.select("id", F.round(fr.geo_longitude(F.col("raan"), F.col("aop"), F.col("ma"), F.col("gmst")), 5).alias("lon"))


@query(CAT + """, d AS (SELECT id, norad, epoch, raan, raan - lag(raan) OVER w AS d FROM cat WINDOW w AS (PARTITION BY norad ORDER BY epoch, id)),
c AS (SELECT *, CASE WHEN d > 180 THEN -360 WHEN d < -180 THEN 360 ELSE 0 END AS c FROM d)
SELECT id, round(raan + sum(c) OVER (PARTITION BY norad ORDER BY epoch, id ROWS UNBOUNDED PRECEDING), 4) AS raan FROM c""")
def angle_unwrap(spark, sf_dir):
    w = Window.partitionBy("norad").orderBy("epoch", "id")
    d = F.col("raan") - F.lag("raan").over(w)
    e = elements(spark, sf_dir).withColumn("c", F.when(d > 180, -360).when(d < -180, 360).otherwise(0))
    return e.select("id", F.round(F.col("raan") + F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("raan"))


@query(CAT + """SELECT '1998-067A' AS OBJECT_NAME, '1998067A' AS OBJECT_ID, strftime(epoch, '%Y-%m-%dT%H:%M:%S.%f') AS EPOCH, round(mm, 8) AS MEAN_MOTION, round(ecc, 7) AS ECCENTRICITY,
  round(inc, 4) AS INCLINATION, norad AS NORAD_CAT_ID, elnum AS ELEMENT_SET_NO, revnum AS REV_AT_EPOCH FROM cat""")
def omm_export(spark, sf_dir):
    from orbitlake.operators.omm import omm

    e = elements(spark, sf_dir).withColumn("object_id", tle.object_id(F.col("line1"))).withColumn("object_name", F.lit("1998-067A"))
    o = omm(e)
    return o.select("OBJECT_NAME", "OBJECT_ID", "EPOCH", F.round("MEAN_MOTION", 8).alias("MEAN_MOTION"), F.round("ECCENTRICITY", 7).alias("ECCENTRICITY"), F.round("INCLINATION", 4).alias("INCLINATION"), "NORAD_CAT_ID", "ELEMENT_SET_NO", "REV_AT_EPOCH")


@query("SELECT o_orderkey, CASE WHEN yy < 57 THEN '20' ELSE '19' END || lpad(yy::VARCHAR, 2, '0') || '001A' AS object_id FROM (SELECT o_orderkey, o_orderkey % 100 AS yy FROM orders)")
def object_id_century(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    line = F.concat(F.lit("1 00001U "), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit("001A  "))
    return o.select("o_orderkey", tle.object_id(line).alias("object_id"))


SUN = GEO + f""", s0 AS (SELECT *, jd - 2451545e0 + fr AS sn FROM geo),
s1 AS (SELECT *, radians(357.528::DOUBLE + 0.9856003::DOUBLE * sn) AS sg, radians(23.439::DOUBLE - 4e-7::DOUBLE * sn) AS eps FROM s0),
s2 AS (SELECT *, radians(280.460::DOUBLE + 0.9856474::DOUBLE * sn + 1.915::DOUBLE * sin(sg) + 0.020::DOUBLE * sin(2 * sg)) AS lam,
  (1.00014::DOUBLE - 0.01671::DOUBLE * cos(sg) - 0.00014::DOUBLE * cos(2 * sg)) * 149597870.7::DOUBLE AS au FROM s1),
s3 AS (SELECT *, au * cos(lam) AS sx, au * cos(eps) * sin(lam) AS sy, au * sin(eps) * sin(lam) AS sz FROM s2),
s4 AS (SELECT *, atan2(sy, sx) / {PI} * 12e0 AS ra, y * vz - z * vy AS hx, z * vx - x * vz AS hy, x * vy - y * vx AS hz,
  sx - x AS tx, sy - y AS ty, sz - z AS tz, sqrt(x * x + y * y + z * z) AS rn FROM s3),
s5 AS (SELECT *, sqrt(tx * tx + ty * ty + tz * tz) AS tn, gmst + lon / 15e0 - ra + 12e0 AS lt FROM s4),
sun AS (SELECT *, acos(greatest(-1, least(1, -(x * tx + y * ty + z * tz) / (rn * tn)))) AS apart, asin(least(1, 6371e0 / rn)) AS shade, asin(least(1, 696340e0 / tn)) AS disc FROM s5)
"""


def _sunny(spark, sf_dir):
    d = _geodetic(spark, sf_dir)
    s, ra = fr.sun(F.col("jd"), F.col("fr"))
    return d.withColumns({"sx": s[0], "sy": s[1], "sz": s[2], "ra": ra})


@query(SUN + "SELECT id, CASE WHEN apart >= shade + disc THEN 2 WHEN apart <= shade - disc THEN 0 ELSE 1 END::TINYINT AS sun FROM sun")
def epoch_sunlight(spark, sf_dir):
    """Umbra, penumbra or sunlight at the epoch, on two-body states."""
    return _sunny(spark, sf_dir).select("id", fr.sunlight(_vec("x", "y", "z"), _vec("sx", "sy", "sz")).alias("sun"))


@query(SUN + f"""SELECT id, round(90e0 - acos(greatest(-1, least(1, (hx * sx + hy * sy + hz * sz) / (sqrt(hx * hx + hy * hy + hz * hz) * au)))) * {DEG}, 6) AS beta FROM sun""")
def epoch_beta(spark, sf_dir):
    """The Sun's angle over the orbit's plane at the epoch."""
    beta = fr.beta_angle(_vec("x", "y", "z"), _vec("vx", "vy", "vz"), _vec("sx", "sy", "sz"))
    return _sunny(spark, sf_dir).select("id", F.round(beta, 6).alias("beta"))


@query(SUN + "SELECT id, round(lt - 24e0 * floor(lt / 24e0), 6) AS lst FROM sun")
def epoch_solar_time(spark, sf_dir):
    """Local solar time under the satellite at the epoch."""
    return _sunny(spark, sf_dir).select("id", F.round(fr.local_solar_time(F.col("lon"), F.col("gmst"), F.col("ra")), 6).alias("lst"))


def _field_sql() -> str:
    """The main field of degree 3 by its Legendre functions written out, with coefficients linear in time."""
    from orbitlake.operators.magnetic import MAIN_FIELD

    p = {
        (1, 0): ("c", "-s"), (1, 1): ("s", "c"), (2, 0): ("(3 * c * c - 1) / 2", "-3 * c * s"), (2, 1): ("sqrt(3e0) * c * s", "sqrt(3e0) * (c * c - s * s)"),
        (2, 2): ("sqrt(3e0) / 2 * s * s", "sqrt(3e0) * s * c"), (3, 0): ("(5 * c * c * c - 3 * c) / 2", "-s * (15 * c * c - 3) / 2"),
        (3, 1): ("sqrt(6e0) / 4 * s * (5 * c * c - 1)", "sqrt(6e0) / 4 * (c * (5 * c * c - 1) - 10 * c * s * s)"),
        (3, 2): ("sqrt(15e0) / 2 * s * s * c", "sqrt(15e0) / 2 * (2 * s * c * c - s * s * s)"), (3, 3): ("sqrt(10e0) / 4 * s * s * s", "sqrt(10e0) / 4 * 3 * s * s * c"),
    }
    up, north, east = [], [], []
    for n, m, g0, h0, g1, h1, dg, dh in MAIN_FIELD:
        at = lambda a, b, d: f"(CASE WHEN yr < 2020 THEN {a!r}::DOUBLE + (yr - 2015) / 5e0 * ({b!r}::DOUBLE - {a!r}::DOUBLE) ELSE {b!r}::DOUBLE + (yr - 2020) * {d!r}::DOUBLE END)"
        g, h, ph = at(g0, g1, dg), at(h0, h1, dh), f"{m} * ph"
        gc, hs = f"({g} * cos({ph}) + {h} * sin({ph}))", f"({g} * sin({ph}) - {h} * cos({ph}))"
        a = f"power(6371.2::DOUBLE / rr, {n + 2})"
        up.append(f"{a} * {n + 1} * {gc} * ({p[n, m][0]})")
        north.append(f"{a} * {gc} * ({p[n, m][1]})")
        east.append(f"{a} * {m} * {hs} * ({p[n, m][0]}) / s")
    return GEO + f""", f0 AS (SELECT id, radians(lat) - atan2(z, p) AS turn, sqrt(p * p + z * z) AS rr, z / sqrt(p * p + z * z) AS c, p / sqrt(p * p + z * z) AS s, atan2(ry, rx) AS ph,
  year(epoch) + date_diff('microsecond', make_date(year(epoch), 1, 1)::TIMESTAMP, epoch) / date_diff('microsecond', make_date(year(epoch), 1, 1)::TIMESTAMP, make_date(year(epoch) + 1, 1, 1)::TIMESTAMP)::DOUBLE AS yr FROM geo),
f1 AS (SELECT id, turn, {' + '.join(east)} AS e, {' + '.join(north)} AS n, {' + '.join(up)} AS u FROM f0)
SELECT id, round(e, 4) AS b_east, round(cos(turn) * n - sin(turn) * u, 4) AS b_north, round(cos(turn) * u + sin(turn) * n, 4) AS b_up, round(sqrt(e * e + n * n + u * u), 4) AS b_total FROM f1"""


@query(_field_sql())
def epoch_field(spark, sf_dir):
    """The main field, as far as degree 3, at the places and times of all epochs."""
    from orbitlake.operators.magnetic import with_field

    d = _geodetic(spark, sf_dir).select("id", "epoch", "rx", "ry", F.col("z").alias("rz"), "lat")
    return _rounded(with_field(d, time="epoch"), 4, "b_east", "b_north", "b_up", "b_total")
