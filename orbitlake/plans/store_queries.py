"""Queries of the catalog store, of written files, of revolutions and of plot series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitlake.functions import frames as fr
from orbitlake.functions import tle
from orbitlake.operators import catalog, emit, filters, geometry, propagate, revs, store
from orbitlake.operators.omm import OMM_FIELDS, omm
from orbitlake.plans.catalog_queries import _SPAN_SQL, CAT, _events, _literals, element_text, elements, query, table
from orbitlake.plans.orbit_queries import GEO, STATE, _geodetic, _vec, states
from orbitlake.sources import files, text
from orbitlake.sources.shared import fresh_folder

_STORES: dict = {}


def stored(spark, sf_dir) -> store.Store:
    """A store with all element sets, made once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        s = store.Store(spark, fresh_folder(spark, "store"))
        s.init()
        s.ingest_pairs(element_text(spark, sf_dir))
        _STORES[key] = store.Store.open(spark, s.path)
    return _STORES[key]


@query(CAT + "SELECT line1, line2, count(*) AS n FROM cat GROUP BY line1, line2")
def read_tle_files(spark, sf_dir):
    at = fresh_folder(spark, "text")
    text.write_pairs(element_text(spark, sf_dir).select("line1", "line2"), at, dedup=False)
    return text.read_pairs(spark, at).groupBy("line1", "line2").agg(F.count("*").alias("n"))


@query(CAT + _SPAN_SQL + """SELECT 1::INTEGER AS batch, count(DISTINCT line1 || line2) AS n_new FROM cat, sp WHERE epoch < start
UNION ALL SELECT 2, count(DISTINCT line1 || line2) FROM cat, sp WHERE epoch >= start UNION ALL SELECT 3, 0""")
def ingest_counts(spark, sf_dir):
    """An early part, then all sets twice: only what isn't stored counts."""
    start, _ = _literals(spark, sf_dir)
    s = store.Store(spark, fresh_folder(spark, "store"))
    s.init()
    t = element_text(spark, sf_dir)
    batches = (t.where(tle.epoch(F.col("line1")) < start), t, t)
    return spark.createDataFrame([(k, s.ingest_pairs(b)) for k, b in enumerate(batches, 1)], "batch int, n_new bigint")


@query(CAT + """SELECT 1::INTEGER AS run, 'new' AS status, count(DISTINCT epoch::DATE) AS n, count(DISTINCT line1 || line2) AS n_new FROM cat
UNION ALL SELECT 2, 'skipped', count(DISTINCT epoch::DATE), 0 FROM cat""")
def ingest_folder_status(spark, sf_dir):
    """A folder for each day, whose rows may be in several files, ingested twice: days by the status of their files."""
    at = fresh_folder(spark, "days")
    text.write_pairs(elements(spark, sf_dir).select("line1", "line2", F.to_date("epoch").alias("epoch_date")), at, key="epoch_date")
    s = store.Store(spark, fresh_folder(spark, "store"))
    s.init()
    out = None
    for run in (1, 2):
        states, added = s.ingest_folder(at)
        day = F.regexp_extract("path", "epoch_date=([0-9-]+)", 1)
        counts = store.status_counts(states.select(day, "status").distinct()).select(F.lit(run).alias("run"), "status", "n", F.lit(added).cast("long").alias("n_new"))
        out = counts if out is None else out.unionByName(counts)
    return out


@query(CAT + """SELECT norad, epoch, c_name AS object_name FROM (SELECT DISTINCT norad, epoch, line1, line2 FROM cat) JOIN customer ON norad = c_custkey""")
def named_sets(spark, sf_dir):
    """Messages are ingested for the objects that are customers, then joined with their sets."""
    s = store.Store(spark, fresh_folder(spark, "store"))
    s.init()
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("norad"), F.col("c_name").alias("OBJECT_NAME"))
    e = elements(spark, sf_dir).join(c, "norad")
    s.ingest_messages(e.select(F.col("line1").alias("TLE_LINE1"), F.col("line2").alias("TLE_LINE2"), "OBJECT_NAME", F.col("id").cast("string").alias("GP_ID")))
    return s.named().select("norad", "epoch", "object_name")


@query(CAT + _SPAN_SQL + "SELECT DISTINCT norad, epoch, line1, line2 FROM cat, sp WHERE epoch >= start AND epoch < stop")
def stored_range(spark, sf_dir):
    start, stop = _literals(spark, sf_dir)
    return stored(spark, sf_dir).between(start, stop).select("norad", "epoch", "line1", "line2")


@query(CAT + "SELECT DISTINCT norad, epoch, line1, line2 FROM cat WHERE norad = 1")
def object_sets(spark, sf_dir):
    """The sets of one object."""
    return stored(spark, sf_dir).sets_of(1).select("norad", "epoch", "line1", "line2")


@query(CAT + _SPAN_SQL + """SELECT DISTINCT norad, epoch, line1 FROM el, sp WHERE epoch >= start AND epoch <= stop AND norad IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)
  AND inc BETWEEN 0 AND 179 AND ecc BETWEEN 0 AND 0.0199 AND 1440e0 / mm BETWEEN 90 AND 130 AND sma BETWEEN 6600 AND 8500
  AND sma * (1 - ecc) - 6371e0 BETWEEN 200 AND 1900 AND sma * (1 + ecc) - 6371e0 BETWEEN 250 AND 2100 AND revnum BETWEEN 1 AND 99990""")
def stored_filter(spark, sf_dir):
    """All 17 predicates; on typed columns they reach the scan."""
    start, stop = _literals(spark, sf_dir)
    f = filters.orbit_filter(
        stored(spark, sf_dir).table("sets"), norad=[1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144], epoch=(start, stop), inc=(0, 179), ecc=(0, 0.0199), period=(90, 130),
        sma=(6600, 8500), perigee=(200, 1900), apogee=(250, 2100), revnum=(1, 99990),
    )
    return f.select("norad", "epoch", "line1")


@query(CAT + _SPAN_SQL + """SELECT id, norad, epoch FROM cat, sp WHERE norad > 10 OR (norad = 10 AND epoch > start) ORDER BY norad, epoch, id LIMIT 500""")
def keyset_page(spark, sf_dir):
    """The page of 500 rows after a given key."""
    start, _ = _literals(spark, sf_dir)
    return store.page(elements(spark, sf_dir).select("id", "norad", "epoch"), {"norad": 10, "epoch": start, "id": 2**62}, 500)


@query("""SELECT user_id, ts, event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM (
  SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""")
def first_seen_order(spark, sf_dir):
    return store.first_seen(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id")


@query(CAT + "SELECT norad FROM cat INTERSECT SELECT c_custkey::INTEGER FROM customer")
def objects_known(spark, sf_dir):
    return elements(spark, sf_dir).select("norad").intersect(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("norad")))


@query(CAT + """SELECT epoch_date, line1, line2 FROM (SELECT epoch::DATE AS epoch_date, line1, line2,
  row_number() OVER (PARTITION BY norad, epoch::DATE ORDER BY epoch DESC, id DESC) AS n FROM cat) WHERE n = 1""")
def date_files(spark, sf_dir):
    """What the written files of all days hold."""
    at = fresh_folder(spark, "files")
    emit.write_dates(elements(spark, sf_dir).select("id", "norad", "epoch", "line1", "line2"), at)
    day = F.regexp_extract("path", "epoch_date=([0-9-]+)", 1).cast("date")
    return text.read_pairs(spark, f"{at}/dates").select(day.alias("epoch_date"), "line1", "line2")


def _generated(spark, sf_dir) -> tuple[str, DataFrame, DataFrame]:
    """Files of the sets before an instant, then of all, made once a session: the folder, what the second run did, what the check found."""
    key = (spark.sparkContext.applicationId, sf_dir, "files")
    if key not in _STORES:
        start, _ = _literals(spark, sf_dir)
        at = fresh_folder(spark, "files")
        # both runs read the sets again and again, and making the text is dear: it is made once
        c = emit.kept(elements(spark, sf_dir).select("id", "norad", "epoch", "line1", "line2", F.col("ts").cast("timestamp_ntz").alias("created")))
        emit.generate(c.where(F.col("epoch") < start), at)
        _STORES[key] = (at, *emit.generate(c, at, as_of=start, window_days=5))
    return _STORES[key]


@query(CAT + "SELECT norad, 2 * count(*) AS lines, max(epoch) AS tail_epoch, true AS intact FROM cat GROUP BY norad")
def object_files(spark, sf_dir):
    at, _, problems = _generated(spark, sf_dir)
    return emit.object_files(spark, at).select("norad", "lines", "tail_epoch", "intact").join(problems.select("norad"), "norad", "left_anti")


@query(CAT + _SPAN_SQL + """SELECT norad, CASE WHEN count(*) FILTER (WHERE epoch < start) = 0 THEN 'create' WHEN count(*) FILTER (WHERE epoch >= start) > 0 THEN 'append' ELSE 'keep' END AS action,
  CASE WHEN count(*) FILTER (WHERE epoch < start) = 0 THEN 0 ELSE count(*) FILTER (WHERE epoch >= start) END AS n_new FROM cat, sp GROUP BY norad""")
def generate_actions(spark, sf_dir):
    return _generated(spark, sf_dir)[1]


@query(CAT + """SELECT '1998-067A' AS "OBJECT_NAME", norad::VARCHAR AS "NORAD_CAT_ID", strftime(epoch, '%Y-%m-%dT%H:%M:%S.%f') AS "EPOCH", round(mm, 8) AS "MEAN_MOTION", revnum::VARCHAR AS "REV_AT_EPOCH" FROM cat""")
def omm_csv_files(spark, sf_dir):
    at = fresh_folder(spark, "messages")
    e = elements(spark, sf_dir).withColumn("object_id", tle.object_id(F.col("line1"))).withColumn("object_name", F.lit("1998-067A"))
    store.write_omm_csv(omm(e), at)
    back = files.read_omm(spark, at, "csv")
    assert tuple(back.columns) == OMM_FIELDS
    return back.select("OBJECT_NAME", "NORAD_CAT_ID", "EPOCH", F.round(F.col("MEAN_MOTION").cast("double"), 8).alias("MEAN_MOTION"), "REV_AT_EPOCH")


@query("""WITH s AS (SELECT event_id, ts AS start, event_id % 600 AS d FROM events WHERE event_type = 'purchase')
SELECT event_id, start + to_seconds((k * 60)::INTEGER) AS t FROM (SELECT *, unnest(range(0, ceil(d / 60.0)::BIGINT + 1)) AS k FROM s)""")
def trace_times(spark, sf_dir):
    e = _events(spark, sf_dir, "purchase").withColumn("start", F.col("ts").cast("timestamp_ntz"))
    spans = e.withColumn("stop", F.timestamp_add("SECOND", (F.col("event_id") % 600).cast("int"), F.col("start")))
    return files.trace_times(spans, 60).select("event_id", "t")


@query(GEO + "SELECT round(avg(alt), 4) AS mean_alt, count(*) AS n FROM geo")
def mean_altitude(spark, sf_dir):
    return geometry.mean_altitude(_geodetic(spark, sf_dir).select("alt"))


@query("SELECT event_id, year(ts)::INTEGER % 100 AS yy, round(dayofyear(ts) + (epoch_us(ts) % 86400000000) / 86400e6::DOUBLE, 9) AS day FROM events")
def epoch_fields(spark, sf_dir):
    yy, day = tle.epoch_fields(F.col("ts").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", yy.cast("int").alias("yy"), F.round(day, 9).alias("day"))


@query("SELECT event_id, date_trunc('second', ts) AS t FROM events")
def wall_clock(spark, sf_dir):
    """Instants written with an offset from UTC, which is dropped."""
    zone = F.element_at(F.array(F.lit("Z"), F.lit("+05:30"), F.lit("-0800"), F.lit("")), (F.col("event_id") % 4 + 1).cast("int"))
    written = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return table(spark, sf_dir, "events").select("event_id", files.wall_clock(written).alias("t"))


_RATE = """(mm + 0.75 * mm * 0.00108262998905::DOUBLE * power(6378.135::DOUBLE / (sma * (1 - ecc * ecc)), 2) * (5 * cos(radians(inc)) * cos(radians(inc)) - 1))"""


@query(CAT + f"""SELECT norad, id, round((5000 - revnum - (aop + ma) / 360e0) / {_RATE}, 5) AS start_days, round((5001 - revnum - (aop + ma) / 360e0) / {_RATE}, 5) AS stop_days
FROM (SELECT *, row_number() OVER (PARTITION BY norad ORDER BY abs(revnum - 5000), epoch, id) AS n FROM el) WHERE n = 1""")
def rev_to_epoch(spark, sf_dir):
    r = revs.rev_bounds(elements(spark, sf_dir), 5000)
    return r.select("norad", "id", F.round("start_days", 5).alias("start_days"), F.round("stop_days", 5).alias("stop_days"))


_AT = CAT + _SPAN_SQL + f""", b2 AS (SELECT el.*, date_diff('microsecond', epoch, start) / 86400e6::DOUBLE AS days,
  row_number() OVER (PARTITION BY norad ORDER BY abs(date_diff('microsecond', epoch, start)), epoch, id) AS n FROM el, sp),
rv AS (SELECT norad, id, revnum + (aop + ma) / 360e0 + {_RATE} * days AS rev FROM b2 WHERE n = 1)
"""


@query(_AT + "SELECT norad, id, round(rev, 5) AS rev FROM rv")
def epoch_to_rev(spark, sf_dir):
    start, _ = _literals(spark, sf_dir)
    return revs.revs_at(elements(spark, sf_dir), start).select("norad", "id", F.round("rev", 5).alias("rev"))


@query(_AT + """SELECT norad, round(miss, 5) AS miss, row_number() OVER (ORDER BY abs(miss), norad) AS place
FROM (SELECT norad, rev - 3000 AS miss FROM rv WHERE abs(floor(rev) - 3000) <= 2000)""")
def rev_match_order(spark, sf_dir):
    start, _ = _literals(spark, sf_dir)
    m = revs.match(elements(spark, sf_dir), 3000, start, 2000.0).select("norad", "miss", F.abs("miss").alias("far"))
    return text.place_in_order(m, "far", "norad").select("norad", F.round("miss", 5).alias("miss"), "place")


@query("""WITH p AS (SELECT event_id, user_id, ts AS start, ts + INTERVAL 90 MINUTE AS stop FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts FROM events WHERE event_type = 'view'),
n AS (SELECT p.event_id, p.start, p.stop, v.ts, abs(date_diff('microsecond', p.start, v.ts)) AS a, abs(date_diff('microsecond', p.stop, v.ts)) AS b
  FROM p LEFT JOIN v ON p.user_id = v.user_id),
r AS (SELECT event_id, start, stop, min(struct_pack(d := a, c := ts)) FILTER (WHERE a <= 86400000000) AS x, min(struct_pack(d := b, c := ts)) FILTER (WHERE b <= 86400000000) AS y
  FROM n GROUP BY event_id, start, stop)
SELECT event_id, coalesce(x.c, start) AS start, coalesce(y.c, stop) AS stop FROM r""")
def rev_refine(spark, sf_dir):
    """Bounds moved to the nearest crossing within a day."""
    p = _events(spark, sf_dir, "purchase").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("start"))
    bounds = p.withColumn("stop", F.timestamp_add("MINUTE", F.lit(90), F.col("start")))
    crossings = _events(spark, sf_dir, "view").select("user_id", F.col("ts").cast("timestamp_ntz").alias("time"))
    return revs.refine(bounds, crossings, "user_id", 86400).select("event_id", "start", "stop")


_SUN = STATE + """, s0 AS (SELECT *, jd - 2451545e0 + fr AS nd FROM g),
s1 AS (SELECT *, radians(357.528::DOUBLE + 0.9856003::DOUBLE * nd) AS sg, radians(23.439::DOUBLE - 4e-7::DOUBLE * nd) AS se FROM s0),
s2 AS (SELECT *, radians(280.460::DOUBLE + 0.9856474::DOUBLE * nd + 1.915::DOUBLE * sin(sg) + 0.020::DOUBLE * sin(2 * sg)) AS sl FROM s1),
s3 AS (SELECT *, degrees(atan2(cos(se) * sin(sl), cos(sl))) / 15e0 AS ra FROM s2),
s4 AS (SELECT *, raan / 15e0 - (ra - 24 * floor(ra / 24e0)) + 12e0 AS lt, raan + aop + ma - gmst * 15e0 + 180e0 AS lo_ FROM s3)
"""


def _with_series(spark, sf_dir):
    s = states(spark, sf_dir)
    _, ra = fr.sun(F.col("jd"), F.col("fr"))
    s = s.withColumn("ra", ra)
    lon = fr.geo_longitude(F.col("raan"), F.col("aop"), F.col("ma"), F.col("gmst"))
    return s.withColumns({"lon": lon, "ltan": fr.node_solar_time(F.col("raan"), F.col("ra"))})


@query(_SUN + "SELECT id, round(lt - 24 * floor(lt / 24e0), 5) AS ltan FROM s4")
def node_solar_time(spark, sf_dir):
    return _with_series(spark, sf_dir).select("id", F.round("ltan", 5).alias("ltan"))


#: Digits of each series.
_SERIES = {"sma": 5, "mm": 8, "ecc": 7, "inc": 4, "raan": 4, "aop": 4, "bstar": 9, "peri": 5, "apo": 5, "revnum": 0, "lon": 5, "ltan": 5}


@query(_SUN + """SELECT id, round(sma, 5) AS sma, round(mm, 8) AS mm, round(ecc, 7) AS ecc, round(inc, 4) AS inc, round(raan, 4) AS raan, round(aop, 4) AS aop, 0e0::DOUBLE AS bstar,
  round(sma * (1 - ecc) - 6371e0, 5) AS peri, round(sma * (1 + ecc) - 6371e0, 5) AS apo, revnum::DOUBLE AS revnum,
  round(lo_ - 360e0 * floor(lo_ / 360e0) - 180e0, 5) AS lon, round(lt - 24 * floor(lt / 24e0), 5) AS ltan FROM s4""")
def plot_series(spark, sf_dir):
    s = geometry.plot_series(_with_series(spark, sf_dir).select("*", F.col("perigee").alias("peri"), F.col("apogee").alias("apo")), tuple(_SERIES), ("id",))
    return s.select("id", *(F.round(c, d).alias(c) for c, d in _SERIES.items()))


@query(STATE + "SELECT id, epoch, round(x, 2)::FLOAT AS x, round(y, 2)::FLOAT AS y, round(z, 2)::FLOAT AS z FROM g")
def states_single(spark, sf_dir):
    s = states(spark, sf_dir).select("id", "epoch", *(F.round(c, 2).alias(c) for c in ("x", "y", "z")))
    return propagate.float32(s, "id", "epoch")


def _inertial_sql() -> str:
    """The turns to J2000 from the same fixed values, one step of SQL each."""
    poly = lambda c: "(" + " + ".join(f"{k!r}::DOUBLE * power(tc, {p})" for p, k in enumerate(c)) + ")"
    arc = f"({fr.PI!r}::DOUBLE / 648000)"
    args = ", ".join(f"radians({poly(c)}) AS d{k}" for k, c in enumerate(fr.DELAUNAY))
    angle = lambda row: "(" + " + ".join(f"{n} * d{k}" for k, n in enumerate(row[:5]) if n) + ")"
    psi = " + ".join(f"({r[5]} + {r[6]!r}::DOUBLE * tc) * sin({angle(r)})" for r in fr.NUTATION)
    eps = " + ".join(f"({r[7]} + {r[8]!r}::DOUBLE * tc) * cos({angle(r)})" for r in fr.NUTATION)
    out = f", n0 AS (SELECT *, {args} FROM g), n1 AS (SELECT *, ({psi}) * 1e-4::DOUBLE * {arc} AS dpsi, ({eps}) * 1e-4::DOUBLE * {arc} AS deps, {poly(fr.OBLIQUITY)} * {arc} AS eb FROM n0)"
    out += ", t0 AS (SELECT *, x AS p0, y AS p1, z AS p2 FROM n1)"
    turns = ((2, "-dpsi * cos(eb)"), (0, "eb + deps"), (2, "dpsi"), (0, "-eb"), (2, f"{poly(fr.Z_ANGLE)} * {arc}"), (1, f"-({poly(fr.THETA)} * {arc})"), (2, f"{poly(fr.ZETA)} * {arc}"))
    for k, (axis, a) in enumerate(turns):
        i, j = (axis + 1) % 3, (axis + 2) % 3
        out += f", t{k + 1} AS (SELECT * REPLACE (cos({a}) * p{i} + sin({a}) * p{j} AS p{i}, cos({a}) * p{j} - sin({a}) * p{i} AS p{j}) FROM t{k})"
    return out


@query(STATE + _inertial_sql() + " SELECT id, round(p0, 4) AS x, round(p1, 4) AS y, round(p2, 4) AS z FROM t7")
def inertial_state(spark, sf_dir):
    s = fr.with_inertial(states(spark, sf_dir), _vec("x", "y", "z"), _vec("vx", "vy", "vz"), F.col("jd"), F.col("fr"), ("gx", "gy", "gz", "gu", "gv", "gw"))
    return s.select("id", *(F.round(f"g{c}", 4).alias(c) for c in "xyz"))


@query(CAT + _SPAN_SQL + """SELECT id, norad, epoch FROM (SELECT id, norad, epoch, row_number() OVER (PARTITION BY norad ORDER BY epoch, id) AS n
  FROM cat, sp WHERE epoch >= start AND epoch <= stop) WHERE n = 1""")
def boundary_earliest(spark, sf_dir):
    start, stop = _literals(spark, sf_dir)
    return catalog.boundary(elements(spark, sf_dir).select("id", "norad", "epoch"), start, stop, latest=False).select("id", "norad", "epoch")
