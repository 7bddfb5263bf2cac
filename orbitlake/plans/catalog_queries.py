"""The registered queries over the driver's tables, each with its oracle where SQL can express it.

The element-set catalog is made from `events` by whole-number rules, so its text is the same in any engine: the object is
the user, the epoch the event's time in units of 864 microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitlake.functions import tle
from orbitlake.operators import catalog, series, switching

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def element_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, line1, line2 for each event."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    i = F.col("event_id")
    part = F.expr("timestampdiff(MICROSECOND, date_trunc('DAY', ts), ts) div 864")
    ep = F.concat(_pad(F.year("ts") % 100, 2), _pad(F.dayofyear("ts"), 3), F.lit("."), _pad(part, 8))
    inc, raan, ecc = F.col("user_id") * 7907 % 1800000, i * 6367 % 3600000, i * 7919 % 200000
    mm = F.lit(1100000000) + i * 104729 % 450000000
    q = lambda c, d: F.floor(c / d).cast("long")
    deg = lambda c: F.concat(F.lpad(q(c, 10000).cast("string"), 3, " "), F.lit("."), _pad(c % 10000, 4))
    num = _pad(F.col("user_id"), 5)
    l1 = F.concat(F.lit("1 "), num, F.lit("U 98067A   "), ep, F.lit("  .00000000  00000-0  00000-0 0 "), F.lpad((i % 10000).cast("string"), 4, " "), F.lit("0"))
    l2 = F.concat(
        F.lit("2 "), num, F.lit(" "), deg(inc), F.lit(" "), deg(raan), F.lit(" "), _pad(ecc, 7), F.lit(" 090.0000 010.0000 "),
        F.lpad(q(mm, 100000000).cast("string"), 2, " "), F.lit("."), _pad(mm % 100000000, 8), F.lpad((i % 100000).cast("string"), 5, " "), F.lit("0"),
    )
    return e.select(i.alias("id"), "user_id", "ts", l1.alias("line1"), l2.alias("line2"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text and its element columns."""
    t = element_text(spark, sf_dir)
    return t.select("id", "ts", "line1", "line2", *(c.alias(n) for n, c in tle.element_columns(F.col("line1"), F.col("line2")).items()))


#: The same in SQL: lines, and the fields as the rules give them.
CAT = """
WITH raw AS (
  SELECT event_id AS id, user_id, ts, year(ts) % 100 AS yy, dayofyear(ts) AS ddd, (epoch_us(ts) % 86400000000) // 864 AS part,
         user_id * 7907 % 1800000 AS inc_i, event_id * 6367 % 3600000 AS raan_i, event_id * 7919 % 200000 AS ecc_i,
         1100000000 + event_id * 104729 % 450000000 AS mm_i FROM events
), cat AS (
  SELECT id, ts, user_id::INTEGER AS norad, inc_i / 1e4::DOUBLE AS inc, raan_i / 1e4::DOUBLE AS raan, ecc_i / 1e7::DOUBLE AS ecc,
         mm_i / 1e8::DOUBLE AS mm, 90e0::DOUBLE AS aop, 10e0::DOUBLE AS ma, (id % 10000)::INTEGER AS elnum, (id % 100000)::INTEGER AS revnum,
         date_trunc('day', ts) + to_microseconds((part * 864)::BIGINT) AS epoch,
         '1 ' || lpad(user_id::VARCHAR, 5, '0') || 'U 98067A   ' || lpad(yy::VARCHAR, 2, '0') || lpad(ddd::VARCHAR, 3, '0') || '.'
           || lpad(part::VARCHAR, 8, '0') || '  .00000000  00000-0  00000-0 0 ' || lpad((id % 10000)::VARCHAR, 4, ' ') || '0' AS line1,
         '2 ' || lpad(user_id::VARCHAR, 5, '0') || ' ' || lpad((inc_i // 10000)::VARCHAR, 3, ' ') || '.' || lpad((inc_i % 10000)::VARCHAR, 4, '0')
           || ' ' || lpad((raan_i // 10000)::VARCHAR, 3, ' ') || '.' || lpad((raan_i % 10000)::VARCHAR, 4, '0') || ' ' || lpad(ecc_i::VARCHAR, 7, '0')
           || ' 090.0000 010.0000 ' || lpad((mm_i // 100000000)::VARCHAR, 2, ' ') || '.' || lpad((mm_i % 100000000)::VARCHAR, 8, '0')
           || lpad((id % 100000)::VARCHAR, 5, ' ') || '0' AS line2
  FROM raw
), el AS (
  SELECT *, power(398600.4418::DOUBLE / power(mm * 6.283185307179586::DOUBLE / 86400e0, 2), 1e0 / 3e0) AS sma FROM cat
)
"""
MIN, MAX = "TIMESTAMP '1957-01-01'", "TIMESTAMP '2056-12-31 23:59:59.999999'"


@query(CAT + "SELECT id, line1, line2, length(line1) AS n1, length(line2) AS n2 FROM cat")
def read_tle_pairs(spark, sf_dir):
    return element_text(spark, sf_dir).select("id", "line1", "line2", F.length("line1").cast("long").alias("n1"), F.length("line2").cast("long").alias("n2"))


@query(CAT + """, f AS (SELECT id, substr(line1, 19, 14) AS e, substr(line1, 3, 5) AS satnum FROM cat)
SELECT id, satnum, round((2000 + substr(e, 1, 2)::INT) * 1000e0 + substr(e, 3)::DOUBLE, 8) AS epoch_number,
       strftime(make_date(2000 + substr(e, 1, 2)::INT, 1, 1) + (substr(e, 3, 3)::INT - 1), '%Y%m%d') AS epoch_date FROM f""")
def tle_fields(spark, sf_dir):
    l1 = F.col("line1")
    return element_text(spark, sf_dir).select("id", tle.satnum_text(l1).alias("satnum"), F.round(tle.epoch_number(l1), 8).alias("epoch_number"), tle.epoch_date(l1).alias("epoch_date"))


_LETTERS = "'ABCDEFGHJKLMNPQRSTUVWXYZ'"
_ENCODE = f"""CASE WHEN n BETWEEN 0 AND 99999 THEN lpad(n::VARCHAR, 5, '0')
  WHEN n <= 339999 THEN substr({_LETTERS}, (n // 10000 - 9)::INT, 1) || lpad((n % 10000)::VARCHAR, 4, '0') END"""


@query(f"SELECT n, {_ENCODE} AS alpha5 FROM (SELECT o_orderkey * 13 % 400000 AS n FROM orders)")
def alpha5_encode(spark, sf_dir):
    n = F.col("o_orderkey") * 13 % 400000
    return table(spark, sf_dir, "orders").select(n.alias("n"), tle.alpha5(n).alias("alpha5"))


@query(f"""SELECT alpha5, CASE WHEN regexp_matches(alpha5, '^[0-9]+$') THEN alpha5::INT
  ELSE (strpos({_LETTERS}, substr(alpha5, 1, 1)) + 9) * 10000 + substr(alpha5, 2)::INT END::INTEGER AS n
  FROM (SELECT {_ENCODE} AS alpha5 FROM (SELECT o_orderkey * 13 % 340000 AS n FROM orders))""")
def alpha5_decode(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(tle.alpha5(F.col("o_orderkey") * 13 % 340000).alias("alpha5"))
    return t.select("alpha5", tle.from_alpha5(F.col("alpha5")).cast("int").alias("n"))


@query(CAT + "SELECT id, epoch, strftime(epoch, '%Y-%m-%dT%H:%M:%S') AS iso FROM cat")
def tle_epoch_exact(spark, sf_dir):
    e = element_text(spark, sf_dir).select("id", tle.epoch(F.col("line1")).alias("epoch"))
    return e.withColumn("iso", F.date_format("epoch", "yyyy-MM-dd'T'HH:mm:ss"))


@query(CAT + """SELECT id, norad, round(mm, 8) AS mm, round(ecc, 7) AS ecc, round(inc, 4) AS inc, round(raan, 4) AS raan, round(aop, 4) AS aop,
  round(ma, 4) AS ma, 0e0::DOUBLE AS bstar, 0e0::DOUBLE AS ndot, round(sma, 6) AS sma, round(1440e0 / mm, 8) AS period,
  round(sma * (1 - ecc) - 6371e0, 6) AS perigee, round(sma * (1 + ecc) - 6371e0, 6) AS apogee, elnum, revnum FROM el""")
def element_table(spark, sf_dir):
    e = elements(spark, sf_dir)
    return e.select("id", "norad", *(F.round(c, d).alias(c) for c, d in (("mm", 8), ("ecc", 7), ("inc", 4), ("raan", 4), ("aop", 4), ("ma", 4))), "bstar", "ndot", F.round("sma", 6).alias("sma"), F.round("period", 8).alias("period"), F.round("perigee", 6).alias("perigee"), F.round("apogee", 6).alias("apogee"), "elnum", "revnum")


@query(CAT + """SELECT id, norad FROM el WHERE inc BETWEEN 20 AND 140 AND ecc <= 0.015 AND 1440e0 / mm BETWEEN 95 AND 125
  AND sma * (1 - ecc) - 6371e0 >= 300 AND sma * (1 + ecc) - 6371e0 <= 2000 AND revnum >= 100""")
def orbit_filter(spark, sf_dir):
    from orbitlake.operators.filters import orbit_filter as f

    return f(elements(spark, sf_dir), inc=(20, 140), ecc=(None, 0.015), period=(95, 125), perigee=(300, None), apogee=(None, 2000), revnum=(100, None)).select("id", "norad")


@query(CAT + "SELECT id, norad, epoch, sha256(line1 || chr(10) || line2) AS line_hash FROM cat")
def line_hash_dedup(spark, sf_dir):
    c = elements(spark, sf_dir).withColumn("line_hash", tle.line_hash(F.col("line1"), F.col("line2")))
    return catalog.new_rows(c.unionByName(c), None, order=("id",)).select("id", "norad", "epoch", "line_hash")


_PAIRS = f"""
WITH p AS (
  SELECT user_id, event_id, ts, lag(ts) OVER w AS a, lead(ts) OVER w AS b FROM events WHERE event_type = 'purchase'
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), v AS (SELECT * FROM events WHERE event_type = 'view'), win AS (
  SELECT user_id, event_id, ts, {{}} FROM p
)
SELECT v.event_id AS view_id, win.event_id AS purchase_id FROM v JOIN win ON v.user_id = win.user_id AND v.ts >= valid_from AND v.ts < valid_to
"""


def _events(spark, sf_dir, kind):
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("event_id", "user_id", "ts")


def _switch(spark, sf_dir, method):
    held = switching.windows(_events(spark, sf_dir, "purchase"), method, key="user_id", epoch="ts", tie=("event_id",))
    held = held.select("user_id", F.col("event_id").alias("purchase_id"), "valid_from", "valid_to")
    views = _events(spark, sf_dir, "view").withColumnRenamed("event_id", "view_id")
    return switching.assign(views, held, on="user_id", time="ts").select("view_id", "purchase_id")


@query(_PAIRS.format(f"CASE WHEN a IS NULL THEN {MIN} ELSE ts END AS valid_from, coalesce(b, {MAX}) AS valid_to"))
def switch_epoch(spark, sf_dir):
    return _switch(spark, sf_dir, "epoch")


_MID = "{0} + to_microseconds(round_even(date_diff('microsecond', {0}, {1}) / 2.0::DOUBLE, 0)::BIGINT)"


@query(_PAIRS.format(f"coalesce({_MID.format('a', 'ts')}, {MIN}) AS valid_from, coalesce({_MID.format('ts', 'b')}, {MAX}) AS valid_to"))
def switch_midpoint(spark, sf_dir):
    return _switch(spark, sf_dir, "midpoint")


_SPAN = ("2024-01-10", "2024-01-20")


def _span(spark, sf_dir):
    """A third of the way through the events to two thirds."""
    return table(spark, sf_dir, "events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))


_SPAN_SQL = """, b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events), sp AS (
  SELECT lo + to_microseconds((date_diff('microsecond', lo, hi) // 3)::BIGINT) AS start, lo + to_microseconds((date_diff('microsecond', lo, hi) // 3 * 2)::BIGINT) AS stop FROM b)
"""


def _bounds(spark, sf_dir) -> DataFrame:
    third = F.expr("timestampdiff(MICROSECOND, lo, hi) div 3")
    return _span(spark, sf_dir).select(F.timestamp_add("MICROSECOND", third, F.col("lo")).alias("start"), F.timestamp_add("MICROSECOND", third * 2, F.col("lo")).alias("stop"))


def _literals(spark, sf_dir):
    r = _bounds(spark, sf_dir).first()
    return F.lit(r["start"]).cast("timestamp_ntz"), F.lit(r["stop"]).cast("timestamp_ntz")


@query(CAT + _SPAN_SQL + f""", a AS (
  SELECT norad, max(epoch) FILTER (WHERE epoch < start) AS lo, min(epoch) FILTER (WHERE epoch >= stop) AS hi FROM cat, sp GROUP BY norad)
SELECT c.id, c.norad FROM cat c JOIN a ON c.norad = a.norad WHERE c.epoch >= coalesce(lo, {MIN}) AND c.epoch <= coalesce(hi, {MAX})""")
def switch_prefilter(spark, sf_dir):
    start, stop = _literals(spark, sf_dir)
    return switching.prefilter(elements(spark, sf_dir).select("id", "norad", "epoch"), start, stop).select("id", "norad")


_WIN_SQL = f""", w AS (
  SELECT id, norad, epoch, CASE WHEN row_number() OVER o = 1 THEN {MIN} ELSE epoch END AS valid_from, coalesce(lead(epoch) OVER o, {MAX}) AS valid_to
  FROM cat WINDOW o AS (PARTITION BY norad ORDER BY epoch, id))
"""


@query(CAT + _SPAN_SQL + _WIN_SQL + """SELECT id, norad, greatest(start, valid_from) AS sub_start, least(stop, valid_to) AS sub_stop
FROM w, sp WHERE valid_from < stop AND valid_to > start""")
def window_split(spark, sf_dir):
    c = elements(spark, sf_dir).select("id", "norad", "epoch")
    spans = c.select("norad").distinct().crossJoin(F.broadcast(_bounds(spark, sf_dir)))  # one row of bounds
    return switching.split(spans, switching.epoch_windows(c, tie=("id",))).select("id", "norad", "sub_start", "sub_stop")


@query(CAT + _WIN_SQL + """, q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), f AS (
  SELECT w.id, w.norad, min(q.event_id) AS first_asked FROM q JOIN w ON q.user_id = w.norad AND q.ts >= valid_from AND q.ts < valid_to GROUP BY 1, 2)
SELECT f.id, f.first_asked, cat.line1, cat.line2 FROM f JOIN cat ON f.id = cat.id""")
def find_tle_unique(spark, sf_dir):
    c = elements(spark, sf_dir).select("id", "norad", "epoch", "line1", "line2")
    asked = _events(spark, sf_dir, "click").select(F.col("event_id").alias("asked"), F.col("user_id").cast("int").alias("norad"), F.col("ts").alias("t"))
    hit = switching.assign(asked, switching.epoch_windows(c, tie=("id",)))
    return hit.groupBy("id").agg(F.min("asked").alias("first_asked"), F.first("line1").alias("line1"), F.first("line2").alias("line2"))


@query(CAT + """SELECT id, norad, epoch_date FROM (SELECT id, norad, epoch::DATE AS epoch_date,
  row_number() OVER (PARTITION BY norad, epoch::DATE ORDER BY epoch DESC, id DESC) AS n FROM cat) WHERE n = 1""")
def latest_per_object_date(spark, sf_dir):
    c = elements(spark, sf_dir).select("id", "norad", "epoch").withColumn("epoch_date", F.to_date("epoch"))
    return catalog.latest_per_object(c, F.col("epoch_date")).select("id", "norad", "epoch_date")


@query(CAT + _SPAN_SQL + """SELECT id, norad, epoch FROM (SELECT id, norad, epoch, row_number() OVER (PARTITION BY norad ORDER BY epoch DESC, id DESC) AS n
  FROM cat, sp WHERE epoch >= start AND epoch <= stop) WHERE n = 1""")
def boundary_latest(spark, sf_dir):
    start, stop = _literals(spark, sf_dir)
    return catalog.boundary(elements(spark, sf_dir).select("id", "norad", "epoch"), start, stop).select("id", "norad", "epoch")


@query(CAT + _SPAN_SQL + """, c AS (SELECT date_trunc('day', start) + INTERVAL 12 HOUR AS center FROM sp)
SELECT id, norad, epoch FROM (SELECT id, norad, epoch, row_number() OVER (PARTITION BY norad ORDER BY abs(date_diff('microsecond', center, epoch)),
  epoch > center, CASE WHEN epoch > center THEN id ELSE -id END) AS n FROM cat, c WHERE abs(date_diff('microsecond', center, epoch)) <= 10 * 86400000000) WHERE n = 1""")
def nearest_to_noon(spark, sf_dir):
    start, _ = _literals(spark, sf_dir)
    noon = F.timestamp_add("HOUR", F.lit(12), F.date_trunc("DAY", start).cast("timestamp_ntz"))
    return catalog.nearest(elements(spark, sf_dir).select("id", "norad", "epoch"), noon, 10).select("id", "norad", "epoch")


@query("SELECT event_id AS tle_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type IN ('view', 'click'))")
def anti_missing_metadata(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("tle_id"), "user_id", "event_type")
    return catalog.missing_metadata(e.drop("event_type"), e.where(F.col("event_type").isin("view", "click")).select("tle_id"))


@query(CAT + """SELECT cat.id, coalesce(c.c_name, '1998-067A') AS object_name FROM cat LEFT JOIN customer c ON cat.norad = c.c_custkey AND cat.norad % 3 = 0""")
def metadata_coalesce(spark, sf_dir):
    from orbitlake.operators.omm import with_name

    meta = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("norad"), F.col("c_name").alias("object_name")).where("norad % 3 = 0")
    e = elements(spark, sf_dir).select("id", F.col("norad").cast("long").alias("norad"), F.lit("1998-067A").alias("object_id"))
    return with_name(e, meta, "norad").select("id", "object_name")


@query(CAT + """, g AS (SELECT *, date_diff('microsecond', lag(epoch) OVER (PARTITION BY norad ORDER BY epoch, id), epoch) / 86400e6::DOUBLE AS gap FROM cat), s AS (
  SELECT norad, count(*) AS n_sets, count(DISTINCT epoch) AS n_epochs, min(epoch) AS first_epoch, max(epoch) AS last_epoch, round(min(gap), 2) AS min_gap,
         round(max(gap), 2) AS max_gap, round(avg(gap), 2) AS mean_gap, round(median(gap), 2) AS median_gap,
         date_diff('microsecond', min(epoch), max(epoch)) / 86400e6::DOUBLE AS span FROM g GROUP BY norad)
SELECT norad, n_sets, n_epochs, first_epoch, last_epoch, min_gap, max_gap, mean_gap, median_gap, round(span, 2) AS span_days,
       CASE WHEN span > 0 THEN round(n_sets / span, 2) END AS per_day FROM s""")
def summary_per_object(spark, sf_dir):
    return catalog.summary(elements(spark, sf_dir).select("id", "norad", "epoch"))


@query(CAT + """, g AS (SELECT norad, lag(epoch) OVER (PARTITION BY norad ORDER BY epoch, id) AS gap_start, epoch AS gap_end FROM cat)
SELECT *, round(date_diff('microsecond', gap_start, gap_end) / 86400e6::DOUBLE, 2) AS gap_days FROM g
WHERE date_diff('microsecond', gap_start, gap_end) / 86400e6::DOUBLE > 1.0""")
def epoch_gaps(spark, sf_dir):
    return catalog.gaps(elements(spark, sf_dir).select("id", "norad", "epoch"), 1.0)


_DELTA = """WITH d AS (
  SELECT user_id, event_id, ts, value - lag(value) OVER w AS delta, date_diff('microsecond', lag(ts) OVER w, ts) / 86400e6::DOUBLE AS spacing
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), m AS (
  SELECT user_id, count(*) AS n, median(delta) AS m, median(spacing) AS median_spacing FROM d GROUP BY user_id
), s AS (
  SELECT m.user_id, any_value(n) AS n, 1.4826::DOUBLE * median(abs(delta - m)) AS sigma, any_value(median_spacing) AS median_spacing FROM d JOIN m ON d.user_id = m.user_id GROUP BY m.user_id
)"""


def _deltas(spark, sf_dir):
    return series.deltas(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), "user_id", "ts", "value", "event_id")


@query(_DELTA + "SELECT user_id, n, round(sigma, 6) AS sigma, round(median_spacing, 6) AS median_spacing FROM s")
def mad_sigma(spark, sf_dir):
    s = series.mad_sigma(_deltas(spark, sf_dir), "user_id")
    return s.select("user_id", "n", F.round("sigma", 6).alias("sigma"), F.round("median_spacing", 6).alias("median_spacing"))


_CLUSTERS = _DELTA + """, f AS (
  SELECT d.*, median_spacing FROM d JOIN s ON d.user_id = s.user_id WHERE n >= 8 AND sigma >= 1e-12 AND abs(delta) > {k} * sigma
), g AS (
  SELECT *, coalesce(date_diff('microsecond', lag(ts) OVER w, ts) / 86400e6::DOUBLE > greatest(2e0, 5 * median_spacing), true) AS fresh
  FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), c AS (
  SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM g
), r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, cluster ORDER BY abs(delta) DESC, ts, event_id) AS k FROM c
)"""


@query(_CLUSTERS.format(k="1.5") + """SELECT user_id, cluster::BIGINT AS cluster, min(ts) AS cluster_start, count(*) AS n_flags,
  max(ts) FILTER (WHERE k = 1) AS event_time FROM r GROUP BY user_id, cluster""")
def flag_clusters(spark, sf_dir):
    return series.flag_clusters(_deltas(spark, sf_dir), "user_id", "ts", "event_id", 1.5)


@query(_CLUSTERS.format(k="2.0") + "SELECT user_id, ts AS event_time FROM r WHERE k = 1")
def maneuvers(spark, sf_dir):
    return series.flag_clusters(_deltas(spark, sf_dir), "user_id", "ts", "event_id", 2.0).select("user_id", "event_time")


_GROUPS = """WITH b AS (SELECT max(ts) AS stop FROM events), s AS (
  SELECT user_id, event_id, ts, value > 50 AS on_, coalesce((value > 50) <> lag(value > 50) OVER w, true) AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), r AS (
  SELECT *, sum(change::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM s
), g AS (SELECT user_id, run, min(ts) AS start, any_value(on_) AS on_ FROM r GROUP BY 1, 2),
p AS (SELECT user_id, start, coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY run), (SELECT stop FROM b)) AS stop, on_ FROM g),
q AS (SELECT user_id, start, stop FROM p WHERE on_)
"""


def _groups(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("value") > 50).alias("on"))
    stop = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    return series.group_periods(e.withColumnRenamed("on", "state"), "user_id", "ts", "state", "event_id", stop)


@query(_GROUPS + "SELECT * FROM q")
def period_group(spark, sf_dir):
    return _groups(spark, sf_dir)


_CUT = "SELECT user_id, start, stop FROM q WHERE date_trunc('hour', start) = date_trunc('hour', stop)"


@query(_GROUPS + """, h AS (SELECT user_id, start, start + to_microseconds((date_diff('microsecond', start, stop) // 2)::BIGINT) AS stop FROM q
  UNION ALL SELECT user_id, start + to_microseconds((date_diff('microsecond', start, stop) // 2)::BIGINT), stop FROM q),
f AS (SELECT *, coalesce(start <> lag(stop) OVER (PARTITION BY user_id ORDER BY start, stop), true) AS fresh FROM h),
c AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS c FROM f)
SELECT user_id, min(start) AS start, max(stop) AS stop FROM c GROUP BY user_id, c""")
def period_merge(spark, sf_dir):
    p = _groups(spark, sf_dir)
    middle = F.timestamp_add("MICROSECOND", F.expr("timestampdiff(MICROSECOND, start, stop) div 2"), F.col("start"))
    halves = p.select("user_id", "start", middle.alias("stop")).unionByName(p.select("user_id", middle.alias("start"), "stop"))
    return series.merge_periods(halves, "user_id")


@query(_GROUPS + """, lim AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
x AS (SELECT user_id, coalesce(lag(stop) OVER (PARTITION BY user_id ORDER BY start, stop), (SELECT lo FROM lim)) AS a, start AS b FROM q
  UNION ALL SELECT user_id, max(stop), (SELECT hi FROM lim) FROM q GROUP BY user_id)
SELECT user_id, a AS start, b AS stop FROM x WHERE a < b""")
def period_complement(spark, sf_dir):
    r = _span(spark, sf_dir).first()
    lim = [F.lit(r[c]).cast("timestamp_ntz") for c in ("lo", "hi")]
    return series.complement(_groups(spark, sf_dir), "user_id", *lim)


_KIND = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END"


@query(f"""WITH lim AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
e AS (SELECT user_id, event_id, ts, value, {_KIND} AS kind FROM events WHERE event_type IN ('view', 'click', 'purchase')),
s AS (SELECT *, coalesce(sum((kind = 2)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, n, kind ORDER BY ts DESC, event_id DESC) AS r FROM s),
g AS (SELECT user_id, n, max(ts) FILTER (WHERE kind = 0) AS rise, max(ts) FILTER (WHERE kind = 1 AND r = 1) AS top,
  max(value) FILTER (WHERE kind = 1 AND r = 1) AS ele, max(ts) FILTER (WHERE kind = 2) AS down FROM k GROUP BY user_id, n)
SELECT user_id, coalesce(rise, (SELECT lo FROM lim)) AS start, coalesce(down, (SELECT hi FROM lim)) AS stop, coalesce(top, rise, (SELECT lo FROM lim)) AS peak_time, ele AS peak_elevation
FROM g WHERE rise IS NOT NULL OR down IS NOT NULL""")
def rise_set_passes(spark, sf_dir):
    r = _span(spark, sf_dir).first()
    lim = [F.lit(r[c]).cast("timestamp_ntz") for c in ("lo", "hi")]
    kind = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2)
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("time"), kind.alias("kind"), F.col("value").alias("elevation"), F.col("event_id").alias("tie")).where("kind is not null")
    return series.passes(e, "user_id", *lim)


@query(CAT + "SELECT norad, count(*) AS n FROM cat GROUP BY norad")
def object_counts(spark, sf_dir):
    return elements(spark, sf_dir).where("norad is not null").groupBy("norad").agg(F.count("*").alias("n"))


@query(CAT + "SELECT DISTINCT epoch::DATE AS epoch_date FROM cat")
def epoch_dates(spark, sf_dir):
    return elements(spark, sf_dir).select(F.to_date("epoch").alias("epoch_date")).distinct()


@query(CAT + """, b AS (SELECT max(ts) AS hi FROM events), c AS (SELECT *, ts + to_days((id % 40)::INTEGER) AS created FROM cat)
SELECT DISTINCT epoch::DATE AS epoch_date FROM c, b WHERE (epoch::DATE > hi::DATE - 10 AND epoch::DATE <= hi::DATE) OR created >= hi - INTERVAL 7 DAY""")
def incremental_dates(spark, sf_dir):
    hi = F.lit(table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    c = elements(spark, sf_dir).withColumn("created", F.timestamp_add("DAY", (F.col("id") % 40).cast("int"), F.col("ts")))
    return catalog.dates_to_write(c, hi, window_days=10)


@query(CAT + _SPAN_SQL + """, st AS (SELECT norad, max(epoch) AS tail_epoch, (SELECT start FROM sp) AS written_at FROM cat WHERE epoch < (SELECT start FROM sp) AND norad % 5 <> 0 GROUP BY norad),
n AS (SELECT norad, epoch, ts + to_days((id % 3)::INTEGER) AS created FROM cat WHERE id % 4 = 0),
j AS (SELECT n.norad, tail_epoch, n.epoch > tail_epoch AS is_new, NOT (n.epoch > tail_epoch) AND created >= written_at AS late FROM n LEFT JOIN st ON n.norad = st.norad),
g AS (SELECT norad, bool_or(tail_epoch IS NULL) AS absent, bool_or(late) AS late, sum(is_new::INT) AS n_new FROM j GROUP BY norad)
SELECT norad, CASE WHEN absent THEN 'create' WHEN late THEN 'rewrite' WHEN n_new > 0 THEN 'append' ELSE 'keep' END AS action, coalesce(n_new, 0)::BIGINT AS n_new FROM g""")
def emit_action(spark, sf_dir):
    start, _ = _literals(spark, sf_dir)
    c = elements(spark, sf_dir).select("id", "norad", "epoch", "ts")
    state = c.where((F.col("epoch") < start) & (F.col("norad") % 5 != 0)).groupBy("norad").agg(F.max("epoch").alias("tail_epoch")).withColumn("written_at", start)
    new = c.where("id % 4 = 0").select("norad", "epoch", F.timestamp_add("DAY", (F.col("id") % 3).cast("int"), F.col("ts")).alias("created"))
    return catalog.output_actions(new, state)


@query(CAT + """, f AS (SELECT norad, (2 * count(*) - CASE WHEN norad % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS lines FROM cat WHERE norad % 11 <> 0 GROUP BY norad),
r AS (SELECT norad, count(*) AS rows FROM cat GROUP BY norad)
SELECT coalesce(f.norad, r.norad) AS norad, lines, rows, CASE WHEN lines IS NULL THEN 'missing' WHEN rows IS NULL THEN 'orphan' ELSE 'count' END AS problem
FROM f FULL JOIN r ON f.norad = r.norad WHERE lines IS NULL OR rows IS NULL OR lines <> 2 * rows""")
def verify_counts(spark, sf_dir):
    c = elements(spark, sf_dir).select("norad")
    files = c.where("norad % 11 <> 0").groupBy("norad").agg((2 * F.count("*")).alias("lines")).withColumn("lines", F.col("lines") - F.when(F.col("norad") % 7 == 0, 1).otherwise(0))
    return catalog.verify_counts(files, c)


@query(CAT + "SELECT id, row_number() OVER (ORDER BY norad, epoch, id) AS place FROM cat")
def dump_order(spark, sf_dir):
    from orbitlake.sources.text import place_in_order

    return place_in_order(elements(spark, sf_dir).select("id", "norad", "epoch"), "norad", "epoch", "id").select("id", "place")
