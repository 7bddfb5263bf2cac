"""The command line: `python -m orbitlake.cli COMMAND`. Exit codes: 1 no result, 2 usage, 3 a store that isn't there."""

from __future__ import annotations

import argparse
import re
import sys
from collections.abc import Iterator
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitlake.operators import catalog, emit, filters, propagate, revs, series, switching
from orbitlake.operators.store import Store, load_sets
from orbitlake.settings import settings
from orbitlake.sources import files

NO_RESULT, USAGE, NO_STORE = 1, 2, 3
_RANGES = ("inc", "ecc", "period", "sma", "perigee", "apogee", "revnum")


def target(value: str) -> date | int:
    """Eight digits are a date, anything else is a catalog number in digits or five characters."""
    if re.fullmatch(r"[0-9]{8}", value):
        return datetime.strptime(value, "%Y%m%d").date()
    return files.to_satnum(value)


def _cell(c: str, kind: T.DataType) -> Column:
    """Text of a value; floats without the zeros that end them, null as empty text."""
    out = F.col(c).cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        out = F.regexp_replace(F.regexp_replace(F.format_string("%.6g", c), r"(\.[0-9]*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    return F.when(F.col(c).isNull(), "").otherwise(out)


def lines(rows: DataFrame, delimiter: str | None = None, header: bool = False) -> Iterator[str]:
    """Rows as text: split by a delimiter, or in columns as wide as their widest value, numbers to the right.

    Rows are streamed. Floats take six digits; widths come from one aggregation.
    """
    fields = rows.schema.fields
    shown = rows.select(*(_cell(f.name, f.dataType).alias(f.name) for f in fields))
    if delimiter is not None:
        if header:
            yield delimiter.join(rows.columns)
        for r in shown.toLocalIterator():
            yield delimiter.join(r)
        return
    widest = shown.agg(*(F.max(F.length(c)).alias(c) for c in shown.columns)).first()
    size = [max(widest[c] or 0, len(c) if header else 0) for c in shown.columns]
    right = [isinstance(f.dataType, T.NumericType) for f in fields]
    fit = lambda row: " ".join(x.rjust(n) if r else x.ljust(n) for x, n, r in zip(row, size, right, strict=True)).rstrip()
    if header:
        yield fit(rows.columns)
    for r in shown.toLocalIterator():
        yield fit(r)


def _show(rows: DataFrame, a: argparse.Namespace) -> int:
    n = 0
    for n, line in enumerate(lines(rows, getattr(a, "delimiter", None), getattr(a, "header", False)), 1):
        print(line)
    return 0 if n > bool(getattr(a, "header", False)) else NO_RESULT


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _sets(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Sets of a file or folder, of an id in the folder of sets, or else of the store."""
    held = settings()
    return load_sets(spark, a.sets, held["sets"][0], held["store"][0])


def _instants(spark: SparkSession, values: list[str]) -> DataFrame:
    """Instants of the arguments, or of standard input for '-'; those that can't be read are named and skipped."""
    good = []
    for v in sys.stdin.read().split("\n") if values == ["-"] else values:
        try:
            good.append((datetime.fromisoformat(v.strip()).replace(tzinfo=None),)) if v.strip() else None
        except ValueError:
            print(f"skipped, no instant: {v}", file=sys.stderr)
    return spark.createDataFrame(good, "t timestamp_ntz")


def _held(sets: DataFrame, times: DataFrame, method: str) -> DataFrame:
    samples = times.crossJoin(F.broadcast(sets.select("norad").distinct()))  # object numbers have five characters, so they are few
    return switching.assign(samples, switching.windows(sets, method, tie=("line_hash",)))


def inspect(spark: SparkSession, a: argparse.Namespace) -> int:
    s = _sets(spark, a)
    few = ["norad", "object_id", "epoch", "mm", "ecc", "inc", "raan", "aop", "ma", "bstar", "period", "perigee", "apogee"]
    columns = a.columns.split(",") if a.columns else few + (["ndot", "sma", "revnum"] if a.all else [])
    if bad := [c for c in columns if c not in s.columns]:
        raise ValueError(f"unknown columns {', '.join(bad)}")
    return _show(s.orderBy("norad", "epoch", "line_hash").select(*columns), a)


def find_tle(spark: SparkSession, a: argparse.Namespace) -> int:
    hit = _held(_sets(spark, a), _instants(spark, a.times), a.method)
    if a.unique:
        hit = hit.groupBy("norad", "line1", "line2").agg(F.min("t").alias("t"))
    return _show(hit.orderBy("t", "norad").select(F.concat_ws("\n", "line1", "line2").alias("set")), a)


def revnum(spark: SparkSession, a: argparse.Namespace) -> int:
    s, value = _sets(spark, a), revs.rev_or_time(a.value)
    tie = ("epoch", "line_hash")
    if isinstance(value, int):
        if a.at:
            s = s.withColumnRenamed("line_hash", "id")
            return _show(revs.match(s, value, F.lit(a.at).cast("timestamp_ntz"), a.tolerance).orderBy(F.abs("miss"), "norad").select("norad", "object_id", "rev", "miss", "days"), a)
        b = revs.rev_bounds(s, value, tie=tie)
        at = lambda c: F.timestamp_add("MICROSECOND", F.round(F.col(c) * 86400e6).cast("long"), F.col("epoch"))
        return _show(b.select("norad", at("start_days").alias("start"), at("stop_days").alias("stop")).orderBy("norad"), a)
    instant = F.lit(value.replace(tzinfo=None).isoformat(" ")).cast("timestamp_ntz")
    return _show(revs.revs_at(s, instant, tie=tie).select("norad", F.round("rev", 3).alias("rev")).orderBy("norad"), a)


def maneuvers(spark: SparkSession, a: argparse.Namespace) -> int:
    s = _sets(spark, a).select("norad", "epoch", "line_hash", a.field)
    return _show(series.flag_clusters(series.deltas(s, "norad", "epoch", a.field, "line_hash"), "norad", "epoch", "line_hash", a.sigmas).select("norad", "event_time").orderBy("norad", "event_time"), a)


def summary(spark: SparkSession, a: argparse.Namespace) -> int:
    return _show(catalog.summary(_sets(spark, a), tie=("line_hash",)).orderBy("norad"), a)


def filter_(spark: SparkSession, a: argparse.Namespace) -> int:
    ranges = {c: (getattr(a, f"{c}_min"), getattr(a, f"{c}_max")) for c in _RANGES}
    ranges["epoch"] = tuple(None if x is None else F.lit(x).cast("timestamp_ntz") for x in (a.after, a.before))
    numbers = [files.to_satnum(x) for x in a.norad.split(",")] if a.norad else None
    kept = filters.orbit_filter(_sets(spark, a), numbers, **ranges)
    return _show(kept.orderBy("norad", "epoch", "line_hash").select(F.concat_ws("\n", "line1", "line2").alias("set")), a)


def propagate_(spark: SparkSession, a: argparse.Namespace) -> int:
    s = _sets(spark, a)
    names = tuple(a.groups.split(","))
    hit = _held(s, files.times(spark, a.start, a.stop, a.step), a.method).select("norad", "t", "epoch", *(c for c in ("mm", "ecc", "inc", "raan", "aop", "ma", "bstar")))
    out = propagate.generate(hit, names, single=True)
    if a.out:
        if _exists(spark, a.out):
            print(f"{a.out} exists", file=sys.stderr)
            return NO_RESULT
        out.write.parquet(a.out)
        return 0
    return _show(out.select(*(c for c in out.columns if not isinstance(out.schema[c].dataType, T.StructType))).orderBy("norad", "t"), a)


def config(spark: None, a: argparse.Namespace) -> int:
    for name, (value, where) in settings().items():
        print(f"{name} = {value!r} ({where})")
    return 0


def _path(a: argparse.Namespace) -> str:
    if not (at := a.store or settings()["store"][0]):
        raise ValueError("name a store, by --store or in the settings")
    return at


def init(spark: SparkSession, a: argparse.Namespace) -> int:
    for what, names in Store(spark, _path(a)).init(a.drop).items():
        print(f"{what}: {', '.join(names) or '-'}")
    return 0


def ingest(spark: SparkSession, a: argparse.Namespace) -> int:
    s = Store.open(spark, _path(a), readonly=False)
    states, added = s.ingest_folder(a.source, a.force)
    for r in states.groupBy("status").count().orderBy("status").toLocalIterator():
        print(f"{r['status']}: {r['count']}")
    print(f"sets added: {added}")
    return 0


def generate(spark: SparkSession, a: argparse.Namespace) -> int:
    s, held = Store.open(spark, _path(a)), settings()
    sets = s.table("sets").withColumnRenamed("line_hash", "id")
    as_of = None if a.all else F.current_timestamp().cast("timestamp_ntz")
    actions, problems = emit.generate(sets, a.out, as_of, int(held["window_days"][0]), int(held["lookback_days"][0]))
    for r in actions.groupBy("action").count().orderBy("action").toLocalIterator():
        print(f"{r['action']}: {r['count']}")
    bad = problems.count()
    print(f"problems: {bad}")
    return NO_RESULT if bad else 0


def dump(spark: SparkSession, a: argparse.Namespace) -> int:
    print("sets {}, messages {}".format(*Store.open(spark, _path(a)).dump(a.out)))
    return 0


def get_tle(spark: SparkSession, a: argparse.Namespace) -> int:
    """All sets of an object, or of a day the set of each object nearest to noon."""
    s, what = Store.open(spark, _path(a)), target(a.target)
    if isinstance(what, int):
        rows = s.sets_of(what)
    else:
        noon = F.lit(f"{what} 12:00:00").cast("timestamp_ntz")
        around = s.between(F.timestamp_add("DAY", F.lit(-a.days), noon), F.timestamp_add("DAY", F.lit(a.days + 1), noon))
        # the order of ties wants a number
        near = catalog.nearest(around.withColumn("id", F.xxhash64("line_hash").cast("decimal(20)")), noon, a.days)
        rows = near.orderBy("norad")
    return _show(rows.select(F.concat_ws("\n", "line1", "line2").alias("set")), a)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orbitlake")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, run, *words: str, store: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for w in words:
            c.add_argument(w)
        if store:
            c.add_argument("--store")
        return c

    c = add("inspect", inspect, "sets")
    c.add_argument("--all", action="store_true")
    c.add_argument("--header", action="store_true")
    c.add_argument("--columns")
    c.add_argument("-d", "--delimiter")
    c = add("find-tle", find_tle, "sets")
    c.add_argument("times", nargs="+")
    c.add_argument("--method", choices=sorted(switching.STRATEGIES), default="midpoint")
    c.add_argument("--unique", action="store_true")
    c = add("revnum", revnum, "sets", "value")
    c.add_argument("--at")
    c.add_argument("--tolerance", type=float, default=1.0)
    c = add("maneuvers", maneuvers, "sets")
    c.add_argument("--field", default="sma")
    c.add_argument("--sigmas", type=float, default=6.0)
    add("summary", summary, "sets").add_argument("--header", action="store_true")
    c = add("filter", filter_, "sets")
    c.add_argument("--norad")
    c.add_argument("--after")
    c.add_argument("--before")
    for r in _RANGES:
        c.add_argument(f"--{r}-min", type=float)
        c.add_argument(f"--{r}-max", type=float)
    c = add("propagate", propagate_, "sets", "start", "stop")
    c.add_argument("--step", type=float, default=60.0)
    c.add_argument("--groups", default="eci,lla")
    c.add_argument("--method", choices=sorted(switching.STRATEGIES), default="midpoint")
    c.add_argument("--out")
    add("config", config)
    add("init", init, store=True).add_argument("--drop", action="store_true")
    add("ingest", ingest, "source", store=True).add_argument("--force", action="store_true")
    add("generate", generate, "out", store=True).add_argument("--all", action="store_true")
    add("dump", dump, "out", store=True)
    add("get-tle", get_tle, "target", store=True).add_argument("--days", type=int, default=3)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command; errors of the user's are told on standard error, others are raised."""
    a = parser().parse_args(argv)
    if a.run is not config and spark is None:
        from orbitlake.session import local_session

        spark = SparkSession.getActiveSession() or local_session("orbitlake")
    try:
        return a.run(spark, a)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return NO_STORE
    except (ValueError, LookupError) as e:
        print(e, file=sys.stderr)
        return USAGE


if __name__ == "__main__":
    sys.exit(main())
