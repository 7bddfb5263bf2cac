"""Propagation of samples and the column groups derived from the state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitlake.functions import frames as fr
from orbitlake.kernels import sgp4
from orbitlake.operators import magnetic, timescale

_ELEMENTS = ("mm", "ecc", "inc", "raan", "aop", "ma", "bstar")
_INERTIAL = ("_x", "_y", "_z", "_vx", "_vy", "_vz")
_STATE = ("x", "y", "z", "vx", "vy", "vz")
#: Sites of a request: they are broadcast, and multiply its rows.
SITES_MAX = 10_000
# The names of the groups.
GROUPS = ("eci", "ecef", "lla", "keplerian", "equinoctial", "sunlight", "beta", "lst", "mag_enu", "mag_total", "mag_ecef")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to as many tasks as the session's shuffles have: for few rows with much to compute, which would else stay
    together since they are few bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def with_states(samples: DataFrame, time: str = "t") -> DataFrame:
    """Samples that hold their element columns and epoch, with x, y, z (km), vx, vy, vz (km/s) and err.

    One Arrow kernel a batch and no shuffle; a row that can't be propagated has nulls and its error code.
    """
    names = samples.columns
    jd, frac = fr.jday(F.col("epoch"))
    d = samples.withColumns({"_minutes": F.timestamp_diff("MICROSECOND", F.col("epoch"), F.col(time)) / 60e6, "_epoch_jd": jd + frac})
    out = T.StructType(list(samples.schema) + [T.StructField(c, T.DoubleType()) for c in _STATE] + [T.StructField("err", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(float)
            r, v, err = sgp4.propagate(*(col(c) for c in (*_ELEMENTS, "_minutes", "_epoch_jd")))
            ok = err == 0
            state = np.where(ok[:, None], np.concatenate([r, v], 1), np.nan)
            cols = [b.column(c) for c in names] + [pa.array(state[:, k], from_pandas=True) for k in range(6)] + [pa.array(err)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *_STATE, "err"])

    return d.mapInArrow(run, out)


@dataclass(frozen=True)
class Group:
    """Columns of a request: names of the groups or steps that it needs, what it gives, and how it is added to a frame.

    build(frame, request) returns the frame with the group's columns; those that its needs give are there already.
    """

    needs: tuple[str, ...]
    columns: tuple[str, ...]
    build: Callable[[DataFrame, Request], DataFrame]


@dataclass(frozen=True)
class Request:
    """What generate() was asked for beside the groups."""

    time: str
    coefficients: DataFrame | list[tuple] | None = None
    field_epoch: Column | None = None


#: Groups and the steps between them by name; register() adds others.
REGISTRY: dict[str, Group] = {}


def register(name: str, needs: tuple[str, ...] = (), columns: tuple[str, ...] = (), replace: bool = False):
    """Decorator: add a group that generate() then knows by name."""

    def add(build: Callable[[DataFrame, Request], DataFrame]):
        if name in REGISTRY and not replace:
            raise ValueError(f"there is a group {name!r} already")
        REGISTRY[name] = Group(tuple(needs), tuple(columns), build)
        return build

    return add


def resolved(names: tuple[str, ...]) -> list[str]:
    """The names and all that they need, each once and after what it needs."""
    out: list[str] = []

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise ValueError(f"groups need each other: {' > '.join((*path, name))}")
        if name not in REGISTRY:
            raise ValueError(f"unknown groups {[name]}; one of {sorted(REGISTRY)}")
        if name not in out:
            for n in REGISTRY[name].needs:
                visit(n, (*path, name))
            out.append(name)

    for n in names:
        visit(n, ())
    return out


def _columns(*names: str) -> tuple[Column, ...]:
    return tuple(F.col(c) for c in names)


_FIXED, _MOVING, _SUN = ("rx", "ry", "rz"), ("ux", "uy", "uz"), ("_sx", "_sy", "_sz")


@register("_day", (), ("_jd", "_fr"))
def _add_day(d: DataFrame, q: Request) -> DataFrame:
    jd, frac = fr.jday(F.col(q.time))
    return d.withColumns({"_jd": jd, "_fr": frac})


@register("_sidereal", ("_day",), ("gmst",))
def _add_sidereal(d: DataFrame, q: Request) -> DataFrame:
    part = F.col("_fr") + F.col("_ut1_utc") / 86400.0 if "_ut1_utc" in d.columns else F.col("_fr")
    return d.withColumn("gmst", fr.gmst_hours(F.col("_jd"), part))


@register("_sun", ("_day",), (*_SUN, "_ra"))
def _add_sun(d: DataFrame, q: Request) -> DataFrame:
    s, ra = fr.sun(F.col("_jd"), F.col("_fr"))
    return d.withColumns({**dict(zip(_SUN, s, strict=True)), "_ra": ra})


@register("eci", ("_day",), _INERTIAL)
def _add_eci(d: DataFrame, q: Request) -> DataFrame:
    return fr.with_inertial(d, _columns(*_STATE[:3]), _columns(*_STATE[3:]), F.col("_jd"), F.col("_fr"), _INERTIAL)


@register("ecef", ("_sidereal",), (*_FIXED, *_MOVING))
def _add_ecef(d: DataFrame, q: Request) -> DataFrame:
    r, v = fr.to_ecef(_columns(*_STATE[:3]), _columns(*_STATE[3:]), F.col("gmst"))
    return d.withColumns(dict(zip((*_FIXED, *_MOVING), (*r, *v), strict=True)))


@register("lla", ("ecef",), ("lat", "lon", "alt"))
def _add_lla(d: DataFrame, q: Request) -> DataFrame:
    return fr.with_geodetic(d, _columns(*_FIXED))


@register("keplerian", ("eci",), ("coe",))
def _add_keplerian(d: DataFrame, q: Request) -> DataFrame:
    return fr.with_osculating(d, _columns(*_INERTIAL[:3]), _columns(*_INERTIAL[3:]))


@register("equinoctial", ("keplerian",), ("mee",))
def _add_equinoctial(d: DataFrame, q: Request) -> DataFrame:
    e = fr.equinoctial(*(F.col(f"coe.{c}") for c in ("sma", "ecc", "inc", "raan", "aop", "ta")))
    return d.withColumn("mee", F.struct(*(c.alias(n) for n, c in e.items())))


@register("sunlight", ("_sun",), ("sun",))
def _add_sunlight(d: DataFrame, q: Request) -> DataFrame:
    return d.withColumn("sun", fr.sunlight(_columns(*_STATE[:3]), _columns(*_SUN)))


@register("beta", ("_sun",), ("beta",))
def _add_beta(d: DataFrame, q: Request) -> DataFrame:
    return d.withColumn("beta", fr.beta_angle(_columns(*_STATE[:3]), _columns(*_STATE[3:]), _columns(*_SUN)))


@register("lst", ("lla", "_sun"), ("lst",))
def _add_lst(d: DataFrame, q: Request) -> DataFrame:
    return d.withColumn("lst", fr.local_solar_time(F.col("lon"), F.col("gmst"), F.col("_ra")))


@register("_field", ("lla",), ("b_east", "b_north", "b_up", "b_total"))
def _add_field(d: DataFrame, q: Request) -> DataFrame:
    return magnetic.with_field(d, q.coefficients, q.time, q.field_epoch)


@register("mag_enu", ("_field",), ("b_east", "b_north", "b_up"))
def _add_mag_enu(d: DataFrame, q: Request) -> DataFrame:
    return d


@register("mag_total", ("_field",), ("b_total",))
def _add_mag_total(d: DataFrame, q: Request) -> DataFrame:
    return d


@register("mag_ecef", ("_field",), ("b_x", "b_y", "b_z"))
def _add_mag_ecef(d: DataFrame, q: Request) -> DataFrame:
    b = fr.enu_to_ecef(*_columns("b_east", "b_north", "b_up", "lat", "lon"))
    return d.withColumns(dict(zip(("b_x", "b_y", "b_z"), b, strict=True)))


def generate(
    samples: DataFrame, groups: tuple[str, ...] = GROUPS, sites: DataFrame | None = None, time: str = "t", single: bool = False,
    coefficients: DataFrame | list[tuple] | None = None, field_epoch: Column | None = None, ut1: DataFrame | None = None,
) -> DataFrame:
    """The requested groups of columns for each sample, in the order asked for; with sites, a row for each site.

    eci and the elements are on the equator and equinox of J2000, the rest on those of date. Only what the groups need is computed.
    UT1 is UTC, unless a table of UT1-UTC is given (ut1, as timescale.with_ut1 takes it): then the Earth's rotation goes by
    UT1, and what depends on it is null before the table's first entry. single gives measures as floats of 32 bits. coefficients and field_epoch are those of magnetic.with_field. Groups are those of
    GROUPS and whatever register() has added.
    """
    request, needs = Request(time, coefficients, field_epoch), resolved((*groups, *(("ecef",) if sites is not None else ())))
    d = with_states(samples if ut1 is None else timescale.with_ut1(samples, ut1, time, "_ut1_utc"), time)
    for name in needs:
        d = REGISTRY[name].build(d, request)
    cols = [c for g in dict.fromkeys(groups) for c in REGISTRY[g].columns]
    if sites is not None:
        at = sites.select(F.col("name").alias("site"), F.col("lat").alias("_la"), F.col("lon").alias("_lo"), (F.col("alt") / 1000.0).alias("_al"))
        if at.limit(SITES_MAX + 1).count() > SITES_MAX:
            raise ValueError(f"more than {SITES_MAX} sites: each makes a row of every sample")
        d = d.crossJoin(F.broadcast(at))
        at = fr.site_ecef(F.col("_la"), F.col("_lo"), F.col("_al"))
        rho, rate = fr.range_rate(_columns(*_FIXED), _columns(*_MOVING), at)
        d = d.withColumns({"range": rho, "range_rate": rate, "elevation": fr.elevation(_columns(*_FIXED), at, F.col("_la"), F.col("_lo"))})
        cols += ["site", "range", "range_rate", "elevation"]
    own = [c for c in samples.columns if c not in _ELEMENTS]
    renamed = dict(zip(_INERTIAL, _STATE, strict=True))
    out = d.select(*own, "err", *(F.col(c).alias(renamed.get(c, c)) for c in dict.fromkeys(cols)))
    return float32(out, *own) if single else out


def float32(df: DataFrame, *keep: str) -> DataFrame:
    """With columns of doubles, but for those named, as floats of 32 bits; others as they are."""
    return df.select(*(F.col(f.name).cast("float").alias(f.name) if isinstance(f.dataType, T.DoubleType) and f.name not in keep else F.col(f.name) for f in df.schema))
