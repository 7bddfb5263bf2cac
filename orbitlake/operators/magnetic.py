"""The main magnetic field along positions, from a table of coefficients by epoch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitlake.kernels.field import Model

#: Degrees and rows that a coefficient table may have: it is broadcast, so its size is bounded.
DEGREE_MAX, ROWS_MAX = 40, 100_000
# The published main field (13th generation) up to degree 3, in nT: degree, order, then g and h at 2015 and at
# 2020, and their change a year from 2020 on. The full table is read from a file.
MAIN_FIELD = (
    (1, 0, -29441.46, 0.0, -29404.8, 0.0, 5.7, 0.0),
    (1, 1, -1501.77, 4795.99, -1450.9, 4652.5, 7.4, -25.9),
    (2, 0, -2445.88, 0.0, -2499.6, 0.0, -11.0, 0.0),
    (2, 1, 3012.20, -2845.41, 2982.0, -2991.6, -7.0, -30.2),
    (2, 2, 1676.35, -642.17, 1677.0, -734.6, -2.1, -22.4),
    (3, 0, 1350.33, 0.0, 1363.2, 0.0, 2.2, 0.0),
    (3, 1, -2352.26, -115.29, -2381.2, -82.1, -5.9, 6.0),
    (3, 2, 1225.85, 245.04, 1236.2, 241.9, 3.1, -1.1),
    (3, 3, 581.69, -538.70, 525.7, -543.4, -12.0, 0.5),
)
MAIN_FIELD_ROWS = [
    row for n, m, g0, h0, g1, h1, dg, dh in MAIN_FIELD for row in ((2015.0, n, m, g0, h0), (2020.0, n, m, g1, h1), (2025.0, n, m, g1 + 5 * dg, h1 + 5 * dh))
]


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """epoch, n, m, g, h of a coefficient file in the usual form: a row g or h, degree, order and a number for each epoch.

    The heading is the last line before the rows that has the years; lines before it and lines of # are skipped. A last column
    that isn't a year is the change a year after the last epoch, and makes an epoch five years on.
    """
    w = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).select(F.monotonically_increasing_id().alias("i"), w.alias("w")).where(F.size("w") > 3)
    row = F.lower(F.col("w")[0]).isin("g", "h") & F.col("w")[1].rlike(r"^\d+$")
    years = t.where(~row & ~F.col("w")[0].startswith("#")).agg(F.max_by(F.slice("w", 4, F.size("w") - 3), "i").alias("y"))  # one line
    values = t.where(row).crossJoin(F.broadcast(years)).select(
        F.lower(F.col("w")[0]).alias("k"), F.col("w")[1].cast("int").alias("n"), F.col("w")[2].cast("int").alias("m"), F.slice("w", 4, F.size("w") - 3).cast("array<double>").alias("v"), "y"
    )
    dated = F.filter(F.transform("y", lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    values = values.withColumn("y", dated)
    last, rate = F.col("v")[F.size("y") - 1], F.get("v", F.size("y"))
    more = F.when(rate.isNotNull(), F.array(F.struct((F.array_max("y") + 5).alias("y"), (last + 5 * rate).alias("v")))).otherwise(F.array())
    at = F.concat(F.zip_with("y", F.slice("v", F.lit(1), F.size("y")), lambda a, b: F.struct(a.alias("y"), b.alias("v"))), more)
    long = values.select("k", "n", "m", F.explode(at).alias("a")).select("k", "n", "m", F.col("a.y").alias("epoch"), F.col("a.v").alias("v"))
    one = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("v"))), F.lit(0.0)).alias(k)
    return long.groupBy("epoch", "n", "m").agg(one("g"), one("h"))


def model_of(coefficients: DataFrame | list[tuple] | None) -> Model:
    """The model of a table (epoch in decimal years, n, m, g, h), of such rows, or of the main field's first degrees."""
    rows = MAIN_FIELD_ROWS if coefficients is None else coefficients
    if isinstance(rows, DataFrame):
        rows = [tuple(r) for r in rows.select("epoch", "n", "m", "g", "h").limit(ROWS_MAX + 1).collect()]  # bounded, see below
    top = max((n for _, n, *_ in rows), default=0)
    if len(rows) > ROWS_MAX or not 1 <= top <= DEGREE_MAX:
        raise ValueError(f"{len(rows)} coefficients of degree {top}; at most {ROWS_MAX} of 1 to {DEGREE_MAX} are allowed")
    return Model(rows)


def decimal_year(t: F.Column) -> F.Column:
    first = lambda y: F.make_timestamp_ntz(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    y = F.year(t)
    micros = lambda a, b: F.timestamp_diff("MICROSECOND", a, b)
    return y + micros(first(y), t) / micros(first(y), first(y + 1))


def with_field(states: DataFrame, coefficients: DataFrame | list[tuple] | None = None, time: str = "t", epoch: F.Column | None = None) -> DataFrame:
    """states (rx, ry, rz in km, geodetic lat in degrees, and their time) with b_east, b_north, b_up and b_total on the ellipsoid.

    The coefficients are those of each row's own time, or of `epoch` (a timestamp) for all rows. A row without a position or
    a time has nulls.
    """
    model, names = model_of(coefficients), states.columns
    new = ("b_east", "b_north", "b_up", "b_total")
    at = decimal_year((F.col(time) if epoch is None else epoch).cast("timestamp_ntz"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, z, lat, year = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("rx", "ry", "rz", "lat", "_year"))
            with np.errstate(all="ignore"):
                e, n, u = model.enu(np.stack([x, y, z], 1), lat, year)
                out = [np.where(np.isfinite(year), v, np.nan) for v in (e, n, u, np.sqrt(e * e + n * n + u * u))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(v, from_pandas=True) for v in out)], names=[*names, *new])

    return states.withColumn("_year", at).mapInArrow(run, T.StructType(list(states.schema) + [T.StructField(c, T.DoubleType()) for c in new]))
