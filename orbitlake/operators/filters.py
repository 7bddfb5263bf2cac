"""Range predicates on element columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orbit_filter(sets: DataFrame, norad: list[int] | None = None, **ranges: tuple) -> DataFrame:
    """Rows within every given (least, greatest) range, both included; None leaves a side open.

    Ranges go by column: epoch, inc, ecc, period, sma, perigee, apogee, revnum. Rows without a value don't pass a range on it.
    A range of epochs is one of days too where sets have epoch_date, as those of the store, so that other days aren't read.
    """
    known = ("epoch", "inc", "ecc", "period", "sma", "perigee", "apogee", "revnum")
    if bad := [c for c in ranges if c not in known]:
        raise ValueError(f"unknown ranges {bad}; one of {known}")
    out = sets if norad is None else sets.where(F.col("norad").isin(norad))
    if "epoch_date" in sets.columns and "epoch" in ranges:
        day = lambda x: None if x is None else F.to_date(x if isinstance(x, Column) else F.lit(x))
        ranges = {"epoch_date": tuple(map(day, ranges["epoch"]))} | ranges
    for c, (lo, hi) in ranges.items():
        if lo is not None:
            out = out.where(F.col(c) >= lo)
        if hi is not None:
            out = out.where(F.col(c) <= hi)
    return out
