"""Two-line element text as Column expressions: rendering, parsing, catalog numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the element format and of published gravity models.
ALPHA5 = "ABCDEFGHJKLMNPQRSTUVWXYZ"  # letters of catalog numbers from 100,000; no I, no O
MU = 398600.4418  # km^3/s^2
RE_KM = 6371.0  # mean radius, for altitudes of the element table
RE_DB_KM = 6378.135  # equatorial radius of the older gravity model, for altitudes of the stored table
YEAR_PIVOT = 57  # two-digit years from here on are 19yy
J2 = 0.00108262998905
TWO_PI = 6.283185307179586


def field(line: Column, first: int, size: int) -> Column:
    """Characters of a line by their column, from 1."""
    return F.substring(line, first, size)


def alpha5(n: Column) -> Column:
    """Five characters for 0 to 339,999; null outside."""
    head = (n / 10000).cast("long") - 10
    lettered = F.concat(F.substr(F.lit(ALPHA5), head.cast("int") + 1, F.lit(1)), F.lpad((n % 10000).cast("string"), 4, "0"))
    plain = F.lpad(n.cast("string"), 5, "0")
    return F.when(n.between(0, 99999), plain).when(n.between(100000, 339999), lettered)


def from_alpha5(c: Column) -> Column:
    """The number of five characters; blanks count as zeros; null if they are none."""
    t = F.translate(F.upper(c), " ", "0")
    head = F.instr(F.lit(ALPHA5), F.substring(t, 1, 1)) + 9
    lettered = head * 10000 + F.substring(t, 2, 4).try_cast("int")
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("int")).when(t.rlike(f"^[{ALPHA5}][0-9]{{4}}$"), lettered)


def epoch_text(l1: Column) -> Column:
    return F.translate(field(l1, 19, 14), " ", "0")


def year(l1: Column) -> Column:
    yy = F.substring(epoch_text(l1), 1, 2).try_cast("int")
    return F.when(yy >= YEAR_PIVOT, yy + 1900).otherwise(yy + 2000)


def epoch_number(l1: Column) -> Column:
    """YYYYDDD.f as one float."""
    return year(l1) * 1000.0 + F.substring(epoch_text(l1), 3, 12).try_cast("double")


def epoch_date(l1: Column) -> Column:
    """YYYYMMDD."""
    day = F.substring(epoch_text(l1), 3, 3).try_cast("int")
    return F.date_format(F.date_add(F.make_date(year(l1), F.lit(1), F.lit(1)), day - 1), "yyyyMMdd")


def epoch(l1: Column) -> Column:
    """The exact instant: a unit of the eighth decimal is 864 microseconds."""
    t = epoch_text(l1)
    day, part = F.substring(t, 3, 3).try_cast("int"), F.substring(t, 7, 8).try_cast("long")
    start = F.to_timestamp_ntz(F.date_format(F.date_add(F.make_date(year(l1), F.lit(1), F.lit(1)), day - 1), "yyyy-MM-dd"))
    return F.timestamp_add("MICROSECOND", part * 864, start)


def epoch_fields(t: Column) -> tuple[Column, Column]:
    """The two digits of the year and the day of the year with its fraction, of an instant."""
    part = F.timestamp_diff("MICROSECOND", F.date_trunc("DAY", t).cast("timestamp_ntz"), t)
    return F.year(t) % 100, F.dayofyear(t) + part / 86400e6


def satnum_text(l1: Column) -> Column:
    return F.translate(field(l1, 3, 5), " ", "0")


def number(line: Column, first: int, size: int) -> Column:
    return F.trim(field(line, first, size)).try_cast("double")


def exponent(line: Column, first: int) -> Column:
    """A field of eight with an implied point and a power of ten: ' 10270-3' is 0.10270e-3."""
    t = field(line, first, 8)
    sign = F.when(F.substring(t, 1, 1) == "-", -1.0).otherwise(1.0)
    digits = F.trim(F.substring(t, 2, 5)).try_cast("double")
    return sign * digits * 1e-5 * F.pow(F.lit(10.0), F.trim(F.substring(t, 7, 2)).try_cast("double"))


def object_id(l1: Column) -> Column:
    """International designator with its century; what isn't numeric stays as it is."""
    t = F.trim(field(l1, 10, 8))
    yy = F.substring(t, 1, 2)
    n = yy.try_cast("int")
    return F.when((F.length(t) < 2) | ~yy.rlike("^[0-9]{2}$"), t).when(n < YEAR_PIVOT, F.concat(F.lit("20"), t)).otherwise(F.concat(F.lit("19"), t))


def line_hash(l1: Column, l2: Column) -> Column:
    return F.sha2(F.concat_ws("\n", l1, l2), 256)


def element_columns(l1: Column, l2: Column) -> dict[str, Column]:
    """The element table: mean elements, their shape and the counters."""
    mm = number(l2, 53, 11)
    n = mm * TWO_PI / 86400.0
    sma = F.pow(F.lit(MU) / (n * n), F.lit(1.0 / 3.0))
    ecc = F.concat(F.lit("0."), F.translate(field(l2, 27, 7), " ", "0")).try_cast("double")
    return {
        "norad": from_alpha5(field(l1, 3, 5)),
        "epoch": epoch(l1),
        "mm": mm,
        "ecc": ecc,
        "inc": number(l2, 9, 8),
        "raan": number(l2, 18, 8),
        "aop": number(l2, 35, 8),
        "ma": number(l2, 44, 8),
        "bstar": exponent(l1, 54),
        "ndot": number(l1, 34, 10),
        "nddot": exponent(l1, 45),
        "sma": sma,
        "period": 1440.0 / mm,
        "perigee": sma * (1 - ecc) - RE_KM,
        "apogee": sma * (1 + ecc) - RE_KM,
        "elnum": F.trim(field(l1, 65, 4)).try_cast("int"),
        "revnum": F.trim(field(l2, 64, 5)).try_cast("int"),
    }


def nodal_rate(mm: Column, ecc: Column, inc: Column) -> Column:
    """Revolutions a day between ascending nodes."""
    n = mm * TWO_PI / 86400.0
    p = F.pow(F.lit(MU) / (n * n), F.lit(1.0 / 3.0)) * (1 - ecc * ecc)
    c = F.cos(F.radians(inc))
    return mm + 0.75 * mm * J2 * F.pow(F.lit(RE_DB_KM) / p, F.lit(2.0)) * (5 * c * c - 1)


def rev_phase(aop: Column, ma: Column) -> Column:
    """Share of a revolution since the node at epoch."""
    return F.pmod(aop + ma, F.lit(360.0)) / 360.0
