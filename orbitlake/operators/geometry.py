"""Ground geometry that needs a kernel: visibility rings, closest-approach switching, position from a Doppler curve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitlake.functions import frames as fr
from orbitlake.kernels import geodesic, neldermead, sgp4
from orbitlake.operators import switching
from orbitlake.operators.events import COARSE, SLACK_KM, _cubic, _fixed
from orbitlake.operators.propagate import spread

_ELEMENTS = ("mm", "ecc", "inc", "raan", "aop", "ma", "bstar")
C_A = geodesic.A


def visibility_rings(sites: DataFrame, points: int = 100) -> DataFrame:
    """name, point, lat, lon of the polygon from which a satellite is in view of each site; null where none is.

    sites: name, lat, lon (degrees), alt, sat_alt (metres), min_el (degrees).
    """
    d = sites.select("name", *(F.col(c).cast("double") for c in ("lat", "lon", "alt", "sat_alt", "min_el")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lat, lon, alt, high, least = (c.to_numpy(zero_copy_only=False).astype(float)[:, None] for c in b.columns[1:])
            with np.errstate(all="ignore"):
                eps = np.radians(least)
                arc = (np.arccos((C_A + alt) * np.cos(eps) / (C_A + high)) - eps) * C_A
                ring = geodesic.direct(lat, lon, np.arange(points)[None, :] * 360.0 / points, arc)
            row = pa.array(np.repeat(np.arange(b.num_rows), points))
            numbers = pa.array(np.tile(np.arange(points, dtype=np.int32), b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), numbers, *(pa.array(x.ravel().astype(np.float32), from_pandas=True) for x in ring)], names=["name", "point", "lat", "lon"])

    return d.mapInArrow(run, "name string, point int, lat float, lon float")


def _closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Microseconds after the first epoch when both sets' positions are nearest: one-minute grid, then five seconds."""
    for b in batches:
        gap, jd, *e = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in b.schema.names[1:])
        best = np.round(gap * 5e5)  # the middle, where nothing better is known
        both = sgp4.Sets(*e[:7], jd), sgp4.Sets(*e[7:], jd + gap / 86400)
        apart = lambda row, t: _apart(both, gap[row], row, t)  # noqa: B023, E731
        for at in _runs(np.maximum(2, gap / 60 + 1) * (gap >= 1)):
            k = at[gap[at] >= 1]
            n = np.maximum(2, (gap[k] / 60).astype(int) + 1)
            t, found = _nearest(k, n, gap[k] / (n - 1), _smooth(e[:7], k) & _smooth(e[7:], k), both, gap[k], apart)
            k, t = k[found], t[found]
            lo, hi = np.maximum(0, t - 60), np.minimum(gap[k], t + 60)
            n = np.ceil((hi - lo) / 5 - 1e-9).astype(int) + 1
            rows, t, found = _least(k, n, lambda i, place: np.where(place < n[i] - 1, lo[i] + 5 * place, hi[i]), apart)  # noqa: B023
            best[rows[found]] = np.round(t[found] * 1e6)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best.astype(np.int64))], names=["_id", "_us"])


def _runs(weight: np.ndarray, most: float = 1 << 18) -> Iterator[np.ndarray]:
    """Rows in runs of about so much weight, so that memory is bounded."""
    at = (np.cumsum(weight) // most).astype(int)
    for k in np.unique(at):
        yield np.flatnonzero(at == k)


def _least(rows: np.ndarray, n: np.ndarray, times, value) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows, the time among n of each at which value(rows, times) is least, and whether it is finite anywhere."""
    i = np.repeat(np.arange(len(rows)), n)
    first = np.cumsum(n) - n
    t = times(i, np.arange(len(i)) - first[i])
    v = value(rows[i], t)
    order = np.lexsort((np.arange(len(i)), v, i))
    top = order[first] if len(rows) else order
    return rows, t[top], np.isfinite(v[top])


def _apart(both: tuple, gap: np.ndarray, row: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Distance of the positions by two sets of each row, the second one's epoch gap seconds later."""
    r1, _, e1 = both[0].at(row, t / 60)
    r2, _, e2 = both[1].at(row, (t - gap) / 60)
    return np.where((e1 == 0) & (e2 == 0), np.linalg.norm(r1 - r2, axis=1), np.inf)


def _smooth(e: list, k: np.ndarray) -> np.ndarray:
    """Rows near the Earth and near a circle, whose way between samples a few minutes apart a cubic follows within SLACK_KM."""
    return (e[1][k] < 0.05) & (e[0][k] > 7.0) & (e[0][k] < 17.5) & (e[6][k] == 0)


def _nearest(rows, n, step, smooth, both, gap, apart) -> tuple[np.ndarray, np.ndarray]:
    """The time among n, step seconds apart, at which two sets of each row are nearest, and whether they have states at any.

    Where the ways are smooth, the difference of the positions is propagated at every COARSE-th time; only times at which a
    cubic through these may be the nearest are propagated themselves.
    """
    if not len(rows):
        return np.zeros(0), np.zeros(0, bool)
    i = np.repeat(np.arange(len(rows)), n)
    first = np.cumsum(n) - n
    place = np.arange(len(i)) - first[i]
    ask, m = np.full(len(i), True), -(-(n - 1) // COARSE) + 1
    own, begin = np.repeat(np.arange(len(rows)), m), np.cumsum(m) - m
    t = (np.arange(len(own)) - begin[own]) * COARSE * step[own]
    r1, v1, e1 = both[0].at(rows[own], t / 60)
    r2, v2, e2 = both[1].at(rows[own], (t - gap[own]) / 60)
    r, v = r1 - r2, v1 - v2
    r[(e1 != 0) | (e2 != 0)] = np.nan
    part = np.minimum(place // COARSE, m[i] - 2)
    node, u, hop = begin[i] + part, place / COARSE - part, COARSE * step[i]
    far = np.sqrt(sum(_cubic(r[node, c], r[node + 1, c], v[node, c], v[node + 1, c], u, hop) ** 2 for c in range(3)))
    least = np.fmin.reduceat(far, first)
    with np.errstate(invalid="ignore"):
        ask = ~smooth[i] | ~(far > least[i] + 4 * SLACK_KM)
    value = np.full(len(i), np.inf)
    value[ask] = apart(rows[i[ask]], gap[i[ask]] * place[ask] / (n[i[ask]] - 1))
    lost = np.zeros(len(rows), bool)
    lost[i[ask & ~np.isfinite(value)]] = True  # a state is missing where one was foreseen: all times are asked
    more = lost[i] & ~ask
    value[more] = apart(rows[i[more]], gap[i[more]] * place[more] / (n[i[more]] - 1))
    low = np.minimum.reduceat(value, first)
    hit = np.flatnonzero(value == low[i])
    top = hit[np.searchsorted(i[hit], np.arange(len(rows)))]
    return gap * place[top] / (n - 1), np.isfinite(low)


def tca_windows(sets: DataFrame, key: str = "norad", epoch: str = "epoch", tie: str = "id") -> DataFrame:
    """Each set until it comes nearest to the next one; sets that can't be propagated switch at the midpoint.

    The pairs are rows of neighbours, so the search spreads over tasks whatever the number of objects.
    """
    w = Window.partitionBy(key).orderBy(epoch, tie)
    nxt = sets.select(tie, F.lead(epoch).over(w).alias("_n"), epoch, *_ELEMENTS, *(F.lead(c).over(w).alias(f"_{c}") for c in _ELEMENTS)).where("_n is not null")
    gap = F.timestamp_diff("MICROSECOND", F.col(epoch), F.col("_n")) / 1e6
    jd, frac = fr.jday(F.col(epoch))
    pairs = nxt.select(F.col(tie).alias("_id"), gap.alias("_gap"), (jd + frac).alias("_jd"), *_ELEMENTS, *(f"_{c}" for c in _ELEMENTS))
    at = spread(pairs, "_id").mapInArrow(_closest, "_id long, _us long")
    j = sets.join(at, sets[tie] == at["_id"], "left").withColumn("_stop", F.timestamp_add("MICROSECOND", F.col("_us"), F.col(epoch))).drop("_id", "_us")
    j = j.withColumn("valid_from", F.coalesce(F.lag("_stop").over(w), F.to_timestamp_ntz(F.lit(switching.TIME_MIN))))
    return j.withColumn("valid_to", F.coalesce("_stop", F.to_timestamp_ntz(F.lit(switching.TIME_MAX)))).drop("_stop")


_SOLUTION = "pass_id long, lat double, lon double, scale double, rms double, residuals array<double>, converged boolean"
_SOLVED = pa.schema(
    [("pass_id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("scale", pa.float64()), ("rms", pa.float64()), ("residuals", pa.list_(pa.float64())), ("converged", pa.bool_())]
)
#: Passes that are solved at once, and distances from the ground track (degrees) among which the search begins.
TOGETHER, OFFSETS = 512, (0.5, 2.0, 4.0, 7.0, 10.0, 13.0, 16.0, 19.0, 23.0)
_OMEGA = np.array([0.0, 0.0, fr.EARTH_RATE])


#: Rounds of a search by slopes, degrees within which it is at rest, and degrees that it goes at once.
SLOPE_ROUNDS, REST, FAR_STEP = 60, 1e-6, 3.0


def _moving(e: list, row: np.ndarray, minutes: np.ndarray, jd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Earth-fixed positions (m) and velocities (m/s) of the element sets `row` at minutes from their epochs."""
    r, v, err = sgp4.Sets(*e, jd).at(row, minutes)
    now = jd[row] + minutes / 1440
    fixed = _fixed(r, now)
    speed = _fixed(v, now) - np.cross(_OMEGA, fixed)
    bad = ((err != 0) & (err != 6))[:, None]
    return np.where(bad, np.nan, fixed * 1000), np.where(bad, np.nan, speed * 1000)


def _ground(lat, lon, alt):
    """Earth-fixed metres of places."""
    la, lo = np.radians(lat), np.radians(lon)
    e2 = geodesic.F * (2 - geodesic.F)
    n = geodesic.A / np.sqrt(1 - e2 * np.sin(la) ** 2)
    return np.stack([(n + alt) * np.cos(la) * np.cos(lo), (n + alt) * np.cos(la) * np.sin(lo), (n * (1 - e2) + alt) * np.sin(la)], -1)


def _along(lat, lon, alt):
    """How places move, in metres, with a degree of latitude and one of longitude."""
    la, lo = np.radians(lat), np.radians(lon)
    e2 = geodesic.F * (2 - geodesic.F)
    w = 1 - e2 * np.sin(la) ** 2
    m, n = geodesic.A * (1 - e2) / w**1.5, geodesic.A / np.sqrt(w)
    north = np.stack([-np.sin(la) * np.cos(lo), -np.sin(la) * np.sin(lo), np.cos(la)], -1) * (m + alt)[:, None]
    east = np.stack([-np.sin(lo), np.cos(lo), np.zeros_like(lo)], -1) * ((n + alt) * np.cos(la))[:, None]
    return np.radians(north), np.radians(east)


def _subpoint(fixed):
    """Latitude and longitude under Earth-fixed positions, near enough to begin a search."""
    return np.degrees(np.arctan2(fixed[..., 2], np.hypot(fixed[..., 0], fixed[..., 1]) * (1 - geodesic.F) ** 2)), np.degrees(np.arctan2(fixed[..., 1], fixed[..., 0]))


class Curves:
    """The Doppler curves of some passes side by side: arrays of passes by samples, short ones filled up with empty samples."""

    def __init__(self, minutes: list, seen: list, jd: np.ndarray, alt: np.ndarray, e: list):
        size = np.fromiter(map(len, minutes), int, len(minutes))
        self.mask = np.arange(size.max(initial=1)) < size[:, None]
        row = np.repeat(np.arange(len(size)), size)
        fixed, speed = _moving(e, row, np.concatenate(minutes), jd)
        self.alt, self.size = alt, size
        self.minutes, self.seen = self._filled(np.concatenate(minutes)), self._filled(np.concatenate(seen))
        self.fixed, self.speed = self._filled(fixed), self._filled(speed)
        self.known = np.isfinite(self.fixed).all((1, 2))
        self._axes = [np.ascontiguousarray(x[..., k]) for x in (self.fixed, self.speed) for k in range(3)]

    def _filled(self, flat: np.ndarray) -> np.ndarray:
        out = np.zeros((*self.mask.shape, *flat.shape[1:]))
        out[self.mask] = flat
        return out

    def fit(self, rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scale that fits a place best, and what is left of the curve, for one place of each row."""
        site = _ground(places[:, 0], places[:, 1], self.alt[rows])
        # axis by axis and in place: searches spend their time here; empty samples don't move, so their rate is 0
        rate = far = None
        for k in range(3):
            d = self._axes[k].take(rows, 0)
            d -= site[:, k, None]
            along = self._axes[3 + k].take(rows, 0)
            along *= d
            d *= d
            rate, far = (along, d) if k == 0 else (np.add(rate, along, out=rate), np.add(far, d, out=far))
        rate /= np.sqrt(far, out=far)
        seen = self.seen.take(rows, 0)
        scale = np.multiply(seen, rate, out=far).sum(1) / np.maximum(np.multiply(rate, rate, out=d).sum(1), 1e-30)
        rate *= scale[:, None]
        seen -= rate
        return scale, seen

    def cost(self, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        left = self.fit(rows, places)[1]
        value = np.multiply(left, left, out=left).sum(1)
        return np.where(np.isfinite(value), value, np.inf)

    def turn(self) -> np.ndarray:
        """The sample at which each curve changes sign, else where it is least."""
        change = (np.sign(self.seen[:, 1:]) != np.sign(self.seen[:, :-1])) & self.mask[:, 1:]
        least = np.where(self.mask, np.abs(self.seen), np.inf).argmin(1)
        return np.where(change.any(1), change.argmax(1) if change.shape[1] else 0, least)

    def track(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Latitude and longitude under the satellite at the turn, and the azimuth of the track there."""
        every, k = np.arange(len(self.size)), self.turn()
        lat, lon = _subpoint(self.fixed[every, k])
        a, b = np.maximum(0, k - 1), np.minimum(self.size - 1, k + 1)
        azimuth, _ = geodesic.inverse(*_subpoint(self.fixed[every, a]), *_subpoint(self.fixed[every, b]))
        return lat, lon, azimuth

    def solve(self, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Two places of each row and whether each search came to rest. first: places to begin at, or nulls.

        The search begins at the best of places beside the track, and a second one where the first solution is turned over the track.
        """
        every = np.arange(len(self.size))
        lat, lon, azimuth = self.track()
        start, given = first.copy(), np.isfinite(first).all(1)
        best = np.full(len(every), np.inf)
        k = np.flatnonzero(~given)
        beside = np.array([(side, far * 111_000.0) for side in (-90.0, 90.0) for far in OFFSETS])[:, :, None]
        for place in np.stack(geodesic.direct(lat[k], lon[k], azimuth[k] + beside[:, 0], beside[:, 1]), -1):
            value = self.cost(k, place)
            good = value < best[k]
            start[k[good]], best[k[good]] = place[good], value[good]
        start = np.where(np.isfinite(start).all(1)[:, None], start, np.stack([lat, lon], 1))
        one, ok = self._search(start)
        az, far = geodesic.inverse(lat, lon, one[:, 0], one[:, 1])
        two, ok_two = self._search(np.stack(geodesic.direct(lat, lon, 2 * azimuth - az, far), 1))
        return [(one, ok), (two, ok_two)]

    def slopes(self, rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cost at one place of each row; by a degree of latitude and of longitude, half its slope and the products of the
        curve's derivatives, where the scale follows the place."""
        site, ways = _ground(places[:, 0], places[:, 1], self.alt[rows]), _along(places[:, 0], places[:, 1], self.alt[rows])
        rate, far, near, turn = 0.0, 0.0, [0.0, 0.0], [0.0, 0.0]
        for k in range(3):
            d, v = self._axes[k].take(rows, 0), self._axes[3 + k].take(rows, 0)
            d -= site[:, k, None]
            rate, far = rate + d * v, far + d * d
            for j in (0, 1):
                near[j], turn[j] = near[j] + d * ways[j][:, k, None], turn[j] + v * ways[j][:, k, None]
        far = np.sqrt(far)
        rate /= far
        seen, size = self.seen.take(rows, 0), np.maximum((rate * rate).sum(1), 1e-30)
        scale = (seen * rate).sum(1) / size
        left = seen - scale[:, None] * rate
        by = []
        for j in (0, 1):
            x = (rate * near[j] / far - turn[j]) / far
            by.append(scale[:, None] * (x - rate * ((x * rate).sum(1) / size)[:, None]))
        value = (left * left).sum(1)
        half = np.stack([(x * left).sum(1) for x in by], 1)
        products = np.stack([(by[a] * by[b]).sum(1) for a, b in ((0, 0), (0, 1), (1, 1))], 1)
        return np.where(np.isfinite(value), value, np.inf), half, products

    def _descended(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place where a damped search by slopes (Levenberg and Marquardt) comes to rest, and whether it does."""
        place, ok, damp = start.copy(), np.zeros(len(start), bool), np.full(len(start), 1e-3)
        value, half, products = np.full(len(start), np.inf), np.zeros((len(start), 2)), np.zeros((len(start), 3))
        go = np.flatnonzero(self.known & np.isfinite(start).all(1))
        value[go], half[go], products[go] = self.slopes(go, place[go])
        go = go[np.isfinite(value[go])]
        for _ in range(SLOPE_ROUNDS):
            if not len(go):
                break
            (a, b, c), (x, y) = products[go].T, half[go].T
            a, c = a * (1 + damp[go]), c * (1 + damp[go])
            step = np.stack([c * x - b * y, a * y - b * x], 1) / (a * c - b * b)[:, None]
            step *= np.minimum(1, FAR_STEP / np.abs(step).max(1))[:, None]
            trial = place[go] + step
            new = self.slopes(go, trial)
            better = new[0] < value[go]
            k = go[better]
            place[k], value[k], half[k], products[k] = trial[better], new[0][better], new[1][better], new[2][better]
            # a short step is no rest if damping alone made it short
            ok[go] = (np.abs(step).max(1) <= REST) & (~better | (damp[go] <= 0.01))
            damp[go] = np.clip(np.where(better, damp[go] * 0.1, damp[go] * 10), 1e-9, 1e12)
            go = go[~ok[go]]
        return place, ok

    def _search(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where searches by slopes come to rest; those that don't are made by simplexes."""
        place, ok = self._descended(start)
        again = np.flatnonzero(~ok & self.known)
        if len(again):
            place[again], _, ok[again] = neldermead.minimise_all(lambda k, x: self.cost(again[k], x), start[again], step=1.0)
        place = np.where((self.known & np.isfinite(start).all(1))[:, None], place, start)
        place = np.stack([np.clip(place[:, 0], -90, 90), np.mod(place[:, 1] + 180, 360) - 180], 1)
        return place, ok & self.known


def _measured(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, length (-1: none) and values of lists; a list with a null counts as none."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    first, values = lists.offsets.to_numpy().astype(np.int64), lists.values
    size, known = np.diff(first), lists.is_valid().to_numpy(zero_copy_only=False)
    if values.null_count:
        nulls = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
        known &= nulls[first[1:]] == nulls[first[:-1]]
    return first[:-1], np.where(known, size, -1), values.to_numpy(zero_copy_only=False)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ident, (first, size, minutes), (first_seen, size_seen, seen) = batch.column(0), _measured(batch.column(1)), _measured(batch.column(2))
        jd, alt, lat0, lon0, *e = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[3:])
        whole = (size >= 3) & (size == size_seen) & np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in (batch.column(3), *batch.columns[7:])])
        if not whole.all():  # too few measurements for a place and a scale
            yield pa.RecordBatch.from_pylist([{"pass_id": k, "converged": False} for k in ident.filter(pa.array(~whole)).to_pylist()], schema=_SOLVED)
        rows = np.flatnonzero(whole)
        rows = rows[np.argsort(size[rows], kind="stable")]
        for at in range(0, len(rows), TOGETHER):
            some = rows[at : at + TOGETHER]
            n = size[some]
            row, ends = np.repeat(np.arange(len(some)), n), np.cumsum(n)
            place = np.arange(len(row)) - np.repeat(ends - n, n)
            m, s = minutes[first[some][row] + place], seen[first_seen[some][row] + place]
            order = np.lexsort((m, row))
            m, s = np.split(m[order], ends[:-1]), np.split(s[order], ends[:-1])
            with np.errstate(all="ignore"):
                curves = Curves(m, s, jd[some], np.nan_to_num(alt[some]), [x[some] for x in e])
                every, out = np.arange(len(some)), []
                for place, ok in curves.solve(np.stack([lat0[some], lon0[some]], 1)):
                    scale, left = curves.fit(every, place)
                    out.append((place, scale, np.sqrt((left**2).sum(1) / curves.size), left, ok))
                # both solutions of a pass, the better one first
                turned = out[1][2] < out[0][2]
                both = lambda k: np.stack([np.where(turned.reshape(-1, *[1] * (out[0][k].ndim - 1)), out[1 - j][k], out[j][k]) for j in (0, 1)], 1)  # noqa: B023, E731
                place, scale, rms, left, ok = (both(k).reshape(2 * len(some), *out[0][k].shape[1:]) for k in range(5))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.repeat(n, 2))]).astype(np.int32)), pa.array(left[np.repeat(curves.mask, 2, 0)]))
            columns = (ident.take(pa.array(np.repeat(some, 2))), *map(pa.array, (np.ascontiguousarray(place[:, 0]), np.ascontiguousarray(place[:, 1]), scale, rms)), lists, pa.array(ok))
            yield pa.RecordBatch.from_arrays(list(columns), schema=_SOLVED)


def geolocate_passes(passes: DataFrame) -> DataFrame:
    """Two solutions for each row of passes, best first: pass_id, lat, lon, scale, rms, residuals, converged.

    passes: pass_id, minutes and doppler (arrays of as many measurements, minutes from the epoch), jd of the epoch, the element
    columns, and, if there, alt of the site (m) and lat0, lon0 where the search is to begin. scale is in units of doppler for
    each m/s of range rate; residuals are in the order of time. A pass of fewer than three measurements, or with nulls, has
    one row without a place. Many passes are minimised at once.
    """
    d = lambda c: (F.col(c) if c in passes.columns else F.lit(None)).cast("double").alias(c)
    rows = passes.select(F.col("pass_id").cast("long").alias("pass_id"), *(F.col(c).cast("array<double>").alias(c) for c in ("minutes", "doppler")), *map(d, ("jd", "alt", "lat0", "lon0", *_ELEMENTS)))
    return spread(rows, "pass_id").mapInArrow(_solved, _SOLUTION)


def geolocate(curves: DataFrame) -> DataFrame:
    """The same of single measurements (pass_id, minutes, doppler, jd, element columns), which are collected by pass first: a few minutes' samples."""
    one = [F.first(c).alias(c) for c in curves.columns if c in ("jd", "alt", "lat0", "lon0", *_ELEMENTS)]
    rows = curves.groupBy("pass_id").agg(F.sort_array(F.collect_list(F.struct("minutes", "doppler"))).alias("s"), *one)
    return geolocate_passes(rows.withColumns({"minutes": F.col("s.minutes"), "doppler": F.col("s.doppler")}))


def pass_curves(passes: DataFrame, site: tuple[float, float, float], step_seconds: float = 20.0) -> DataFrame:
    """passes (start, stop, epoch, element columns and any others) with jd, minutes and doppler: the range rate (m/s) that a site
    (latitude, longitude, altitude in km) sees every step_seconds, from start on to stop. Nothing is shuffled."""
    names = passes.columns
    jd, frac = fr.jday(F.col("epoch"))
    minutes = lambda c: F.timestamp_diff("MICROSECOND", F.col("epoch"), F.col(c)) / 60e6
    rows = passes.withColumns({"jd": jd + frac, "_lo": minutes("start"), "_hi": minutes("stop")})
    out = T.StructType([*rows.schema.fields[:-2], T.StructField("minutes", T.ArrayType(T.DoubleType())), T.StructField("doppler", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _ground(site[0], site[1], site[2] * 1000.0)
        for b in batches:
            col = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
            lo, hi = col("_lo"), col("_hi")
            n = np.nan_to_num(np.floor((hi - lo) * 60 / step_seconds) + 1).clip(0).astype(int)
            row = np.repeat(np.arange(len(n)), n)
            t = lo[row] + (np.arange(len(row)) - (np.cumsum(n) - n)[row]) * step_seconds / 60
            with np.errstate(all="ignore"):
                fixed, speed = _moving([col(c) for c in _ELEMENTS], row, t, col("jd"))
                d = fixed - at
                rate = (d * speed).sum(1) / np.sqrt((d * d).sum(1))
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, from_pandas=True)) for x in (t, rate)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*names, "jd"]), *lists], names=[*names, "jd", "minutes", "doppler"])

    return rows.mapInArrow(run, out)


# The series that can be plotted, and panels for kinds of orbits.
SERIES = ("sma", "mm", "ecc", "inc", "raan", "aop", "bstar", "peri", "apo", "revnum", "lon", "ltan")
DEFAULT_SERIES = ("sma", "mm", "ecc", "inc", "raan", "aop")
PRESETS = {
    "leo": ("sma", "mm", "peri", "apo", "inc", "bstar"),
    "geo": ("lon", "mm", "sma", "ecc", "inc"),
    "sunsync": ("ltan", "sma", "mm", "ecc", "inc"),
    "heo": ("peri", "apo", "ecc", "inc", "aop", "mm"),
}


def plot_series(sets: DataFrame, names: str | tuple[str, ...] = DEFAULT_SERIES, keep: tuple[str, ...] = ("norad", "epoch")) -> DataFrame:
    """The named series, or those of a preset, as doubles beside the columns to keep."""
    if isinstance(names, str):
        if names not in PRESETS:
            raise ValueError(f"unknown preset {names!r}; one of {sorted(PRESETS)}")
        names = PRESETS[names]
    if bad := [n for n in names if n not in SERIES]:
        raise ValueError(f"unknown series {bad}; one of {SERIES}")
    return sets.select(*keep, *(F.col(n).cast("double").alias(n) for n in names))


def mean_altitude(traces: DataFrame) -> DataFrame:
    """One row: mean_alt of all points of all traces, and their number."""
    return traces.agg(F.round(F.avg("alt"), 4).alias("mean_alt"), F.count("*").alias("n"))
