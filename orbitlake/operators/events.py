"""Intervals and crossings of a propagated object: a scan at one-minute steps, then bisection to a millisecond.

Each row of spans (elements, start and stop) is scanned by itself, so those of one object spread over tasks; what meets at a
switch is joined after. Passes are also looked for at each elevation maximum between samples; other states that last less
than the step can be missed.

Passes over a site are scanned beyond both ends of each window, so that one which a window cuts has its true rise and set;
where the windows of neighbouring element sets find the same pass, the window that holds its culmination has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitlake.functions import frames as fr
from orbitlake.kernels import sgp4
from orbitlake.operators.propagate import spread

STEP_MINUTES, ROUNDS = 1.0, 17
_ELEMENTS = ("mm", "ecc", "inc", "raan", "aop", "ma", "bstar")
_US = 60e6
_ZERO = "timestamp_ntz'2000-01-01 00:00:00'"


def _sun(jd: np.ndarray) -> np.ndarray:
    n = jd - 2451545.0
    g = np.radians(357.528 + 0.9856003 * n)
    lam = np.radians(280.460 + 0.9856474 * n + 1.915 * np.sin(g) + 0.020 * np.sin(2 * g))
    eps = np.radians(23.439 - 4e-7 * n)
    r = (1.00014 - 0.01671 * np.cos(g) - 0.00014 * np.cos(2 * g)) * fr.AU_KM
    return np.stack([r * np.cos(lam), r * np.cos(eps) * np.sin(lam), r * np.sin(eps) * np.sin(lam)], -1)


def _north(r, v, jd, site):
    return r[:, 2]


def _ascending(r, v, jd, site):
    return v[:, 2]


def _sunlit(r, v, jd, site):
    """Positive outside of the Earth's shadow, penumbra included in it."""
    s = _sun(jd) - r
    rn, sn = np.linalg.norm(r, axis=1), np.linalg.norm(s, axis=1)
    apart = np.arccos(np.clip(-(r * s).sum(1) / (rn * sn), -1, 1))
    return apart - np.arcsin(np.clip(fr.R_EARTH / rn, -1, 1)) - np.arcsin(fr.R_SUN / sn)


def _fixed(r, jd):
    a = sgp4.sidereal(jd)
    return np.stack([np.cos(a) * r[:, 0] + np.sin(a) * r[:, 1], np.cos(a) * r[:, 1] - np.sin(a) * r[:, 0], r[:, 2]], -1)


def _turning(r, v, jd):
    """Earth-fixed positions and speeds a minute."""
    q, w, spin = _fixed(r, jd), _fixed(v, jd), fr.EARTH_RATE * 60.0
    return q, np.stack([w[:, 0] + spin * q[:, 1], w[:, 1] - spin * q[:, 0], w[:, 2]], -1)


def _place(site):
    """Earth-fixed position of a site, the direction up there, and the sine of its least elevation."""
    lat, lon, alt, least = site
    la, lo, e2 = np.radians(lat), np.radians(lon), fr.WGS84_F * (2 - fr.WGS84_F)
    n = fr.WGS84_A / np.sqrt(1 - e2 * np.sin(la) ** 2)
    at = np.array([(n + alt) * np.cos(la) * np.cos(lo), (n + alt) * np.cos(la) * np.sin(lo), (n * (1 - e2) + alt) * np.sin(la)])
    return at, np.array([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)]), np.sin(np.radians(least))


def _elevation(r, v, jd, site):
    """Degrees above the site's horizon, less the least elevation."""
    at, up, _ = _place(site)
    d = _fixed(r, jd) - at
    return np.degrees(np.arcsin(np.clip(d @ up / np.linalg.norm(d, axis=1), -1, 1))) - site[3]


def _golden(value, left, right):
    """Where value(t) is greatest between left and right, by golden sections, to a few milliseconds."""
    lo, hi, g = left.copy(), right.copy(), (5**0.5 - 1) / 2
    one, two = hi - g * (hi - lo), lo + g * (hi - lo)
    if not len(lo):
        return lo
    u, v = value(one), value(two)
    for k in range(32):
        right = u < v
        lo, hi = np.where(right, one, lo), np.where(right, hi, two)
        if k == 31:
            break
        # one of the two points is the other one of the next round
        fresh = np.where(right, lo + g * (hi - lo), hi - g * (hi - lo))
        w = value(fresh)
        one, two = np.where(right, two, fresh), np.where(right, fresh, one)
        u, v = np.where(right, v, w), np.where(right, w, u)
    return (lo + hi) / 2


#: Samples from one that is propagated to the next, and kilometres (by minutes, for speeds; radians, for the Sun) from zero
#: beyond which a rough value's sign is certain.
COARSE, SLACK_KM, SLACK_RATE, SLACK_SUN = 8, 30.0, 6.0, 0.01


def _cubic(p0, p1, v0, v1, u, h):
    """Values between two points with speeds, at the part u of the way, h apart in time."""
    w, d = 1 - u, p1 - p0
    return w * p0 + u * p1 + u * w * (w * (v0 * h - d) - u * (v1 * h - d))


def _slope(p0, p1, v0, v1, u, h):
    """The derivative of that cubic."""
    d = p1 - p0
    a, b = v0 * h - d, v1 * h - d
    return (d + (1 - 2 * u) * ((1 - u) * a - u * b) - u * (1 - u) * (a + b)) / h


_HOP = COARSE * STEP_MINUTES


def _rough_north(p, own, coarse, r, v, node, u):
    z, s = r[:, 2], v[:, 2]
    f = _cubic(z[node], z[node + 1], s[node], s[node + 1], u, _HOP)
    return f, np.abs(f) < SLACK_KM


def _rough_ascending(p, own, coarse, r, v, node, u):
    z, s = r[:, 2], v[:, 2]
    f = _slope(z[node], z[node + 1], s[node], s[node + 1], u, _HOP)
    return f, np.abs(f) < SLACK_RATE


def _rough_sunlit(p, own, coarse, r, v, node, u):
    """The cosine of the widest angle of shadow less that of the angle apart."""
    sun = _sun(p.jd[own] + coarse / 1440.0)
    rr = ss = rs = 0.0
    for c in range(3):
        x = _cubic(r[node, c], r[node + 1, c], v[node, c], v[node + 1, c], u, _HOP)
        y = sun[node, c] + u * (sun[node + 1, c] - sun[node, c]) - x
        rr, ss, rs = rr + x * x, ss + y * y, rs + x * y
    with np.errstate(all="ignore"):
        a, b = np.minimum(1.0, fr.R_EARTH / np.sqrt(rr)), fr.R_SUN / np.sqrt(ss)
        f = np.sqrt(1 - a * a) * np.sqrt(1 - b * b) - a * b + rs / np.sqrt(rr * ss)
    return f, np.abs(f) < SLACK_SUN


def _rough_elevation(p, own, coarse, r, v, node, u):
    """Kilometres above the cone of the least elevation, of Earth-fixed ways. A pass between samples is higher by as much as the way bends in a minute."""
    at, up, least = _place(p.site)
    high = far = 0.0
    for c in range(3):
        d = _cubic(r[node, c], r[node + 1, c], v[node, c], v[node + 1, c], u, _HOP) - at[c]
        high, far = high + d * up[c], far + d * d
    far = np.sqrt(far)
    f = high - far * least
    reach = SLACK_KM + 1.2 * (20.0 + 120_000.0 * abs(least) / np.maximum(far - 500.0, 100.0))
    return f, (f < SLACK_KM) & (f > -np.maximum(SLACK_KM, reach))


#: How far from zero both ends of a hop must be: more than a way can bend in between.
BENDS = {"north": lambda site: 500.0, "ascending": lambda site: 40.0, "sunlit": lambda site: 0.25, "pass": lambda site: 800.0 + 3500.0 * abs(np.sin(np.radians(site[3])))}
ROUGH = {"north": _rough_north, "ascending": _rough_ascending, "sunlit": _rough_sunlit, "pass": _rough_elevation}
KINDS = {"north": _north, "ascending": _ascending, "sunlit": _sunlit, "pass": _elevation}
_NAMES = ["row", "span", "start_us", "stop_us", "peak_us", "peak", "longitude"]
_OUT = "row long, span long, start_us long, stop_us long, peak_us long, peak double, longitude double"
#: Minutes that windows are scanned beyond their ends for passes, points of a pass among which its highest is looked for, and
#: the part of a revolution within which crossings of neighbouring sets at a switch are the same.
PAD, POINTS, NEAR = 100.0, 64, 1 / 32
#: Samples of a piece of a span, and about as many of all that is scanned at once, so that memory is bounded.
PIECE, AT_ONCE = 1440, 1 << 19
#: The part of a revolution within which a pass has one culmination, secants to it, minutes within which they find it.
ONE_TOP, SECANTS, STILL = 0.35, 20, 1e-6
#: Degrees, and parts of what the lower neighbour lacks, that a maximum may be above the parabola through its samples.
LOW = 0.5
#: A satellite so many degrees under the horizon is over 4,000 km away, too far to rise within a step.
FAR_BELOW = -20.0


class _Pieces:
    """Pieces of spans that are scanned at once: columns of elements, epoch, start and stop in minutes from it."""

    def __init__(self, kind: str, invert: bool, site: tuple, row, span, epoch, lo, hi, jd, elements):
        self.kind, self.sign, self.site, self.row = kind, -1.0 if invert else 1.0, site, row
        self.span, self.epoch, self.lo, self.hi, self.jd, self.elements = span, epoch, lo, hi, jd, elements
        self.sets = sgp4.Sets(*elements, jd)

    def state(self, i: np.ndarray, t: np.ndarray):
        """Value, position and Julian date of pieces i at t; a decayed orbit (error 6) has a state, other errors have none."""
        r, v, err = self.sets.at(i, t)
        jd = self.jd[i] + t / 1440.0
        return np.where((err == 0) | (err == 6), self.sign * KINDS[self.kind](r, v, jd, self.site), np.nan), r, jd

    def longitude(self, i: np.ndarray, t: np.ndarray) -> np.ndarray:
        _, r, jd = self.state(i, t)
        xyz = _fixed(r, jd)
        return np.degrees(np.arctan2(xyz[:, 1], xyz[:, 0]))

    def scan(self):
        """Piece, time, direction and whether both sides have states of each crossing in order; states at the ends of pieces."""
        n = np.ceil((self.hi - self.lo) / STEP_MINUTES).astype(int) + 1
        i = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(n) - n
        t = np.minimum(self.lo[i] + (np.arange(len(i)) - first[i]) * STEP_MINUTES, self.hi[i])
        f = self.sampled(i, first, n, t)
        above, same = f > 0, i[:-1] == i[1:]
        a = np.flatnonzero((above[:-1] != above[1:]) & same)
        at, x, y, up = i[a], t[a], t[a + 1], above[a + 1]
        known = np.isfinite(f[a]) & np.isfinite(f[a + 1])
        if self.kind == "pass":
            more = self.between(i, t, f, same)
            at, x, y, up = (np.concatenate([p, q]) for p, q in zip((at, x, y, up), more, strict=True))
            known = np.concatenate([known, np.full(len(more[0]), True)])
        y = self.bisected(at, x, y, up)
        order = np.lexsort((y, at))
        return at[order], y[order], up[order], known[order], above[first], above[first + n - 1]

    def sampled(self, i: np.ndarray, first: np.ndarray, n: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The values at the samples, of which those far from zero may be rough: their sign is certain, and for passes so is
        that no maximum beside them rises above zero.

        Orbits near the Earth and near a circle are propagated at every COARSE-th sample; between these a cubic through
        positions and velocities is within SLACK (a few kilometres, where SLACK is some tens). Samples at which it can't tell
        the side, and all of other orbits, are propagated themselves.
        """
        smooth = (self.elements[1] < 0.05) & (self.elements[0] > 7.0) & (self.elements[0] < 17.5) & (self.elements[6] == 0) & (self.kind != "pass" or self.sign > 0)
        f, doubtful = np.full(len(t), np.nan), ~smooth[i]
        some = np.flatnonzero(smooth)
        if len(some):
            m = -(-(n[some] - 1) // COARSE) + 1
            own, begin = np.repeat(some, m), np.cumsum(m) - m
            coarse = self.lo[own] + (np.arange(len(own)) - np.repeat(begin, m)) * (COARSE * STEP_MINUTES)
            r, v, err = self.sets.at(own, coarse)
            r[(err != 0) & (err != 6)] = np.nan
            v = v * 60.0  # km a minute
            if self.kind == "pass":
                r, v = _turning(r, v, self.jd[own] + coarse / 1440.0)
            # hops whose ends are so far from zero on one side that no way between them bends to it
            every, margin = np.flatnonzero(np.diff(own) == 0), BENDS[self.kind](self.site)
            ends = [ROUGH[self.kind](self, own, coarse, r, v, every, np.full(len(every), u))[0] for u in (0.0, 1.0)]
            side = np.where(np.minimum(*ends) > margin, np.inf, np.where(np.maximum(*ends) < -margin, -np.inf, 0.0))
            hop = np.zeros(len(own))
            hop[every] = side if self.kind != "pass" else np.minimum(side, 0.0)
            begins, last = np.zeros(len(n), int), np.zeros(len(n), int)
            begins[some], last[some] = begin, m - 2
            # samples of such hops are settled, the others are looked at
            place = np.arange(len(t)) - np.repeat(first, n)
            node = np.repeat(begins, n) + np.minimum(place // COARSE, np.repeat(last, n))
            f = np.where(doubtful, np.nan, self.sign * hop[node])
            k = np.flatnonzero(f == 0)
            node = node[k]
            u = (t[k] - self.lo[i[k]]) / (COARSE * STEP_MINUTES) - (node - begins[i[k]])
            f[k], doubt = ROUGH[self.kind](self, own, coarse, r, v, node, u)
            doubtful[k] = doubt | ~np.isfinite(f[k])
            # what is rough and low is no maximum
            f[k] = self.sign * f[k] if self.kind != "pass" else np.where(f[k] < 0, f[k] - 1000.0, f[k])
        if self.kind == "pass":
            # the neighbours of what may be a maximum are compared with it
            low = doubtful & ~(f > 0)
            doubtful[:-1] |= low[1:] & (i[:-1] == i[1:])
            doubtful[1:] |= low[:-1] & (i[:-1] == i[1:])
        k = np.flatnonzero(doubtful)
        f[k] = self.state(i[k], t[k])[0]
        return f

    def bisected(self, at: np.ndarray, x: np.ndarray, y: np.ndarray, up: np.ndarray) -> np.ndarray:
        """What ROUNDS halvings of [x, y] by the side would give as the upper end.

        The root is first put to one of their 2^ROUNDS steps by inverse interpolation, which is kept where the sides of that
        step's ends confirm it; the halvings are then made without states. Where they don't, all are made.
        """
        if not len(at):
            return y
        every, parts = np.arange(len(at)), 1 << ROUNDS
        side = lambda j, t: (self.state(at[j], t)[0] > 0) == up[j]
        with np.errstate(all="ignore"):
            a, b = self.state(at, x)[0], self.state(at, y)[0]
            m = x + (y - x) * a / (a - b)
            m = np.where((m > x) & (m < y), m, (x + y) / 2)
            c = self.state(at, m)[0]
            root = x * b * c / ((a - b) * (a - c)) + m * a * b / ((c - a) * (c - b)) + y * a * c / ((b - a) * (b - c))
            root = np.where((root >= x) & (root <= y), root, m)
            cell = np.floor((root - x) / (y - x) * parts)
        cell = np.clip(np.where(np.isfinite(cell), cell, 0), 0, parts - 1).astype(np.int64)
        time = lambda j, n: x[j] + (y[j] - x[j]) * (n / parts)
        lower, upper = side(every, time(every, cell)), side(every, time(every, cell + 1))
        # the ends of [x, y] have their sides already
        lower, upper = lower & (cell > 0), upper | (cell == parts - 1)
        good = ~lower & upper
        j = np.flatnonzero(lower)  # it lies in a step before: the next one is tried
        cell[j] -= 1
        good[j] = ~side(j, time(j, cell[j])) | (cell[j] == 0)
        j = np.flatnonzero(~lower & ~upper)
        cell[j] += 1
        good[j] = side(j, time(j, cell[j] + 1)) | (cell[j] == parts - 1)
        x, y, bad = x.copy(), y.copy(), np.flatnonzero(~good)
        place = np.full(len(at), 0, np.int64)
        for k in range(ROUNDS):
            m = (x + y) / 2
            middle = place + (parts >> (k + 1))
            right = middle > cell
            if len(bad):
                right[bad] = side(bad, m[bad])
            x, y, place = np.where(right, x, m), np.where(right, m, y), np.where(right, place, middle)
        return y

    def between(self, i, t, f, same):
        """Crossings of passes that rise and set between two samples: piece, before, after, direction."""
        before, after = np.concatenate([[False], same]), np.concatenate([same, [False]])
        with np.errstate(invalid="ignore"):
            top = (f <= 0) & (f + self.site[3] > FAR_BELOW)
            top[1:] &= ~before[1:] | (f[1:] >= f[:-1])
            top[:-1] &= ~after[:-1] | (f[:-1] >= f[1:])
        c = np.flatnonzero(top)
        if self.sign > 0:
            # what the parabola through three samples leaves far below zero doesn't rise
            inner = before[c] & after[c]
            a, z = np.where(inner, c - 1, c), np.where(inner, c + 1, c)
            with np.errstate(all="ignore"):
                one, two = (f[c] - f[a]) / (t[c] - t[a]), (f[z] - f[c]) / (t[z] - t[c])
                slope, bend = (one * (t[z] - t[c]) + two * (t[c] - t[a])) / (t[z] - t[a]), (two - one) / (t[z] - t[a])
                high = f[c] - slope * slope / (4 * bend) + LOW + LOW * (f[c] - np.minimum(f[a], f[z]))
                c = c[~inner | ~(bend < 0) | ~(high < 0)]
        at, left, right = i[c], t[c - before[c]], t[c + after[c]]
        peak = _golden(lambda x: self.state(at, x)[0], left, right)
        ok = (self.state(at, peak)[0] > 0) if len(c) else np.zeros(0, bool)
        at, left, peak, right = at[ok], left[ok], peak[ok], right[ok]
        return np.tile(at, 2), np.concatenate([left, peak]), np.concatenate([peak, right]), np.repeat([True, False], len(at))

    def climb(self, i: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Zero where the elevation of pieces i at t is greatest or least, positive where it grows: its slope without divisors, which
        bends least."""
        r, v, err = self.sets.at(i, t)
        q, w = _turning(r, v * 60.0, self.jd[i] + t / 1440.0)
        at, up, _ = _place(self.site)
        d = q - at
        return np.where((err == 0) | (err == 6), (w @ up) * (d * d).sum(1) - (d @ up) * (d * w).sum(1), np.nan)

    def culminations(self, i: np.ndarray, s: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """When each pass from s to p is highest, to some milliseconds, and how high it is then; nan where that isn't settled here.

        In a small part of a revolution a way near a circle climbs once and sinks once: secants find where it does neither.
        """
        at, top = np.full(len(i), np.nan), np.full(len(i), np.nan)
        e, mm = self.elements[1], self.elements[0]
        k = np.flatnonzero((e[i] < 0.05) & (mm[i] > 7.0) & (mm[i] < 17.5) & (p - s < ONE_TOP * 1440.0 / mm[i]) & (p > s) & (self.sign > 0))
        if not len(k):
            return at, top
        x, y = s[k], p[k]
        a, b = self.climb(i[k], x), self.climb(i[k], y)
        # one that is cut may sink or climb all the time
        out = np.where((a <= 0) & (b < 0), x, np.where((a > 0) & (b >= 0), y, np.nan))
        left = np.flatnonzero((a > 0) & (b < 0))
        x, y, a, b = x[left], y[left], a[left], b[left]
        for _ in range(SECANTS):
            if not len(left):
                break
            with np.errstate(all="ignore"):
                n = y - b * (y - x) / (b - a)
            n = np.where((n >= s[k[left]]) & (n <= p[k[left]]), n, (x + y) / 2)
            out[left] = np.where(np.abs(n - y) < STILL, n, np.nan)
            more = np.isnan(out[left])
            left, x, a, n = left[more], y[more], b[more], n[more]
            y, b = n, self.climb(i[k[left]], n)
        k, n = k[np.isfinite(out)], out[np.isfinite(out)]
        at[k], top[k] = n, self.state(i[k], n)[0]
        return at, top

    def micros(self, i: np.ndarray, t: np.ndarray) -> pa.Array:
        return pa.array(self.epoch[i] + np.round(t * _US).astype(np.int64))

    def highest(self, i: np.ndarray, s: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest of POINTS points of each period, for passes with what is between its neighbours, and its value."""
        fine = s[:, None] + (p - s)[:, None] * np.linspace(0, 1, POINTS)
        g = self.state(np.repeat(i, POINTS), fine.ravel())[0].reshape(fine.shape)
        g = np.where(np.isfinite(g), g, -np.inf)
        best, every = g.argmax(1), np.arange(len(s))
        at, top = fine[every, best], g[every, best]
        if self.kind == "pass":  # between the neighbours of the highest point
            near = _golden(lambda x: self.state(i, x)[0], fine[every, np.maximum(best - 1, 0)], fine[every, np.minimum(best + 1, POINTS - 1)])
            high = self.state(i, near)[0] if len(i) else top
            at, top = np.where(high > top, near, at), np.fmax(high, top)
        return at, top

    def periods(self, peaks: bool = True, longitudes: bool = True) -> pa.RecordBatch:
        at, t, up, _, begins, ends = self.scan()
        one, two = np.flatnonzero(begins), np.flatnonzero(ends)
        i, s = np.concatenate([one, at[up]]), np.concatenate([self.lo[one], t[up]])
        j, p = np.concatenate([at[~up], two]), np.concatenate([t[~up], self.hi[two]])
        order = np.lexsort((s, i))
        i, s = i[order], s[order]
        p = p[np.lexsort((p, j))]
        if not peaks:
            none = pa.nulls(len(i), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(self.row[i]), pa.array(self.span[i]), self.micros(i, s), self.micros(i, p), pa.nulls(len(i), pa.int64()), none, none], names=_NAMES)
        at, top = self.culminations(i, s, p) if self.kind == "pass" else (np.full(len(i), np.nan), np.full(len(i), np.nan))
        k = np.flatnonzero(~np.isfinite(top))
        at[k], top[k] = self.highest(i[k], s[k], p[k])
        place = pa.array(self.longitude(i, s)) if longitudes else pa.nulls(len(i), pa.float64())
        return pa.RecordBatch.from_arrays(
            [pa.array(self.row[i]), pa.array(self.span[i]), self.micros(i, s), self.micros(i, p), self.micros(i, at), pa.array(top), place],
            names=_NAMES,
        )

    def crossings(self) -> pa.RecordBatch:
        """Crossings (edge 0), and on which side each piece begins (edge 1) and ends (edge -1), with the same longitude and time."""
        at, t, up, known, begins, ends = self.scan()
        every = np.arange(len(self.lo))
        i, t = np.concatenate([at[known], every, every]), np.concatenate([t[known], self.lo, self.hi])
        side = np.concatenate([up[known], begins, ends])
        edge = np.repeat(np.array([0, 1, -1], np.int32), [int(known.sum()), len(every), len(every)])
        stated = (edge == 0) | np.isfinite(self.state(i, t)[0])
        i, t, side, edge = i[stated], t[stated], side[stated], edge[stated]
        near = np.round(NEAR * 1440.0 / self.elements[0][i] * _US).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(self.span[i]), self.micros(i, t), pa.array(self.longitude(i, t)), pa.array(side), pa.array(edge), pa.array(near)], names=["span", "time_us", "longitude", "ascending", "edge", "near"])


_CROSSINGS = "span long, time_us long, longitude double, ascending boolean, edge int, near long"


def _scan(kind: str, invert: bool, site: tuple, crossings: bool = False, keep: tuple[str, ...] = (), peaks: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.Table.from_batches([b])
            kept, rows = rows.select([f"_k{n}" for n in range(len(keep))]), rows.drop_columns([f"_k{n}" for n in range(len(keep))])
            known = np.logical_and.reduce([c.is_valid().to_numpy() for c in rows.columns])
            kept, rows = kept.filter(pa.array(known)), rows.filter(pa.array(known))
            row, span, epoch, lo, hi, jd, *e = (rows.column(c).to_numpy() for c in rows.column_names)
            n = np.maximum(0, np.ceil((hi - lo) / PIECE)).astype(int)  # none where stop isn't after start
            i = np.repeat(np.arange(len(n)), n)
            a = lo[i] + PIECE * (np.arange(len(i)) - (np.cumsum(n) - n)[i])
            z = np.minimum(a + PIECE, hi[i])
            full = (np.cumsum(z - a) // AT_ONCE).astype(int)
            for c in (np.flatnonzero(full == k) for k in np.unique(full)):
                o = i[c]
                # the place in this batch instead of the row's number, to find what is kept of it
                piece = _Pieces(kind, invert, site, o if keep else row[o], span[o], epoch[o], a[c], z[c], jd[o], [x[o] for x in e])
                found = piece.crossings() if crossings else piece.periods(peaks, not keep)
                if keep:
                    at = found.column("row")
                    found = pa.RecordBatch.from_arrays([pa.array(row[at.to_numpy()]), *found.columns[1:], *(kept.column(c).take(at).combine_chunks() for c in kept.column_names)], names=[*found.schema.names, *kept.column_names])
                yield found

    return run


def _rows(spans: DataFrame, pad: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    minutes = lambda c: F.timestamp_diff("MICROSECOND", F.col("epoch"), F.col(c)) / _US
    jd, frac = fr.jday(F.col("epoch"))
    epoch = F.timestamp_diff("MICROSECOND", F.expr(_ZERO), F.col("epoch"))
    return spread(spans, "span", "start").select(
        F.xxhash64("span", "start", "stop", "epoch").alias("row"), F.col("span").cast("long").alias("span"), epoch.alias("epoch"), (minutes("start") - pad).alias("lo"), (minutes("stop") + pad).alias("hi"),
        (jd + frac).alias("jd"), *(F.col(c).cast("double") for c in _ELEMENTS), *(F.col(c).alias(f"_k{n}") for n, c in enumerate(keep)),
    )


def _at(c: str):
    return F.timestamp_add("MICROSECOND", F.col(c), F.expr(_ZERO))


def find_periods(spans: DataFrame, kind: str, invert: bool = False, site: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0), peaks: bool = True) -> DataFrame:
    """span, start, stop, peak_time, peak, longitude of the start: when the state holds in each span.

    spans: span (an id), start, stop, epoch and the element columns; a span may have several rows, one for each window of an
    element set, and periods that meet where one row stops and the next starts are one. kind: north, ascending, sunlit or
    pass (elevation over site = latitude, longitude, altitude in km, least elevation); invert gives the complement. A state
    that holds at a span's end is cut there. Without peaks, only span, start and stop are computed and given.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; one of {sorted(KINDS)}")
    found = _rows(spans).mapInArrow(_scan(kind, invert, site, peaks=peaks), _OUT).drop("row")
    w = Window.partitionBy("span").orderBy("start_us", "stop_us")
    found = found.withColumn("_f", F.coalesce(F.col("start_us") != F.lag("stop_us").over(w), F.lit(True)).cast("int"))
    found = found.withColumn("_g", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if not peaks:
        return found.groupBy("span", "_g").agg(F.min("start_us").alias("a"), F.max("stop_us").alias("b")).select("span", _at("a").alias("start"), _at("b").alias("stop"))
    top = F.max(F.struct("peak", -F.col("peak_us"))).alias("_top")
    found = found.groupBy("span", "_g").agg(F.min("start_us").alias("start_us"), F.max("stop_us").alias("stop_us"), top, F.min_by("longitude", "start_us").alias("longitude"))
    found = found.withColumn("peak_us", -F.col("_top.col2"))
    return found.select("span", _at("start_us").alias("start"), _at("stop_us").alias("stop"), _at("peak_us").alias("peak_time"), F.col("_top.peak").alias("peak"), "longitude")


def find_passes(spans: DataFrame, site: tuple[float, float, float, float], keep: tuple[str, ...] = ()) -> DataFrame:
    """span, start, stop, peak_time, peak_elevation and the columns to keep: the passes over a site of each span.

    spans and site are as find_periods takes them. A pass that overlaps a window has its true rise and set, by the window's own
    element set, even where they are outside of the window, up to PAD minutes; beyond, it ends with the window. Passes that
    overlap in a span, as neighbouring windows find one, are one: the one whose own window holds its culmination, or else
    is nearest to it, then the higher; passes longer than that are joined where windows meet. The columns to keep are of that
    window's row.
    """
    rows = _rows(spans.withColumns({"_w0": F.timestamp_diff("MICROSECOND", F.expr(_ZERO), F.col("start")), "_w1": F.timestamp_diff("MICROSECOND", F.expr(_ZERO), F.col("stop"))}).where("start < stop"), PAD, ("_w0", "_w1", *keep))
    own = [f"_k{n}" for n in range(len(keep) + 2)]
    schema = T.StructType([*T.StructType.fromDDL(_OUT), *(T.StructField(c, rows.schema[c].dataType) for c in own)])
    found = rows.mapInArrow(_scan("pass", False, site, keep=("_w0", "_w1", *keep)), schema)
    # pieces of a window that meet
    w = Window.partitionBy("span", "row").orderBy("start_us", "stop_us")
    found = found.withColumn("_f", F.coalesce(F.col("start_us") != F.lag("stop_us").over(w), F.lit(True)).cast("int"))
    found = found.withColumn("_g", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min_by(F.struct(*own), "start_us").alias("_own")
    found = found.groupBy("span", "row", "_g").agg(F.min("start_us").alias("a"), F.max("stop_us").alias("b"), F.max(F.struct("peak", -F.col("peak_us"))).alias("_top"), first)
    found = found.select("span", "a", "b", F.col("_top.peak").alias("peak"), (-F.col("_top.col2")).alias("peak_us"), F.col("_own._k0").alias("w0"), F.col("_own._k1").alias("w1"), "_own")
    pad = round(PAD * _US)
    found = found.where("b > w0 and a < w1").withColumns({"cut": (F.col("a") <= F.col("w0") - pad) | (F.col("b") >= F.col("w1") + pad)})
    found = found.withColumns({"a": F.when(F.col("a") <= F.col("w0") - pad, F.col("w0")).otherwise(F.col("a")), "b": F.when(F.col("b") >= F.col("w1") + pad, F.col("w1")).otherwise(F.col("b"))})
    # finds of one pass by several windows
    o = Window.partitionBy("span").orderBy("a", "b")
    apart = F.col("a") > F.max("b").over(o.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("_f", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("_g", F.sum("_f").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    off = F.greatest(F.col("w0") - F.col("peak_us"), F.col("peak_us") - F.col("w1") + 1, F.lit(0))
    found = found.withColumn("_by", F.struct("cut", off.alias("off"), (-F.col("peak")).alias("low"), F.col("w0")))
    best = found.groupBy("span", "_g").agg(F.min_by(F.struct("a", "b", "cut", "peak", "peak_us", "_own"), "_by").alias("p"), F.min("a").alias("a"), F.max("b").alias("b"))
    start, stop = (F.when(F.col("p.cut"), F.col(c)).otherwise(F.col(f"p.{c}")) for c in ("a", "b"))
    best = best.select("span", start.alias("start_us"), stop.alias("stop_us"), F.col("p.peak_us").alias("peak_us"), (F.col("p.peak") + site[3]).alias("peak_elevation"), *(F.col(f"p._own._k{n + 2}").alias(c) for n, c in enumerate(keep)))
    return best.select("span", _at("start_us").alias("start"), _at("stop_us").alias("stop"), _at("peak_us").alias("peak_time"), "peak_elevation", *keep)


def node_crossings(spans: DataFrame) -> DataFrame:
    """span, time, longitude, ascending of each crossing of the equator in the rows of spans, as find_periods takes them.

    Directions alternate in a span whose rows meet: where the element set changes and the two are on different sides, the object
    crosses at the switch, or, if a crossing of either set is near, the ones that are the same crossing become one.
    """
    found = _rows(spans).mapInArrow(_scan("north", False, (0.0, 0.0, 0.0, 0.0), True), _CROSSINGS)
    # the side on which a piece begins, against the side on which the one that ends there ends
    edges = found.where("edge <> 0")
    w = Window.partitionBy("span").orderBy("time_us", "edge")
    before = F.lag(F.struct("time_us", "edge", "ascending")).over(w)
    jumps = edges.withColumn("_p", before).where((F.col("edge") == 1) & (F.col("_p.edge") == -1) & (F.col("_p.time_us") == F.col("time_us")) & (F.col("_p.ascending") != F.col("ascending")))
    flips = found.where("edge = 0").withColumn("jump", F.lit(False)).unionByName(jumps.drop("_p").withColumn("jump", F.lit(True)))
    # at one time the switch comes last: what the earlier set crosses it crosses before
    w = Window.partitionBy("span").orderBy("time_us", "jump", F.col("ascending"))
    gap = F.col("time_us") - F.lag("time_us").over(w) > F.greatest("near", F.lag("near").over(w))
    flips = flips.withColumn("_f", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("_g", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = Window.partitionBy("span", "_g")
    o = g.orderBy("time_us", "jump", F.col("ascending"))
    flips = flips.withColumns({"_n": F.count("*").over(g), "_j": F.max("jump").over(g), "_up": F.first("ascending").over(o)})
    place = F.row_number().over(g.orderBy((F.col("ascending") != F.col("_up")).cast("int"), F.col("jump").cast("int"), "time_us"))
    kept = flips.withColumn("_place", place).where(~F.col("_j") | ((F.col("_n") % 2 == 1) & (F.col("_place") == 1)))
    return kept.select("span", _at("time_us").alias("time"), "longitude", "ascending")
