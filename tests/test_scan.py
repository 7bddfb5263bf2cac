"""The scan of spans: few states are propagated, and the sides and times are those of a scan at every sample."""

import numpy as np
import pytest

from orbitlake.kernels import sgp4
from orbitlake.operators import events

SITE = (28.5, -80.65, 0.0, 5.0)


def pieces(kind, invert=False, n=40):
    r = np.random.default_rng(4)
    e = [r.uniform(11, 15.5, n), r.uniform(0, 0.02, n), r.uniform(1, 179, n), r.uniform(0, 360, n), np.full(n, 90.0), np.full(n, 10.0), np.zeros(n)]
    e[1][:4], e[0][4:6], e[6][6:8] = 0.3, 1.0027, 1e-4  # not near a circle, deep space, drag
    i = np.arange(n)
    lo = r.uniform(-500, 0, n)
    return events._Pieces(kind, invert, SITE, i, i, np.zeros(n, int), lo, lo + r.uniform(1, 900, n), 2460310.5 + r.uniform(0, 30, n), e)


def every_minute(p):
    """Crossings by the definition: all samples propagated, then ROUNDS halvings."""
    out = []
    for i in range(len(p.lo)):
        t = np.minimum(p.lo[i] + np.arange(int(np.ceil(p.hi[i] - p.lo[i])) + 1), p.hi[i])
        above = p.state(np.full(len(t), i), t)[0] > 0
        for k in np.flatnonzero(above[:-1] != above[1:]):
            x, y = t[k], t[k + 1]
            for _ in range(events.ROUNDS):
                m = (x + y) / 2
                x, y = (x, m) if (p.state(np.array([i]), np.array([m]))[0][0] > 0) == above[k + 1] else (m, y)
            out.append((i, y, above[k + 1]))
    return out


@pytest.mark.parametrize("kind, invert", [("north", False), ("ascending", False), ("sunlit", False), ("sunlit", True), ("pass", False)])
def test_the_scan_is_that_of_every_minute(kind, invert):
    p = pieces(kind, invert)
    at, t, up, *_ = p.scan()
    found = set(zip(at.tolist(), t.tolist(), up.tolist(), strict=True))
    assert {(i, float(y), bool(u)) for i, y, u in every_minute(p)} <= found if kind == "pass" else found == {(i, float(y), bool(u)) for i, y, u in every_minute(p)}


def test_few_states_are_propagated(monkeypatch):
    seen, kernel = [], sgp4._at
    monkeypatch.setattr(sgp4, "_at", lambda k, t: seen.append(len(t)) or kernel(k, t))
    p = pieces("sunlit", n=400)
    p.periods(False)
    assert sum(seen) < 0.5 * np.ceil(p.hi - p.lo).sum()


def test_peaks_of_passes_take_few_states(monkeypatch):
    """Without 64 points and golden sections for each pass and each low maximum."""
    p, seen, kernel = pieces("pass", n=400), [], sgp4._at
    monkeypatch.setattr(sgp4, "_at", lambda k, t: seen.append(len(t)) or kernel(k, t))
    assert len(p.periods()) > 300
    assert sum(seen) < 0.5 * np.ceil(p.hi - p.lo).sum()


def test_peaks_of_passes_are_where_the_way_turns():
    p = pieces("pass", n=400)
    at, t, up, *_ = p.scan()
    k = np.flatnonzero(up[:-1] & ~up[1:] & (at[:-1] == at[1:]))
    i, s, e = at[k], t[k], t[k + 1]
    when, top = p.culminations(i, s, e)
    slow, high = p.highest(i, s, e)
    settled = np.isfinite(when)
    assert settled.mean() > 0.9 and settled[p.elements[1][i] < 0.05].mean() > 0.95
    assert np.abs(when - slow)[settled].max() < 0.2 / 60 and np.abs(top - high)[settled].max() < 1e-5
    # a pass that is cut before or after it culminates is highest at the cut
    half = (s + e) / 2
    first, last = p.culminations(i, s, np.minimum(half, when - 0.1)), p.culminations(i, np.maximum(half, when + 0.1), e)
    early, late = settled & (half > s) & (when - 0.1 > s), settled & (when + 0.1 < e)
    assert np.array_equal(first[0][early], np.minimum(half, when - 0.1)[early]) and np.array_equal(last[0][late], np.maximum(half, when + 0.1)[late])


@pytest.mark.parametrize("site", [SITE, (69.0, 20.0, 0.0, 40.0), (-5.0, 100.0, 0.0, 0.0)])
def test_maxima_that_are_left_out_do_not_rise(monkeypatch, site):
    monkeypatch.setitem(globals(), "SITE", site)
    out = pieces("pass", n=300).scan()
    monkeypatch.setattr(events, "LOW", 1e9)  # none is left out
    assert all(np.array_equal(a, b) for a, b in zip(out, pieces("pass", n=300).scan()))
