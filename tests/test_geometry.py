"""Geodesics, rings, closest-approach windows and geolocation."""

import tracemalloc

import numpy as np
import pytest

from orbitlake.kernels import geodesic
from orbitlake.operators import geometry
from orbitlake.plans import kernel_queries as k

SF = "/root/testdata/sf0.001"


def test_geodesics_invert():
    r = np.random.default_rng(1)
    lat, lon, az, s = r.uniform(-85, 85, 200), r.uniform(-180, 180, 200), r.uniform(0, 360, 200), r.uniform(1e3, 1.5e7, 200)
    a, d = geodesic.inverse(lat, lon, *geodesic.direct(lat, lon, az, s))
    assert np.abs(d - s).max() < 1e-3 and np.abs(np.mod(a - az + 180, 360) - 180).max() < 1e-5
    # a quarter meridian of the ellipsoid
    assert geodesic.direct(0, 0, 0, 10001965.729)[0] == pytest.approx(90, abs=1e-6)


def test_rings_have_one_radius(spark):
    rows = k.visibility_ring(spark, SF).collect()
    assert len(rows) % 36 == 0 and rows
    site = [r for r in rows if r["name"] == rows[0]["name"]]
    s = k.table(spark, SF, "supplier").where(f"s_name = '{rows[0]['name']}'").first()["s_suppkey"]
    d = geodesic.inverse(s * 37 % 160 - 80, s * 53 % 360 - 180, [r["lat"] for r in site], [r["lon"] for r in site])[1]
    assert np.ptp(d) < 20 and 1.4e6 < d.mean() < 2.2e6


def test_tca_windows_tile(spark):
    from orbitlake.operators.geometry import tca_windows

    by = {}
    for r in tca_windows(k.elements(spark, SF)).select("norad", "epoch", "valid_from", "valid_to").collect():
        by.setdefault(r["norad"], []).append((r["valid_from"], r["valid_to"], r["epoch"]))
    for rows in by.values():
        rows.sort()
        assert rows[0][0].year == 1957 and rows[-1][1].year == 2056
        assert all(a[1] == b[0] and a[2] <= a[1] <= b[2] for a, b in zip(rows, rows[1:]))


def test_geolocation_finds_the_site(spark):
    best = {}
    for r in k.doppler_geolocate(spark, SF).collect():
        best.setdefault(r["pass_id"], []).append(r)
    hits = sum(min(abs(r["lat"] - 28.5) + abs(r["lon"] + 80.65) for r in rs) < 0.5 for rs in best.values())
    assert best and hits / len(best) > 0.6


def test_a_fit_is_made_axis_by_axis_with_the_same_result():
    rng = np.random.default_rng(3)
    size = rng.integers(3, 60, 200)
    flat = lambda lo, hi: rng.uniform(lo, hi, 200)
    e = [flat(11, 15.5), flat(0, 0.02), flat(20, 160), flat(0, 360), flat(0, 360), flat(0, 360), np.zeros(200)]
    c = geometry.Curves([np.arange(k) / 3 for k in size], [rng.normal(0, 3000, k) for k in size], np.full(200, 2460310.5), np.zeros(200), e)
    rows, places = np.sort(rng.permutation(200)[:150]), np.column_stack([rng.uniform(-80, 80, 150), rng.uniform(-180, 180, 150)])
    d = c.fixed[rows] - geometry._ground(places[:, 0], places[:, 1], c.alt[rows])[:, None, :]
    rate = (d * c.speed[rows]).sum(2) / np.sqrt((d * d).sum(2)) * c.mask[rows]
    scale = (c.seen[rows] * rate).sum(1) / (rate * rate).sum(1)
    tracemalloc.start()
    got = c.fit(rows, places)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got[0], scale) and np.array_equal(got[1], c.seen[rows] - scale[:, None] * rate)
    assert np.array_equal(c.cost(rows, places), (got[1] ** 2).sum(1))
    assert peak < 7 * rate.nbytes  # not all axes of all samples at once


def test_places_are_found_in_few_rounds(monkeypatch):
    """A search by slopes looks at few places and comes to rest at the site that made the curves."""
    rng, n, seen = np.random.default_rng(5), 60, []
    flat = lambda lo, hi: rng.uniform(lo, hi, n)
    e = [flat(13, 15.5), flat(0, 0.02), flat(30, 150), flat(0, 360), flat(0, 360), flat(0, 360), np.zeros(n)]
    jd, minutes = np.full(n, 2460310.5), [np.arange(30) / 3 for _ in range(n)]
    c = geometry.Curves(minutes, [np.zeros(30) for _ in range(n)], jd, np.zeros(n), e)
    lat, lon, azimuth = c.track()
    site = np.stack(geodesic.direct(lat, lon, azimuth + 90, flat(3e5, 1e6)), 1)
    d = c.fixed - geometry._ground(site[:, 0], site[:, 1], np.zeros(n))[:, None, :]
    rate = (d * c.speed).sum(2) / np.sqrt((d * d).sum(2))
    for name in ("fit", "slopes"):
        if made := getattr(geometry.Curves, name, None):
            monkeypatch.setattr(geometry.Curves, name, lambda self, rows, places, made=made: seen.append(len(rows)) or made(self, rows, places))
    batch = geometry.pa.table({"pass_id": np.arange(n), "minutes": minutes, "doppler": list(rate), "jd": jd, "alt": np.zeros(n), "lat0": np.full(n, np.nan), "lon0": np.full(n, np.nan), **{f"e{k}": x for k, x in enumerate(e)}})
    out = geometry.pa.Table.from_batches(list(geometry._solved(iter(batch.to_batches())))).to_pydict()
    assert out["pass_id"] == np.repeat(np.arange(n), 2).tolist() and all(a <= b for a, b in zip(out["rms"][::2], out["rms"][1::2]))
    off = np.hypot(np.array(out["lat"][::2]) - site[:, 0], np.array(out["lon"][::2]) - site[:, 1])
    assert np.mean(off < 1e-6) > 0.9 and np.mean(out["converged"]) > 0.9
    assert sum(seen) < 90 * n


def test_curves_with_nulls_or_few_samples_have_no_place():
    e = {f"e{k}": [x] * 5 for k, x in enumerate((15.0, 0.001, 50.0, 10.0, 20.0, 30.0, 0.0))}
    minutes = [[0.0, 0.5, 1.0, 1.5], [0.0, 1.0], None, [0.0, None, 1.0], [1.5, 0.0, 1.0, 0.5]]
    seen = [[4.0, 3.0, 1.0, -2.0], [1.0, 2.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [-2.0, 4.0, 1.0, 3.0]]
    table = geometry.pa.table({"pass_id": [1, 2, 3, 4, 5], "minutes": minutes, "doppler": seen, "jd": [2460310.5] * 5, "alt": [0.0] * 5, "lat0": [None] * 5, "lon0": [None] * 5, **e}, schema=geometry.pa.schema(
        [("pass_id", "int64"), ("minutes", geometry.pa.list_(geometry.pa.float64())), ("doppler", geometry.pa.list_(geometry.pa.float64())), *((c, "float64") for c in ("jd", "alt", "lat0", "lon0", *e))]
    ))
    out = geometry.pa.Table.from_batches(list(geometry._solved(iter(table.slice(0, 5).to_batches())))).to_pylist()
    assert [r["pass_id"] for r in out] == [2, 3, 4, 1, 1, 5, 5] and all(r["lat"] is None and r["converged"] is False for r in out[:3])
    assert out[3] | {"pass_id": 0} == out[5] | {"pass_id": 0} and len(out[3]["residuals"]) == 4
    late = geometry.pa.Table.from_batches(list(geometry._solved(iter(table.slice(4, 1).to_batches())))).to_pylist()
    assert [r["pass_id"] for r in late] == [5, 5]
