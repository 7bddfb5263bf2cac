"""Spherical-harmonic synthesis of the main magnetic field; coefficients come from the caller."""

from __future__ import annotations

import numpy as np

RADIUS = 6371.2  # km, the reference radius of the coefficients


def synthesise(lat_c, lon, r_km, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """East, north and up components (units of the coefficients) at geocentric latitude, longitude (degrees) and radius.

    g and h are (degree + 1, order + 1) of Schmidt semi-normalised coefficients, with a third axis where they differ by place.
    """
    lat_c, lon, r = np.broadcast_arrays(*(np.asarray(x, float) for x in (lat_c, lon, r_km)))
    th, ph = np.radians(90 - lat_c), np.radians(lon)
    c, s = np.cos(th), np.maximum(np.sin(th), 1e-10)
    top = g.shape[0] - 1
    p, dp = {(0, 0): np.ones_like(c)}, {(0, 0): np.zeros_like(c)}
    for n in range(1, top + 1):
        for m in range(n + 1):
            if n == m:
                k = 1.0 if n == 1 else np.sqrt(1 - 1 / (2 * n))
                p[n, n] = k * s * p[n - 1, n - 1]
                dp[n, n] = k * (s * dp[n - 1, n - 1] + c * p[n - 1, n - 1])
            else:
                low = np.sqrt((n - 1) ** 2 - m * m)
                before, dbefore = (p[n - 2, m], dp[n - 2, m]) if n - 2 >= m else (0.0, 0.0)
                k = np.sqrt(n * n - m * m)
                p[n, m] = ((2 * n - 1) * c * p[n - 1, m] - low * before) / k
                dp[n, m] = ((2 * n - 1) * (c * dp[n - 1, m] - s * p[n - 1, m]) - low * dbefore) / k
    east, north, up = np.zeros_like(c), np.zeros_like(c), np.zeros_like(c)
    for n in range(1, top + 1):
        a = (RADIUS / r) ** (n + 2)
        for m in range(n + 1):
            gc, hs = g[n, m] * np.cos(m * ph) + h[n, m] * np.sin(m * ph), g[n, m] * np.sin(m * ph) - h[n, m] * np.cos(m * ph)
            up += a * (n + 1) * gc * p[n, m]
            north += a * gc * dp[n, m]
            east += a * m * hs * p[n, m] / s
    return east, north, up


class Model:
    """Coefficients at epochs (decimal years), linear in time between them, and beyond the ends as in the nearest interval."""

    def __init__(self, rows: list[tuple]):
        """rows: epoch, n, m, g, h."""
        self.years = np.array(sorted({float(r[0]) for r in rows}))
        self.top = max(int(r[1]) for r in rows)
        self.g, self.h = (np.zeros((len(self.years), self.top + 1, self.top + 1)) for _ in range(2))
        for year, n, m, g, h in rows:
            k = int(np.searchsorted(self.years, float(year)))
            self.g[k, int(n), int(m)], self.h[k, int(n), int(m)] = g, h or 0.0

    def at(self, years: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """g and h (degree + 1, order + 1, rows) at decimal years."""
        if len(self.years) == 1:
            return self.g[0][:, :, None], self.h[0][:, :, None]
        k = np.clip(np.searchsorted(self.years, years, "right") - 1, 0, len(self.years) - 2)
        w = (years - self.years[k]) / (self.years[k + 1] - self.years[k])
        return tuple(np.moveaxis(x[k] + w[:, None, None] * (x[k + 1] - x[k]), 0, -1) for x in (self.g, self.h))

    def enu(self, xyz: np.ndarray, lat: np.ndarray, years: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """East, north and up of the ellipsoid at Earth-fixed positions (km) of geodetic latitude lat (degrees)."""
        flat = np.hypot(xyz[:, 0], xyz[:, 1])
        below = np.degrees(np.arctan2(xyz[:, 2], flat))
        east, north, up = synthesise(below, np.degrees(np.arctan2(xyz[:, 1], xyz[:, 0])), np.hypot(flat, xyz[:, 2]), *self.at(years))
        turn = np.radians(lat - below)  # the ellipsoid's vertical leans poleward
        return east, np.cos(turn) * north - np.sin(turn) * up, np.cos(turn) * up + np.sin(turn) * north
