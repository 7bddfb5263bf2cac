"""Geodesics on the WGS84 ellipsoid by Vincenty's series (1975), over arrays; degrees and metres."""

from __future__ import annotations

import numpy as np

A, F = 6378137.0, 1 / 298.257223563
B = A * (1 - F)


def _series(cos2a):
    u = cos2a * (A * A - B * B) / (B * B)
    return 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))), u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))


def _turn(b, sin_s, cos_s, c2m):
    return b * sin_s * (c2m + b / 4 * (cos_s * (2 * c2m**2 - 1) - b / 6 * c2m * (4 * sin_s**2 - 3) * (4 * c2m**2 - 3)))


def direct(lat, lon, azimuth, distance):
    """Where a geodesic of a length ends: latitude, longitude in [-180, 180)."""
    lat, lon, az, s = np.broadcast_arrays(*(np.asarray(x, float) for x in (lat, lon, azimuth, distance)))
    az = np.radians(az)
    u1 = np.arctan((1 - F) * np.tan(np.radians(lat)))
    su, cu = np.sin(u1), np.cos(u1)
    s1 = np.arctan2(np.tan(u1), np.cos(az))
    sa = cu * np.sin(az)
    c2a = 1 - sa * sa
    k, b = _series(c2a)
    sigma = s / (B * k)
    for _ in range(20):
        c2m, before = np.cos(2 * s1 + sigma), sigma
        sigma = s / (B * k) + _turn(b, np.sin(sigma), np.cos(sigma), c2m)
        if np.array_equal(sigma, before, equal_nan=True):
            break
    ss, cs, c2m = np.sin(sigma), np.cos(sigma), np.cos(2 * s1 + sigma)
    lat2 = np.arctan2(su * cs + cu * ss * np.cos(az), (1 - F) * np.hypot(sa, su * ss - cu * cs * np.cos(az)))
    lam = np.arctan2(ss * np.sin(az), cu * cs - su * ss * np.cos(az))
    c = F / 16 * c2a * (4 + F * (4 - 3 * c2a))
    dl = lam - (1 - c) * F * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
    return np.degrees(lat2), np.mod(lon + np.degrees(dl) + 180, 360) - 180


def inverse(lat1, lon1, lat2, lon2):
    """Azimuth at the start and distance. Nearly opposite points don't converge and give what the last round had."""
    u1, u2 = (np.arctan((1 - F) * np.tan(np.radians(np.asarray(x, float)))) for x in (lat1, lat2))
    dl = np.radians(np.mod(np.asarray(lon2, float) - np.asarray(lon1, float) + 180, 360) - 180)
    lam = dl
    for _ in range(50):
        sl, cl = np.sin(lam), np.cos(lam)
        x, y = np.cos(u2) * sl, np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * cl
        ss, cs = np.hypot(x, y), np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * cl
        sigma = np.arctan2(ss, cs)
        sa = np.cos(u1) * np.cos(u2) * sl / np.where(ss == 0, 1, ss)
        c2a = 1 - sa * sa
        c2m = np.where(c2a > 1e-15, cs - 2 * np.sin(u1) * np.sin(u2) / np.where(c2a > 1e-15, c2a, 1), 0.0)
        c = F / 16 * c2a * (4 + F * (4 - 3 * c2a))
        before, lam = lam, dl + (1 - c) * F * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
        if np.array_equal(lam, before, equal_nan=True):
            break
    k, b = _series(c2a)
    return np.degrees(np.arctan2(x, y)) % 360, B * k * (sigma - _turn(b, ss, cs, c2m))
