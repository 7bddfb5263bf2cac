"""SGP4 (Hoots and Roehrich 1980; Vallado, Crawford, Hujsak and Kelso 2006), over arrays of element sets and times.

Element sets with a period of 225 minutes or more get the deep-space terms too; those need the epoch.
"""

from __future__ import annotations

import numpy as np

from orbitlake.kernels.deepspace import DeepSpace

# The gravity model that element sets are fitted with.
MU, RE, J2, J3, J4 = 398600.8, 6378.135, 0.001082616, -0.00000253881, -0.00000165597
XKE = 60.0 / np.sqrt(RE**3 / MU)
TWO_PI = 2 * np.pi
DEEP_MINUTES = 225.0


def sidereal(jd):
    """Greenwich mean sidereal angle in radians."""
    t = (jd - 2451545.0) / 36525.0
    return np.radians(np.mod(67310.54841 + (876600.0 * 3600 + 8640184.812866) * t + 0.093104 * t * t - 6.2e-6 * t**3, 86400.0) / 240.0)


def propagate(mm, ecc, inc, raan, aop, ma, bstar, minutes, jd=None):
    """TEME position (km) and velocity (km/s), shape (n, 3), and an error code for each row.

    mm in rev/day, angles in degrees, jd the Julian date of the epoch. Errors: 1 eccentricity out of range, 3 the same by the
    pull of Sun and Moon, 4 no semi-latus rectum, 6 decayed, 7 deep space without a known epoch.
    """
    mm, e, bstar, t = (np.asarray(x, float) for x in (mm, ecc, bstar, minutes))
    i, node0, arg0, m0 = (np.radians(np.asarray(x, float)) for x in (inc, raan, aop, ma))
    with np.errstate(all="ignore"):
        jd = np.full(len(mm), np.nan) if jd is None else np.asarray(jd, float)
        return _run(mm * TWO_PI / 1440.0, e, i, node0, arg0, m0, bstar, t, jd)


class Sets:
    """Element sets whose constants are computed once, for many times of each."""

    def __init__(self, mm, ecc, inc, raan, aop, ma, bstar, jd=None):
        mm, e, bstar = (np.asarray(x, float) for x in (mm, ecc, bstar))
        i, node0, arg0, m0 = (np.radians(np.asarray(x, float)) for x in (inc, raan, aop, ma))
        with np.errstate(all="ignore"):
            self.k = _constants(mm * TWO_PI / 1440.0, e, i, node0, arg0, m0, bstar, np.full(len(mm), np.nan) if jd is None else np.asarray(jd, float))

    def at(self, rows, minutes):
        """What propagate gives for the sets `rows` at minutes from their epochs."""
        t = np.asarray(minutes, float)
        r, v, err = np.empty((len(t), 3)), np.empty((len(t), 3)), np.empty(len(t), np.int32)
        with np.errstate(all="ignore"):
            for a in range(0, len(t), CHUNK):  # what is computed at once stays in the cache
                c = slice(a, a + CHUNK)
                own = rows[c]
                names = PLAIN if self.k["plain"][own].all() else self.k
                r[c], v[c], err[c] = _at({n: self.k[n][own] for n in names}, t[c])
        return r, v, err


def _run(kozai, e, i, node0, arg0, m0, bstar, t, jd):
    return _at(_constants(kozai, e, i, node0, arg0, m0, bstar, jd), t)


#: Times that are computed at once.
CHUNK = 1 << 13


def _constants(kozai, e, i, node0, arg0, m0, bstar, jd) -> dict[str, np.ndarray]:
    """What doesn't depend on the time; `plain` are sets without drag and without deep-space terms."""
    c, s = np.cos(i), np.sin(i)
    c2 = c * c
    om = 1 - e * e
    rt = np.sqrt(om)
    # mean motion and axis without the secular part of the oblateness
    a1 = (XKE / kozai) ** (2 / 3)
    d1 = 0.75 * J2 * (3 * c2 - 1) / (rt * om)
    d = d1 / a1**2
    d = d1 / (a1 * (1 - d * d - d * (1 / 3 + 134 * d * d / 81))) ** 2
    n0 = kozai / (1 + d)
    a0 = (XKE / n0) ** (2 / 3)
    con42, con41 = 1 - 5 * c2, 3 * c2 - 1
    perigee = (a0 * (1 - e) - 1) * RE
    s4 = np.where(perigee < 98, 20.0, np.where(perigee < 156, perigee - 78, 78.0))
    q4 = ((120 - s4) / RE) ** 4
    s4 = s4 / RE + 1
    pinv2 = 1 / (a0 * om) ** 2
    tsi = 1 / (a0 - s4)
    eta = a0 * e * tsi
    eta2, eeta = eta * eta, e * eta
    psi2 = np.abs(1 - eta2)
    coef = q4 * tsi**4
    coef1 = coef / psi2**3.5
    cc2 = coef1 * n0 * (a0 * (1 + 1.5 * eta2 + eeta * (4 + eta2)) + 0.375 * J2 * tsi / psi2 * con41 * (8 + 3 * eta2 * (8 + eta2)))
    cc1 = bstar * cc2
    round_ = e <= 1e-4
    cc3 = np.where(round_, 0.0, -2 * coef * tsi * (J3 / J2) * n0 * s / np.where(round_, 1.0, e))
    x1mth2 = 1 - c2
    cc4 = 2 * n0 * coef1 * a0 * om * (
        eta * (2 + 0.5 * eta2) + e * (0.5 + 2 * eta2)
        - J2 * tsi / (a0 * psi2) * (-3 * con41 * (1 - 2 * eeta + eta2 * (1.5 - 0.5 * eeta)) + 0.75 * x1mth2 * (2 * eta2 - eeta * (1 + eta2)) * np.cos(2 * arg0))
    )
    cc5 = 2 * coef1 * a0 * om * (1 + 2.75 * (eta2 + eeta) + eeta * eta2)
    t1 = 1.5 * J2 * pinv2 * n0
    t2_ = 0.5 * t1 * J2 * pinv2
    t3_ = -0.46875 * J4 * pinv2 * pinv2 * n0
    c4 = c2 * c2
    mdot = n0 + 0.5 * t1 * rt * con41 + 0.0625 * t2_ * rt * (13 - 78 * c2 + 137 * c4)
    argdot = -0.5 * t1 * con42 + 0.0625 * t2_ * (7 - 114 * c2 + 395 * c4) + t3_ * (3 - 36 * c2 + 49 * c4)
    xh = -t1 * c
    nodedot = xh + (0.5 * t2_ * (4 - 19 * c2) + 2 * t3_ * (3 - 7 * c2)) * c
    xmcof = np.where(round_, 0.0, -(2 / 3) * coef * bstar / np.where(round_, 1.0, eeta))
    nodecf = 3.5 * om * xh * cc1
    *_, aycof, xlcof = _tilted(i)
    far = TWO_PI / n0 >= DEEP_MINUTES
    high = (a0 * (1 - e) >= 220 / RE + 1) & ~far  # lower ones drop the higher drag terms, deep-space ones have none
    h = high.astype(float)
    d2 = 4 * a0 * tsi * cc1**2
    temp = d2 * tsi * cc1 / 3
    d3 = (17 * a0 + s4) * temp
    d4 = 0.5 * temp * a0 * tsi * (221 * a0 + 31 * s4) * cc1
    am0 = (XKE / n0) ** (2 / 3)
    nm0 = XKE / am0**1.5
    plain = (bstar == 0) & ~far & np.isfinite(cc1) & np.isfinite(cc3) & np.isfinite(cc4) & np.isfinite(cc5) & np.isfinite(xmcof) & np.isfinite(d3) & np.isfinite(d4) & np.isfinite(eta)
    own = locals()
    return {n: own[n] for n in (*PLAIN, *DRAGGED)}


#: Constants that a plain set needs, and the others.
PLAIN = ("plain", "e", "i", "node0", "arg0", "m0", "mdot", "argdot", "nodedot", "am0", "nm0", "aycof", "xlcof", "c", "s", "c2", "con41", "x1mth2", "far", "jd")
DRAGGED = ("n0", "a0", "h", "bstar", "eta", "cc1", "cc3", "cc4", "cc5", "xmcof", "nodecf", "d2", "d3", "d4")


def _at(k, t):
    e, i, node0, arg0, m0, mdot, argdot, nodedot, am, nm, aycof, xlcof, c, s, c2, con41, x1mth2, far, jd = (k[n] for n in PLAIN[1:])
    # secular gravity and drag
    mdf, argdf, nodedf = m0 + mdot * t, arg0 + argdot * t, node0 + nodedot * t
    deep = np.zeros(0, int)
    if k["plain"].all():
        m, arg, node, em, xi = mdf, argdf, nodedf, e, i
        err = np.where((em >= 1) | (em < -0.001) | (am < 0.95), 1, 0)
        em = np.maximum(em, 1e-6)
    else:
        n0, a0, h, bstar, eta, cc1, cc3, cc4, cc5, xmcof, nodecf, d2, d3, d4 = (k[n] for n in DRAGGED)
        node = nodedf + nodecf * t * t
        shift = h * (bstar * cc3 * np.cos(arg0) * t + xmcof * ((1 + eta * np.cos(mdf)) ** 3 - (1 + eta * np.cos(m0)) ** 3))
        m, arg = mdf + shift, argdf - shift
        ta = 1 - cc1 * t - h * (d2 * t**2 + d3 * t**3 + d4 * t**4)
        te = bstar * cc4 * t + h * bstar * cc5 * (np.sin(m) - np.sin(m0))
        tl = 1.5 * cc1 * t**2 + h * (
            (d2 + 2 * cc1**2) * t**3
            + t**4 * (0.25 * (3 * d3 + cc1 * (12 * d2 + 10 * cc1**2)) + t * 0.2 * (3 * d4 + 12 * cc1 * d3 + 6 * d2 * d2 + 15 * cc1**2 * (2 * d2 + cc1**2)))
        )
        nm, em, xi = n0, e, i
        deep = np.flatnonzero(far & np.isfinite(jd))
        if len(deep):
            own = DeepSpace(*(x[deep] for x in (e, i, node0, arg0, m0, n0, a0, jd)), sidereal(jd[deep]), (mdot[deep], argdot[deep], nodedot[deep]))
            em, xi, node, arg, m, nm = _put(deep, own.secular(t[deep], *(x[deep] for x in (em, xi, node, arg, m))), (em, xi, node, arg, m, nm))
        am = (XKE / nm) ** (2 / 3) * ta * ta
        nm = XKE / am**1.5
        em = em - te
        err = np.where((em >= 1) | (em < -0.001) | (am < 0.95), 1, 0)
        em = np.maximum(em, 1e-6)
        m = m + n0 * tl
    xlm = np.mod(m + arg + node, TWO_PI)
    node, arg = np.mod(node, TWO_PI), np.mod(arg, TWO_PI)
    m = np.mod(xlm - arg - node, TWO_PI)
    if len(deep):
        e_, i_, node_, arg_, m_ = own.periodic(t[deep], *(x[deep] for x in (em, xi, node, arg, m)))
        turned = i_ < 0
        i_, node_, arg_ = np.where(turned, -i_, i_), np.where(turned, node_ + np.pi, node_), np.where(turned, arg_ - np.pi, arg_)
        em, xi, node, arg, m = _put(deep, (e_, i_, node_, arg_, m_), (em, xi, node, arg, m))
        err = np.where((err == 0) & ((em < 0) | (em > 1)), 3, err)
        (c, s, c2, con41, x1mth2, aycof, xlcof) = _put(deep, _tilted(i_), (c, s, c2, con41, x1mth2, aycof, xlcof))
    # long-period terms, then Kepler's equation
    axn = em * np.cos(arg)
    inv = 1 / (am * (1 - em * em))
    ayn = em * np.sin(arg) + inv * aycof
    u = np.mod(m + arg + node + inv * xlcof * axn - node, TWO_PI)
    eo, live = u.copy(), np.ones(u.shape, bool)
    for _ in range(10):
        se, ce = np.sin(eo), np.cos(eo)
        step = np.clip((u - ayn * ce + axn * se - eo) / (1 - ce * axn - se * ayn), -0.95, 0.95)
        eo = np.where(live, eo + step, eo)
        live = live & (np.abs(step) > 1e-9)  # the next step, by its square, would be nothing; each row by itself
        if not live.any():
            break
    se, ce = np.sin(eo), np.cos(eo)
    ecose, esine, el2 = axn * ce + ayn * se, axn * se - ayn * ce, axn**2 + ayn**2
    pl = am * (1 - el2)
    err = np.where((err == 0) & (pl < 0), 4, err)
    rl = am * (1 - ecose)
    rdot, rvdot, beta = np.sqrt(am) * esine / rl, np.sqrt(pl) / rl, np.sqrt(1 - el2)
    w = esine / (1 + beta)
    su = np.arctan2(am / rl * (se - ayn - axn * w), am / rl * (ce - axn + ayn * w))
    s2u, c2u = np.sin(2 * su), np.cos(2 * su)
    k1 = 0.5 * J2 / pl
    k2 = k1 / pl
    mr = rl * (1 - 1.5 * k2 * beta * con41) + 0.5 * k1 * x1mth2 * c2u
    su = su - 0.25 * k2 * (7 * c2 - 1) * s2u
    xnode, xinc = node + 1.5 * k2 * c * s2u, xi + 1.5 * k2 * c * s * c2u
    mv = rdot - nm * k1 * x1mth2 * s2u / XKE
    rv = rvdot + nm * k1 * (x1mth2 * c2u + 1.5 * con41) / XKE
    ss, cs, sn, cn, si, ci = np.sin(su), np.cos(su), np.sin(xnode), np.cos(xnode), np.sin(xinc), np.cos(xinc)
    uu = np.stack([-sn * ci * ss + cn * cs, cn * ci * ss + sn * cs, si * ss], -1)
    vv = np.stack([-sn * ci * cs - cn * ss, cn * ci * cs - sn * ss, si * cs], -1)
    err = np.where((err == 0) & (mr < 1), 6, err)
    err = np.where(far & ~np.isfinite(jd), 7, err)
    return mr[..., None] * uu * RE, (mv[..., None] * uu + rv[..., None] * vv) * (RE * XKE / 60), err.astype(np.int32)


def _tilted(i):
    """What the position needs of an inclination: cosine, sine, combinations of them, and the long-period coefficients."""
    c, s = np.cos(i), np.sin(i)
    flat = np.abs(1 + c) > 1.5e-12
    xlcof = -0.25 * (J3 / J2) * s * (3 + 5 * c) / np.where(flat, 1 + c, 1.5e-12)
    return c, s, c * c, 3 * c * c - 1, 1 - c * c, -0.5 * (J3 / J2) * s, xlcof


def _put(rows, new, old):
    """The old arrays with the new values at rows."""
    out = []
    for x, y in zip(new, old, strict=True):
        z = np.array(y)
        z[rows] = x
        out.append(z)
    return out
