"""Deep-space terms of SGP4: pull of the Sun and the Moon, and resonance with the Earth's rotation (Hujsak 1979; Hoots and
Roehrich 1980; Vallado, Crawford, Hujsak and Kelso 2006), over arrays of element sets and times.

The Sun and the Moon are two instances of one perturber. Rows are classed by resonance: none, one revolution a day or two;
each class is integrated by itself, all its rows at once in steps of half a day.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the theory: mean motions (rad/min) and eccentricities of the perturbers' orbits, their strengths, the
# Sun's orbit, and the Earth's rotation (rad/min).
SUN_RATE, MOON_RATE = 1.19459e-5, 1.5835218e-4
SUN_ECC, MOON_ECC = 0.01675, 0.05490
SUN_PULL, MOON_PULL = 2.9864797e-6, 4.7968065e-7
SIN_ECLIPTIC, COS_ECLIPTIC = 0.39785416, 0.91744867
COS_SUN_PERIGEE, SIN_SUN_PERIGEE = 0.1945905, -0.98088458
EARTH_RATE = 4.37526908801129966e-3
# Inclinations below (or, turned over, above) this have no node to speak of; below the second one the periodic terms of node
# and perigee are added in other variables.
FLAT, LOW = 5.2359877e-2, 0.2
# Phases and strengths of the tesseral harmonics, mean motions (rad/min) of the resonant orbits.
DAY_RANGE, HALF_DAY_RANGE, HALF_DAY_ECC = (0.0034906585, 0.0052359877), (8.26e-3, 9.24e-3), 0.5
Q22, Q31, Q33 = 1.7891679e-6, 2.1460748e-6, 2.2123015e-7
PHASE_1, PHASE_2, PHASE_3 = 0.13130908, 2.8843198, 0.37448087
ROOT22, ROOT32, ROOT44, ROOT52, ROOT54 = 1.7891679e-6, 3.7393792e-7, 7.3636953e-9, 1.1428639e-7, 2.1765803e-9
G22, G32, G44, G52, G54 = 5.7686396, 0.95240898, 1.8014998, 1.0508330, 4.4108898
# Eccentricity functions of the half-day resonance as cubics, lowest power first, below and above a limit.
G211 = (0.65, (3.616, -13.2470, 16.2900, 0.0), (-72.099, 331.819, -508.738, 266.724))
G310 = (0.65, (-19.302, 117.3900, -228.4190, 156.5910), (-346.844, 1582.851, -2415.925, 1246.113))
G322 = (0.65, (-18.9068, 109.7927, -214.6334, 146.5816), (-342.585, 1554.908, -2366.899, 1215.972))
G410 = (0.65, (-41.122, 242.6940, -471.0940, 313.9530), (-1052.797, 4758.686, -7193.992, 3651.957))
G422 = (0.65, (-146.407, 841.8800, -1629.014, 1083.4350), (-3581.690, 16178.110, -24462.770, 12422.520))
G520 = (0.65, (-532.114, 3017.977, -5740.032, 3708.2760), (1464.74, -4664.75, 3763.64, 0.0))
G520_HIGH = (0.715, (-5149.66, 29936.92, -54087.36, 31324.56))
G533 = (0.7, (-919.22770, 4988.6100, -9064.7700, 5542.21), (-37995.780, 161616.52, -229838.20, 109377.94))
G521 = (0.7, (-822.71072, 4568.6173, -8491.4146, 5337.524), (-51752.104, 218913.95, -309468.16, 146349.42))
G532 = (0.7, (-853.66600, 4690.2500, -8624.7700, 5341.4), (-40023.880, 170470.89, -242699.48, 115605.82))
STEP = 720.0
TWO_PI = 2 * np.pi


class Perturber:
    """The Sun or the Moon as seen from the orbits: a third body's averaged force in the orbits' own axes."""

    def __init__(self, orbit, perigee, tilt, node, pull, rate, ecc, phase):
        """orbit: e, cos and sin of inclination and of argument of perigee, mean motion; the others of the perturber: (cos, sin)
        of its perigee, inclination and node relative to the orbits' nodes, its strength, mean motion, eccentricity, mean anomaly."""
        e, ci, si, cw, sw, n = orbit
        self.rate, self.ecc, self.phase, self.e2 = rate, ecc, phase, e * e
        (cg, sg), (cz, sz), (ch, sh) = perigee, tilt, node
        # the perturber's axes in the orbits' node frames, then turned by the inclination and by the perigee
        px, qx = cg * ch + sg * cz * sh, -sg * ch + cg * cz * sh
        py, qy = -cg * sh + sg * cz * ch, sg * sh + cg * cz * ch
        pz, qz = sg * sz, cg * sz
        a2, a4 = ci * py + si * pz, ci * qy + si * qz
        a5, a6 = -si * py + ci * pz, -si * qy + ci * qz
        x1, x2, x3, x4 = px * cw + a2 * sw, qx * cw + a4 * sw, -px * sw + a2 * cw, -qx * sw + a4 * cw
        x5, x6, x7, x8 = a5 * sw, a6 * sw, a5 * cw, a6 * cw
        self.z31, self.z32, self.z33 = 12 * x1**2 - 3 * x3**2, 24 * x1 * x2 - 6 * x3 * x4, 12 * x2**2 - 3 * x4**2
        b2 = 1 - self.e2
        root = np.sqrt(b2)
        # the first letter's terms count twice, and once more with the share of a circle
        double = lambda z, own: 2 * (z + own * self.e2) + b2 * own
        self.z1 = double(3 * (px**2 + a2**2), self.z31)
        self.z2 = double(6 * (px * qx + a2 * a4), self.z32)
        self.z3 = double(3 * (qx**2 + a4**2), self.z33)
        self.z11 = -6 * px * a5 + self.e2 * (-24 * x1 * x7 - 6 * x3 * x5)
        self.z12 = -6 * (px * a6 + qx * a5) + self.e2 * (-24 * (x2 * x7 + x1 * x8) - 6 * (x3 * x6 + x4 * x5))
        self.z13 = -6 * qx * a6 + self.e2 * (-24 * x2 * x8 - 6 * x4 * x6)
        self.z21 = 6 * a2 * a5 + self.e2 * (24 * x1 * x5 - 6 * x3 * x7)
        self.z22 = 6 * (a4 * a5 + a2 * a6) + self.e2 * (24 * (x2 * x5 + x1 * x6) - 6 * (x4 * x7 + x3 * x8))
        self.z23 = 6 * a4 * a6 + self.e2 * (24 * x2 * x6 - 6 * x4 * x8)
        self.s3 = pull / n
        self.s2, self.s4 = -0.5 * self.s3 / root, self.s3 * root
        self.s1 = -15 * e * self.s4
        self.s5, self.s6, self.s7 = x1 * x3 + x2 * x4, x2 * x3 + x1 * x4, x2 * x4 - x1 * x3

    def secular(self):
        """Rates of eccentricity, inclination, mean anomaly, of perigee and of the node times the sine of inclination."""
        return (
            self.rate * self.s1 * self.s5, self.rate * self.s2 * (self.z11 + self.z13), -self.rate * self.s3 * (self.z1 + self.z3 - 14 - 6 * self.e2),
            self.rate * self.s4 * (self.z31 + self.z33 - 6), -self.rate * self.s2 * (self.z21 + self.z23),
        )

    def periodic(self, t):
        """Changes of the same five by the perturber's place in its orbit, t minutes after epoch."""
        mean = self.phase + self.rate * t
        true = mean + 2 * self.ecc * np.sin(mean)
        s = np.sin(true)
        f2, f3 = 0.5 * s * s - 0.25, -0.5 * s * np.cos(true)
        return (
            2 * self.s1 * (self.s6 * f2 + self.s7 * f3), 2 * self.s2 * (self.z12 * f2 + (self.z13 - self.z11) * f3),
            -2 * self.s3 * (self.z2 * f2 + (self.z3 - self.z1) * f3 + (-21 - 9 * self.e2) * self.ecc * s),
            2 * self.s4 * (self.z32 * f2 + (self.z33 - self.z31) * f3 - 9 * self.ecc * s), -2 * self.s2 * (self.z22 * f2 + (self.z23 - self.z21) * f3),
        )


def perturbers(e, i, node, arg, n, jd) -> tuple[Perturber, Perturber]:
    """The Sun and the Moon for orbits at their epochs (Julian dates)."""
    day = jd - 2415020.0  # of the Moon's theory, from 1899 December 31 at noon
    cn, sn = np.cos(node), np.sin(node)
    orbit = (e, np.cos(i), np.sin(i), np.cos(arg), np.sin(arg), n)
    moon_node = np.mod(4.5236020 - 9.2422029e-4 * day, TWO_PI)
    s, c = np.sin(moon_node), np.cos(moon_node)
    cz = 0.91375164 - 0.03568096 * c
    sz = np.sqrt(1 - cz * cz)
    sh = 0.089683511 * s / sz
    ch = np.sqrt(1 - sh * sh)
    perigee = 5.8351514 + 0.0019443680 * day
    g = perigee + np.arctan2(SIN_ECLIPTIC * s / sz, ch * c + COS_ECLIPTIC * sh * s) - moon_node
    sun = Perturber(orbit, (COS_SUN_PERIGEE, SIN_SUN_PERIGEE), (COS_ECLIPTIC, SIN_ECLIPTIC), (cn, sn), SUN_PULL, SUN_RATE, SUN_ECC, np.mod(6.2565837 + 0.017201977 * day, TWO_PI))
    moon = Perturber(
        orbit, (np.cos(g), np.sin(g)), (cz, sz), (ch * cn + sh * sn, sn * ch - cn * sh), MOON_PULL, MOON_RATE, MOON_ECC, np.mod(4.7199672 + 0.22997150 * day - perigee, TWO_PI)
    )
    return sun, moon


def _cubic(c: tuple, e):
    return c[0] + e * (c[1] + e * (c[2] + e * c[3]))


def _split(table: tuple, e):
    limit, low, high = table
    return np.where(e <= limit if limit == 0.65 else e < limit, _cubic(low, e), _cubic(high, e))


class _Resonance:
    """Rows of one class: longitude and mean motion are integrated from the epoch to each row's time.

    A subclass gives harmonics(longitude, minutes): the acceleration of the longitude and its derivative by it.
    """

    def integrated(self, t):
        longitude, n, at = self.start.copy(), self.n.copy(), np.zeros(len(t))
        step = np.where(t >= 0, STEP, -STEP)
        for k in range(int(np.max(np.abs(t) // STEP, initial=0))):
            go = np.flatnonzero(np.abs(t) >= (k + 1) * STEP)
            a, b = self.harmonics(longitude, at, go)
            rate = n[go] + self.drift[go]
            d = step[go]
            longitude[go] += rate * d + a * d * d / 2
            n[go] += a * d + b * rate * d * d / 2
            at[go] += d
        every, rest = np.arange(len(t)), t - at
        a, b = self.harmonics(longitude, at, every)
        rate = n + self.drift
        return longitude + rate * rest + a * rest**2 / 2, n + a * rest + b * rate * rest**2 / 2


class Daily(_Resonance):
    """One revolution a day."""

    def __init__(self, e, i, n, a, longitude, drift):
        self.start, self.n, self.drift = longitude, n, drift
        c, s, e2 = np.cos(i), np.sin(i), e * e
        base = 3 * (n / a) ** 2
        self.d1 = base * (0.9375 * s * s * (1 + 3 * c) - 0.75 * (1 + c)) * (1 + 2 * e2) * Q31 / a
        self.d2 = 2 * base * 0.75 * (1 + c) ** 2 * (1 + e2 * (-2.5 + 0.8125 * e2)) * Q22
        self.d3 = 3 * base * 1.875 * (1 + c) ** 3 * (1 + e2 * (-6 + 6.60937 * e2)) * Q33 / a

    def harmonics(self, longitude, at, go):
        x = longitude[go]
        terms = [(d[go], k, k * (x - p)) for d, k, p in ((self.d1, 1, PHASE_1), (self.d2, 2, PHASE_2), (self.d3, 3, PHASE_3))]
        return sum(d * np.sin(u) for d, _, u in terms), sum(k * d * np.cos(u) for d, k, u in terms)


class HalfDaily(_Resonance):
    """Two revolutions a day in an eccentric orbit."""

    def __init__(self, e, i, n, a, longitude, drift, arg, arg_rate):
        self.start, self.n, self.drift, self.arg, self.arg_rate = longitude, n, drift, arg, arg_rate
        c, s = np.cos(i), np.sin(i)
        c2, s2 = c * c, s * s
        g520 = np.where(e > G520_HIGH[0], _cubic(G520_HIGH[1], e), _split(G520, e))
        f220, f221 = 0.75 * (1 + 2 * c + c2), 1.5 * s2
        f321, f322 = 1.875 * s * (1 - 2 * c - 3 * c2), -1.875 * s * (1 + 2 * c - 3 * c2)
        f441, f442 = 35 * s2 * f220, 39.3750 * s2 * s2
        f522 = 9.84375 * s * (s2 * (1 - 2 * c - 5 * c2) + 0.33333333 * (-2 + 4 * c + 6 * c2))
        f523 = s * (4.92187512 * s2 * (-2 - 4 * c + 10 * c2) + 6.56250012 * (1 + 2 * c - 3 * c2))
        f542 = 29.53125 * s * (2 - 8 * c + c2 * (-12 + 8 * c + 10 * c2))
        f543 = 29.53125 * s * (-2 - 8 * c + c2 * (12 + 8 * c - 10 * c2))
        b = [3 * n * n / a**k for k in range(2, 6)]
        # strength, multiples of the perigee and of the longitude, phase
        self.terms = (
            (b[0] * ROOT22 * f220 * (-0.306 - (e - 0.64) * 0.440), 2, 1, G22), (b[0] * ROOT22 * f221 * _split(G211, e), 0, 1, G22),
            (b[1] * ROOT32 * f321 * _split(G310, e), 1, 1, G32), (b[1] * ROOT32 * f322 * _split(G322, e), -1, 1, G32),
            (2 * b[2] * ROOT44 * f441 * _split(G410, e), 2, 2, G44), (2 * b[2] * ROOT44 * f442 * _split(G422, e), 0, 2, G44),
            (b[3] * ROOT52 * f522 * g520, 1, 1, G52), (b[3] * ROOT52 * f523 * _split(G532, e), -1, 1, G52),
            (2 * b[3] * ROOT54 * f542 * _split(G521, e), 1, 2, G54), (2 * b[3] * ROOT54 * f543 * _split(G533, e), -1, 2, G54),
        )

    def harmonics(self, longitude, at, go):
        x, w = longitude[go], self.arg[go] + self.arg_rate[go] * at[go]
        terms = [(d[go], k, j * w + k * x - p) for d, j, k, p in self.terms]
        return sum(d * np.sin(u) for d, _, u in terms), sum(k * d * np.cos(u) for d, k, u in terms)


class DeepSpace:
    """All terms of a set of rows. jd: epochs, sidereal: the sidereal angle at them, rates: those of the oblateness alone."""

    def __init__(self, e, i, node, arg, m, n, a, jd, sidereal, rates):
        self.n, self.i, self.sidereal = n, i, sidereal
        self.bodies = perturbers(e, i, node, arg, n, jd)
        de, di, dm, dw, dh = (sum(x) for x in zip(*(b.secular() for b in self.bodies), strict=True))
        s, c = np.sin(i), np.cos(i)
        dh = np.where((i < FLAT) | (i > np.pi - FLAT) | (s == 0), 0.0, dh)
        dnode = dh / np.where(s == 0, 1.0, s)
        self.rates = (de, di, dnode, dw - c * dnode, dm)
        m_rate, w_rate, h_rate = rates
        half = (n >= HALF_DAY_RANGE[0]) & (n <= HALF_DAY_RANGE[1]) & (e >= HALF_DAY_ECC)
        day = (n > DAY_RANGE[0]) & (n < DAY_RANGE[1])
        self.classes = []
        for kind, mask in ((1, day), (2, half)):
            k = np.flatnonzero(mask)
            if not len(k):
                continue
            if kind == 1:
                longitude, rate = (m + node + arg - sidereal)[k], (m_rate + w_rate + h_rate - EARTH_RATE + dm + self.rates[3] + dnode - n)[k]
                r = Daily(e[k], i[k], n[k], a[k], np.mod(longitude, TWO_PI), rate)
            else:
                longitude, rate = (m + 2 * node - 2 * sidereal)[k], (m_rate + dm + 2 * (h_rate + dnode - EARTH_RATE) - n)[k]
                r = HalfDaily(e[k], i[k], n[k], a[k], np.mod(longitude, TWO_PI), rate, arg[k], w_rate[k])
            self.classes.append((kind, k, r))

    def secular(self, t, e, i, node, arg, m):
        """e, i, node, arg, m and mean motion with the secular and resonant terms."""
        e, i, node, arg, m = (x + r * t for x, r in zip((e, i, node, arg, m), self.rates, strict=True))
        n = self.n.copy()
        turned = self.sidereal + EARTH_RATE * t
        for kind, k, r in self.classes:
            longitude, n[k] = r.integrated(t[k])
            m[k] = longitude - node[k] - arg[k] + turned[k] if kind == 1 else longitude - 2 * node[k] + 2 * turned[k]
        return e, i, node, arg, m, n

    def periodic(self, t, e, i, node, arg, m):
        """e, i, node, arg, m with the periodic terms."""
        de, di, dm, dw, dh = (sum(x) for x in zip(*(b.periodic(t) for b in self.bodies), strict=True))
        i, e = i + di, e + de
        s, c = np.sin(i), np.cos(i)
        low = i < LOW
        straight = dh / np.where(low, 1.0, s)
        # near the equator: the pole's direction is moved, and the sum of all angles is kept
        sn, cn = np.sin(node), np.cos(node)
        turned = np.arctan2(s * sn + dh * cn + di * c * sn, s * cn - dh * sn + di * c * cn)
        own = np.fmod(node, TWO_PI)
        whole = m + arg + c * own + dm + dw - di * own * s
        turned = np.where(np.abs(own - turned) > np.pi, turned + np.where(turned < own, TWO_PI, -TWO_PI), turned)
        m = m + dm
        return e, i, np.where(low, turned, node + straight), np.where(low, whole - m - c * turned, arg + dw - c * straight), m
