"""Physics of the propagation kernel and of the groups derived from it."""

import numpy as np
import pytest

from orbitlake.kernels import sgp4
from orbitlake.plans import kernel_queries as k

SF = "/root/testdata/sf0.001"
ISS = (15.49560532, 0.0006703, 51.64, 208.9163, 30.5502, 329.5947, 1.027e-4)


def test_energy_momentum_and_plane():
    t = np.linspace(0, 1440, 2000)
    r, v, err = sgp4.propagate(*(np.full(2000, x) for x in ISS), t)
    assert not err.any()
    n = np.linalg.norm(r, axis=1)
    assert n.min() > 6378 + 350 and n.max() < 6378 + 480
    energy = (v**2).sum(1) / 2 - sgp4.MU / n
    assert np.ptp(energy) / abs(energy.mean()) < 2e-3
    h = np.cross(r, v)
    inc = np.degrees(np.arccos(h[:, 2] / np.linalg.norm(h, axis=1)))
    assert np.abs(inc - 51.64).max() < 0.05
    # velocity is the derivative of position
    step = np.diff(r, axis=0) / (60 * np.diff(t)[:, None])
    assert np.abs(step - (v[1:] + v[:-1]) / 2).max() < 0.01


def test_node_regresses_and_errors():
    day = 1440.0
    a, b = (np.cross(*(x[0] for x in sgp4.propagate(*([y] for y in ISS), [m])[:2])) for m in (0.0, day))
    node = np.degrees(np.arctan2(b[0], -b[1]) - np.arctan2(a[0], -a[1]))
    assert node == pytest.approx(-5.0, abs=0.1)
    *_, err = sgp4.propagate([1.0027, 16.9], [0.0002, 0.01], [0.1, 50], [0, 0], [0, 0], [0, 0], [0, 0.5], [0, 9000])
    assert err[0] == 7 and err[1] != 0


def test_groups(spark):
    rows = k.generate_all(spark, SF).where("err = 0").collect()
    assert rows
    for x in rows:
        assert -90 <= x["lat"] <= 90 and x["alt"] > 0 and x["sun"] in (0, 1, 2) and 0 <= x["lst"] < 24 and -90 <= x["beta"] <= 90
        assert x["range"] >= x["alt"] - 25 and -90 <= x["elevation"] <= 90
        assert np.hypot(np.hypot(x["x"], x["y"]), x["z"]) == pytest.approx(np.hypot(np.hypot(x["rx"], x["ry"]), x["rz"]))


# Published verification states (Vallado, Crawford, Hujsak and Kelso 2006; Hoots and Roehrich 1980): mean motion,
# eccentricity, inclination, node, perigee, mean anomaly, drag, year and day of the epoch; then minutes, km and km/s.
PUBLISHED = [
    ((2.28537848, 0.7318036, 46.7916, 230.4354, 47.4722, 10.4117, 0.014311), 1980, 230.29629788, [
        (0, 7473.37102491, 428.94748312, 5828.74846783, 5.107155391, 6.444680305, -0.186133297),
        (360, -3305.22148694, 32410.84323331, -24697.16974954, -1.301137319, -1.151315600, -0.283335823),
        (720, 14271.29083858, 24110.44309009, -4725.76320143, -0.320504528, 2.679841539, -2.084054355),
        (1080, -9990.05800009, 22717.34212448, -23616.88515553, -1.016674392, -2.290267981, 0.728923337),
        (1440, 9787.87836256, 33753.32249667, -15030.79874625, -1.094251553, 0.923589906, -1.522311008),
    ]),
    ((1.20231981, 0.1450506, 11.4628, 273.1101, 207.6000, 143.9350, 1e-4), 2004, 31.91070959, [
        (0, 2334.11450085, -41920.44035349, -0.03867437, 2.826321032, -0.065091664, 0.570936053),
        (-5184, -29020.02587128, 13819.84419063, -5713.33679183, -1.768068390, -3.235371192, -0.395206135),
    ]),
    ((2.00491383, 0.6877146, 64.1586, 279.0717, 264.7651, 20.2257, 1.1873e-4), 2006, 176.33215444, [
        (0, 2349.89483350, -14785.93811562, 0.02119378, 2.721488096, -3.256811655, 4.498416672),
        (120, 15223.91713658, -17852.95881713, 25280.39558224, 1.079041732, 0.875187372, 2.485682813),
        (240, 19752.78050009, -8600.07130962, 37522.72921090, 0.238105279, 1.546110924, 0.986410447),
        (360, 19089.29762968, 3107.89495018, 39958.14661370, -0.410308034, 1.640332277, -0.306873818),
    ]),
    ((0.98870114, 0.0011562, 11.4384, 35.2134, 26.4582, 333.5652, 1e-4), 2006, 176.02844893, [
        (0, 34747.57932696, 24502.37114079, -1.32832986, -1.731642662, 2.452772615, 0.608510081),
        (120, 18263.33439094, 38159.96004751, 4186.18304085, -2.744396611, 1.255583260, 0.528558932),
    ]),
    ((1.00270176, 0.0000335, 0.0019, 286.9433, 13.7918, 55.6504, 1e-4), 2006, 176.46683397, [
        (0, 42080.71852213, -2646.86387436, 0.81851294, 0.193105177, 3.068688251, 0.000438449),
        (120, 37740.00085593, 18802.76872802, 3.45512584, -1.371035206, 2.752105932, 0.000336883),
    ]),
    ((1.00778054, 0.0026640, 3.8536, 80.0121, 311.0977, 48.3000, 1e-4), 2006, 177.04061740, [
        (0, 7534.10987189, 41266.39266843, -0.10801028, -3.027168008, 0.558848996, 0.207982755),
        (120, -14289.19940414, 39469.05530051, 1428.62838591, -2.893205245, -1.045447840, 0.179634249),
    ]),
    ((10.82419157, 0.1859667, 34.2682, 348.7242, 331.7664, 19.3264, 2.8098e-5), 2000, 179.78495062, [
        (0, 7022.46529266, -1400.08296755, 0.03995155, 1.893841015, 6.405893759, 4.534807250),
        (360, -7154.03120202, -3783.17682504, -3536.19412294, 4.741887409, -4.151817765, -2.093935425),
    ]),
]


def julian(year, day):
    import datetime

    return datetime.date(year, 1, 1).toordinal() + 1721424.5 + day - 1


def test_published_states():
    rows = [(e, julian(y, d), *x) for e, y, d, xs in PUBLISHED for x in xs]
    r, v, err = sgp4.propagate(*np.array([e for e, *_ in rows]).T, [x[2] for x in rows], [x[1] for x in rows])
    want = np.array([x[3:] for x in rows])
    assert not err.any()
    assert np.abs(r - want[:, :3]).max() < 1e-6 and np.abs(v - want[:, 3:]).max() < 1e-8


def test_published_states_by_spark(spark):
    """The same states through the operator, from the columns of a table."""
    import datetime

    from orbitlake.operators import propagate

    names = ("mm", "ecc", "inc", "raan", "aop", "ma", "bstar")
    rows = []
    for e, y, d, xs in PUBLISHED:
        epoch = datetime.datetime(y, 1, 1) + datetime.timedelta(days=d - 1)
        rows += [(*e, epoch, epoch + datetime.timedelta(minutes=m), *want) for m, *want in xs]
    schema = ", ".join(f"{n} double" for n in names) + ", epoch timestamp_ntz, t timestamp_ntz, " + ", ".join(f"w{k} double" for k in range(6))
    got = propagate.with_states(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    for g in got:
        assert g["err"] == 0 and max(abs(g[c] - g[f"w{k}"]) for k, c in enumerate(("x", "y", "z"))) < 0.05  # the epoch is a whole microsecond


@pytest.mark.parametrize("mm, ecc, inc", [(1.0027, 0.0003, 0.05), (1.0027, 0.2, 63.4), (2.0057, 0.7, 63.4), (2.0057, 0.54, 30.0), (2.01, 0.735, 120.0)])
def test_resonance_steps_agree_with_short_ones(mm, ecc, inc, monkeypatch):
    """Steps of half a day against steps of a minute, months before and after the epoch."""
    from orbitlake.kernels import deepspace

    e = [np.full(4, x) for x in (mm, ecc, inc, 80.0, 270.0, 40.0, 0.0)]
    t, jd = np.array([-90000.0, -1000.0, 1000.0, 90000.0]), np.full(4, julian(2010, 100.25))
    r, _, err = sgp4.propagate(*e, t, jd)
    monkeypatch.setattr(deepspace, "STEP", 1.0)
    fine, _, _ = sgp4.propagate(*e, t, jd)
    assert not err.any()
    assert np.linalg.norm(r - fine, axis=1).max() < 5.0


def test_deep_space_rows_stand_alone():
    """Rows of all classes together give what each gives alone; without an epoch only near rows have a state."""
    sets = [e for e, *_ in PUBLISHED] + [ISS]
    jd = np.array([julian(y, d) for _, y, d, _ in PUBLISHED] + [julian(2020, 1.0)])
    t = np.linspace(-4000, 4000, len(sets))
    r, v, err = sgp4.propagate(*np.array(sets).T, t, jd)
    for k, e in enumerate(sets):
        one, _, _ = sgp4.propagate(*([x] for x in e), [t[k]], [jd[k]])
        assert np.array_equal(one[0], r[k])
    _, _, none = sgp4.propagate(*np.array(sets).T, t)
    assert none.tolist() == [7] * 6 + [0, 0]
    # velocity is the derivative of position, over resonance steps too
    s = np.arange(1400.0, 1480.0, 0.25)
    for e, j in zip(sets[:6], jd, strict=False):
        r, v, _ = sgp4.propagate(*(np.full(len(s), x) for x in e), s, np.full(len(s), j))
        step = np.diff(r, axis=0) / 15.0
        assert np.abs(step - (v[1:] + v[:-1]) / 2).max() < 0.01
