"""Files: pairing rules, formats, ids, change detection, times and specs; and the field of a dipole."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitlake.functions import tle
from orbitlake.kernels import field
from orbitlake.sources import files, text

L1 = "1 40001U 14001A   21100.25000000  .00001234  00000-0  56789-4 0  1111"
L2 = "2 40001  45.0000 100.0000 0010000  90.0000 270.0000 14.50000000  1234"


def test_pairs(spark, tmp_path):
    p = tmp_path / "a.tle"
    p.write_text(f"\n1 OLD\n{L1}\n{L2}   \n{L2}\n10 NAME\n{L1}\n\n{L2}\n")
    strict = text.read_pairs(spark, str(p)).orderBy("place").collect()
    assert [(r["line1"], r["line2"]) for r in strict] == [(L1, L2), (L1, L2)]
    assert text.read_pairs(spark, str(p), "lenient").count() == 2
    with pytest.raises(ValueError):
        text.read_pairs(spark, str(p), "odd")
    rows, rejects = files.read_catalog(spark, str(p))
    r = rows.first()
    assert (r["norad"], r["epoch"], r["revnum"]) == (40001, dt.datetime(2021, 4, 10, 6), 123) and rejects.count() == 0
    assert r["bstar"] == pytest.approx(5.6789e-5) and r["ndot"] == pytest.approx(0.00001234)


def test_formats_and_ids(spark):
    assert [files.detect_format(x) for x in ("a.JSON", "b.3le", "c", "d.xml")] == ["json", "tle", "tle", "xml"]
    assert files.candidate_names("a0001") == ["a0001", "A0001", "100001"]
    assert files.candidate_names("22") == ["22", "00022"]
    pairs = [(0, "00000"), (99999, "99999"), (100000, "A0000"), (148493, "E8493"), (182931, "J2931"), (234018, "P4018"), (339999, "Z9999"), (-1, None), (340000, None)]
    got = spark.createDataFrame(pairs, "n long, a string").select("n", "a", tle.alpha5(F.col("n")).alias("e"), tle.from_alpha5(F.col("a")).alias("d")).collect()
    assert all(r["e"] == r["a"] and (r["a"] is None or r["d"] == r["n"]) for r in got)


def test_change_detection(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a").write_text("x"), (d / "b").write_text("y")
    empty = spark.createDataFrame([], "path string, size long, modified timestamp, sha256 string")
    first = files.changed_files(spark, str(d), empty)
    assert {r["status"] for r in first.collect()} == {"new"}
    known = spark.createDataFrame(first.drop("status").collect(), empty.schema)
    (d / "b").write_text("longer")
    assert sorted(r["status"] for r in files.changed_files(spark, str(d), known).collect()) == ["changed", "skipped"]


def test_times_sites_and_specs(spark):
    t = [r["t"] for r in files.times(spark, "2024-01-01 00:00:00", "2024-01-01 00:00:10", 4).collect()]
    assert [x.second for x in sorted(t)] == [0, 4, 8]
    rows = spark.createDataFrame([("K:1:2",), ("K:1",), ("2024-01-01,2024-01-02,5,color=red",), ("# c",), ("2024-01-02,2024-01-01,5",)], "s string").select(files.site(F.col("s")).alias("a"), files.trace_spec(F.col("s")).alias("b")).collect()
    assert tuple(rows[0]["a"]) == ("K", 1.0, 2.0, 0.0) and rows[1]["a"] is None
    assert rows[2]["b"]["options"] == {"color": "red"} and rows[3]["b"] is None and rows[4]["b"] is None


def test_dipole_field():
    g, h = np.zeros((2, 2)), np.zeros((2, 2))
    g[1, 0] = -30000.0
    e, n, u = field.synthesise([0, 90 - 1e-6, -45], [0, 10, 20], [field.RADIUS] * 3, g, h)
    assert np.allclose(e, 0) and n[0] == pytest.approx(30000) and u[1] == pytest.approx(-60000) and u[2] == pytest.approx(60000 * np.sin(np.pi / 4))


@pytest.mark.parametrize("size", [60, 150, 1000, 1 << 20])
@pytest.mark.parametrize("mode", ["strict", "lenient"])
def test_pairs_over_splits(spark, tmp_path, size, mode):
    """Files cut anywhere, in splits of less than a line and more, against one pass over the lines."""
    import random

    r, want = random.Random(size), []
    for f in range(4):
        lines = []
        for k in range(r.randrange(0, 120)):
            lines += r.choice([[f"1 {k:05d} first{f}", f"2 {k:05d} second{f}  "]] * 5 + [[f"1 {k} alone"], [f"2 {k} alone"], [""], ["# note " * 9], ["1x", "2x"]])
        (tmp_path / f"{f}.tle").write_text("\n".join(lines) + r.choice(["", "\n"]))
        before = None
        for line in (x.rstrip(" ") for x in lines):
            if line.startswith("1 " if mode == "strict" else "1"):
                before = line
            elif line.startswith("2 " if mode == "strict" else "2"):
                want += [(f, before, line)] if before is not None else []
                before = None
    confs = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    old = {c: spark.conf.get(c) for c in confs}
    try:
        for c, v in confs.items():
            spark.conf.set(c, v)
        rows = text.read_pairs(spark, str(tmp_path), mode).collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    got = sorted((int(x["path"][-5]), x["place"], x["line1"], x["line2"]) for x in rows)
    assert [(f, a, b) for f, _, a, b in got] == want and len({x[:2] for x in got}) == len(got)


def test_a_busy_key_is_written_by_several_tasks(spark, tmp_path):
    lines = [(L1.replace("21100.", f"21{d:03d}."), L2, "a") for d in range(1, 300)]
    text.write_pairs(spark.createDataFrame(lines, "line1 string, line2 string, k string").repartition(8), str(tmp_path / "out"), "k")
    files_ = sorted((tmp_path / "out" / "k=a").glob("*.txt"))
    assert [x for f in files_ for x in f.read_text().splitlines() if x.startswith("1")] == [a for a, _, _ in lines]
