"""The command line, its store and settings, on a few sets."""

import json

import pytest
from pyspark.sql import functions as F

from orbitlake import cli, settings
from orbitlake.functions import frames as fr
from orbitlake.operators import emit, store
from orbitlake.sources import files

L1 = "1 40001U 14001A   21{:03d}.25000000  .00001234  00000-0  56789-4 0  1111"
L2 = "2 40001  45.0000 100.0000 0010000  90.0000 270.0000 14.50000000  1234"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("in") / "sets"
    at.mkdir()
    (at / "40001.tle").write_text("".join(f"{L1.format(d)}\n{L2}\n" for d in (100, 102, 104)))
    return at


def _run(spark, capsys, *argv):
    code = cli.main([str(x) for x in argv], spark)
    return code, capsys.readouterr().out


def test_files_of_sets(spark, folder, capsys, monkeypatch):
    one = folder / "40001.tle"
    code, out = _run(spark, capsys, "inspect", one, "--columns", "norad,mm", "-d", ";", "--header")
    assert code == 0 and out.split("\n")[:2] == ["norad;mm", "40001;14.5"]
    assert _run(spark, capsys, "inspect", one, "--columns", "nothing")[0] == cli.USAGE
    monkeypatch.setenv("ORBITLAKE_SETS", str(folder))
    code, out = _run(spark, capsys, "find-tle", "40001", "2021-04-12T12:00:00", "odd", "--unique")
    assert code == 0 and out == f"{L1.format(102)}\n{L2}\n"
    code, out = _run(spark, capsys, "summary", one)
    assert code == 0 and out.split()[:3] == ["40001", "3", "3"]
    assert _run(spark, capsys, "filter", one, "--inc-min", 50)[0] == cli.NO_RESULT
    assert _run(spark, capsys, "filter", one, "--inc-min", 40, "--after", "2021-04-11")[1].count("1 40001U") == 2
    assert _run(spark, capsys, "revnum", one, "2021-04-10T06:00:00")[1].split() == ["40001", "123"]
    assert _run(spark, capsys, "revnum", one, "123", "--at", "2021-04-10T06:00:00")[0] == 0
    assert _run(spark, capsys, "maneuvers", one)[0] == cli.NO_RESULT
    assert len(_run(spark, capsys, "propagate", one, "2021-04-10T06:00:00", "2021-04-10T06:05:00", "--groups", "eci")[1].split("\n")) == 6
    assert _run(spark, capsys, "inspect", "nowhere")[0] == cli.USAGE


def test_store(spark, folder, capsys, tmp_path):
    at = tmp_path / "store"
    assert _run(spark, capsys, "get-tle", "40001", "--store", at)[0] == cli.NO_STORE
    assert _run(spark, capsys, "init", "--store", at)[1].split("\n")[1] == "created: sets, messages, files"
    assert _run(spark, capsys, "ingest", folder, "--store", at)[1] == "new: 1\nsets added: 3\n"
    assert _run(spark, capsys, "ingest", folder, "--store", at)[1] == "skipped: 1\nsets added: 0\n"
    assert _run(spark, capsys, "ingest", folder, "--force", "--store", at)[1] == "new: 1\nsets added: 0\n"
    assert _run(spark, capsys, "get-tle", "40001", "--store", at)[1].count("1 40001U") == 3
    assert _run(spark, capsys, "get-tle", "20210412", "--store", at)[1] == f"{L1.format(102)}\n{L2}\n"
    out = tmp_path / "out"
    assert _run(spark, capsys, "generate", out, "--all", "--store", at) == (0, "create: 1\nproblems: 0\n")
    assert _run(spark, capsys, "generate", out, "--all", "--store", at) == (0, "keep: 1\nproblems: 0\n")
    for f in (out / "objects" / "norad=40001").glob("part*"):
        f.write_text("damaged\n")
        (f.parent / f".{f.name}.crc").unlink()
    assert _run(spark, capsys, "generate", out, "--all", "--store", at) == (0, "create: 1\nproblems: 0\n")
    state = emit.object_files(spark, str(out)).first()
    assert state["lines"] == 6 and state["intact"]
    assert _run(spark, capsys, "dump", tmp_path / "dump", "--store", at)[1] == "sets 3, messages 0\n"
    with pytest.raises(PermissionError):
        store.Store.open(spark, str(at)).ingest_pairs(spark.createDataFrame([], "line1 string, line2 string"))
    assert store.Store(spark, str(at)).init(drop=True)["dropped"] == ["sets", "messages", "files"]


def test_messages_and_rejects(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    s.init()
    rows = [(L1.format(100), L2, "A", "1"), (L1.format(100), L2, "B", "2"), (None, L2, "C", "3"), ("1 x", "2 x", "D", "4")]
    records = spark.createDataFrame(rows, "TLE_LINE1 string, TLE_LINE2 string, OBJECT_NAME string, GP_ID string")
    assert s.ingest_messages(records) == 1 and s.ingest_messages(records) == 0
    assert [r["object_name"] for r in s.named().collect()] == ["B"]
    assert s.dump(str(tmp_path / "dump")) == (1, 1)


def test_settings_and_targets(tmp_path, spark):
    user = tmp_path / "user.json"
    user.write_text(json.dumps({"store": "/u", "window_days": 9}))
    got = settings.settings({"ORBITLAKE_STORE": "/e"}, user, tmp_path / "none")
    assert got["store"] == ("/e", "environment") and got["window_days"] == ("9", str(user)) and got["lookback_days"][1] == "default"
    assert str(cli.target("20240131")) == "2024-01-31" and cli.target("A0001") == 100001
    with pytest.raises(ValueError):
        cli.target("what")
    assert files.to_satnum("00022") == 22


def test_inertial_state_of_a_published_example(spark):
    """A state of 2004-04-06 07:51:28.386009 UTC in the frames of date and of J2000, km, as published with the propagator's revision."""
    d = spark.sql("SELECT TIMESTAMP_NTZ '2004-04-06 07:51:28.386009' AS t, 5094.1801072D AS x, 6127.6447052D AS y, 6380.3445327D AS z, -4.746131487D AS vx, 0.785818041D AS vy, 5.531931288D AS vz")
    jd, frac = fr.jday(F.col("t"))
    v = lambda *n: tuple(F.col(c) for c in n)
    r = fr.with_inertial(d, v("x", "y", "z"), v("vx", "vy", "vz"), jd, frac, ("gx", "gy", "gz", "gu", "gv", "gw")).first()
    assert [r["gx"], r["gy"], r["gz"]] == pytest.approx([5102.5096, 6123.01152, 6378.1363], abs=5e-3)
    assert [r["gu"], r["gv"], r["gw"]] == pytest.approx([-4.7432196, 0.7905366, 5.53375619], abs=5e-6)
