"""The store: what a batch adds, message files in several forms, and days that a range reads."""

import json

import pytest
from pyspark.sql import functions as F

from orbitlake.functions import tle
from orbitlake.operators import filters, store
from orbitlake.sources import files


def line(body):
    digits = sum(int(c) if c.isdigit() else c == "-" for c in body)
    return f"{body}{digits % 10}"


def pair(norad, day, rev=10):
    return line(f"1 {norad:05d}U 14001A   24{day:012.8f}  .00001234  00000-0  56789-4 0  111"), line(f"2 {norad:05d}  45.0000 100.0000 0010000  90.0000 270.0000 14.50000000{rev:5d}")


def records(n, shift=0):
    out = []
    for k in range(n):
        one, two = pair(40000 + k, 100.25 + k + shift)
        out.append({"OBJECT_NAME": f"SAT {k}", "GP_ID": str(500 + k), "TLE_LINE1": one, "TLE_LINE2": two, "CENTER_NAME": "EARTH", "MEAN_MOTION": "14.5"})
    return out


def nested(r):
    user = "".join(f'<USER_DEFINED parameter="{c}">{r[c]}</USER_DEFINED>' for c in ("TLE_LINE1", "TLE_LINE2", "GP_ID"))
    return (
        f"<omm id='CCSDS_OMM_VERS' version='2.0'><header><ORIGINATOR>X</ORIGINATOR></header><body><segment><metadata><OBJECT_NAME>{r['OBJECT_NAME']}</OBJECT_NAME>"
        f"<CENTER_NAME>{r['CENTER_NAME']}</CENTER_NAME></metadata><data><meanElements><MEAN_MOTION>{r['MEAN_MOTION']}</MEAN_MOTION></meanElements>"
        f"<userDefinedParameters>{user}</userDefinedParameters></data></segment></body></omm>"
    )


def written(tmp_path, kind, rows, name="m"):
    p = tmp_path / f"{name}.{kind}"
    if kind == "json":
        p.write_text(json.dumps(rows))
    elif kind == "csv":
        p.write_text("\n".join([",".join(rows[0]), *(",".join(r.values()) for r in rows)]))
    else:
        p.write_text("<ndm>" + "".join(map(nested, rows)) + "</ndm>")
    return str(p)


@pytest.fixture
def empty(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    s.init()
    return s


def named(s):
    return sorted((r["norad"], r["object_name"], r["fields"]["MEAN_MOTION"], r["fields"]["CENTER_NAME"], r["fields"]["GP_ID"]) for r in s.named().collect())


@pytest.mark.parametrize("kind", ["json", "csv", "xml"])
def test_message_files_of_each_kind(empty, tmp_path, kind):
    rows = records(5)
    path = written(tmp_path, kind, rows)
    assert empty.ingest_file(path) == 5 and empty.ingest_file(path) == 0
    assert named(empty) == [(40000 + k, f"SAT {k}", "14.5", "EARTH", str(500 + k)) for k in range(5)]


def test_one_message_and_parameters_that_some_lack(spark, tmp_path):
    one = records(1)[0]
    p = tmp_path / "one.xml"
    p.write_text(nested(one))
    r = files.read_omm(spark, str(p)).collect()
    assert len(r) == 1 and r[0]["TLE_LINE1"] == one["TLE_LINE1"] and r[0]["OBJECT_NAME"] == "SAT 0" and r[0]["ORIGINATOR"] == "X"
    two = records(2)
    p.write_text("<ndm>" + nested(two[0]).replace('parameter="GP_ID"', 'parameter="OTHER"') + nested(two[1]) + "</ndm>")
    got = {x["OBJECT_NAME"]: (x["GP_ID"], x["OTHER"]) for x in files.read_omm(spark, str(p)).collect()}
    assert got == {"SAT 0": (None, "500"), "SAT 1": ("501", None)}


@pytest.mark.parametrize("kind", ["json", "csv", "xml"])
def test_folders_are_read_together_and_again_only_where_changed(empty, spark, tmp_path, kind):
    at = tmp_path / "in"
    at.mkdir()
    for k in range(3):
        rows = records(4, 10 * k)
        if kind == "csv" and k == 1:  # another order of columns
            rows = [dict(reversed(r.items())) for r in rows]
        written(at, kind, rows, f"f{k}")
    states, added = empty.ingest_folder(str(at))
    assert added == 12 and {r["status"] for r in states.collect()} == {"new"}
    written(at, kind, records(6, 10), "f1")
    states, added = empty.ingest_folder(str(at))
    assert added == 2 and sorted(r["status"] for r in states.collect()) == ["changed", "skipped", "skipped"]
    assert empty.ingest_folder(str(at))[1] == 0 and empty.named().count() == 14


def test_a_batch_counts_what_it_writes(empty, spark):
    pairs = spark.createDataFrame([pair(1 + k % 3, 50 + k / 2) for k in range(20)], "line1 string, line2 string")
    assert empty.ingest_pairs(pairs.limit(0)) == 0
    assert empty.ingest_pairs(pairs.unionByName(pairs)) == 20
    assert empty.ingest_pairs(pairs) == 0
    assert empty.ingest_pairs(spark.createDataFrame([pair(9, 50.5), pair(1, 50.0), ("1 bad", "2 bad")], pairs.schema)) == 1
    assert empty.table("sets").count() == 21


def test_a_range_of_epochs_reads_its_days(empty, spark):
    empty.ingest_pairs(spark.createDataFrame([pair(1, 50 + k) for k in range(20)], "line1 string, line2 string"))
    lo, hi = (F.lit(f"2024-02-{d} 00:00:00").cast("timestamp_ntz") for d in (21, 23))
    d = filters.orbit_filter(empty.table("sets"), epoch=(lo, hi))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "epoch_date" in plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
    assert d.count() == 3 and len(d.inputFiles()) > 0
    assert filters.orbit_filter(empty.table("sets"), epoch=("2024-02-21", None)).count() == 18
    assert filters.orbit_filter(spark.createDataFrame([pair(1, 60.0)], "line1 string, line2 string").withColumn("epoch", tle.epoch(F.col("line1"))), epoch=(lo, None)).count() == 1


def test_sets_by_path_name_or_number(empty, spark, tmp_path):
    one = pair(25544, 50.5)
    (tmp_path / "25544.tle").write_text("\n".join(one))
    assert store.load_sets(spark, str(tmp_path / "25544.tle")).count() == 1
    assert store.load_sets(spark, "25544", str(tmp_path)).first()["line1"] == one[0]
    empty.ingest_pairs(spark.createDataFrame([pair(7, 50.5), pair(7, 51.5)], "line1 string, line2 string"))
    assert store.load_sets(spark, "7", str(tmp_path), empty.path).count() == 2
    with pytest.raises(LookupError):
        store.load_sets(spark, "8x", str(tmp_path), empty.path)
