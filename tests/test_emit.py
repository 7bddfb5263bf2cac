"""Files by day and object: the manifest, message files beside the text, and streams that keep them up to date."""

import os
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from orbitlake.functions import tle
from orbitlake.operators import emit, propagate, store, switching
from orbitlake.streaming import streams
from tests.test_store import pair, records


def sets(spark, rows, created="2000-01-01", fields=False):
    t = spark.createDataFrame(rows, "line1 string, line2 string")
    t = t.select("line1", "line2", tle.element_columns(F.col("line1"), F.col("line2"))["norad"].alias("norad"), tle.epoch(F.col("line1")).alias("epoch"), F.lit(created).cast("timestamp_ntz").alias("created")).withColumn("id", F.xxhash64("line1"))
    return t.withColumn("fields", F.when(F.col("norad") % 2 == 1, F.create_map(F.lit("OBJECT_NAME"), F.concat(F.lit("N"), F.col("norad"))))) if fields else t


def text_of(path, norad):
    return "".join(f.read_text() for f in sorted(Path(path, "objects", f"norad={norad}").glob("*.txt"))).splitlines()


def garbled(path, norad):
    """Other text in an object's files that look as before in a list of the folder."""
    for f in Path(path, "objects", f"norad={norad}").glob("*.txt"):
        s = f.stat()
        f.write_bytes(b"x" * (s.st_size - 1) + b"\n")
        os.utime(f, ns=(s.st_atime_ns, s.st_mtime_ns))
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)


def actions(d):
    return {r["norad"]: (r["action"], r["n_new"]) for r in d.collect()}


def test_a_second_run_reads_no_other_objects_text(spark, tmp_path):
    at, rows = str(tmp_path), [pair(n, 50.5 + d) for n in (1, 2, 3) for d in range(4)]
    done, problems = emit.generate(sets(spark, rows), at)
    assert actions(done) == {n: ("create", 0) for n in (1, 2, 3)} and problems.count() == 0
    garbled(at, 1)
    done, problems = emit.generate(sets(spark, [*rows, pair(2, 60.5)]), at)
    # were object 1 read, it would be found damaged and written anew
    assert actions(done) == {1: ("keep", 0), 2: ("append", 1), 3: ("keep", 0)} and problems.count() == 0
    assert text_of(at, 1)[0].startswith("xx") and len(text_of(at, 2)) == 10
    held = {r["norad"]: r["lines"] for r in spark.read.parquet(f"{at}/manifest").collect()}
    assert held == {1: 8, 2: 10, 3: 8}
    # the full audit reads all text
    assert {r["norad"]: r["intact"] for r in emit.object_files(spark, at).collect()} == {1: False, 2: True, 3: True}


def test_touched_damaged_missing_and_late(spark, tmp_path):
    at, rows = str(tmp_path), [pair(n, 50.5 + d) for n in (1, 2, 3, 4) for d in range(3)]
    emit.generate(sets(spark, rows), at)
    f = next(Path(at, "objects", "norad=1").glob("*.txt"))
    f.write_text(f.read_text()[:-30])  # torn
    f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    shutil.rmtree(Path(at, "objects", "norad=2"))
    late = sets(spark, [pair(3, 51.0)], created="2100-01-01")
    done, problems = emit.generate(sets(spark, rows).unionByName(late), at)
    assert {n: a for n, (a, _) in actions(done).items()} == {1: "create", 2: "create", 3: "rewrite", 4: "keep"} and problems.count() == 0
    assert [len(text_of(at, n)) for n in (1, 2, 3, 4)] == [6, 6, 8, 6]
    assert [x for x in text_of(at, 3) if x.startswith("1")] == sorted(x for x in text_of(at, 3) if x.startswith("1"))
    done, _ = emit.generate(sets(spark, rows).unionByName(late.withColumn("created", F.lit("2000-01-01").cast("timestamp_ntz"))), at)
    assert {a for a, _ in actions(done).values()} == {"keep"}


def test_folders_are_listed_twice_a_run_by_few_tasks(spark, tmp_path):
    at, rows = str(tmp_path), [pair(n, 50.5) for n in range(1, 101)]
    emit.generate(sets(spark, rows), at)
    group, before = "emit-listing", spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    spark.sparkContext.setJobGroup(group, group)
    done, problems = emit.generate(sets(spark, [*rows, pair(7, 60.5)]), at)
    kept = {n: a for n, (a, _) in actions(done).items()}
    assert kept.pop(7) == "append" and set(kept.values()) == {"keep"} and len(kept) == 99 and problems.count() == 0
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    most = 4 * spark.sparkContext.defaultParallelism
    assert 100 > most >= max(s.numTasks for s in stages if s)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before


def test_small_files_are_written_by_all_tasks(spark, tmp_path):
    rows = [pair(n, 50.5) for n in range(1, 101)]
    emit.write_objects(sets(spark, rows), str(tmp_path))
    tasks = {f.name.split("-")[1] for n in range(1, 101) for f in Path(tmp_path, "objects", f"norad={n}").glob("*.txt")}
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(len(text_of(tmp_path, n)) == 2 for n in range(1, 101))


def test_messages_beside_the_text(spark, tmp_path):
    at, rows = str(tmp_path), [pair(n, 50.5 + d) for n in (1, 2, 3) for d in range(2)]
    emit.generate(sets(spark, rows, fields=True), at)
    names = lambda kind: sorted((r["OBJECT_NAME"], str(r[0])) for r in spark.read.csv(f"{at}/{kind}_messages", header=True).select({"objects": "norad", "dates": "epoch_date"}[kind], "OBJECT_NAME").collect())
    assert names("objects") == [("N1", "1")] * 2 + [("N3", "3")] * 2
    assert names("dates") == [("N1", "2024-02-19"), ("N1", "2024-02-20"), ("N3", "2024-02-19"), ("N3", "2024-02-20")]
    emit.generate(sets(spark, [*rows, pair(1, 60.5)], fields=True), at)
    assert names("objects") == [("N1", "1")] * 3 + [("N3", "3")] * 2


def held_sets(spark):
    rows = store.typed_sets(spark.createDataFrame([pair(1, 50.5), pair(1, 52.5), pair(2, 50.5)], "line1 string, line2 string"))[0]
    return switching.midpoint_windows(rows, tie=("line_hash",)).select("norad", "epoch", "mm", "ecc", "inc", "raan", "aop", "ma", "bstar", "valid_from", "valid_to")


def test_a_stream_of_times_is_propagated(spark, tmp_path):
    times = "norad int, t timestamp_ntz"
    batches = [[(1, "2024-02-19 12:00:00"), (2, "2024-02-20 00:00:00")], [(1, "2024-02-25 00:00:00"), (3, "2024-02-20 00:00:00"), (1, None)]]
    rows = [spark.createDataFrame(b, "norad int, t string").withColumn("t", F.col("t").cast("timestamp_ntz")) for b in batches]
    held = held_sets(spark)
    for b in rows:  # two triggers with one checkpoint
        b.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(times).parquet(str(tmp_path / "in"))
        out = streams.propagated(stream, held, ("lla", "mag_total"))
        out.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["norad"], r["t"], r["epoch"], r["lat"], r["b_total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    static = propagate.generate(switching.assign(rows[0].unionByName(rows[1]), held), ("lla", "mag_total"))
    want = sorted((r["norad"], r["t"], r["epoch"], r["lat"], r["b_total"]) for r in static.collect())
    assert len(got) == 3 and [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3:] == pytest.approx(w[3:]) for g, w in zip(got, want, strict=True))


def test_files_that_arrive_go_to_the_store_and_the_output(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    s = store.Store(spark, str(tmp_path / "store"))
    s.init()

    def arrive(name, *pairs):
        (folder / name).write_text("\n".join(x for p in pairs for x in p) + "\n")
        streams.ingest_files(spark, str(folder), s, str(tmp_path / "c"), out).awaitTermination()

    arrive("a.tle", pair(1, 50.5), pair(1, 51.5), pair(2, 50.5))
    assert s.table("sets").count() == 3 and [len(text_of(out, n)) for n in (1, 2)] == [4, 2]
    second = Path(out, "objects", "norad=2")
    before = {f.name: f.stat().st_mtime_ns for f in second.glob("*.txt")}
    arrive("b.tle", pair(1, 51.0), pair(1, 53.5))  # a late set, and a new one
    assert s.table("sets").count() == 5 and len(text_of(out, 1)) == 8
    assert {f.name: f.stat().st_mtime_ns for f in second.glob("*.txt")} == before
    # a batch that runs again, as after a lost checkpoint, adds nothing
    streams.ingest_files(spark, str(folder), s, str(tmp_path / "again"), out).awaitTermination()
    assert s.table("sets").count() == 5 and [len(text_of(out, n)) for n in (1, 2)] == [8, 2]
    assert sorted(os.listdir(Path(out, "dates")))[-1].startswith("epoch_date=2024-02-22")
    assert records(1)


def test_the_text_of_sets_is_made_once(spark, monkeypatch):
    """Both runs of generate read kept sets, not the events."""
    from orbitlake.plans import store_queries as q

    seen = []
    monkeypatch.setattr(q, "_STORES", {})
    monkeypatch.setattr(q.emit, "generate", lambda sets, path, **k: seen.append(sets) or (None, None))
    sf = "/root/testdata/sf0.001"
    q._generated(spark, sf)
    assert len(seen) == 2 and not any("events.parquet" in f for s in seen for f in s.inputFiles())
    made = q.elements(spark, sf).select("id", "norad", "epoch", "line1", "line2", q.F.col("ts").cast("timestamp_ntz").alias("created"))
    assert seen[1].schema == made.schema and seen[1].exceptAll(made).isEmpty() and made.exceptAll(seen[1]).isEmpty()
