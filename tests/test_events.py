"""Complementary states tile each span; nodes alternate; passes stay over the least elevation; the stream drops repeats."""

from pyspark.sql import functions as F

from orbitlake.plans import kernel_queries as k

SF = "/root/testdata/sf0.001"


def _tiled(spark, one, two):
    spans = {r["span"]: (r["start"], r["stop"]) for r in k.spans(spark, SF).collect()}
    by = {}
    for q in (one, two):
        for r in q(spark, SF).collect():
            by.setdefault(r["span"], []).append((r["start"], r["stop"]))
    assert by
    for s, rows in by.items():
        rows.sort()
        assert abs((rows[0][0] - spans[s][0]).total_seconds()) < 0.01 and abs((rows[-1][1] - spans[s][1]).total_seconds()) < 0.01
        assert all(abs((b[0] - a[1]).total_seconds()) < 0.01 for a, b in zip(rows, rows[1:]))


def test_sunlit_and_eclipse_tile(spark):
    _tiled(spark, k.sunlit, k.eclipse)


def test_ascending_and_descending_tile(spark):
    _tiled(spark, k.ascending, k.descending)


def test_nodes_alternate(spark):
    by = {}
    for r in k.nodes(spark, SF).collect():
        by.setdefault(r["span"], []).append((r["time"], r["ascending"]))
    for rows in by.values():
        rows.sort()
        assert all(a[1] != b[1] for a, b in zip(rows, rows[1:]))


def test_passes_are_above_the_least_elevation(spark):
    rows = k.passes(spark, SF).collect()
    assert rows and all(r["peak_elevation"] >= 4.99 and r["start"] <= r["peak_time"] <= r["stop"] for r in rows)


def test_stream_ingest_is_idempotent(spark, tmp_path):
    from orbitlake.functions import tle
    from orbitlake.plans.catalog_queries import element_text
    from orbitlake.streaming.streams import ingest

    t = element_text(spark, SF).select("id", "line1", "line2").limit(50)
    t.unionByName(t).write.parquet(str(tmp_path / "in"))
    for n in range(2):
        s = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
        s = s.withColumn("epoch", tle.epoch(F.col("line1"))).withColumn("line_hash", tle.line_hash(F.col("line1"), F.col("line2")))
        ingest(s, str(tmp_path / "table"), str(tmp_path / f"check{n}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 50


def test_every_set_is_scanned(spark):
    from orbitlake.plans.catalog_queries import elements

    sets = elements(spark, SF).where("norad is not null")
    lo, hi = sets.agg(F.min("ts"), F.max("ts")).first()
    objects = sets.select("norad").distinct().count()
    seconds = lambda d: sum((r["stop"] - r["start"]).total_seconds() for r in d.collect())
    assert abs(seconds(k.sunlit(spark, SF)) + seconds(k.eclipse(spark, SF)) - objects * (hi - lo).total_seconds()) < objects
    # a set that holds for more than two revolutions crosses the equator
    long = {r["id"] for r in k.windows(spark, SF).where("inc > 0").where(F.timestamp_diff("HOUR", F.col("start"), F.col("stop")) >= 5).collect()}
    assert len(long) > 10 * objects and long <= {r["span"] for r in k.nodes(spark, SF).select("span").distinct().collect()}


def test_passes_between_two_samples(spark):
    from orbitlake.operators.events import find_periods

    one = k.windows(spark, SF).where("mm < 14 and ecc < 0.05 and inc > 5").orderBy("id").limit(1)
    day = lambda shift: one.withColumn("span", F.lit(shift).cast("long")).withColumn("start", F.timestamp_add("SECOND", F.lit(shift), F.col("epoch"))).withColumn("stop", F.timestamp_add("HOUR", F.lit(30), F.col("start")))
    high = max(find_periods(day(0), "pass", site=(5.0, -80.65, 0.0, 5.0)).collect(), key=lambda r: r["peak"])
    spans = day(0)
    for s in range(5, 60, 5):
        spans = spans.unionByName(day(s))
    # seen above 0.05 degrees under its highest, which lasts for some seconds, wherever the samples are
    got = find_periods(spans, "pass", site=(5.0, -80.65, 0.0, 5.0 + high["peak"] - 0.05)).collect()
    assert sorted(r["span"] for r in got) == list(range(0, 60, 5))
    assert all(0 < (r["stop"] - r["start"]).total_seconds() < 60 and abs((r["peak_time"] - high["peak_time"]).total_seconds()) < 60 for r in got)
