"""Closest approaches ask few times, and find what all times would."""

import numpy as np

from orbitlake.kernels import sgp4
from orbitlake.operators import geometry


def test_few_times_are_asked():
    r = np.random.default_rng(3)
    n = 120
    e = [x for _ in range(2) for x in (r.uniform(11, 15.5, n), r.uniform(0, 0.02, n), np.linspace(1, 179, n), r.uniform(0, 360, n), np.full(n, 90.0), np.full(n, 10.0), np.zeros(n))]
    e[1][:5], e[7][5:9] = 0.4, 1.0027  # not near a circle, deep space
    gap, jd = r.uniform(1, 90000, n), 2460310.5 + r.uniform(0, 30, n)
    both = sgp4.Sets(*e[:7], jd), sgp4.Sets(*e[7:], jd + gap / 86400)
    asked = []
    apart = lambda row, t: asked.append(len(t)) or geometry._apart(both, gap[row], row, t)
    rows, m = np.arange(n), np.maximum(2, (gap / 60).astype(int) + 1)
    t, ok = geometry._nearest(rows, m, gap / (m - 1), geometry._smooth(e[:7], rows) & geometry._smooth(e[7:], rows), both, gap, apart)
    assert ok.all() and sum(asked) < 0.3 * m.sum()
    _, best, _ = geometry._least(rows, m, lambda i, place: gap[i] * place / (m[i] - 1), apart)
    assert (t == best).all()


def test_status_counts_days(spark):
    from orbitlake.plans import store_queries as s

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # days are then written by several tasks
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = {(r["run"], r["status"]): r["n"] for r in s.ingest_folder_status(spark, "/root/testdata/sf0.001").collect()}
        days = s.elements(spark, "/root/testdata/sf0.001").select(s.F.to_date("epoch")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == {(1, "new"): days, (2, "skipped"): days}


def test_ingest_shuffles_once(spark, tmp_path):
    from orbitlake.operators import store
    from orbitlake.plans.catalog_queries import element_text

    s = store.Store(spark, str(tmp_path))
    s.init()
    t = element_text(spark, "/root/testdata/sf0.001").select("line1", "line2")
    plan = s._new(t, None)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    # one for the rows, one for the days that they touch
    assert plan.count("Exchange hashpartitioning") <= 2 and "rangepartitioning" not in plan
    n = t.distinct().count()
    half = t.where(F_hash() % 2 == 0)
    first = s.ingest_pairs(half.unionByName(half))
    assert (first, s.ingest_pairs(t), s.ingest_pairs(t), s.table("sets").count()) == (half.distinct().count(), n - first, 0, n)


def F_hash():
    from pyspark.sql import functions as F

    return F.xxhash64("line1", "line2")
