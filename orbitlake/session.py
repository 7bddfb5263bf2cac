"""A local session with the settings that the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "orbitlake", cores: int | None = None, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the bench; a cluster brings its own."""
    n = cores or int(os.environ.get("BENCH_CPUS", "0")) or min(8, os.cpu_count() or 8)
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", os.environ.get("ORBITLAKE_WAREHOUSE", "/tmp/orbitlake-warehouse"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
