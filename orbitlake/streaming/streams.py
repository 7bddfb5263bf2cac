"""Streaming forms: propagation of a stream of times, and ingest of arriving element sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orbitlake.operators import catalog, emit, propagate, switching
from orbitlake.operators.store import Store, typed_sets
from orbitlake.sources.text import read_pairs


def assigned(times: DataFrame, held: DataFrame, on: str = "norad", time: str = "t") -> DataFrame:
    """A stream of (on, time) with the window that holds: a stream-static join without state, so no watermark is needed."""
    return switching.assign(times, held, on, time)


def propagated(times: DataFrame, held: DataFrame, groups: tuple[str, ...] = ("ecef", "lla"), on: str = "norad", time: str = "t") -> DataFrame:
    """A stream of (on, time) with the groups of propagate.generate by the set that holds: stateless, in append mode.

    Each row depends on itself and the static sets alone, so a batch that runs again gives the same rows.
    """
    return propagate.generate(assigned(times, held, on, time), groups, time=time)


def ingest_files(spark: SparkSession, folder: str, store: Store, checkpoint: str, out: str | None = None, max_files: int = 1000) -> StreamingQuery:
    """Element text files that arrive in a folder go to the store, and, if `out` is given, the days and objects that they touch
    are written there again.

    Each trigger takes at most max_files new files, whose names come to the driver; their lines are read by read_pairs, so a
    file is best moved into the folder whole. A batch that runs again adds nothing, and late sets rewrite their object's files.
    """

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        paths = [r["path"] for r in batch.select("path").distinct().collect()]
        if not paths:
            return
        began = session.sql("select current_timestamp()").first()[0]
        pairs = read_pairs(session, paths, "lenient").select("line1", "line2")
        target = Store(session, store.path)
        target.ingest_pairs(pairs, F.lit(began).cast("timestamp_ntz"))
        if out is not None:
            touched = typed_sets(pairs)[0].select("norad", "epoch_date")
            sets = target.table("sets")
            emit.write_dates(sets.join(touched.select("epoch_date").distinct(), "epoch_date", "left_semi").withColumn("id", F.col("line_hash")), out)
            emit.write_objects(sets.join(touched.select("norad").distinct(), "norad", "left_semi"), out)

    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder).select(F.col("_metadata.file_path").alias("path"))
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(arriving: DataFrame, table: str, checkpoint: str, keys: tuple[str, ...] = ("epoch", "line_hash"), after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Append what a stream of element rows brings that the Parquet table at `table` lacks.

    A batch that runs again finds its rows stored, so at-least-once delivery is enough; late rows are never dropped. `after`
    gets each batch's new rows, to write the objects and days that they touch again. One writer a table.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        try:
            stored = spark.read.parquet(table)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            stored = None
        if stored is not None:
            days = batch.select(F.to_date("epoch").alias("epoch_date")).distinct()
            stored = stored.join(days, "epoch_date", "left_semi")  # only the days that the batch touches
        new = catalog.new_rows(batch, stored, keys).withColumn("epoch_date", F.to_date("epoch"))
        new.write.mode("append").partitionBy("epoch_date").parquet(table)
        if after is not None:
            after(new)

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
