"""Element text by day and by object: written where something changed, checked against the catalog.

Folders are partitions of Spark's text sink: `dates/epoch_date=...` holds the last set of each object on that day,
`objects/norad=...` an object's whole history. Files of an object are in order of epoch by their names within one write.
`manifest` keeps, for each object, what its files hold and how they look in the folder's list; while they look so, their
text isn't read again. Sets with message fields get CSV files of them beside the text, in `dates_messages` and
`objects_messages`, under the same partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.functions import tle
from orbitlake.operators import catalog
from orbitlake.operators.omm import OMM_FIELDS
from orbitlake.sources.shared import fresh_folder


#: Objects whose text is read by name; of more, all text is read and joined.
NAMED_MAX = 10_000
_MANIFEST = "norad int, lines bigint, tail_epoch timestamp_ntz, n_files bigint, bytes bigint, written_at timestamp_ntz"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@contextmanager
def _few_tasks(spark: SparkSession) -> Iterator[None]:
    """Frames that are loaded inside list their folders by a few tasks for each core; Spark alone takes one for each folder."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def kept(sets: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder once: what writes files reads its sets several times."""
    spark = sets.sparkSession
    at = fresh_folder(spark, "sets")
    sets.write.parquet(at)
    return spark.read.schema(sets.schema).parquet(at)


def _write_messages(rows: DataFrame, path: str, by: str, mode: str) -> None:
    """CSV of the message fields of sets that have any; rows may lack the column."""
    if "fields" in rows.columns:
        named = rows.where("fields is not null").select(by, *(F.col("fields")[f].alias(f) for f in OMM_FIELDS))
        named.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(by).csv(path, header=True)


def _write(rows: DataFrame, path: str, by: str, mode: str) -> None:
    rows.select(by, F.concat_ws("\n", "line1", "line2").alias("value")).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(by).text(path)


def write_dates(sets: DataFrame, path: str, dates: DataFrame | None = None) -> None:
    """Files of the given days, or of all: a day's files are replaced whole. A day holds at most one set of each object."""
    day = F.to_date("epoch")
    if dates is not None:
        sets = sets.join(dates.select(F.col("epoch_date").alias("_d")), day == F.col("_d"), "left_semi")
    rows = catalog.latest_per_object(sets.withColumn("epoch_date", day), F.col("epoch_date"))
    rows = rows.repartition("epoch_date").sortWithinPartitions("epoch_date", "norad")
    _write(rows, f"{path}/dates", "epoch_date", "overwrite")
    _write_messages(rows, f"{path}/dates_messages", "epoch_date", "overwrite")


def object_files(spark: SparkSession, path: str, norads: list[int] | None = None) -> DataFrame:
    """norad, lines, tail_epoch, written_at, intact of each object's files, or of those of some objects, by reading their text;
    no rows where none are."""
    if not _exists(spark, f"{path}/objects"):
        return spark.createDataFrame([], "norad int, lines bigint, tail_epoch timestamp_ntz, written_at timestamp_ntz, intact boolean")
    line = F.col("value")
    with _few_tasks(spark):
        text = spark.read.text(f"{path}/objects")
    text = text.select("norad", "value", F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("at"))
    if norads is not None:
        text = text.where(F.col("norad").isin(norads))
    one, two = line.startswith("1 ") & (F.length(line) == 69), line.startswith("2 ") & (F.length(line) == 69)
    g = text.groupBy(F.col("norad").cast("int").alias("norad")).agg(
        F.count("*").alias("lines"), F.max(F.when(one, tle.epoch(line))).alias("tail_epoch"), F.max("at").alias("written_at"),
        (F.count_if(one) == F.count_if(two)).alias("even"), (F.count_if(one) + F.count_if(two) == F.count("*")).alias("whole"),
    )
    return g.select("norad", "lines", "tail_epoch", "written_at", (F.col("even") & F.col("whole")).alias("intact"))


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """norad, n_files, bytes, written_at of each object's files as the folder lists them; nothing is read. The list is kept, one
    row an object, so that what uses it doesn't look at the files again."""
    if not _exists(spark, f"{path}/objects"):
        return spark.createDataFrame([], "norad int, n_files bigint, bytes bigint, written_at timestamp_ntz")
    with _few_tasks(spark):
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{path}/objects")
    at = fresh_folder(spark, "listing")
    listed.groupBy(F.col("norad").cast("int").alias("norad")).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"), F.max("modificationTime").cast("timestamp_ntz").alias("written_at")).write.parquet(at)
    return spark.read.parquet(at)


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def object_states(spark: SparkSession, path: str, listing: DataFrame | None = None) -> DataFrame:
    """What object_files says, from the manifest where an object's files look as they did when it was kept; only the text of
    others is read. listing: how the files look, if that has been listed already."""
    look = ["norad", "n_files", "bytes", "written_at"]
    listing, manifest = _listing(spark, path) if listing is None else listing, _manifest(spark, path)
    known = listing.join(manifest, look).select("norad", "lines", "tail_epoch", "written_at", F.lit(True).alias("intact"))
    others = listing.join(manifest.select(*look), look, "left_anti").select("norad")
    some = [r["norad"] for r in others.limit(NAMED_MAX + 1).collect()]
    if not some:
        return known
    read = object_files(spark, path, some) if len(some) <= NAMED_MAX else object_files(spark, path).join(others, "norad", "left_semi")
    return known.unionByName(read)


def _keep_manifest(spark: SparkSession, path: str, held: DataFrame, listing: DataFrame) -> None:
    """Replace the manifest by what the objects' files hold now (norad, lines, tail_epoch), one row for each."""
    at = fresh_folder(spark, "manifest")
    held.join(listing, "norad").select("norad", "lines", "tail_epoch", "n_files", "bytes", "written_at").write.parquet(at)
    spark.read.parquet(at).write.mode("overwrite").parquet(f"{path}/manifest")


def write_objects(sets: DataFrame, path: str) -> DataFrame:
    """Appends to, writes or rewrites each object's files; returns norad, action and n_new.

    Files that were damaged or are missing are written whole, as are those of an object that got a late set. Tasks follow
    ranges of (object, epoch), so an object with very many sets is written by many. The text of objects that nobody touched
    isn't read: the manifest knows it.
    """
    return _written(sets, path)[0]


def _written(sets: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """What write_objects does and returns, and how the files look afterwards."""
    spark = sets.sparkSession
    rows = sets.where(F.col("norad").isNotNull())
    state = object_states(spark, path).where("intact").select("norad", "lines", "tail_epoch", "written_at")
    # the state is read from the files that are about to be written: keep it, one row an object
    at, done = fresh_folder(spark, "state"), fresh_folder(spark, "actions")
    state.write.parquet(at)
    state = spark.read.parquet(at)
    catalog.output_actions(rows.select("norad", "epoch", "created"), state).write.parquet(done)
    actions = spark.read.parquet(done)
    j = rows.join(actions, "norad").join(state.select("norad", "tail_epoch", F.col("lines").alias("old_lines")), "norad", "left")
    # files are dear, rows are not: by size, adaptive execution would leave all objects to a few tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = lambda d: d.repartitionByRange(tasks, "norad", "epoch", "line1", "line2").sortWithinPartitions("norad", "epoch", "line1", "line2")
    for mode, part in (("overwrite", j.where("action in ('create', 'rewrite')")), ("append", j.where("action = 'append' and epoch > tail_epoch"))):
        _write(ordered(part), f"{path}/objects", "norad", mode)
        _write_messages(ordered(part), f"{path}/objects_messages", "norad", mode)
    whole = F.col("action").isin("create", "rewrite")
    added = F.count(F.when(whole | ((F.col("action") == "append") & (F.col("epoch") > F.col("tail_epoch"))), 1)) * 2
    new = j.where("action <> 'keep'").groupBy("norad").agg((added + F.coalesce(F.first(F.when(~whole, F.col("old_lines"))), F.lit(0))).alias("lines"), F.max("epoch").alias("tail_epoch"))
    listing = _listing(spark, path)
    _keep_manifest(spark, path, new.unionByName(state.select("norad", "lines", "tail_epoch").join(new.select("norad"), "norad", "left_anti")), listing)
    return actions, listing


def generate(sets: DataFrame, path: str, as_of: Column | None = None, window_days: int = 60, lookback_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Days in the window or with late rows (all, without as_of), then objects, then the check: actions and problems.

    The check goes by the manifest; catalog.verify_counts of object_files reads all text. The sets are read about ten times:
    kept() first, if they are dear to make."""
    dates = None if as_of is None else catalog.dates_to_write(sets, as_of, window_days, lookback_days)
    write_dates(sets, path, dates)
    actions, listing = _written(sets, path)
    return actions, catalog.verify_counts(object_states(sets.sparkSession, path, listing).select("norad", "lines"), sets)
