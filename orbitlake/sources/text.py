"""Element text files: reading pairs of lines in order, and writing them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitlake.sources.shared import fresh_folder


_PAIRED = pa.schema([("path", pa.string()), ("place", pa.int64()), ("line1", pa.string()), ("line2", pa.string()), ("edge", pa.bool_())])


def _paired(two: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of neighbouring lines (path, block, line) of each split as it streams by; and, for each split, an edge: its last
        line if that is a first line of a set, and its first line if that is a second one."""
        key, n, first, last = None, 0, None, None

        def edge() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"path": key[0], "place": key[1], "line1": last, "line2": first, "edge": True}], schema=_PAIRED)

        for b in batches:
            path, block, line = b.columns
            where = pa.array(np.asarray(block)), path.dictionary_encode().indices
            ends = np.flatnonzero(np.logical_or.reduce([np.diff(np.asarray(x)) != 0 for x in where])) + 1
            for i, j in zip([0, *ends.tolist()], [*ends.tolist(), b.num_rows], strict=True):
                if i == j:
                    continue
                here = (path[i].as_py(), block[i].as_py())
                own = line.slice(i, j - i)
                second = np.asarray(pc.starts_with(own, two))
                if here != key:
                    if key is not None:
                        yield edge()
                    key, n, last = here, 0, None
                    first = own[0].as_py() if second[0] else None
                at = np.flatnonzero(second[1:] & ~second[:-1]) + 1
                rows = [own.take(pa.array(at - 1)), own.take(pa.array(at)), pa.array(here[1] + n + at)]
                if last is not None and second[0]:  # the set's first line came in the batch before
                    rows = [pa.concat_arrays([pa.array([x], c.type), c]) for x, c in zip((last, own[0].as_py(), here[1] + n), rows, strict=True)]
                one, other, place = rows
                if len(place):
                    yield pa.RecordBatch.from_arrays([pa.array([here[0]] * len(place)), place, one, other, pa.array([False] * len(place))], schema=_PAIRED)
                n, last = n + j - i, None if second[-1] else own[-1].as_py()
        if key is not None:
            yield edge()

    return run


def read_pairs(spark: SparkSession, path: str | list[str], mode: str = "strict") -> DataFrame:
    """path, place, line1, line2 of each pair. strict wants a blank after the line number, lenient doesn't.

    Blank lines are skipped, a first line that another follows is replaced, a second line without a first is dropped. place grows
    along a file. A file may be split: lines are paired inside each split as it is read, without a shuffle, and only the first
    and the last line of each split meet their neighbours'. Both come from one reading, which is kept in the shared folder,
    so that another reading in other splits can't fall between them.
    """
    if mode not in ("strict", "lenient"):
        raise ValueError(f"mode {mode!r} is neither strict nor lenient")
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.rtrim("value").alias("line"))
    one, two = ("1 ", "2 ") if mode == "strict" else ("1", "2")
    t = t.where(F.col("line").startswith(one) | F.col("line").startswith(two))
    at = fresh_folder(spark, "pairs")
    t.mapInArrow(_paired(two), "path string, place long, line1 string, line2 string, edge boolean").write.partitionBy("edge").parquet(at)
    rows = spark.read.schema("path string, place long, line1 string, line2 string, edge boolean").parquet(at)
    edges = rows.where("edge")  # two lines of each split
    over = edges.withColumn("line1", F.lag("line1").over(Window.partitionBy("path").orderBy("place"))).where("line1 is not null and line2 is not null")
    return rows.where("not edge").unionByName(over).select("path", "place", "line1", "line2")


def place_in_order(rows: DataFrame, *columns: str) -> DataFrame:
    """With place, the row's number in the order of columns. Rows are sorted by range and saved once; only counts of partitions meet."""
    at = fresh_folder(rows.sparkSession, "ordered")
    ordered = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    # the lower 33 bits of the id count the rows of a partition
    ordered.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("_n")).write.parquet(at)
    per = rows.sparkSession.read.parquet(at)
    sizes = per.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return per.join(F.broadcast(before), "_p").withColumn("place", F.col("_n") + F.col("_b") + 1).drop("_p", "_n", "_b")


def write_pairs(pairs: DataFrame, path: str, key: str | None = None, dedup: bool = True) -> None:
    """Pairs as text, in the order of satellite and epoch; a folder for each value of key, if one is given, whose files are in order.

    Rows are dealt by ranges of key and order, so a key with many rows is written by many tasks."""
    if dedup:
        pairs = pairs.dropDuplicates(["line1", "line2"])
    order = [F.substring("line1", 3, 5), F.translate(F.substring("line1", 19, 14), " ", "0")]
    if key is None:
        pairs.repartitionByRange(*order).sortWithinPartitions(*order).select(F.concat_ws("\n", "line1", "line2")).write.mode("overwrite").text(path)
    else:
        pairs.repartitionByRange(key, *order).sortWithinPartitions(key, *order).select(key, F.concat_ws("\n", "line1", "line2").alias("value")).write.mode("overwrite").partitionBy(key).text(path)
