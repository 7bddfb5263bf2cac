"""The catalog store: typed Parquet tables in a shared folder, with ingest that may be repeated.

One writer at a time. `sets` and `messages` are partitioned by epoch_date, so a range of epochs reads its days alone, and every
range on a typed column reaches the scan. A batch is compared with the days it touches, by (epoch, line_hash), and what is
new is counted as it is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitlake.functions import tle
from orbitlake.operators import catalog
from orbitlake.operators.omm import OMM_FIELDS
from orbitlake.sources import files
from orbitlake.sources.shared import fresh_folder

_KEY = ["epoch", "line_hash"]
_ELEMENTS = (
    "norad int, epoch timestamp_ntz, mm double, ecc double, inc double, raan double, aop double, ma double, bstar double, ndot double, nddot double, "
    "sma double, period double, perigee double, apogee double, elnum int, revnum int"
)
SCHEMAS = {
    "sets": f"line1 string, line2 string, line_hash string, {_ELEMENTS}, object_id string, created timestamp_ntz, epoch_date date",
    "messages": "line_hash string, epoch timestamp_ntz, gp_id int, object_name string, fields map<string,string>, epoch_date date",
    "files": "path string, size bigint, modified timestamp, sha256 string",
}
_BY = {"sets": ["epoch_date"], "messages": ["epoch_date"], "files": []}


def typed_sets(pairs: DataFrame, created: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the table `sets` from line1 and line2, and the pairs that can't be read."""
    l1, l2 = F.col("line1"), F.col("line2")
    made = F.current_timestamp().cast("timestamp_ntz") if created is None else created
    columns = {**tle.element_columns(l1, l2), "object_id": tle.object_id(l1), "created": made, "epoch_date": F.to_date(tle.epoch(l1))}
    rows = pairs.select("line1", "line2", tle.line_hash(l1, l2).alias("line_hash"), *(c.alias(n) for n, c in columns.items()))
    good = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in ("norad", "epoch", "mm", "ecc", "inc")))
    return rows.where(good), rows.where(~good).select("line1", "line2")


#: Parts of a day that are written by tasks of their own: a day may hold a large share of all rows.
PARTS = 16


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of one day and part of it in one task, by the hash of their lines, without a reading to find ranges."""
    return rows.withColumn("_part", F.pmod(F.xxhash64("line_hash"), F.lit(PARTS))).repartition("epoch_date", "_part")


class Store:
    """A catalog in one folder. `Store.open(..., readonly=True)` has no way to write."""

    def __init__(self, spark: SparkSession, path: str, readonly: bool = False):
        self.spark, self.path, self.readonly = spark, path.rstrip("/"), readonly

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def init(self, drop: bool = False) -> dict[str, list[str]]:
        """Makes the tables that are missing, after dropping all if asked: names dropped, created and existing."""
        self._writable()
        there = [n for n in SCHEMAS if self._exists(n)]
        dropped = there if drop else []
        for n in dropped:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(n))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        made = [n for n in SCHEMAS if n not in there or drop]
        for n in made:
            self._append(n, self.spark.createDataFrame([], SCHEMAS[n]))
        return {"dropped": dropped, "created": made, "existing": [n for n in there if not drop]}

    @classmethod
    def open(cls, spark: SparkSession, path: str, readonly: bool = True) -> Store:
        """A store whose tables all exist, else FileNotFoundError."""
        store = cls(spark, path, readonly)
        if missing := [n for n in SCHEMAS if not store._exists(n)]:
            raise FileNotFoundError(f"{path} lacks {', '.join(missing)}; init makes them")
        return store

    def _writable(self) -> None:
        if self.readonly:
            raise PermissionError(f"{self.path} was opened to be read only")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(self._at(name))

    def _append(self, name: str, rows: DataFrame, dealt: bool = False) -> int:
        """Writes rows to a table; how many, as the write itself counts them."""
        if _BY[name] and not dealt:
            rows = _dealt(rows)
        columns = [f.name for f in T._parse_datatype_string(SCHEMAS[name]).fields]
        written = Observation()
        rows.select(*columns).observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(*_BY[name]).parquet(self._at(name))
        return written.get.get("n") or 0

    def _of_days(self, name: str, rows: DataFrame) -> DataFrame:
        """What a table has of the days that rows touch."""
        return self.table(name).join(rows.select("epoch_date").distinct(), "epoch_date", "left_semi")

    def _new(self, pairs: DataFrame, created: Column | None) -> DataFrame:
        """Rows of a batch of pairs that the days it touches lack; of equal pairs the first by its time.

        Pairs meet what is stored in the one shuffle that deals them for writing; their elements are read after it."""
        l1, l2 = F.col("line1"), F.col("line2")
        made = F.current_timestamp().cast("timestamp_ntz") if created is None else created
        batch = pairs.where(tle.epoch(l1).isNotNull()).select("line1", "line2", made.alias("created"), tle.epoch(l1).alias("epoch"), tle.line_hash(l1, l2).alias("line_hash"), F.to_date(tle.epoch(l1)).alias("epoch_date"), F.lit(1).alias("_new"))
        none = (F.lit(None).cast(t).alias(c) for c, t in (("line1", "string"), ("line2", "string"), ("created", "timestamp_ntz")))
        held = self._of_days("sets", batch).select(*none, *_KEY, "epoch_date", F.lit(0).alias("_new"))
        first = F.row_number().over(Window.partitionBy("epoch_date", "_part", *_KEY).orderBy("_new", "line1", "line2", "created"))
        rows = _dealt(batch.unionByName(held)).withColumn("_n", first).where("_n = 1 and _new = 1")
        return typed_sets(rows.select("line1", "line2", "created"), F.col("created"))[0]

    def ingest_pairs(self, pairs: DataFrame, created: Column | None = None) -> int:
        """Adds pairs that aren't stored; returns how many were new. Pairs that can't be read are left out."""
        self._writable()
        return self._append("sets", self._new(pairs, created), dealt=True)

    def ingest_messages(self, records: DataFrame) -> int:
        """Adds the sets of message records, and a message for each set that has none; returns how many sets were new.

        Records without both lines are left out. Of records for one set in a batch, the last by GP_ID holds, then by content.
        """
        self._writable()
        for c in ("TLE_LINE1", "TLE_LINE2", "GP_ID", "OBJECT_NAME"):
            if c not in records.columns:
                records = records.withColumn(c, F.lit(None).cast("string"))
        lines = [F.col("TLE_LINE1"), F.col("TLE_LINE2")]
        whole = records.where(lines[0].isNotNull() & lines[1].isNotNull())
        keys = [F.lit(f) for f in sorted(c for c in records.columns if not c.startswith("TLE_"))]
        fields = F.map_filter(F.map_from_arrays(F.array(*keys), F.array(*(F.col(c).cast("string") for c in sorted(records.columns) if not c.startswith("TLE_")))), lambda k, v: v.isNotNull())
        m = whole.select(
            tle.line_hash(*lines).alias("line_hash"), tle.epoch(lines[0]).alias("epoch"), F.col("GP_ID").try_cast("int").alias("gp_id"),
            F.col("OBJECT_NAME").alias("object_name"), fields.alias("fields"), F.to_date(tle.epoch(lines[0])).alias("epoch_date"),
        ).where("epoch is not null")
        added = self.ingest_pairs(whole.select(lines[0].alias("line1"), lines[1].alias("line2")))
        last = catalog.last_wins(m, "line_hash", F.struct("gp_id", F.to_json("fields")))
        have, known = (self._of_days(n, m).select(*_KEY) for n in ("sets", "messages"))
        self._append("messages", last.join(have, _KEY, "left_semi").join(known, _KEY, "left_anti"))
        return added

    def ingest_file(self, path: str) -> int:
        """Adds a file or folder of one format; returns how many sets were new."""
        kind = files.detect_format(path)
        if kind == "tle":
            from orbitlake.sources.text import read_pairs

            return self.ingest_pairs(read_pairs(self.spark, path).select("line1", "line2"))
        return self.ingest_messages(files.read_omm(self.spark, path, kind))

    def ingest_folder(self, path: str, force: bool = False) -> tuple[DataFrame, int]:
        """Adds the files of a folder that are new or changed: (path, status of each file; how many sets were new).

        Files of one format are read together. State is recorded after their rows, so a failed run is repeated by the next.
        """
        self._writable()
        known = self.table("files")
        states = files.changed_files(self.spark, path, known.where(F.lit(not force)))
        at = fresh_folder(self.spark, "seen")
        states.write.parquet(at)
        seen = self.spark.read.parquet(at)
        todo = [r["path"] for r in seen.where("status in ('new', 'changed')").select("path").toLocalIterator()]
        added = 0
        for kind in sorted({files.detect_format(p) for p in todo}):
            chosen = [p for p in todo if files.detect_format(p) == kind]
            if kind == "tle":
                from orbitlake.sources.text import read_pairs

                added += self.ingest_pairs(read_pairs(self.spark, chosen).select("line1", "line2"))
            else:
                added += self.ingest_messages(files.read_omm(self.spark, chosen, kind))
        keep = known.join(seen, "path", "left_anti").unionByName(seen.drop("status"))
        self._replace_files(keep)
        return seen.select("path", "status"), added

    def _replace_files(self, rows: DataFrame) -> None:
        # the list of files is read before it is written: by way of another folder
        at = fresh_folder(self.spark, "files")
        rows.write.parquet(at)
        self.spark.read.parquet(at).write.mode("overwrite").parquet(self._at("files"))

    def sets_of(self, norad: int) -> DataFrame:
        """All sets of an object in the order of epoch."""
        return self.table("sets").where(F.col("norad") == norad).orderBy("epoch", "line_hash")

    def between(self, start: Column, stop: Column) -> DataFrame:
        """Sets in [start, stop); only the days in question are read."""
        day = F.col("epoch_date")
        return self.table("sets").where((day >= F.to_date(start)) & (day <= F.to_date(stop)) & (F.col("epoch") >= start) & (F.col("epoch") < stop))

    def named(self) -> DataFrame:
        """Sets that have a message, with its name."""
        return self.table("sets").join(self.table("messages").select(*_KEY, "object_name", "fields"), _KEY)

    def dump(self, path: str) -> tuple[int, int]:
        """Element text and, if there are any, messages as lines of JSON, in order of object and epoch: their numbers."""
        sets = self.table("sets")
        files.dump(sets.withColumnRenamed("line_hash", "id"), f"{path}/sets")
        named = self.named()
        n = named.count()
        if n:
            out = named.select("norad", "epoch", "line_hash", F.to_json("fields").alias("value"))
            out.repartitionByRange("norad", "epoch", "line_hash").sortWithinPartitions("norad", "epoch", "line_hash").select("value").write.mode("overwrite").text(f"{path}/messages")
        return sets.count(), n


def load_sets(spark: SparkSession, name: str, folder: str = ".", store: str | None = None) -> DataFrame:
    """Sets by a path, by the name or id of a file in a folder, or by an object's id in the store, in this order; else LookupError.

    Rows are those of the table `sets`; what can't be read of a file is left out.
    """
    from orbitlake.sources.text import read_pairs

    if at := files.find_file(spark, name, folder):
        return typed_sets(read_pairs(spark, at, "lenient"))[0]
    if store and files.is_catalog_id(name):
        return Store.open(spark, store).sets_of(files.to_satnum(name))
    raise LookupError(f"no sets by the name of {name}: looked for {', '.join([name, *files.candidate_names(name)])} in {folder}")


def write_omm_csv(messages: DataFrame, path: str) -> None:
    """The fields of a message file, in order, under a header; other columns are left out. Nothing is written without rows."""
    if not messages.isEmpty():
        messages.select(*OMM_FIELDS).write.mode("overwrite").csv(path, header=True)


def status_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count("*").alias("n"))


def page(sets: DataFrame, after: dict | None = None, size: int = 50_000, order: tuple[str, ...] = ("norad", "epoch", "id")) -> DataFrame:
    """The next rows in the order of a key, after a given one; the key's order is total, so pages tile the table."""
    if after is not None:
        past, same = F.lit(False), F.lit(True)
        for c in order:
            at = F.lit(after[c]) if not isinstance(after[c], Column) else after[c]
            past, same = past | (same & (F.col(c) > at)), same & (F.col(c) == at)
        sets = sets.where(past)
    return sets.orderBy(*order).limit(size)


def first_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key, with its place: by order. Partial top-1, then a range sort of what is left."""
    from orbitlake.sources.text import place_in_order

    least = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("_o")).select(key, *(F.col(f"_o.{c}").alias(c) for c in order))
    return place_in_order(least, *order)
