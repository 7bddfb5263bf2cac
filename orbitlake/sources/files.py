"""Files of the catalog: formats by name, message readers, change detection, dumps, and small parsers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitlake.functions import tle
from orbitlake.sources.text import read_pairs

# Formats by extension; anything else holds element text.
FORMATS = {"tle": "tle", "txt": "tle", "3le": "tle", "json": "json", "csv": "csv", "xml": "xml"}
_CATALOG_ID = re.compile(r"^(?:[0-9]{1,9}|[A-HJ-NP-Z][0-9]{4})$", re.I)


def detect_format(path: str) -> str:
    return FORMATS.get(path.rpartition(".")[2].lower(), "tle")


def is_catalog_id(text: str) -> bool:
    return bool(_CATALOG_ID.match(text))


def to_satnum(text: str) -> int:
    """The number of a catalog id in digits or five characters."""
    if not is_catalog_id(text):
        raise ValueError(f"{text!r} is no catalog id")
    return int(text) if text.isdigit() else (tle.ALPHA5.index(text[0].upper()) + 10) * 10000 + int(text[1:])


def candidate_names(text: str) -> list[str]:
    """How an id may be spelt as a name: as typed, upper, as a number, in five characters."""
    out = [text, text.upper()]
    if is_catalog_id(text):
        n = to_satnum(text)
        five = f"{n:05d}" if n < 100000 else tle.ALPHA5[n // 10000 - 10] + f"{n % 10000:04d}" if n < 340000 else str(n)
        out += [str(n), five]
    return list(dict.fromkeys(out))


def find_file(spark: SparkSession, text: str, folder: str) -> str | None:
    """An existing path, or the first file in a folder that an id may name; None if there is none. Any store Spark can read."""

    def exists(path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    names = [text] + [f"{folder.rstrip('/')}/{n}{end}" for n in candidate_names(text) for end in ("", *(f".{x}" for x in FORMATS if FORMATS[x] == "tle"))]
    return next((n for n in names if exists(n)), None)


def _flat(columns: list[tuple[str, T.DataType, str]]) -> tuple[list[tuple[str, str]], list[str]]:
    """Leaves (field, path) of nested columns, and the paths of lists of named parameters."""
    leaves, named = [], []
    for name, kind, path in columns:
        if isinstance(kind, T.StructType):
            own, more = _flat([(f.name, f.dataType, f"{path}.`{f.name}`") for f in kind.fields])
            leaves, named = leaves + own, named + more
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and {"_VALUE", "_parameter"} <= set(kind.elementType.names):
            named.append(path)
        elif not name.startswith("_") and not isinstance(kind, T.ArrayType):
            leaves.append((name, path))
    return leaves, named


def _parameter(values: Column, name: str) -> Column:
    return F.get(F.filter(values, lambda x: x["_parameter"] == name), F.lit(0))["_VALUE"].cast("string")


#: Names that parameters of the user's own may have in a nested message: they become columns, so their number is bounded.
PARAMETERS_MAX = 1000


def flattened(messages: DataFrame) -> DataFrame:
    """A row for each message with its fields as text columns, whatever segments they stand in.

    Of fields with one name, the first that has a value holds. Parameters of the user's own (`USER_DEFINED parameter="X"`)
    become columns of their names.
    """
    leaves, named = _flat([(f.name, f.dataType, f"`{f.name}`") for f in messages.schema.fields])
    fields: dict[str, list[Column]] = {}
    for name, path in leaves:
        fields.setdefault(name, []).append(F.col(path).cast("string"))
    for path in named:
        keys = messages.select(F.explode(F.col(path)["_parameter"]).alias("k")).where("k is not null").distinct().limit(PARAMETERS_MAX + 1).collect()
        if len(keys) > PARAMETERS_MAX:
            raise ValueError(f"more than {PARAMETERS_MAX} names of parameters")
        for (k,) in sorted(keys):
            fields.setdefault(k, []).append(_parameter(F.col(path), k))
    return messages.select(*(F.coalesce(*cs).alias(n) for n, cs in fields.items()))


def read_omm(spark: SparkSession, path: str | list[str], kind: str | None = None) -> DataFrame:
    """Message records of files of one kind, all fields as text; JSON may be an object or an array, XML nested in segments."""
    kind = kind or detect_format(path if isinstance(path, str) else path[0])
    if kind == "json":
        return spark.read.json(path, multiLine=True, primitivesAsString=True)
    if kind == "csv":
        return spark.read.csv(path, header=True, enforceSchema=False) if isinstance(path, str) else _csv_together(spark, path)
    if kind == "xml":
        return flattened(spark.read.format("xml").option("rowTag", "omm").option("inferSchema", False).load(path))
    raise ValueError(f"{path} holds no messages")


def _csv_together(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files with headers of their own, those with one header read together."""
    head = spark.read.text(paths).select(F.input_file_name().alias("p"), "value", F.monotonically_increasing_id().alias("n"))
    heads = head.groupBy("p").agg(F.min_by("value", "n").alias("h")).groupBy("h").agg(F.collect_list("p").alias("ps")).collect()  # names of files, as in changed_files
    out = None
    for h in sorted(heads):
        part = spark.read.csv(h["ps"], header=True)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_catalog(spark: SparkSession, path: str, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (line1, line2, line_hash and element columns) and rejects (line1, line2) of a file or folder."""
    kind = kind or detect_format(path)
    if kind == "tle":
        pairs = read_pairs(spark, path).select("line1", "line2")
    else:
        pairs = read_omm(spark, path, kind).select(F.col("TLE_LINE1").alias("line1"), F.col("TLE_LINE2").alias("line2"))
    l1, l2 = F.col("line1"), F.col("line2")
    rows = pairs.select("line1", "line2", tle.line_hash(l1, l2).alias("line_hash"), *(c.alias(n) for n, c in tle.element_columns(l1, l2).items()))
    good = F.col("epoch").isNotNull() & F.col("norad").isNotNull() & F.col("mm").isNotNull() & F.col("ecc").isNotNull() & F.col("inc").isNotNull()
    return rows.where(good), rows.where(~good).select("line1", "line2")


def changed_files(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """path, size, modified, sha256, status of each file: new, changed, refreshed (same content) or skipped (same size and time).

    known: path, size, modified, sha256. Only files whose size or time differ are read; their names come to the driver, where
    Spark's own list of the folder is. A file must be smaller than 2 GB, the limit of the binary reader.
    """
    meta = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    k = known.select(F.col("path").alias("p"), F.col("size").alias("s"), F.col("modified").alias("m"), F.col("sha256").alias("old"))
    j = meta.join(k, F.col("path") == F.col("p"), "left").withColumn("same", F.coalesce((F.col("size") == F.col("s")) & (F.col("modified") == F.col("m")), F.lit(False)))
    done = j.where("same").select("path", "size", "modified", F.col("old").alias("sha256"), F.lit("skipped").alias("status"))
    differ = [r["path"] for r in j.where("not same").select("path").toLocalIterator()]
    if not differ:
        return done
    content = spark.read.format("binaryFile").load(differ).select("path", F.sha2("content", 256).alias("now"))
    hashed = j.where("not same").join(content, "path")
    state = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("now"), "refreshed").otherwise("changed")
    return done.unionByName(hashed.select("path", "size", "modified", F.col("now").alias("sha256"), state.alias("status")))


def times(spark: SparkSession, start: str, stop: str, step_seconds: float) -> DataFrame:
    """t from start while before stop, steps cut to microseconds; made in parallel."""
    step = int(step_seconds * 1e6)
    if step <= 0:
        raise ValueError("a step must be positive")
    a, b = F.to_timestamp_ntz(F.lit(start)), F.to_timestamp_ntz(F.lit(stop))
    n = spark.range(1).select(F.timestamp_diff("MICROSECOND", a, b)).first()[0]
    return spark.range(max(0, -(-n // step))).select(F.timestamp_add("MICROSECOND", F.col("id") * step, a).alias("t"))


def trace_times(spans: DataFrame, step_seconds: float) -> DataFrame:
    """Each span with t from start by steps; the last is at stop or less than a step beyond it."""
    step = int(step_seconds * 1e6)
    n = F.ceil(F.timestamp_diff("MICROSECOND", F.col("start"), F.col("stop")) / step).cast("long")
    k = F.explode(F.sequence(F.lit(0).cast("long"), n))
    return spans.where(F.col("stop") >= F.col("start")).withColumn("_k", k).withColumn("t", F.timestamp_add("MICROSECOND", F.col("_k") * step, F.col("start"))).drop("_k")


def wall_clock(text: Column) -> Column:
    """The instant as it is written: an offset from UTC is dropped, not applied."""
    return F.try_to_timestamp(F.regexp_replace(text, "(Z|[+-][0-9]{2}:?[0-9]{2})$", "")).cast("timestamp_ntz")


def site(text: Column) -> Column:
    """struct of name, lat, lon, alt from NAME:LAT:LON[:ALT]; null if it has fewer parts."""
    p = F.split(text, ":")
    s = F.struct(p[0].alias("name"), p[1].try_cast("double").alias("lat"), F.get(p, F.lit(2)).try_cast("double").alias("lon"), F.coalesce(F.get(p, F.lit(3)).try_cast("double"), F.lit(0.0)).alias("alt"))
    return F.when(F.size(p) >= 3, s)


def trace_spec(line: Column) -> Column:
    """struct of start, stop, sat and options from `start,stop,sat[,key=value...]`; null for blanks, comments and bad lines."""
    p = F.transform(F.split(line, ","), F.trim)
    start, stop = (F.try_to_timestamp(F.get(p, F.lit(k))).cast("timestamp_ntz") for k in (0, 1))
    opts = F.map_from_entries(F.transform(F.filter(F.slice(p, F.lit(4), F.size(p)), lambda x: x.contains("=")), lambda x: F.struct(F.substring_index(x, "=", 1), F.regexp_replace(x, "^[^=]*=", ""))))
    ok = ~line.startswith("#") & (F.size(p) >= 3) & (stop > start)
    return F.when(ok, F.struct(start.alias("start"), stop.alias("stop"), F.get(p, F.lit(2)).alias("sat"), opts.alias("options")))


def dump(sets: DataFrame, path: str) -> None:
    """All element text in the order of object, epoch and id, as files whose names sort in that order."""
    order = ["norad", "epoch", "id"]
    sets.repartitionByRange(*order).sortWithinPartitions(*order).select(F.concat_ws("\n", "line1", "line2")).write.mode("overwrite").text(path)
