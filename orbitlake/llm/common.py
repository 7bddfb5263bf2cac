"""What the text operators share: tables in the shared folder, words, shingles and Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
#: Rows up to which a counted frame of ids or numbers is broadcast.
BROADCAST_ROWS = 500_000
_OWN: dict[str, str] = {}
_MADE: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Without one, a temporary folder in local mode and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = own.get() if own.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="orbitlake-shared-")
        at = _OWN["dir"]
    return at.rstrip("/")


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage is cut and lost executors cost nothing.

    The files stay until dropped(), the end of a scoped() block or the end of the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._orbitlake_path = path
    return out


def _removed(path: str) -> None:
    spark = _MADE.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*frames: DataFrame | None) -> None:
    """Remove the files of frames made by saved() that are needed no more."""
    for df in frames:
        _removed(getattr(df, "_orbitlake_path", ""))


@contextmanager
def scoped() -> Iterator[None]:
    """On leaving, remove what saved() has made inside: for blocks that write their results themselves."""
    before = set(_MADE)
    try:
        yield
    finally:
        for path in set(_MADE) - before:
            _removed(path)


@atexit.register
def _all_removed() -> None:
    for path in list(_MADE):
        try:
            _removed(path)
        except Exception:  # the session may be gone: the folder's owner cleans up
            return


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A frame of few columns of ids or numbers, to be broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of few rows and bytes: texts have no length limit, so 10,000 of them have no memory limit."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: The C library's call that returns free memory, if it has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_BUSY = {"tasks": 0, "used": False, "watched": 0}


def released() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _watch() -> None:
    while True:
        time.sleep(0.5)
        if _BUSY["used"] and not _BUSY["tasks"]:
            _BUSY["used"] = False
            released()


@contextmanager
def working() -> Iterator[None]:
    """Around what a worker does. A worker stays for other tasks, and what it holds on to counts against them, so a thread
    gives its free memory back once it is idle; doing that after each group would cost more than the group."""
    if _BUSY["watched"] != os.getpid():
        _BUSY.update(watched=os.getpid(), tasks=0)
        threading.Thread(target=_watch, daemon=True).start()
    _BUSY["tasks"] += 1
    _BUSY["used"] = True
    try:
        yield
    finally:
        _BUSY["tasks"] -= 1


def lean(f: Callable) -> Callable:
    """A function for mapInArrow that leaves its worker small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with working():
            yield from f(batches)

    return run


def lean_group(f: Callable) -> Callable:
    """The same for applyInArrow over a group's batches."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with working():
            yield from f(key, batches)

    return run


def lean_pair(f: Callable) -> Callable:
    """The same for applyInArrow over two groups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        with working():
            return f(left, right)

    return run


def fold(key: F.Column | str, n: int, keep: int) -> F.Column:
    """Whether crc32(key as text) mod n is keep; a null key counts as empty text."""
    c = F.col(key) if isinstance(key, str) else key
    return (F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n) == keep


def words(text: str | None) -> list[bytes]:
    """Lower-case A-Z, then words [^\\x20\\x09-\\x0D]+, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen lately."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


#: Odd multipliers.
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S30, _S27 = np.uint64(30), np.uint64(27)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> _S30)) * _M2
    return x ^ (x >> _S27)


def shingles(h: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of the distinct runs of `size` words, ascending; fewer words make one run; none, none."""
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    out = np.full(n, np.uint64(min(size, len(h))), np.uint64)
    for j in range(min(size, len(h))):
        out = out * _M1 + h[j : j + n]
    return np.unique(mixed(out))


def arrow_rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values."""
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)


def typed(docs: DataFrame, **kinds: str) -> DataFrame:
    """The named columns alone, cast, so that extra columns of any name don't matter."""
    return docs.select(*(docs[c].cast(k).alias(c) for c, k in kinds.items()))
