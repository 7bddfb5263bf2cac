"""Dictionaries of blocks of documents: what a block asks of the whole corpus, and the answers in the block's own order.

A token-level join would shuffle a row for each token. Instead, documents are bundled into compressed blocks as they are
read, a block asks for each of its distinct keys once, and the requests and answers travel as packed arrays: one row for
each block and key range. Blocks hold a bounded number of bytes unless a single document is larger.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.llm.common import arrow_rows, lean

#: Bytes of text of a block, unless its user says otherwise.
BLOCK_BYTES = 4 << 20
#: Bytes of text whose requests one key range holds, about, and the least number of ranges.
RANGE_BYTES, RANGES_MIN = 64 << 20, 256
_BUNDLES = pa.schema([("block", pa.int64()), ("fold", pa.int32()), ("data", pa.binary())])
_REQUESTS = pa.schema([("kind", pa.int32()), ("k", pa.int64()), ("block", pa.int64()), ("fold", pa.int32()), ("data", pa.binary())])


def pack(*arrays: np.ndarray | bytes, level: int = 1) -> bytes:
    """Arrays and bytes, compressed together."""
    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    head = struct.pack(f"<{len(raw) + 1}q", len(raw), *map(len, raw))
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(raw))


def unpack(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = struct.unpack_from("<q", raw)[0]
    sizes = struct.unpack_from(f"<{n}q", raw, 8)
    out, at = [], 8 * (n + 1)
    for s in sizes:
        out.append(raw[at : at + s])
        at += s
    return out


def pack_docs(ids: list[int | None], texts: list[str | None]) -> bytes:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return pack(
        np.array([i if i is not None else 0 for i in ids], np.int64), np.array([i is None for i in ids], np.bool_), np.array([len(r) for r in raw], np.int64), b"".join(raw),
        level=3,
    )


def unpack_docs(data: bytes) -> Iterator[tuple[int | None, str]]:
    ids, none, sizes, text = unpack(data)
    at = 0
    for i, n, s in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(none, np.bool_).tolist(), np.frombuffer(sizes, np.int64).tolist(), strict=True):
        yield (None if n else i), text[at : at + s].decode("utf-8", "surrogatepass")
        at += s


def steady_splits(spark: SparkSession) -> None:
    """From now on files are split alike at every reading in this session: as many tasks are aimed at as there are cores now,
    whatever executors are lost or added. It stays set, since plans run later; a setting of the user's own is kept."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism))


def ranges(docs: DataFrame) -> int:
    """Key ranges for the requests of docs, so that a range's share is bounded whatever the input."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(RANGES_MIN, -(-total // RANGE_BYTES))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, int, list, list]]:
    """Number, fold, ids and texts of each block of a partition: as many documents of one fold as make `size` bytes.

    A block's number is its partition and its place in it, so a task that runs again makes the same blocks.
    """
    base, n = TaskContext.get().partitionId() << 24, 0
    held: dict[int, list] = {}
    for i, text, f in arrow_rows(batches, "doc_id", "text", "fold"):
        own = held.setdefault(f, [[], [], 0])
        own[0].append(i), own[1].append(text or "")
        own[2] += len(text or "")
        if own[2] >= size:
            n += 1
            yield base + n, f, *held.pop(f)[:2]
    for f in sorted(held):
        n += 1
        yield base + n, f, *held.pop(f)[:2]


def bundled(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """block, fold, data: documents (doc_id, text, fold) in compressed blocks of one fold each. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, f, ids, texts in _blocks(batches, size):
            yield pa.RecordBatch.from_pylist([{"block": block, "fold": f, "data": pack_docs(ids, texts)}], schema=_BUNDLES)

    return docs.mapInArrow(lean(run), "block long, fold int, data binary")


def _asked(block: int, f: int, rows: Iterator[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"kind": a, "k": k, "block": block, "fold": f, "data": d} for a, k, d in rows], schema=_REQUESTS)


def requested(bundles: DataFrame, requests: Callable[[list[str]], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """kind, k, block, fold, data: what requests(texts) yields for each bundle: kind, key range, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, f, data in arrow_rows(batches, "block", "fold", "data"):
            yield _asked(block, f, requests([t for _, t in unpack_docs(data)]))

    return bundles.mapInArrow(lean(run), "kind int, k long, block long, fold int, data binary")


def requested_of(docs: DataFrame, requests: Callable[[list[str]], Iterator[tuple[int, int, bytes]]], size: int = BLOCK_BYTES) -> DataFrame:
    """The same of documents (doc_id, text, fold) themselves, in the blocks that bundled() makes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, f, _, texts in _blocks(batches, size):
            yield _asked(block, f, requests(texts))

    return docs.mapInArrow(lean(run), "kind int, k long, block long, fold int, data binary")
