"""Centroid clustering of integer vectors, screened by the norms of their segments.

A vector is compressed to the Euclidean norms of its segments, once. By the inequality of Cauchy and Schwarz the squared
distance of two vectors is at least the sum over segments of the squared difference of their norms, so most centroids are
ruled out by a short product of norms; only the others receive an exact distance in integers. A round is one pass over the
vectors: each task adds up its own vectors by cluster, and what leaves it is a number for each cluster and component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitlake.llm.common import dropped, lean, saved, small_batches

#: Clusters, rounds, components of a vector, and what components are multiplied by before they are rounded down.
CLUSTERS, ROUNDS, DIMENSION, SCALE = 8, 10, 64, 1024
#: Components of a segment.
SEGMENT = 8
#: Components of less than this size are squared and added in 64 bits, others as integers of any size.
SMALL = 1 << 24
#: Sums leave a task in digits of so many bits, so that a 64-bit sum over all tasks is exact whatever the components.
LIMB = 40
_LONG = 1 << 63


def kept(vectors: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """vec_id, x (array<double>): the vectors (vec_id, embedding) with exactly `dimension` components, none null or non-finite."""
    x = vectors["embedding"].cast("array<double>")
    v = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), x.alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return v.where((F.size("x") == dimension) & F.coalesce(finite, F.lit(False)))


def seeds(vectors: DataFrame, n: int) -> list[list[float]]:
    """The n vectors (vec_id, x) with the smallest SHA-256 of 3:<vec_id>, ties to the smaller vector; a null id counts as empty."""
    key = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [r["x"] for r in vectors.select(key.alias("key"), "x").orderBy("key", "x").limit(n).collect()]


def whole(x: float, scale: int) -> int:
    """floor(scale * x) of a finite x."""
    return math.floor(scale * x) if abs(x) < 2.0**900 else int(x) * scale


def norms(q: np.ndarray, segment: int) -> np.ndarray:
    """The norm of each segment of each row."""
    n, d = q.shape
    padded = np.zeros((n, -(-d // segment) * segment))
    padded[:, :d] = q
    return np.sqrt((padded.reshape(n, -1, segment) ** 2).sum(2))


class Centroids:
    """The centroids of a round: exact components, the same as floats' norms, and whether all components are small."""

    def __init__(self, rows: list[list[int]], segment: int):
        self.rows = rows
        self.small = np.array([all(-SMALL < c < SMALL for c in r) for r in rows], np.bool_)
        self.q = np.array([r if s else [0] * len(r) for r, s in zip(rows, self.small, strict=True)], np.int64).reshape(len(rows), -1)
        with np.errstate(over="ignore"):
            self.norms = norms(np.array([[float(c) for c in r] for r in rows]), segment)

    def bounds(self, own: np.ndarray) -> np.ndarray:
        """For rows of norms, a lower bound of the squared distance to each centroid, less what rounding may add to it."""
        with np.errstate(all="ignore"):
            squares = (own**2).sum(1)[:, None] + (self.norms**2).sum(1)[None, :]
            return squares - 2 * (own @ self.norms.T) - 1e-9 * squares - 1

    def nearest(self, x: np.ndarray, own: np.ndarray, scale: int) -> tuple[np.ndarray, list]:
        """The nearest centroid of each row and the squared distance, ties to the smaller number. own: norms of the rows."""
        with np.errstate(over="ignore"):
            scaled = np.floor(x * scale)
        plain = (np.abs(scaled) < SMALL).all(1)
        q = np.where(plain[:, None], scaled, 0).astype(np.int64)
        low = self.bounds(own)
        best, cluster = np.full(len(x), _LONG - 1), np.zeros(len(x), np.int64)
        # the centroid of the least bound first: its distance rules out most of the others
        first = np.argmin(np.where(np.isnan(low), np.inf, low), 1) if len(x) else cluster
        exact = plain & self.small[first]
        for j in np.unique(first[exact]).tolist():
            at = np.flatnonzero(exact & (first == j))
            best[at], cluster[at] = ((q[at] - self.q[j]) ** 2).sum(1), j
        odd = ~exact
        for j in range(len(self.rows)):
            open_ = ~odd & (first != j) & ~(low[:, j] > best)
            if not self.small[j]:
                odd |= open_
                continue
            at = np.flatnonzero(open_)
            d = ((q[at] - self.q[j]) ** 2).sum(1)
            won = (d < best[at]) | ((d == best[at]) & (j < cluster[at]))
            best[at[won]], cluster[at[won]] = d[won], j
        distance = best.tolist()
        for i in np.flatnonzero(odd).tolist():
            own_q = [whole(c, scale) for c in x[i].tolist()]
            distance[i], cluster[i] = min((sum((a - b) ** 2 for a, b in zip(own_q, c, strict=True)), j) for j, c in enumerate(self.rows))
        return cluster, distance


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))


def _limbs(n: int) -> Iterator[tuple[int, int]]:
    """A number as signed digits, the lowest first."""
    sign, n, k = (-1 if n < 0 else 1), abs(n), 0
    while n:
        yield k, sign * (n & ((1 << LIMB) - 1))
        n >>= LIMB
        k += 1


_SUMS = pa.schema([("cluster", pa.int32()), ("pos", pa.int32()), ("limb", pa.int32()), ("v", pa.int64())])


def _summer(centroids: Centroids, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a task's vectors by cluster: the sum of each component, and at position -1 how many there are."""
        k = len(centroids.rows)
        total, count = [[0] * len(r) for r in centroids.rows], [0] * k
        for b in batches:
            x = _matrix(b, "x")
            cluster, _ = centroids.nearest(x, _matrix(b, "norms"), scale)
            with np.errstate(over="ignore"):
                scaled = np.floor(x * scale)
            plain = (np.abs(scaled) < SMALL).all(1)
            for j in np.unique(cluster).tolist():
                mine = cluster == j
                count[j] += int(mine.sum())
                total[j] = [a + c for a, c in zip(total[j], scaled[mine & plain].astype(np.int64).sum(0).tolist(), strict=True)]
                for i in np.flatnonzero(mine & ~plain).tolist():
                    total[j] = [a + whole(c, scale) for a, c in zip(total[j], x[i].tolist(), strict=True)]
        rows = [(j, p, limb, v) for j in range(k) if count[j] for p, n in enumerate([*total[j], count[j]]) for limb, v in _limbs(n)]
        rows = [(j, -1 if p == len(total[j]) else p, limb, v) for j, p, limb, v in rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SUMS, strict=True)] if rows else [pa.array([], t.type) for t in _SUMS], schema=_SUMS)

    return run


def moved(vectors: DataFrame, centroids: list[list[int]], scale: int = SCALE, segment: int = SEGMENT) -> list[list[int]]:
    """One round: the floor of the mean of each centroid's vectors; a centroid without any stays.

    What comes to the driver is a few numbers for each cluster and component, added up by Spark before.
    """
    sums = vectors.mapInArrow(lean(_summer(Centroids(centroids, segment), scale)), "cluster int, pos int, limb int, v long")
    total: dict[tuple[int, int], int] = {}
    for r in sums.groupBy("cluster", "pos", "limb").agg(F.sum("v").alias("v")).collect():
        key = (r["cluster"], r["pos"])
        total[key] = total.get(key, 0) + (r["v"] << (LIMB * r["limb"]) if r["v"] >= 0 else -(-r["v"] << (LIMB * r["limb"])))
    return [[total.get((j, p), 0) // total[j, -1] for p in range(len(c))] if (j, -1) in total else c for j, c in enumerate(centroids)]


def prepared(vectors: DataFrame, dimension: int = DIMENSION, scale: int = SCALE, segment: int = SEGMENT) -> DataFrame:
    """vec_id, x, norms: the kept vectors with the norms of the segments of their scaled components, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with np.errstate(over="ignore"):
                own = norms(np.floor(_matrix(b, "x") * scale), segment)
            at = np.arange(0, own.size + 1, max(1, own.shape[1]) if b.num_rows else 1, dtype=np.int32)[: b.num_rows + 1]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.ListArray.from_arrays(pa.array(at), pa.array(own.ravel()))], names=["vec_id", "x", "norms"])

    return saved(kept(vectors, dimension).mapInArrow(lean(run), "vec_id long, x array<double>, norms array<double>"), "vectors")


def _assigner(centroids: Centroids, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, distance = centroids.nearest(_matrix(b, "x"), _matrix(b, "norms"), scale)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array([d if d < _LONG else None for d in distance], pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def assigned(vectors: DataFrame, centroids: list[list[int]], scale: int = SCALE, segment: int = SEGMENT) -> DataFrame:
    """vec_id, cluster, distance of prepared vectors: the nearest centroid, and the squared distance (null beyond 64 bits)."""
    return vectors.select("vec_id", "x", "norms").mapInArrow(lean(_assigner(Centroids(centroids, segment), scale)), "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, segment: int = SEGMENT) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance of each kept vector after `rounds` rounds and a last assignment, and the final centroids.

    Input: vec_id, embedding. Vectors that are null, of another length or with null or non-finite components take no part;
    repeated rows count as often as they come; with fewer than `clusters` vectors there are as many centroids; an empty table
    gives no rows and no centroids; other columns are ignored.
    """
    small_batches(vectors.sparkSession, 4096)
    base = prepared(vectors, dimension, scale, segment)
    centroids = [[whole(c, scale) for c in x] for x in seeds(base, clusters)]
    if not centroids:
        return base.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        new = moved(base, centroids, scale, segment)
        if new == centroids:  # every further round would give the same
            break
        centroids = new
    out = saved(assigned(base, centroids, scale, segment), "clusters")
    dropped(base)
    return out, centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clusters(vectors: DataFrame, **options: int) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept vector; see cluster().

    Inertias are sums of distances over the cluster and over all; they are null if a distance or the sum is beyond 64 bits.
    """
    found, centroids = cluster(vectors, **options)
    exact = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    by = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(exact.alias("d")).collect()}  # a row for each cluster
    fits = lambda d: int(d) if d is not None and d < _LONG else None
    every = fits(None if None in by.values() else sum(map(int, by.values())))
    rows = [(j, fits(by.get(j)), every, digest(c)) for j, c in enumerate(centroids)]
    known = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
