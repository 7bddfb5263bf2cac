"""Exact top-k inner products over vectors grouped by length.

Vectors are dealt out by range of length, longest first, and each range is cut into buckets. A query goes through a
range's buckets in order with the k-th best score so far. That score over the two lengths is the cosine that a vector of
the bucket must reach: above 1, the bucket is pruned by length; if it is high, a few of the query's largest coordinates
bound the rest (Cauchy and Schwarz) and prune by coordinate; else the bucket is multiplied in whole. Whatever survives is
verified by its integer product. Queries go in blocks of bounded size. A query's own row takes part in the search, for one
more place than asked for, and its place is taken out at the end.

Doubles hold those products exactly while two lengths multiply to less than 2**37. Vectors too long for that (WIDE) go
another way: doubles with an error bound choose the candidates, and Python integers of any size decide among them.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitlake.llm.common import dropped, lean, saved, typed

#: Queries of a block, so many are broadcast at once; vectors of a bucket; vectors of a range, about.
QUERY_BLOCK, BUCKET, RANGE = 8192, 1024, 16384
#: Local cosine threshold from which coordinates prune, and how many coordinates.
COSINE, FOCUS = 0.6, 16
#: Products are multiples of 2**-16, so they and their sums are exact in doubles below 2**37. Vectors of this length or more
#: are multiplied as integers.
WIDE = float(1 << 18)
#: From this size on, a double is a multiple of 1/256.
WHOLE = float(1 << 45)


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, q (array<double> of floor(256 x) / 256), length; without vectors that are null or hold null or non-finite components.

    A length may be infinite: the squares of large components overflow.
    """
    v = typed(vectors, vec_id="long", embedding="array<double>")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where("vec_id is not null and embedding is not null").where(~F.coalesce(bad, F.lit(True)))
    v = v.select("vec_id", F.transform("embedding", lambda x: F.when(F.abs(x) < WHOLE, F.floor(x * 256) / 256.0).otherwise(x)).alias("q"))
    return v.select("vec_id", "q", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)).alias("length"))


class Queries:
    """A block of queries, by dimension: all of them for integer products, first those that aren't wide, and these alone."""

    def __init__(self, rows: list[tuple[int, list[float], float, int]]):
        self.groups, self.all, self.rows, self.times, self.first = {}, {}, {}, {}, 0
        for d in {len(q) for _, q, _, _ in rows}:
            numbered = sorted(((i, q, n, m, at) for at, (i, q, n, m) in enumerate(rows) if len(q) == d), key=lambda x: x[2] >= WIDE)
            own = [x[:3] for x in numbered]
            self.times[d], self.rows[d] = [x[3] for x in numbered], [x[4] for x in numbered]
            narrow = sum(n < WIDE for _, _, n in own)
            q = np.array([q for _, q, _ in own], float).reshape(len(own), d)
            self.all[d] = (np.array([i for i, _, _ in own]), q, np.array([n for _, _, n in own], float), narrow)
            own, q = own[:narrow], q[:narrow]
            order = np.argsort(-np.abs(q), axis=1)[:, : min(FOCUS, d)]
            rest = np.sqrt(np.maximum(0, (q * q).sum(1) - (np.take_along_axis(q, order, 1) ** 2).sum(1)))
            self.groups[d] = (np.array([i for i, _, _ in own], np.int64), q, np.sqrt((q * q).sum(1)), order, rest)


class Best:
    """The k best of each query so far, by score and then by smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores and ids: a candidate in each column; -inf is none."""
        if scores.shape[1] > 4 * self.k:  # all that reach the k-th best, ties included
            cut = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k][:, None]
            widest = int((scores >= cut).sum(1).max())
            if widest <= 4 * self.k:
                top = np.argpartition(-scores, widest - 1, axis=1)[:, :widest]
                scores, ids = np.take_along_axis(scores, top, 1), np.take_along_axis(ids, top, 1)
        s = np.concatenate([self.score[rows], scores], 1)
        i = np.concatenate([self.id[rows], np.where(np.isfinite(scores), ids, np.iinfo(np.int64).max)], 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def scan(ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, queries: tuple, best: Best) -> None:
    """One bucket, longest vector first, against all queries of its dimension."""
    _, q, qlen, focus, rest = queries
    bound = lengths[0] if len(lengths) else 0.0
    floor = best.score[:, -1]
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(qlen * bound > 0, floor / (qlen * bound), np.where(floor > 0, np.inf, -np.inf))
    live = np.flatnonzero(cosine <= 1 + 1e-9)  # length pruning; equal scores still count for the smaller id
    by_coordinate = live[cosine[live] >= COSINE]
    whole = live[cosine[live] < COSINE]
    for x in by_coordinate:
        partial = vectors[:, focus[x]] @ q[x, focus[x]]
        left = np.sqrt(np.maximum(0, lengths**2 - (vectors[:, focus[x]] ** 2).sum(1)))
        c = np.flatnonzero(partial + left * rest[x] >= floor[x] - 1e-6 * (1 + qlen[x] * bound))
        if len(c):
            best.add(np.array([x]), (vectors[c] @ q[x])[None], ids[c][None])
    for at in range(0, len(whole), 512):
        rows = whole[at : at + 512]
        scores = q[rows] @ vectors.T
        best.add(rows, scores, np.broadcast_to(ids, scores.shape))


def whole(vector: np.ndarray) -> list[int]:
    """256 times each component, as Python integers."""
    return [int(x * 256) if abs(x) < WHOLE else int(x) * 256 for x in vector.tolist()]


class Exact:
    """The k best of each query among pairs whose products doubles can't hold, as integers of any size."""

    def __init__(self, queries: tuple, k: int):
        self.ids, self.q, self.lengths, _ = queries
        self.k = k
        self.best: dict[int, list[tuple[int, int]]] = {}  # row of the query: -score, id, best first
        self.floor = np.full(len(self.ids), -np.inf)  # no more than the k-th best
        self.whole: dict[int, list[int]] = {}

    def _pushed(self, x: int, found: list[tuple[int, int]]) -> None:
        own = self.best[x] = sorted(self.best.get(x, []) + found)[: self.k]
        if len(own) == self.k:
            try:
                self.floor[x] = np.nextafter(-own[-1][0] / 65536, -np.inf)
            except OverflowError:
                self.floor[x] = np.finfo(float).max if own[-1][0] < 0 else -np.inf

    def scan(self, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, first: int, last: int) -> None:
        """One bucket against the queries from first to last."""
        if first >= last or not len(ids):
            return
        # of equal vectors the k with the smallest ids
        order = np.lexsort((ids, np.unique(vectors, axis=0, return_inverse=True)[1].ravel())) if vectors.shape[1] else np.argsort(ids)
        same = np.concatenate([[False], (vectors[order][1:] == vectors[order][:-1]).all(1)])
        at = np.arange(len(order))
        order = order[at - np.maximum.accumulate(np.where(same, 0, at)) < self.k]
        ids, vectors, lengths = ids[order], vectors[order], lengths[order]
        seen: dict[int, list[int]] = {}
        for lo in range(first, last, 512):
            rows = np.arange(lo, min(last, lo + 512))
            with np.errstate(over="ignore", invalid="ignore"):
                about = self.q[rows] @ vectors.T
                # twice the bound of a sum's rounding; infinite or unknown where something overflows
                error = (vectors.shape[1] + 8) * 2.0**-52 * (self.lengths[rows][:, None] * lengths[None] + 1)
                low, high = about - error, about + error
            sure = np.isfinite(low) & np.isfinite(high)
            low, high = np.where(sure, low, -np.inf), np.where(sure, high, np.inf)
            cut = self.floor[rows]
            if len(ids) >= self.k:
                cut = np.maximum(cut, np.partition(low, len(ids) - self.k, axis=1)[:, -self.k])
            for r, x in enumerate(rows.tolist()):
                c = np.flatnonzero(high[r] >= cut[r]).tolist()
                if not c:
                    continue
                if x not in self.whole:
                    self.whole[x] = whole(self.q[x])
                for j in c:
                    if j not in seen:
                        seen[j] = whole(vectors[j])
                self._pushed(x, [(-sum(map(mul, self.whole[x], seen[j])), int(ids[j])) for j in c])


def _sortable(score: int) -> tuple[int | None, int, bytes]:
    """score if it has 64 bits, else None; two columns that sort scores of more bits around them, descending."""
    if -(1 << 63) <= score < 1 << 63:
        return score, 0, b""
    bits = abs(score).bit_length()
    return None, bits if score > 0 else -bits, (score % (1 << bits + 1)).to_bytes(bits // 8 + 1, "big")


_FOUND = pa.schema([("query", pa.int64()), ("times", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("size", pa.int32()), ("key", pa.binary()), ("own", pa.bool_())])


def _searcher(shared, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Queries = shared.value
        best = {d: Best(len(g[0]), k) for d, g in block.groups.items()}
        exact = {d: Exact(g, k) for d, g in block.all.items()}
        for b in batches:
            lists = b.column("q")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            ids, length = b.column("vec_id").to_numpy(), b.column("length").to_numpy()
            flat, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
            for d in np.unique(sizes):
                if d not in best:
                    continue
                rows = np.flatnonzero(sizes == d)
                v = flat[(ends[rows] - d)[:, None] + np.arange(d)] if d else np.zeros((len(rows), 0))
                order = np.argsort(-length[rows], kind="stable")
                for at in range(0, len(order), BUCKET):
                    o = order[at : at + BUCKET]
                    i, n, narrow = ids[rows][o], length[rows][o], block.all[d][3]
                    w = int((n >= WIDE).sum())
                    exact[d].scan(i[:w], v[o[:w]], n[:w], 0, len(exact[d].ids))
                    exact[d].scan(i[w:], v[o[w:]], n[w:], narrow, len(exact[d].ids))
                    if narrow and w < len(o):
                        scan(i[w:], v[o[w:]], n[w:], block.groups[d], best[d])
        for d, found in best.items():
            r, c = np.nonzero(np.isfinite(found.score))
            score, own = found.score[r, c], (block.groups[d][1] ** 2).sum(1)
            out = [
                block.first + np.array(block.rows[d], np.int64)[r], np.array(block.times[d], np.int64)[r], block.groups[d][0][r], found.id[r, c], (score * 65536).astype(np.int64),
                np.zeros(len(r), np.int32), [b""] * len(r), (found.id[r, c] == block.groups[d][0][r]) & (score == own[r]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(out, _FOUND, strict=True)], schema=_FOUND)
        for d, e in exact.items():
            out = []
            for x, found in e.best.items():
                own = sum(v * v for v in whole(e.q[x]))
                out += [(block.first + block.rows[d][x], block.times[d][x], int(e.ids[x]), i, *_sortable(-s), i == e.ids[x] and -s == own) for s, i in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return search


def _counted(vectors: DataFrame) -> DataFrame:
    """vec_id, q, length, n: equal rows counted, in partial aggregates first."""
    return vectors.groupBy("vec_id", "q", "length").agg(F.count("*").alias("n"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each query by integer inner product, ties to smaller ids.

    Input: vec_id, embedding in both. Vectors that are null or hold null or non-finite components take no part; a query with
    no other vector of its dimension has no rows. Any finite component counts; a product beyond 64 bits keeps its exact rank
    and has a null score. Every row but the query's own (one with its id and its vector) is a candidate, so rows that share a
    vec_id, and repeated rows, are candidates and queries of their own; other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    # of equal rows no more than k and the query itself can be among the best
    counted = saved(_counted(quantised(vectors)).select("vec_id", "q", "length", F.least("n", F.lit(k + 1)).alias("n")), "counted")
    n = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    base = counted.select("vec_id", "q", "length", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    # longest first; ids part vectors of one length, so a frequent vector is no hot range
    ranges = max(1, -(-n // RANGE), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET)))
    base = saved(base.repartitionByRange(ranges, F.col("length").desc(), "vec_id").sortWithinPartitions(F.col("length").desc(), "vec_id"), "vectors")
    asked = _counted(quantised(queries))
    found, block, first = None, [], 0

    def add() -> None:
        nonlocal found, block, first
        own = Queries(block)
        own.first = first
        shared = spark.sparkContext.broadcast(own)
        part = saved(base.mapInArrow(lean(_searcher(shared, k + 1)), "query long, times long, query_id long, vec_id long, score long, size int, key binary, own boolean"), "found")
        shared.unpersist()
        first += len(block)
        found, block = part if found is None else found.unionByName(part), []

    for r in asked.toLocalIterator():
        block.append((r["vec_id"], r["q"], r["length"], r["n"]))
        if len(block) == QUERY_BLOCK:
            add()
    if block or found is None:
        add()
    dropped(base, counted)
    order = (F.col("size").desc(), F.col("score").desc(), F.col("key").desc(), "vec_id", F.col("own").desc())
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    best = found.withColumn("place", place).where(F.col("place") <= k + 1)
    self = F.min(F.when(F.col("own"), F.col("place"))).over(Window.partitionBy("query"))
    rank = F.when(F.col("place") > F.coalesce("self", F.lit(k + 2)), F.col("place") - 1).otherwise(F.col("place"))
    best = best.withColumn("self", self).where(~F.col("place").eqNullSafe(F.col("self"))).withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    best = best.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return best.select("query_id", "rank", "vec_id", "score")
