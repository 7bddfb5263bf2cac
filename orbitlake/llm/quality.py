"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

Terms of a document are hashed runs of four bytes, trigrams of character classes and marks of repetition, all weighted by
how rare they are. A labelled sample gives the weights, the latent axes (the leading singular vectors) and the labelled
vectors; every document is compared with all of those by exact cosine products, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitlake.llm.common import WordHashes, arrow_rows, fold, lean, mixed, released, small_batches, typed, working

#: Labelled documents of each label that the model is fitted on, at most: a documented bound, so the model is small enough to broadcast.
SAMPLE_PER_LABEL = 2000
#: Latent dimensions, voting neighbours, and how much faster a vote falls off with distance.
DIMENSIONS, NEIGHBOURS, SHARPNESS = 32, 25, 8.0
BLOCK = 256

# Classes of UTF-8 bytes.
_CLASS = np.full(256, 8, np.uint16)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[ord(" ")] = 3
_CLASS[[9, 10, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 5
_CLASS[[ord(c) for c in "!?"]] = 6
_CLASS[[ord(c) for c in "#$%&*|@^~+=<>{}[]\\/_`"]] = 7
_N_TRI = 9**3
_MARKS = 5
#: Buckets of runs of four bytes.
_GRAMS = 1024
N_TERMS = _N_TRI + 2 * _MARKS + _GRAMS
_GRAM_MULT, _GRAM_SHIFT = np.uint32(0x9E3779B1), np.uint32(22)
#: Bytes of a text that are looked at together.
_PART = 1 << 20


def _grams(raw: np.ndarray) -> np.ndarray:
    """Relative frequencies of hashed runs of four bytes, lower-case A-Z."""
    out = np.zeros(_GRAMS)
    low = raw + ((raw >= 65) & (raw <= 90)).view(np.uint8) * np.uint8(32)
    for i in range(0, len(low) - 3, _PART):
        x = low[i : i + _PART + 3].astype(np.uint32)
        k = (x[:-3] << np.uint32(24)) | (x[1:-2] << np.uint32(16)) | (x[2:-1] << np.uint32(8)) | x[3:]
        k ^= k >> np.uint32(15)
        out += np.bincount((k * _GRAM_MULT) >> _GRAM_SHIFT, minlength=_GRAMS)
    return out / max(1, len(low) - 3)


def terms(text: str, hashes: WordHashes) -> np.ndarray:
    """Root relative frequencies of a document's terms."""
    raw = text.encode("utf-8", "surrogatepass")
    c = _CLASS[np.frombuffer(raw, np.uint8)]
    out = np.zeros(N_TERMS)
    out[_N_TRI + 2 * _MARKS :] = _grams(np.frombuffer(raw, np.uint8))
    if len(c) > 2:
        out[:_N_TRI] = np.bincount(c[:-2] * 81 + c[1:-1] * 9 + c[2:], minlength=_N_TRI) / (len(c) - 2)
    ws = raw.lower().split()
    h = hashes.of(ws)
    n = max(1, len(h))
    grams = mixed(h[:-2] * np.uint64(31) + h[1:-1] * np.uint64(17) + h[2:]) if len(h) > 2 else h[:0]
    lines = [x for x in raw.split(b"\n") if len(x) > 20]
    letters = np.count_nonzero(c < 2) + 1
    marks = (
        np.count_nonzero(h[1:] == h[:-1]) / n,
        1 - len(np.unique(grams)) / len(grams) if len(grams) else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        np.count_nonzero(c == 1) / letters,
        np.count_nonzero(c == 7) / max(1, len(c)),
    )
    for j, m in enumerate(marks):  # a pair of terms each, so that much and little differ in direction
        m = min(1.0, m)
        out[_N_TRI + 2 * j], out[_N_TRI + 2 * j + 1] = m, 0.25 * (1 - m)
    return np.sqrt(out)


def leading_axes(a: np.ndarray, d: int) -> np.ndarray:
    """The d leading right singular vectors of a, as columns, by subspace iteration."""
    d = min(d, *a.shape)
    q = np.random.default_rng(1).standard_normal((a.shape[1], min(a.shape[1], d + 16))).astype(a.dtype)
    for _ in range(12):
        q = np.linalg.qr(a.T @ (a @ q))[0]
    return q @ np.linalg.svd(a @ q, full_matrices=False)[2][:d].T


class Neighbours:
    """The fitted model: term weights, latent axes, labelled vectors and their labels."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        """x: rows of terms, which are overwritten; y: their labels."""
        self.labels = np.asarray(y, float)
        n = len(self.labels)
        self.weights = (np.log((1 + n) / (1 + np.count_nonzero(x, axis=0))) + 1.0).astype(x.dtype)
        x *= self.weights
        self.axes = leading_axes(x, DIMENSIONS) if n else np.zeros((N_TERMS, 1))
        self.vectors = self._unit(x @ self.axes)
        ones = self.labels.sum()
        # equal classes: a vote counts by the inverse of how often its label is in the sample
        self.votes = np.where(self.labels > 0, 0.5 / max(1.0, ones), 0.5 / max(1.0, n - ones))

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Of rows of terms: the share of label 1 among the nearest labelled vectors' votes."""
        if not len(self.labels):
            return np.full(len(x), 1.0)
        if self.labels.min() == self.labels.max():
            return np.full(len(x), self.labels[0])
        cos = self._unit((x * self.weights) @ self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(cos, near, 1)
        w = np.exp(SHARPNESS * (best - best.max(1, keepdims=True)) / np.maximum(1e-3, 1 - best.min(1, keepdims=True))) * self.votes[near]
        return np.clip((w * self.labels[near]).sum(1) / w.sum(1), 0.0, 1.0)


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """id and y of each training document, once."""
    return (
        labels.select(labels["doc_id"].cast("long").alias("id"), labels[label].cast("int").alias("y"))
        .where("id is not null and y in (0, 1)")
        .groupBy("id")
        .agg(F.avg("y").alias("y"))
        .select("id", F.when(F.col("y") >= 0.5, 1).otherwise(0).alias("y"))
        .where(~fold("id", 5, 0))
    )


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """Text and label of training documents: at most `per_label` of each label, those with the smallest hash of their id.

    Training documents are those whose crc32(doc_id as text) mod 5 isn't 0. A document with several labels has their
    majority, 1 on a tie; null labels and ids don't count. Of documents that share an id, each gets the label.
    """
    one = training_labels(labels, label)
    picked = [one.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_label) for y in (0, 1)]
    d = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))
    return d.join(F.broadcast(picked[0].unionByName(picked[1])), "id").select("id", "text", "y")


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        rows = [(i, y, terms(t or "", hashes).astype(np.float32).tobytes()) for i, t, y in arrow_rows([b], "id", "text", "y")]
        yield pa.RecordBatch.from_pylist([dict(zip(("id", "y", "x"), r, strict=True)) for r in rows], schema=_TERMS)


_TERMS = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("x", pa.binary())])


def fit(docs: DataFrame, labels: DataFrame) -> Neighbours:
    """The model of at most SAMPLE_PER_LABEL documents of each label, one for each id.

    Terms are counted in tasks; the driver gets N_TERMS numbers a document, whatever the texts' lengths.
    """
    rows = labelled(docs, labels, "quality", SAMPLE_PER_LABEL).groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("y").alias("y"))
    got = sorted((r["id"], r["y"], bytes(r["x"])) for r in rows.mapInArrow(lean(_term_rows), "id long, y int, x binary").toLocalIterator())
    x = np.frombuffer(b"".join(v for _, _, v in got), np.float32).reshape(len(got), N_TERMS).copy()
    del rows
    model = Neighbours(x, np.array([y for _, y, _ in got]))
    del x, got
    released()
    return model


def model_of(docs: DataFrame, labels: DataFrame):
    """The fitted model, broadcast."""
    small_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(fit(docs, labels))


def with_scores(docs: DataFrame, model) -> DataFrame:
    """All columns of docs, and score. Only the texts go to the Python workers, and only numbers come back."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m, hashes = model.value, WordHashes()
        with working():
            for texts in batches:
                out = [np.zeros(0)]
                for i in range(0, len(texts), BLOCK):
                    out.append(m.scores(np.array([terms(t or "", hashes) for t in texts.slice(i, BLOCK).to_pylist()])))
                yield pa.array(np.concatenate(out), pa.float64())

    # said to be nondeterministic, lest a filter on the score evaluates it once more
    return docs.withColumn("score", score.asNondeterministic()(docs["text"].cast("string")))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels has doc_id, quality.

    Null and empty texts are scored as a text without terms; rows are neither joined nor dropped, repeated rows get equal
    scores; of several labels of a document the majority counts, 1 on a tie; equal distances share the vote by the order
    of ids in the sample; without labels every score is 1; with labels of one kind every score is that label; an empty
    table gives no rows; other columns are ignored. No shuffle of texts but the labelled sample's.
    """
    scored = with_scores(typed(docs, doc_id="long", text="string"), model_of(docs, labels))
    return scored.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
