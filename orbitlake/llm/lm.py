"""A word bigram model by deleted interpolation.

log P(w | u) mixes the maximum-likelihood estimates c(u, w) / c(u) and c(w) / N with 1 / (V + 1). The weights depend on how
often the context u was seen (a bucket for each power of two) and are learnt by expectation maximisation on counts that
the other documents haven't seen: a part of the training documents is held out of the counts for that, and put back for
the final ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitlake.llm import blocks
from orbitlake.llm.common import WordHashes, dropped, fold, lean_group, lean_pair, mixed, saved, small_batches, typed, words

#: Folds of documents: those whose counts stay, those that the weights are learnt on, and those that nothing is learnt from.
KEPT, DELETED, UNSEEN = 0, 1, 2
#: EM rounds at most, the gain in log-likelihood a token at which they end, and the weight that all estimates share.
ROUNDS, GAIN, FLOOR = 40, 1e-6, 0.001
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a bigram's key: the upper 48.
PAIR_BITS = np.uint64(0xFFFFFFFFFFFF0000)
UNIGRAM = 1


def token_keys(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of tokens and of their bigrams, text after text, and where each text ends. The last token of a text is its end."""
    own = [hashes.of(words(t)) for t in texts]
    ends = np.cumsum([len(h) + 1 for h in own])
    tokens = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    before = np.empty_like(tokens)
    at = 0
    for h in own:
        n = len(h)
        tokens[at : at + n], tokens[at + n] = h, END
        before[at] = BEGIN
        before[at + 1 : at + n + 1] = h
        at += n + 1
    # 48 bits tell bigrams apart well enough, and pack in half the bytes
    return tokens, mixed(before * _MULT + tokens) & PAIR_BITS, ends


def _asked(tokens: np.ndarray, pairs: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct keys of a block, their counts, and where each occurrence is: tokens, then a beginning for each text; bigrams."""
    uni = np.unique(np.concatenate([tokens, np.full(len(ends), BEGIN)]), return_inverse=True, return_counts=True)
    two = np.unique(pairs, return_inverse=True, return_counts=True)
    return [(k, n, at) for k, at, n in (uni, two)]


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys by their gaps, in halves: the upper ones are mostly equal."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    short = not (keys & ~PAIR_BITS).any()
    return blocks.pack(*_halves(gaps >> np.uint64(16) if short else gaps), counts.astype(np.uint32), b"x" if short else b"")


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    *planes, short = blocks.unpack(data)
    low, high, counts = (np.frombuffer(x, np.uint32) for x in planes)
    keys = np.cumsum((high.astype(np.uint64) << np.uint64(32)) | low, dtype=np.uint64)
    return (keys << np.uint64(16) if short else keys), counts


def _cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each key range begins in sorted keys."""
    edges = (np.arange(1, ranges, dtype=np.float64) / ranges * 2.0**64).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(int)


def _requester(ranges: int):
    hashes = WordHashes()

    def requests(texts: list[str]) -> Iterator[tuple[int, int, bytes]]:
        for order, (keys, counts, _) in enumerate(_asked(*token_keys(texts, hashes)), UNIGRAM):
            cut = _cuts(keys, ranges)
            for r in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[r], cut[r + 1]
                yield order, r, _packed(keys[a:b], counts[a:b])

    return requests


def _small(c: np.ndarray) -> np.ndarray:
    """Counts in two planes of 32 bits, the upper one all but empty."""
    return np.concatenate([c & 0xFFFFFFFF, c >> 32]).astype(np.uint32)


def _large(data: bytes) -> np.ndarray:
    c = np.frombuffer(data, np.uint32).astype(np.int64)
    return c[: len(c) // 2] | (c[len(c) // 2 :] << 32)


def _answer(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a key range: for each block, the counts of its keys in training and in the kept part; and the range's totals."""
    order, r = key[0].as_py(), key[1].as_py()
    rows = [(b, f, d) for batch in batches for b, f, d in zip(batch.column("block").to_pylist(), batch.column("fold").to_pylist(), batch.column("data").to_pylist(), strict=True)]
    rows.sort(key=lambda x: x[0])
    got = [_unpacked(d) for _, _, d in rows]
    keys = np.unique(np.concatenate([k for k, _ in got]))
    all_, kept = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    places = [np.searchsorted(keys, k) for k, _ in got]
    for (_, f, _), (_, c), at in zip(rows, got, places, strict=True):
        if f != UNSEEN:
            all_[at] += c
        if f == KEPT:
            kept[at] += c
    for (block, f, _), at in zip(rows, places, strict=True):
        data = blocks.pack(*(_small(x[at]) for x in ((all_, kept) if f == DELETED else (all_,))))
        yield pa.RecordBatch.from_pylist([{"order": order, "r": r, "block": block, "fold": f, "data": data, "n": 0, "v": 0, "kept": 0}], schema=_ANSWER)
    real = keys != BEGIN
    totals = {"n": int(all_[real].sum()), "v": int((all_[real] > 0).sum()), "kept": int(kept[real].sum())}
    yield pa.RecordBatch.from_pylist([{"order": order, "r": r, "block": None, "fold": None, "data": None} | totals], schema=_ANSWER)


_ANSWER = pa.schema([("order", pa.int32()), ("r", pa.int64()), ("block", pa.int64()), ("fold", pa.int32()), ("data", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("kept", pa.int64())])
_ANSWER_SQL = "order int, r long, block long, fold int, data binary, n long, v long, kept long"


def _block(left: pa.Table, right: pa.Table, part: int, hashes: WordHashes):
    """ids, ends of texts, and of each token: c(u, w), c(u), c(w), from the answers of one part (0 training, 1 kept)."""
    rows = list(blocks.unpack_docs(left.column("data")[0].as_py()))
    tokens, pairs, ends = token_keys([t for _, t in rows], hashes)
    got = sorted(zip(right.column("order").to_pylist(), right.column("r").to_pylist(), right.column("data").to_pylist(), strict=True), key=lambda x: x[:2])
    uni, two = (np.concatenate([_large(blocks.unpack(d)[part]) for o, _, d in got if o == order]).astype(float) for order in (UNIGRAM, UNIGRAM + 1))
    (_, _, at1), (_, _, at2) = _asked(tokens, pairs, ends)
    one = uni[at1]
    one, begin = one[: len(tokens)], one[len(tokens) :]
    context = np.empty_like(one)
    context[1:] = one[:-1]
    context[np.concatenate([[0], ends[:-1]]).astype(int)] = begin
    return [i for i, _ in rows], ends, two[at2], context, one


def _bucket(c: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + the power of two that its count reaches."""
    return np.where(c > 0, 1 + np.floor(np.log2(np.maximum(c, 1))), 0).astype(np.int64)


def _estimates(both, context, one, n: float, v: float) -> tuple[np.ndarray, np.ndarray, float]:
    return np.where(context > 0, both / np.maximum(context, 1), 0.0), one / max(n, 1.0), 1.0 / (v + 1)


def _held_counts(left: pa.Table, right: pa.Table) -> pa.Table:
    """How often each triple of kept counts c(u, w), c(u), c(w) meets a token of a block that they haven't seen."""
    _, _, both, context, one = _block(left, right, 1, WordHashes())
    key, n = np.unique(np.stack([both, context, one]).astype(np.int64), axis=1, return_counts=True)
    return pa.table({"bucket": _bucket(key[1]), "both": key[0], "context": key[1], "one": key[2], "n": n})


def mixture(held: DataFrame, n: float, v: float) -> dict[int, tuple[float, float, float]]:
    """Weights of the bigram, unigram and uniform estimates in each bucket, by expectation maximisation over the held-out
    counts (bucket, both, context, one, n): a round is one aggregation, and only sums by bucket come to the driver."""
    held = held.select(
        "bucket", "n", F.when(F.col("context") > 0, F.col("both") / F.col("context")).otherwise(0.0).alias("p2"),
        (F.col("one") / max(n, 1.0)).alias("p1"), F.lit(1.0 / (v + 1)).alias("p0"),
    )
    sizes = {r["bucket"]: r["n"] for r in held.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # at most 65 rows
    # a context never seen has no bigram estimate
    weights = {b: (0.0, 0.5, 0.5) if b == 0 else (1 / 3, 1 / 3, 1 / 3) for b in sizes}
    before = -np.inf
    for _ in range(ROUNDS if sizes else 0):
        table = F.create_map(*(F.lit(x) for b in sorted(weights) for x in (b, list(weights[b]))))
        own = held.withColumn("w", table[F.col("bucket")])
        parts = [F.col("w")[k] * F.col(p) for k, p in enumerate(("p2", "p1", "p0"))]
        own = own.withColumn("mix", parts[0] + parts[1] + parts[2])
        sums = own.groupBy("bucket").agg(*(F.sum(x / F.col("mix") * F.col("n")).alias(f"s{k}") for k, x in enumerate(parts)), F.sum(F.log("mix") * F.col("n")).alias("fit"))
        rows = sums.collect()
        weights = {r["bucket"]: tuple(r[f"s{k}"] / sizes[r["bucket"]] for k in range(3)) for r in rows}
        fit = sum(r["fit"] for r in rows) / sum(sizes.values())
        if fit - before < GAIN:
            break
        before = fit
    # nothing is impossible
    return {b: tuple(float((1 - FLOOR) * x + FLOOR * y) for x, y in zip(w, (0, 0.5, 0.5) if b == 0 else (1 / 3,) * 3, strict=True)) for b, w in weights.items()}


def weight_of(weights: dict, bucket: int) -> tuple[float, float, float]:
    """The weights of a bucket, or of the next lower one that any held-out token was in; context 0 has no bigram estimate."""
    if bucket in weights:
        return weights[bucket]
    if bucket == 0:
        return (0.0, 0.9, 0.1)
    lower = [b for b in weights if 0 < b < bucket]
    return weights[max(lower)] if lower else (0.4, 0.5, 0.1)


def _scorer(totals: dict, weights: dict):
    table = np.array([weight_of(weights, b) for b in range(66)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, ends, both, context, one = _block(left, right, 0, WordHashes())
        n, v = totals["n"], totals["v"]
        p2, p1, p0 = _estimates(both, context, one, n, v)
        w = table[_bucket(context)]
        first = np.concatenate([[0], ends[:-1]]).astype(int)
        per = lambda x: np.add.reduceat(x, first)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(ends - first, pa.int64()), "n_known": pa.array(per((one > 0).astype(np.int64)), pa.int64()),
                "base_score": per(np.log10((one + 1) / (n + 1.0 * (v + 1)))),
                "score": per(np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)),
            }
        )

    return run


def scores(docs: DataFrame, modulus: int = 7, held: int = 2, deleted: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    Learnt from documents whose crc32(doc_id as text) mod `modulus` isn't `held`; those with remainder `deleted` teach the
    weights. Null and empty texts have one token, the end; a null doc_id counts as empty text in the remainder; repeated rows
    are documents of their own; an empty table gives no rows; without a training document every count is 0; other columns are
    ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = typed(docs, doc_id="long", text="string")
    part = F.when(fold("doc_id", modulus, held), UNSEEN).when(fold("doc_id", modulus, deleted), DELETED).otherwise(KEPT)
    bundles = saved(blocks.bundled(d.withColumn("fold", part)), "blocks")
    asked = blocks.requested(bundles, _requester(blocks.ranges(d)))
    answers = saved(asked.select(F.col("kind").alias("order"), "k", "block", "fold", "data").groupBy("order", "k").applyInArrow(lean_group(_answer), _ANSWER_SQL), "answers")
    t = answers.where("block is null and order = 1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "kept"))).first().asDict()
    replies = answers.where("block is not null").select("block", "fold", "order", "r", "data")

    def joined(where: str, run, schema: str) -> DataFrame:
        return bundles.where(where).groupBy("block").cogroup(replies.where(where).groupBy("block")).applyInArrow(lean_pair(run), schema)

    seen = joined(f"fold = {DELETED}", _held_counts, "bucket long, both long, context long, one long, n long")
    seen = saved(seen.groupBy("bucket", "both", "context", "one").agg(F.sum("n").alias("n")), "held")
    weights = mixture(seen, t["kept"], t["v"])
    out = saved(joined("true", _scorer(t, weights), "doc_id long, n_tokens long, n_known long, base_score double, score double"), "scores")
    dropped(bundles, answers, seen)
    return out.select("doc_id", fold("doc_id", modulus, held).alias("held_out"), "n_tokens", "n_known", F.lit(t["n"]).cast("long").alias("train_tokens"), "base_score", "score")
