"""Toxic passages as maximum-scoring segments of token log-odds.

A token's features are its word and its beginnings, so that inflected forms share evidence. Their log-odds between the
tokens of toxic and of clean documents get a Dirichlet prior in proportion to all tokens. One linear scan finds every
maximal segment of a text (Ruzzo and Tompa); the chance of such a segment in clean text follows an extreme-value law
(Karlin and Altschul), and a logistic curve over the best and the summed significance gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitlake.llm.common import arrow_rows, dropped, fold, lean, saved, small_batches, typed, working
from orbitlake.llm.quality import labelled, training_labels

#: Labelled documents of each label that are learnt from, at most; what is learnt is bounded by them.
SAMPLE_PER_LABEL = 10_000
#: Lengths of the beginnings that are features.
PREFIXES = (4, 5, 6)
#: Weight of the prior in tokens, the cost of a token without evidence, and the z score from which evidence counts.
PRIOR, DRIFT, Z_MIN = 1000.0, 0.1, 3.0
#: Log-odds under which a feature is no sign of toxicity: toxic documents may just be longer.
ODDS_MIN = 1.5
#: E-value under which a segment is significant.
E_MAX = 0.05
#: Counts are kept as whole thousandths, so that their sums don't depend on the order.
UNIT = 1000

# Bytes of UTF-8 that are no part of a word.
_BREAKS = bytes(32 if (b < 128 and not chr(b).isalpha()) else b for b in range(256))


def tokens(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_BREAKS).decode("utf-8", "replace").split()


def features(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in PREFIXES if len(word) >= n)]


def maximal_segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """Score, first place and place after the last of every maximal-scoring segment, in order and in linear time."""
    found: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, end
    lower: list[int] = []  # of each: the last one before it whose sum before is lower, or -1
    total = 0.0
    for i, s in enumerate(scores):
        if s > 0:
            left, right, first = total, total + s, i
            # what is passed over begins no lower than this one, so no later search has to look at it again
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = lower[j]
            # join with an earlier segment that begins lower, as long as this one ends higher than that
            while j >= 0 and found[j][1] < right:
                left, first, back = found[j][0], found[j][2], lower[j]
                del found[j:], lower[j:]
                j = back
            found.append((left, right, first, i + 1)), lower.append(j)
        total += s
    return [(r - l, i, e) for l, r, i, e in found]


class Model:
    """Log-odds of features, the extreme-value law of clean text and the calibration."""

    def __init__(self, odds: dict[str, tuple[float, float]]):
        self.odds = odds
        self.rate, self.k = 1.0, 1.0
        self.curve = (0.0, 1.0, 0.0)
        self._seen: dict[str, float] = {}

    def token(self, word: str) -> float:
        """The log-odds of the feature with the most evidence; -DRIFT without any."""
        s = self._seen.get(word)
        if s is None:
            best, s = Z_MIN, -DRIFT
            for f in features(word):
                d, z = self.odds.get(f, (0.0, 0.0))
                if abs(z) > best:
                    best, s = abs(z), d - DRIFT
            if len(self._seen) > 50_000:
                self._seen.clear()
            self._seen[word] = s
        return s

    def segments(self, ws: list[str]) -> list[tuple[float, int, int]]:
        """All maximal segments: score, first token, token after the last."""
        return maximal_segments([self.token(w) for w in ws])

    def summary(self, text: str | None) -> tuple[float, float, int, list[tuple[float, int, int]]]:
        """Significance of the best segment, of all, tokens, and the significant segments by E-value."""
        ws = tokens(text) if text else []
        room = math.log(max(1.0, self.k * max(1, len(ws))))
        out, best, total = [], 0.0, 0.0
        for s, i, e in self.segments(ws):
            strength = self.rate * s - room  # -ln E
            best = max(best, strength)
            if strength > -math.log(E_MAX):
                total += strength
                out.append((math.exp(-strength), i, e))
        return best, total, len(ws), out

    def score(self, best: float, total: float) -> float:
        a, b, c = self.curve
        x = a + b * math.log1p(best) + c * math.log1p(total)
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each batch's features by label; the feature "" counts all tokens.

    A word's occurrences in one text are no independent evidence: n of them count 1 + ln n.
    """
    for b in batches:
        toxic, clean = Counter(), Counter()
        for text, y in arrow_rows([b], "text", "y"):
            own, into = Counter(tokens(text or "")), toxic if y else clean
            into[""] += UNIT * sum(own.values())
            for w, n in own.items():
                c = round(UNIT * (1 + math.log(n)))
                for f in features(w):
                    into[f] += c
        keys = sorted(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["f", "t", "c"])


def log_odds(counts: DataFrame, n_toxic: float, n_clean: float) -> DataFrame:
    """f, d, z: log-odds and z scores of features (f, t, c) with a Dirichlet prior in proportion to all counts; those that are evidence."""
    t, c = F.col("t") / UNIT, F.col("c") / UNIT
    a = PRIOR * (t + c) / (n_toxic + n_clean) + 0.01
    d = F.log((t + a) / (n_toxic + PRIOR - t - a)) - F.log((c + a) / (n_clean + PRIOR - c - a))
    out = counts.where("f <> ''").select("f", d.alias("d"), (d / F.sqrt(1 / (t + a) + 1 / (c + a))).alias("z"))
    return out.where((F.abs("z") >= Z_MIN) & ~((F.col("d") > 0) & (F.col("d") < ODDS_MIN)))


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, y: the labelled sample, each text once, with the majority of its labels, 1 on a tie."""
    rows = labelled(docs, labels, "toxic", SAMPLE_PER_LABEL).select(F.coalesce("text", F.lit("")).alias("text"), "y")
    return rows.groupBy("text").agg(F.when(F.avg("y") >= 0.5, 1).otherwise(0).alias("y"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of at most SAMPLE_PER_LABEL documents of each label. To the driver come the features that are evidence
    and a row of numbers for each document of the sample; the texts don't."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = saved(training_texts(docs, labels), "sample")
    shares = {r["y"]: r["n"] for r in training_labels(labels, "toxic").groupBy("y").agg(F.count("*").alias("n")).collect()}
    counts = saved(sample.mapInArrow(lean(_counted), "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "counts")
    whole = counts.where("f = ''").select(F.col("t") / UNIT, F.col("c") / UNIT).first() or (0, 0)
    kinds = {r["y"] for r in sample.select("y").distinct().collect()}
    odds = log_odds(counts, *whole).collect() if whole[0] and whole[1] else []
    model = Model({f: (d, z) for f, d, z in odds})
    if len(kinds) < 2:
        dropped(sample, counts)
        model.curve = (35.0 if 1 in kinds else -35.0, 0.0, 0.0)
        return model
    shared = spark.sparkContext.broadcast(model)

    def best_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = []
            for text, y in arrow_rows([b], "text", "y"):
                scores = [m.token(w) for w in tokens(text or "")]
                h = Counter(round(s, 1) for s in scores)
                out.append({"best": max((s for s, _, _ in maximal_segments(scores)), default=0.0), "n": len(scores), "y": y, "scores": list(map(float, h)), "counts": list(h.values())})
            yield pa.RecordBatch.from_pylist(out, schema=_SEEN)

    seen = sample.mapInArrow(lean(best_scores), "best double, n long, y int, scores array<double>, counts array<long>").toLocalIterator()
    rows, token_scores = [], Counter()
    for r in seen:  # at most two samples of numbers
        rows.append((r["best"], max(1, r["n"]), r["y"]))
        if not r["y"]:
            token_scores.update(dict(zip(r["scores"], r["counts"], strict=True)))
    shared.unpersist()
    dropped(sample, counts)
    best, n, y = (np.array(x) for x in zip(*sorted(rows), strict=True))
    # each label weighs as much as it has in the training labels, however many of it were sampled
    weight = np.where(y == 1, shares.get(1, 0) / max(1, (y == 1).sum()), shares.get(0, 0) / max(1, (y == 0).sum()))
    calibrate(model, best, n.astype(float), y, weight * len(y) / max(1.0, weight.sum()), token_scores)
    return model


_SEEN = pa.schema([("best", pa.float64()), ("n", pa.int64()), ("y", pa.int32()), ("scores", pa.list_(pa.float64())), ("counts", pa.list_(pa.int64()))])


def calibrate(model: Model, best: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray, token_scores: Counter) -> None:
    """The law's two parameters from clean texts, then the logistic curve over significance, each text by its weight."""
    s = np.array(list(token_scores.keys()), float)
    p = np.array(list(token_scores.values()), float)
    if len(s) and s.max() > 0 and (s * p).sum() < 0:
        p = p / p.sum()
        lo, hi = 1e-6, 1.0
        while (p * np.exp(np.minimum(700, hi * s))).sum() < 1 and hi < 1e3:
            hi *= 2
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (p * np.exp(np.minimum(700, mid * s))).sum() < 1 else (lo, mid)
        model.rate = min(lo, 5.0)
    clean = y == 0
    # mean of a Gumbel variable: ln K + Euler's constant
    model.k = float(np.clip(np.exp(np.mean(model.rate * best[clean] - np.log(n[clean])) - 0.5772), 1e-4, 10.0))
    b = np.maximum(0, model.rate * best - np.log(np.maximum(1.0, model.k * n)))
    total = np.where(b > -math.log(E_MAX), b, 0.0)
    x = np.stack([np.ones(len(b)), np.log1p(b), np.log1p(total)], 1)
    w = np.zeros(3)

    def loss(w: np.ndarray) -> float:
        u = x @ w
        return float((weight * (np.logaddexp(0, u) - y * u)).sum() + 0.05 * (w @ w))

    for _ in range(100):  # Newton steps with a small ridge, halved until they help
        q = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (weight * (y - q)) - 0.1 * w
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3)
        step, now = np.linalg.solve(h, g), loss(w)
        while loss(w + step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        w += step
        if np.abs(step).max() < 1e-9:
            break
    model.curve = tuple(map(float, w))


def model_of(docs: DataFrame, labels: DataFrame):
    """The fitted model, broadcast."""
    return docs.sparkSession.sparkContext.broadcast(fit(docs, labels))


_PASSAGES = pa.list_(pa.struct([("first", pa.int64()), ("tokens", pa.int64()), ("e_value", pa.float64())]))


def with_scores(docs: DataFrame, model) -> DataFrame:
    """All columns of docs, score, and passages: first token, tokens and E-value of each significant segment.

    Only the texts go to the Python workers, and only numbers come back.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<score: double, passages: array<struct<first: bigint, tokens: bigint, e_value: double>>>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model.value
        with working():
            for texts in batches:
                s, p = [], []
                for text in texts.to_pylist():
                    best, total, _, found = m.summary(text)
                    s.append(m.score(best, total)), p.append([{"first": a, "tokens": e - a, "e_value": v} for v, a, e in found])
                yield pa.StructArray.from_arrays([pa.array(s, pa.float64()), pa.array(p, _PASSAGES)], names=["score", "passages"])

    rest = [c for c in docs.columns if c not in ("score", "passages")]
    # said to be nondeterministic, lest a filter on the score evaluates it once more
    return docs.select(*rest, judged.asNondeterministic()(docs["text"].cast("string")).alias("_judged")).select(*rest, "_judged.score", "_judged.passages")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, passages (array of first token, tokens, e_value) for every row of docs.

    Input: docs (doc_id, text), labels (doc_id, toxic). Null and empty texts have no passage and get the score of none;
    rows are neither joined nor dropped, repeated rows get equal scores; texts of any length are scanned whole, in linear
    time; of clashing labels of one document or one text the majority counts, 1 on a tie; without labels of one kind every
    score is 0 or 1; an empty table gives no rows; other columns are ignored. No shuffle of texts beyond the labelled sample.
    """
    scored = with_scores(typed(docs, doc_id="long", text="string"), model_of(docs, labels))
    return scored.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "passages")
