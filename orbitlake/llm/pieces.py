"""SentencePiece encoding by a relational lattice, and decoding.

A text is cut where no piece can reach over: before a space, and between two characters that stand side by side in no
piece. The best way through the text is then the best ways through those words, one after another. Documents ask for
their distinct words block by block (see blocks.py). The distinct words of the corpus, of any length, are exploded into
substrings of bounded length, joined with the piece table by equality, and the edges of each word are folded by Viterbi
with Spark's aggregate function: the best-scoring way of pieces through the word. Characters without a piece become bytes.
A vocabulary made by merging is used as a unigram one: its ids are those of the best path, not of its merge order.
The answers go back to the blocks, which put the ids of their documents together and decode them again.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.llm import blocks
from orbitlake.llm.common import lean_group, lean_pair, mixed, saved, small_batches, typed

#: The vocabulary file; the environment or a parameter names another.
MODEL = os.environ.get("ORBITLAKE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: Characters of a word that are exploded together, and entries of an array that the fold appends to: long words take
#: time in proportion to their length, not to its square.
SEGMENT, CHUNK = 256, 1024
#: Characters up to which the fold carries the ids of each way along; beyond, it keeps back pointers.
SHORT = 64
#: Bytes of text of a block: larger ones ask less often for the same words.
BLOCK_BYTES = 5 << 20
#: Characters of a text that are looked at together, about.
PART, GATHER = 1 << 20, 1 << 18
SPACE = "▁"
#: Neighbouring characters are looked up by a hash of these bits; a collision only leaves a cut out.
_PAIR_BITS = 20
_LEFT, _RIGHT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
#: How much worse than the worst piece a character is that only bytes can spell.
_UNKNOWN = 10.0


@lru_cache(maxsize=2)
def pieces(path: str = MODEL) -> tuple[dict[str, tuple[int, float]], dict[int, int], list[bytes], float]:
    """Pieces with id and score, ids of bytes, what each id spells, and the score of an unknown character."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = [sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    ranked = all(x <= 0 and x == int(x) for x in scores)
    table, of_byte, spell = {}, {}, []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            of_byte[int(p[3:5], 16)] = i
            spell.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            spell.append(b"")
        else:
            # a merge table's scores are ranks: by Zipf's law the logarithm of a rank stands for a log-probability
            score = sp.get_score(i)
            table[p] = (i, -math.log(2.0 - score) if ranked else score)
            spell.append(p.replace(SPACE, " ").encode())
    return table, of_byte, spell, min(s for _, s in table.values()) - _UNKNOWN


def _pairs(points: np.ndarray) -> np.ndarray:
    return (points[:-1] * _LEFT + points[1:] * _RIGHT) >> np.uint32(32 - _PAIR_BITS)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=2)
def joined_pairs(path: str = MODEL) -> np.ndarray:
    """Whether some piece holds the two neighbouring characters, by their hash."""
    out = np.zeros(1 << _PAIR_BITS, np.bool_)
    for p in pieces(path)[0]:
        out[_pairs(_points(p))] = True
    return out


def _cuts(points: np.ndarray, path: str) -> np.ndarray:
    """Where words begin, but for the first: before each run of spaces and between characters that are neighbours in no piece."""
    space = points == ord(SPACE)
    return np.flatnonzero(~joined_pairs(path).take(_pairs(points)) | (space[1:] & ~space[:-1])) + 1


def split_words(text: str, path: str = MODEL) -> list[str]:
    """The text, with marks for spaces and one in front, cut where no piece reaches over."""
    if not text:
        return []
    marked = SPACE + text.replace(" ", SPACE)
    cuts = _cuts(_points(marked), path).tolist()
    return [marked[a:b] for a, b in zip([0, *cuts], [*cuts, len(marked)], strict=True)]


def _parts(text: str) -> Iterator[str]:
    """A text with marks for spaces in parts of about PART characters, each but the first from where a run of spaces begins."""
    marked, at = SPACE + text.replace(" ", SPACE), 0
    while len(marked) - at > PART:
        end = at + PART
        while 0 < end < len(marked) and not (marked[end] == SPACE != marked[end - 1]):
            end = marked.find(SPACE, end + 1)
        if end <= 0 or end >= len(marked):
            break
        yield marked[at:end]
        at = end
    yield marked[at:]


@lru_cache(maxsize=1)
def _scrambled() -> np.ndarray:
    """A number for each code point."""
    return mixed(np.arange(1, 0x110001, dtype=np.uint64))


def _gathered(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Parts of texts, marked, and the numbers of their texts: a few at a time, so that short ones share what a call costs."""
    parts, of, size = [], [], 0
    for t, text in enumerate(texts):
        for part in _parts(text) if text else ():
            parts.append(part), of.append(t)
            size += len(part)
            if size >= GATHER:
                yield parts, of
                parts, of, size = [], [], 0
    if parts:
        yield parts, of


def indexed_words(texts: list[str], path: str = MODEL) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of texts and their hashes, the number of each word in turn, and how many words each text has.

    Words are told apart by 64 bits of a hash of their characters; a text whose words were confused would not decode to
    itself, and round_trip would say so.
    """
    strings, hashes, begins, ends, owner, counts = [], [], [], [], [], np.zeros(len(texts), np.int64)
    for parts, of in _gathered(texts):
        string = "".join(parts)
        points = _points(string)
        first = np.cumsum([0, *map(len, parts)])[:-1]
        begin = np.zeros(len(points), np.bool_)
        begin[first] = begin[_cuts(points, path)] = True
        at = np.flatnonzero(begin)
        size = np.diff(at, append=len(points))
        place = mixed(np.arange(1, int(size.max()) + 1, dtype=np.uint64)) | np.uint64(1)
        within = np.arange(len(points)) - np.repeat(at, size)
        hashes.append(np.add.reduceat(_scrambled().take(points) * place.take(within), at))
        begins.append(at.astype(np.int32)), ends.append((at + size).astype(np.int32)), owner.append(np.full(len(at), len(strings), np.int32))
        strings.append(string)
        np.add.at(counts, of, np.diff(np.searchsorted(at, first), append=len(at)))
    if not strings:
        return [], np.zeros(0, np.uint64), np.zeros(0, np.int64), counts
    numbered = pa.array(np.concatenate(hashes)).dictionary_encode()
    index, distinct = numbered.indices.to_numpy(), numbered.dictionary.to_numpy()
    first = np.empty(len(distinct), np.int64)
    first[index[::-1]] = np.arange(len(index) - 1, -1, -1)
    spans = zip(*(np.concatenate(x)[first].tolist() for x in (owner, begins, ends)), strict=True)
    return [strings[p][a:b] for p, a, b in spans], mixed(distinct), index, counts


def lattice(words: DataFrame, spark: SparkSession, path: str = MODEL, by: tuple[str, ...] = ("word",)) -> DataFrame:
    """by and ids: the best way through the lattice of each word; `by` are the columns that tell words apart.

    Of equal ways the one whose last piece is longest counts, and so on backwards; empty and null words give no row.
    """
    table, _, _, unknown = pieces(path)
    longest = max(map(len, table))
    rows = [(p, i, s) for p, (i, s) in table.items()]
    known = spark.createDataFrame(rows, "known string, id int, score double").withColumn("key", F.xxhash64("known"))
    known = F.broadcast(known)  # as many as the vocabulary has
    # a segment has the edges that begin in it
    segments = F.transform(
        F.sequence(F.lit(0), F.floor((F.char_length("word") - 1) / SEGMENT).cast("int")),
        lambda i: F.struct((i * SEGMENT).alias("at"), F.substring(F.col("word"), i * SEGMENT + 1, F.lit(SEGMENT + longest - 1)).alias("text")),
    )
    cut = words.where("word <> ''").select(*by, F.explode(segments).alias("s")).select(*by, "s.at", "s.text")
    starts = cut.select(*by, "at", "text", F.explode(F.sequence(F.lit(1), F.least(F.lit(SEGMENT), F.char_length("text")))).alias("p"))
    sub = starts.select(*by, "at", "text", "p", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("text") - F.col("p") + 1))).alias("n"))
    sub = sub.select(*by, (F.col("at") + F.col("p") + F.col("n") - 1).cast("int").alias("end"), "n", F.expr("substring(text, p, n)").alias("piece"))
    # a number is looked up faster than a text, which is compared after
    met = sub.withColumn("key", F.xxhash64("piece")).join(known, "key", "left")
    met = met.withColumn("id", F.when(F.col("piece") == F.col("known"), F.col("id"))).where("id is not null or n = 1")
    edge = F.struct(
        F.col("end"), (-F.col("n")).alias("n"), F.coalesce("id", -1 - F.ascii("piece")).alias("id"),
        F.when(F.col("id").isNull(), F.lit(unknown)).otherwise(F.col("score")).alias("score"),
    )
    grouped = met.select(*by, edge.alias("e")).groupBy(*by).agg(F.sort_array(F.collect_list("e")).alias("es"))
    way = F.when(F.element_at("es", -1)["end"] <= SHORT, _short_way(F.col("es"))).otherwise(_long_way(F.col("es"), longest))
    return grouped.select(*by, way.alias("ids"))


def _short_way(edges: Column) -> Column:
    """Viterbi over edges by end, longest first: the state has the best way to each end reached so far."""

    def fold(s: Column, e: Column) -> Column:
        before = F.element_at(s, e["end"] + e["n"] + 1)
        cand = before["best"] + e["score"]
        entry = F.array(F.struct(cand.alias("best"), F.concat(before["ids"], F.array(e["id"])).alias("ids")))
        better = F.concat(F.slice(s, F.lit(1), e["end"]), entry)
        return F.when(F.size(s) <= e["end"], F.concat(s, entry)).when(cand > F.element_at(s, -1)["best"], better).otherwise(s)

    zero = F.array(F.struct(F.lit(0.0).alias("best"), F.array().cast("array<int>").alias("ids")))
    return F.aggregate(edges, zero, fold, lambda s: F.element_at(s, -1)["ids"])


def _long_way(edges: Column, longest: int) -> Column:
    """The same with back pointers, appended to arrays of at most about CHUNK entries, and a walk back."""

    def fold(s: Column, e: Column) -> Column:
        # `now` has an entry for each end from `at` to the last one reached
        now, at = s["now"], s["at"]
        cand = F.element_at(now, e["end"] + e["n"] + 1 - at)["best"] + e["score"]
        entry = F.array(F.struct(cand.alias("best"), e["id"].alias("id"), (-e["n"]).alias("n")))
        gone = F.size(now) - longest  # entries that no later edge begins at
        full = F.struct(F.concat(F.slice(now, gone + 1, F.lit(longest)), entry).alias("now"), F.concat(s["old"], F.array(F.slice(now, F.lit(1), gone))).alias("old"), (at + gone).alias("at"))
        begins = F.size(now) + at <= e["end"]
        put = lambda kept: F.struct(F.concat(kept, entry).alias("now"), s["old"].alias("old"), at.alias("at"))
        return (
            F.when(begins & (F.size(now) > CHUNK), full)
            .when(begins, put(now))
            .when(cand > F.element_at(now, -1)["best"], put(F.slice(now, F.lit(1), e["end"] - at)))
            .otherwise(s)
        )

    zero = F.struct(
        F.array(F.struct(F.lit(0.0).alias("best"), F.lit(0).alias("id"), F.lit(0).alias("n"))).alias("now"),
        F.array().cast("array<array<struct<best: double, id: int, n: int>>>").alias("old"), F.lit(0).alias("at"),
    )

    def walk(v: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            top = F.element_at(v, s["at"] + 1)
            full = F.size(s["ids"]) >= CHUNK
            return F.when(s["at"] <= 0, s).otherwise(
                F.struct(
                    (s["at"] - top["n"]).alias("at"),
                    F.concat(F.when(full, F.array().cast("array<int>")).otherwise(s["ids"]), F.array(top["id"])).alias("ids"),
                    F.when(full, F.concat(s["old"], F.array(s["ids"]))).otherwise(s["old"]).alias("old"),
                )
            )

        begin = F.struct((F.size(v) - 1).alias("at"), F.array().cast("array<int>").alias("ids"), F.array().cast("array<array<int>>").alias("old"))
        return F.aggregate(F.sequence(F.lit(1), F.size(v) - 1), begin, step, lambda s: F.reverse(F.concat(F.flatten(s["old"]), s["ids"])))

    done = F.aggregate(edges, zero, fold, lambda s: F.concat(F.flatten(s["old"]), s["now"]))
    # bound as a lambda's variable, so that the walk doesn't fold again for each step
    return F.transform(F.array(done), walk).getItem(0)


def _spread(ids: list[int], of_byte: dict[int, int]) -> list[int]:
    """With unknown characters as their bytes."""
    if min(ids, default=0) >= 0:
        return ids
    out = []
    for i in ids:
        out += [i] if i >= 0 else [of_byte.get(b, 0) for b in chr(-1 - i).encode("utf-8", "surrogatepass")]
    return out


def decode(ids: list[int], path: str = MODEL) -> str:
    """The text of ids; the space that encoding puts in front is taken away. U+2581 in a text comes back as a space."""
    spell = pieces(path)[2]
    text = b"".join([spell[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def decoded(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """encoded (ids and others) with text: what the ids spell; null ids have a null text. Ids outside the vocabulary are an error."""

    @F.arrow_udf("string")
    def spelt(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else decode(x, path) for x in ids.to_pylist()], pa.string())

    return encoded.withColumn("text", spelt(encoded["ids"]))


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each word's bytes begin and the last one's end, and all bytes."""
    _, ends, data = words.buffers()
    at = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    return at, np.frombuffer(data or b"", np.uint8)


def _by_range(words: list[str], hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, list[tuple[int, int, int, np.ndarray, bytes]]]:
    """The order of words by key range and inside it by their bytes, and of each range that any is in: the range, begin,
    end, the words' sizes and their bytes. A block sends no more rows than it has words, however many ranges there are."""
    k = (hashes % np.uint64(ranges)).astype(np.int64)
    text = pa.array(words, pa.string())
    order = pc.sort_indices(pa.table({"k": k, "w": text}), sort_keys=[("k", "ascending"), ("w", "ascending")])
    at, data = _bytes_of(text.take(order))
    order = order.to_numpy().astype(np.int64)
    some, first = np.unique(k[order], return_index=True)
    size = np.diff(at).astype(np.uint32)
    return order, [
        (r, a, b, size[a:b], data[at[a] : at[b]].tobytes()) for r, a, b in zip(some.tolist(), first.tolist(), [*first.tolist(), len(k)][1:], strict=True)
    ]


def _requester(ranges: int, path: str):
    def requests(texts: list[str]) -> Iterator[tuple[int, int, bytes]]:
        words, hashes, _, _ = indexed_words(texts, path)
        for k, _, _, size, raw in _by_range(words, hashes, ranges)[1]:
            yield 1, k, blocks.pack(size.astype(np.uint8) if size.max() < 256 else size, raw, level=3)

    return requests


def _words_of(data: bytes) -> tuple[pa.Array, bytes]:
    """The words of a request, in order, and its digest. Sizes come as bytes where all are small."""
    sizes, raw = blocks.unpack(data)
    small = np.frombuffer(sizes, np.uint8)
    size = small if small.sum(dtype=np.int64) == len(raw) else np.frombuffer(sizes, np.uint32)
    at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(raw)), xxhash.xxh3_64_digest(raw)


_WORDS = "k long, w long, word string, block long, data binary"


def _distinct(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a key range, numbered in order (w, word), and each request (block) as numbers."""
    k, asked = key[0].as_py(), []
    for b in batches:
        for block, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist(), strict=True):
            asked.append((block, *_words_of(data)))
    numbered = pa.concat_arrays([own for _, own, _ in asked]).dictionary_encode()
    order = pc.sort_indices(numbered.dictionary)
    ws = numbered.dictionary.take(order)
    rank = np.empty(len(ws), np.uint32)
    rank[order.to_numpy()] = np.arange(len(ws), dtype=np.uint32)
    number, at = rank[numbered.indices.to_numpy()], 0
    for i in range(0, len(ws), 20_000):
        part = ws[i : i + 20_000].cast(pa.string())
        n = len(part)
        yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int64()), pa.array(range(i, i + n), pa.int64()), part, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=["k", "w", "word", "block", "data"])
    for block, own, digest in asked:
        gaps = np.diff(number[at : at + len(own)], prepend=np.uint32(0))
        at += len(own)
        data = blocks.pack(gaps.astype(np.uint32), digest, level=3)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["k", "w", "word", "block", "data"])


def _replies(path: str):
    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        """The ids of each request's words, in its order, with the request's digest."""
        _, of_byte, _, _ = pieces(path)
        lists, out = known.column("ids").combine_chunks(), []
        size, flat = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
        start = np.cumsum(size) - size
        if (flat < 0).any():  # unknown characters become bytes
            ids = [_spread(flat[a : a + n].tolist(), of_byte) for a, n in zip(start.tolist(), size.tolist(), strict=True)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat, start = np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum())), np.cumsum(size) - size
        by = np.argsort(known.column("w").to_numpy(), kind="stable")
        flat, start, size = flat.astype(_id_type(path)), start[by], size[by]
        for d in asked.column("data").to_pylist():
            gaps, digest = blocks.unpack(d)
            at = np.cumsum(np.frombuffer(gaps, np.uint32), dtype=np.int64)
            own = size[at]
            out.append(blocks.pack(own.astype(np.uint32), flat[_places(start[at], own)], digest, level=3))
        return pa.table({"k": asked.column("k"), "block": asked.column("block"), "data": pa.array(out, pa.binary())})

    return run


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for `size` places, one run after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


@lru_cache(maxsize=2)
def _spelling(path: str) -> tuple[np.ndarray, np.ndarray]:
    """What all ids spell, one after another, and how many bytes each spells."""
    spell = pieces(path)[2]
    return np.frombuffer(b"".join(spell), np.uint8), np.fromiter(map(len, spell), np.int64, len(spell))


def _id_type(path: str):
    return np.uint16 if len(pieces(path)[2]) < 65_536 else np.uint32


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])


def _assembler(ranges: int, path: str):
    def run(bundle: pa.Table, replies: pa.Table) -> pa.Table:
        """Texts of one block, put together from the answers to its request."""
        kind = _id_type(path)
        docs = [x for d in bundle.column("data").to_pylist() for x in blocks.unpack_docs(d)]
        words, hashes, index, counts = indexed_words([text for _, text in docs], path)
        order, spans = _by_range(words, hashes, ranges)
        answers = dict(zip(replies.column("k").to_pylist(), replies.column("data").to_pylist(), strict=True))
        flats, size = [np.zeros(0, np.int32)], np.zeros(len(words), np.int64)
        for k, a, b, _, raw in spans:
            sizes, flat, digest = blocks.unpack(answers[k])
            if digest != xxhash.xxh3_64_digest(raw):
                raise RuntimeError("the documents changed between two readings")
            size[order[a:b]] = np.frombuffer(sizes, np.uint32)
            flats.append(np.frombuffer(flat, kind).astype(np.int32))
        flat = np.concatenate(flats)
        start = np.empty(len(words), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        letters, width = _spelling(path)
        long = width[flat]
        data = letters[_places((np.cumsum(width) - width)[flat], long)].tobytes()
        to = np.concatenate([[0], np.cumsum(long)])
        spelt = [data[a:b] for a, b in zip(to[start].tolist(), to[start + size].tolist(), strict=True)]
        out_ids, same, at = [], [], 0
        for (_, text), n in zip(docs, counts.tolist(), strict=True):
            mine = index[at : at + n]
            at += n
            sizes = size[mine]
            out_ids.append(flat[_places(start[mine], sizes)])
            same.append(b"".join(map(spelt.__getitem__, mine.tolist())) == (b" " + text.encode("utf-8", "surrogatepass") if text else b""))
        return pa.table([pa.array([i for i, _ in docs], pa.int64()), pa.array(out_ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], schema=_ENCODED)

    return run


@contextmanager
def _hashed_groups(spark: SparkSession) -> Iterator[None]:
    """Group edges in memory: a task's words are bounded by its key range, and sorting all edges would spill them."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "1000000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids, round_trip for each row of docs (doc_id, text).

    ids are the best-scoring pieces of the whole text, of whatever length; of equal ways through a word the one whose last
    piece is longest counts. round_trip says that the ids spell the text again exactly, which all texts do but those with
    U+2581. Null and empty texts have no ids; rows are neither joined nor dropped, so repeated rows stay repeated; null ids
    stay null; an empty table gives no rows; other columns, whatever their names, are ignored. Files are read twice, in the same
    splits even if executors come or go between; files that are overwritten meanwhile end in an error.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks.steady_splits(spark)
    d = typed(docs, doc_id="long", text="string")
    try:
        docs.select("_metadata.file_path")
    except AnalysisException:  # blocks are made twice, so they are made of what is stored, which every reading gives alike
        d = saved(d, "rows")
    n = blocks.ranges(d)
    d = d.withColumn("fold", F.lit(0))
    bundles = blocks.bundled(d, BLOCK_BYTES)  # read twice, which costs less than keeping a copy
    requests = blocks.requested_of(d, _requester(n, path), BLOCK_BYTES).select("k", "block", "data")
    both = saved(requests.groupBy("k").applyInArrow(lean_group(_distinct), _WORDS), "words")
    words, asked = both.where("w is not null").select("k", "w", "word"), both.where("w is null").select("k", "block", "data")
    with _hashed_groups(spark):
        known = saved(lattice(words.repartition(n, "k"), spark, path, ("k", "w")), "pieces")
    replies = asked.groupBy("k").cogroup(known.groupBy("k")).applyInArrow(lean_pair(_replies(path)), "k long, block long, data binary")
    return bundles.select("block", "data").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lean_pair(_assembler(n, path)), "doc_id long, ids array<int>, round_trip boolean")
