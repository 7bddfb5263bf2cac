"""Best-fit packing of token pieces into sequences of bounded length.

Pieces are dealt into shards of a bounded number of rows by a number of their own, so no text, source or document is hot. A
shard is packed by best fit, longest first, and then improved by a local search: between a poorly filled sequence and
another underfull one a piece is moved, or one is exchanged for one, two for one or one for two, whenever that increases
the sum of squared fills, until the poor one is empty. What a shard could not fill goes on: the pieces of its least full
sequences are packed again together with those of other shards, level by level, up to one group.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitlake.llm.align import flat, places, shared_files, summed
from orbitlake.llm.common import dropped, lean, saved, small_batches, typed, working

#: The vocabulary file, the tokens of a sequence and the id that ends a document.
PATH, CAPACITY, END = "/opt/tokenizers/word_bpe_49k.json", 4096, 1
#: Rows of a shard, shards whose remainders are packed together, and sequences that a shard passes on at most.
SHARD, FAN, CARRY = 16_384, 64, 4
#: Poor sequences in a row that the search could not empty before it ends.
PATIENCE = 64
#: Words of a corpus, and parts of them, whose ids a worker keeps.
WORDS = 800_000
#: Words whose lower case and parts don't depend on a version of Unicode: printable ASCII and the letters of Latin-1 and Latin
#: Extended-A but U+0130; and how the vocabulary's own pattern cuts them once in lower case.
_LATIN = "À-ÖØ-öø-įı-ſ"
_SIMPLE, _PARTS = re.compile(f"[!-~{_LATIN}]+"), re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z{_LATIN}0-9]+")
_SPECIAL, _WORD_END, _MARKS = "<|", "</w>", b",.;:!?"
#: Parts that the library is given at a time: it slows down with longer texts.
JOINED = 200


class Pool:
    """Lists of ids, numbered in turn, in one array."""

    def __init__(self):
        self.ids, self.size, self.start = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        start = len(self.ids) + np.cumsum(size) - size
        self.ids, self.size, self.start = np.concatenate([self.ids, ids.astype(np.uint32)]), np.concatenate([self.size, size]), np.concatenate([self.start, start])

    def take(self, numbers: np.ndarray) -> np.ndarray:
        return self.ids[places(self.start[numbers], self.size[numbers])]


def numbering() -> defaultdict:
    """A dictionary that numbers its keys in turn."""
    out = defaultdict()
    out.default_factory = out.__len__
    return out


class WordIds:
    """Ids of words (bytes without white space), kept for words seen lately. The key None stands for a document's end."""

    def __init__(self, content: bytes, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.t, self.plain, self.end = Tokenizer.from_str(content.decode()), Tokenizer.from_str(content.decode()), end
        # parts of lower-case ASCII are cut already, and each of their characters is its own byte
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        vocabulary = self.t.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, np.bool_)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.words, self.parts, self.of_words, self.of_parts = numbering(), numbering(), Pool(), Pool()
        self.words[None], self.parts[b""]
        self.of_words.add(np.array([self.end]), np.ones(1, np.int64))
        self.of_parts.add(np.zeros(0), np.zeros(1, np.int64))

    def _whole(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.t.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return flat(found), np.fromiter(map(len, found), np.int64, len(found))

    def _joined(self, parts: list[bytes], t) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts of words and how many each has: the library is given many as one text, in which tokens with an end mark end them."""
        texts = [b" ".join(parts[i : i + JOINED]).decode() for i in range(0, len(parts), JOINED)]
        ids = flat([e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)])
        at = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(at, prepend=0)) if len(at) == len(parts) else self._whole(parts)

    def learn(self) -> None:
        """Ids of new words: of letters and marks after them by these parts, of other simple words by theirs, of the rest as a whole."""
        new = list(islice(self.words, len(self.of_words.size), None))
        parts, known, letters, marks, simple, others = self.parts, len(self.parts), [], [], [], []
        kind = np.zeros(len(new), np.int8)
        for n, w in enumerate(new):
            stem = w.rstrip(_MARKS)
            if stem.isalpha():  # letters of ASCII alone
                letters.append(parts[stem.lower()])
                marks.append(parts[w[len(stem) :]])
                continue
            text = w.decode()
            if _SIMPLE.fullmatch(text) and _SPECIAL not in text:
                kind[n] = 1
                simple.append([parts[p.encode()] for p in _PARTS.findall(text.lower())])
            else:
                kind[n] = 2
                others.append(w)
        fresh = list(islice(parts, known, None))
        ascii_ = np.fromiter((p.isascii() for p in fresh), np.bool_, len(fresh))
        self.of_parts.add(*_merged(~ascii_, self._joined([p for p in fresh if p.isascii()], self.plain), self._joined([p for p in fresh if not p.isascii()], self.t)))
        of, pool = np.array([letters, marks], np.int64).T.ravel(), self.of_parts
        some, many = flat(simple), np.fromiter(map(len, simple), np.int64, len(simple))
        plain = (pool.take(of), pool.size[of].reshape(-1, 2).sum(1))
        two = _merged(kind[kind < 2], plain, (pool.take(some), summed(pool.size[some], many)))
        self.of_words.add(*_merged(kind == 2, two, self._whole(others)))

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts with their ends, one text's after another's, and how many each has; white space has none."""
        split = [t.encode().split() if t else [] for t in texts]
        for ws in split:
            ws.append(None)
        if len(self.words) > WORDS:
            self.clear()
        size = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
        self.learn()
        return self.of_words.take(numbers), summed(self.of_words.size[numbers], size)


def _merged(second: np.ndarray, *lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two rows of lists (ids and sizes) as one, in the order that `second` says."""
    second = second.astype(np.bool_)
    size, start = np.zeros(len(second), np.int64), np.zeros(len(second), np.int64)
    (a, of_a), (b, of_b) = lists
    size[~second], size[second] = of_a, of_b
    start[~second], start[second] = np.cumsum(of_a) - of_a, len(a) + np.cumsum(of_b) - of_b
    return np.concatenate([a, b])[places(start, size)], size


_LOADED: dict[tuple[int, int], WordIds] = {}


def _words_of(shared: Broadcast, end: int) -> WordIds:
    (content,) = shared.value
    key = (xxhash.xxh3_64_intdigest(content), end)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordIds(content, end)
    return _LOADED[key]


def _cut(shared: Broadcast, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId() << 40
        words = _words_of(shared, end)
        for b in batches:
            ids, size = words.of(b.column("text").to_pylist())
            count = -(-size // capacity)
            doc, piece = np.repeat(np.arange(len(size)), count), places(np.zeros(len(size), np.int64), count)
            start = piece * capacity
            length = np.minimum(capacity, size[doc] - start)
            to = np.concatenate([[0], np.cumsum(length)])
            raw, at = memoryview(ids.astype("<u4").tobytes()), (4 * to).tolist()
            out = {
                "slot": pa.array(slot + np.arange(len(doc))), "doc_id": b.column("doc_id").take(pa.array(doc)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start),
                "length": pa.array(length), "ids_crc32": pa.array([zlib.crc32(raw[s:e]) for s, e in zip(at, at[1:], strict=False)], pa.int64()),
            }
            slot += len(doc)
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(out)

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str = PATH, with_ids: bool = False) -> DataFrame:
    """slot, doc_id, piece, start, length, ids_crc32 and, if asked for, ids: the pieces of each row of docs (doc_id, text).

    A document is the ids of its whole text, then `end`; only one of more than `capacity` ids is cut. A null text is an empty
    one, of the id `end` alone. slot is a number of the piece's own in this table, so rows that are equal stay apart.
    """
    small_batches(docs.sparkSession)
    shared = shared_files(docs.sparkSession, path)
    kind = "slot long, doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return saved(typed(docs, doc_id="long", text="string").mapInArrow(lean(_cut(shared, capacity, end, with_ids)), kind), "pieces")


class Bin:
    """A sequence: its pieces by size, and their sum."""

    __slots__ = ("pieces", "fill", "sizes")

    def __init__(self):
        self.pieces: list[int] = []
        self.fill, self.sizes = 0, Counter()


def best_fit(lengths: list[int], capacity: int) -> list[Bin]:
    """Longest first, each piece into the fullest sequence that has room. Room is found in a mask of the free sizes."""
    bins, at, free = [], {}, 0
    for p in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[p]
        room = free >> n
        if room:
            f = n + (room & -room).bit_length() - 1
            b = at[f].pop()
            if not at[f]:
                free ^= 1 << f
        else:
            b, f = Bin(), capacity
            bins.append(b)
        b.pieces.append(p)
        b.sizes[n] += 1
        b.fill += n
        if f > n:
            at.setdefault(f - n, []).append(b)
            free |= 1 << (f - n)
    return bins


def _mask(sizes: Counter) -> int:
    out = 0
    for n in sizes:
        out |= 1 << n
    return out


def _pair_sums(sizes: Counter) -> dict[int, tuple[int, int]]:
    """Sums of two pieces of a sequence, with their sizes."""
    own = list(sizes)
    return {a + b: (a, b) for i, a in enumerate(own) for b in own[i:] if a != b or sizes[a] > 1}


def _best_move(donor: Bin, one: int, two: int, to: Bin, capacity: int) -> tuple[int, int, int] | None:
    """What the other sequence gains at most, up to its room, with what it gives back and whether two pieces come for that.

    Returns gain, size given back (of one piece or a pair) and the kind: 0 a move or a one-for-one, 1 two for one, 2 one for two.
    """
    room, best = capacity - to.fill, None
    limit = (2 << room) - 2
    floor = max(0, donor.fill - to.fill)  # the squares grow if the gain is more than this

    def better(mask: int, back: int, kind: int) -> bool:
        nonlocal best
        gain = ((mask >> back) & limit).bit_length() - 1
        if gain > floor and (best is None or gain > best[0]):
            best = (gain, back, kind)
        return best is not None and best[0] == room

    if better(one, 0, 0):
        return best
    for e in to.sizes:
        if better(one, e, 0) or better(two, e, 1):
            return best
    for e in _pair_sums(to.sizes):
        if better(one, e, 2):
            return best
    return best


def _passed(source: Bin, target: Bin, size: int, lengths: list[int]) -> None:
    p = next(p for p in source.pieces if lengths[p] == size)
    source.pieces.remove(p)
    target.pieces.append(p)
    source.fill, target.fill = source.fill - size, target.fill + size
    target.sizes[size] += 1
    source.sizes[size] -= 1
    if not source.sizes[size]:
        del source.sizes[size]


def _drained(donor: Bin, bins: list[Bin], lengths: list[int], capacity: int) -> None:
    """Let a sequence give to the others whatever increases the sum of squared fills, as long as anything does."""
    moved = True
    while donor.fill and moved:
        moved = False
        for to in bins:
            if to is donor or to.fill == capacity or not donor.fill:
                continue
            found = _best_move(donor, _mask(donor.sizes), _mask(_pair_sums(donor.sizes)), to, capacity)
            if found is None:
                continue
            gain, back, kind = found
            given = _pair_sums(donor.sizes)[gain + back] if kind == 1 else (gain + back,)
            returned = _pair_sums(to.sizes)[back] if kind == 2 else (back,) if back else ()
            for n in given:
                _passed(donor, to, n, lengths)
            for n in returned:
                _passed(to, donor, n, lengths)
            moved = True


def packed(lengths: list[int], capacity: int) -> list[Bin]:
    """Sequences of at most `capacity`: best fit, then the local search until no fewer are possible or nothing helps."""
    bins = best_fit(lengths, capacity)
    least = max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths))
    tried, failed = set(), 0
    while len(bins) > least and failed < PATIENCE:
        under = sorted((b for b in bins if b.fill < capacity), key=lambda b: b.fill)
        donor = next((b for b in under if id(b) not in tried), None)
        if donor is None:
            break
        _drained(donor, under[::-1], lengths, capacity)
        if donor.fill:
            tried.add(id(donor))
            failed += 1
        else:
            bins.remove(donor)
            tried, failed = set(), 0
    return bins


def _packer(capacity: int, level: int, carry: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with working():
            rows = pa.Table.from_batches(list(batches))
            rows = rows.sort_by([("length", "descending"), ("slot", "ascending")])
            lengths = rows.column("length").to_pylist()
            bins = packed(lengths, capacity)
            order = flat([b.pieces for b in bins])
            size = np.fromiter((len(b.pieces) for b in bins), np.int64, len(bins))
            number = np.repeat(np.arange(len(bins)), size)
            fill = np.array([b.fill for b in bins])
            goes_on = np.zeros(len(bins), np.bool_)
            goes_on[[i for i in np.argsort(fill, kind="stable")[:carry].tolist() if fill[i] < capacity]] = True
            n = np.array(lengths)[order]
            begin = np.cumsum(n) - n
            first = np.cumsum(size) - size
            rows = rows.take(pa.array(order)).drop_columns(["sequence_id", "offset", "goes_on"])
            rows = rows.append_column("sequence_id", pa.array((((level << 36) + key[0].as_py()) << 24) + number))
            rows = rows.append_column("offset", pa.array(begin - begin[first][number])).append_column("goes_on", pa.array(goes_on[number]))
            yield from rows.to_batches(max_chunksize=4096)

    return run


def place(rows: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """rows (slot, length and any other columns, none called shard, sequence_id, offset or goes_on) with sequence_id and offset.

    slot tells the rows apart, length is at least 1 and at most `capacity`. Offsets run without gaps from 0 in each sequence.
    An empty table gives no rows.
    """
    n = rows.count()
    shards, level, done = max(1, -(-n // shard)), 0, None
    kinds = rows.withColumn("shard", F.lit(0).cast("long")).withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).withColumn("goes_on", F.lit(True))
    todo, before = kinds.withColumn("shard", F.pmod(F.xxhash64("slot"), F.lit(shards))), None
    while True:
        last = shards == 1
        found = todo.groupBy("shard").applyInArrow(_packer(capacity, level, 0 if last else CARRY), kinds.schema)
        if last:
            out = found if done is None else done.unionByName(found)
            return out.drop("shard", "goes_on")
        found = saved(found, "packed")
        part = found.where(~F.col("goes_on"))
        done = part if done is None else done.unionByName(part)
        shards, level = -(-shards // FAN), level + 1
        todo = found.where("goes_on").withColumn("shard", F.floor(F.col("shard") / FAN).cast("long"))


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str = PATH, with_ids: bool = False, shard: int = SHARD) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids: all pieces of docs (doc_id, text) in place.

    Null ids stay null; repeated rows are documents of their own; ties in length go by the rows' places in the table; an empty
    table gives no rows; other columns, whatever their names, are ignored; texts of any length are tokenized whole.
    """
    return place(pieces(docs, capacity, end, path, with_ids), capacity, shard).drop("slot")


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """sequence_id, ids: the sequences themselves, of what pack(with_ids=True) returns."""
    rows = packed_pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("r"))
    return rows.select("sequence_id", F.flatten(F.transform("r", lambda r: r["ids"])).alias("ids"))
