"""Alignment of the tokens that two tokenizers, A and B, make of the same text.

A text, with a space in front, is cut before spaces that follow another character than white space: neither vocabulary
has a token that reaches over such a place, so a text's tokens are those of its words, one after another. Each word is
aligned once: the byte ranges of B's tokens are a static index of intervals, and each token of A is a stabbing query that
lists what it overlaps by bisection. Gaps between B's tokens that no token of A spans are the boundaries of groups.

How often a pair of ids is linked is counted over the whole corpus. Documents are held in blocks of a bounded number of
bytes; a block adds up the links of its own words, so that a row for each pair of ids and block is what is shuffled, not
one for each link, and no pair has more rows than there are blocks.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.llm import blocks
from orbitlake.llm.common import arrow_rows, lean, lean_pair, saved, small_batches, typed

#: The vocabulary files.
PATH_A, PATH_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text of a block, and distinct words that a worker keeps aligned.
BLOCK_BYTES, WORDS = 12 << 20, 400_000
SPACE, _BYTE = "▁", re.compile(r"<0x([0-9A-F]{2})>")
#: A space at the very beginning or after white space: then the text is cut by a search, else at each space.
_RUNS, _CUT = re.compile(r"^ |\s "), re.compile(r"(?<=\S)(?= )")
#: The same for a text of ASCII alone: what may stand before such a space; and marks after a letter, which A parts from it.
_BLANKS, _TAIL = [f"{c} " for c in " \t\n\r\v\f\x1c\x1d\x1e\x1f"], ",.;:!?"
_PLAIN = re.compile(r"\S+")
#: Words that the library is given at a time: it slows down with longer texts.
JOINED = 200
#: White space to some Unicode versions only: a text with it is one word.
_DOUBTFUL = "᠎"


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes: printable Latin-1 ones for themselves, the others from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in own)
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers and what their ids spell, made of the contents of their files."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        letters = _byte_alphabet()
        vocabulary = self.a.get_vocab()
        spell = [b""] * (max(vocabulary.values()) + 1)
        heads = np.zeros(len(spell), np.bool_)
        space = next(c for c, x in letters.items() if x == 0x20)
        for token, i in vocabulary.items():
            spell[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
            heads[i] = token[:1] == space
        self.heads = heads
        self.spell_a = pa.array(spell, pa.large_binary())
        self.spell_b = pa.array([self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())], pa.large_binary())
        self.bits = int(self.b.get_piece_size()).bit_length()
        # three rows an id: as it stands before another of its kind, as the last of A's and as the last of B's in a group
        self.text_a, self.text_b = (pa.array([b"%d%s" % (i, s) for i in range(n) for s in (b",", b"|", b";")], pa.large_binary()) for n in (len(spell), len(self.spell_b)))
        self.alone = self.b.piece_to_id(SPACE)
        self.words = Words(self)

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = _BYTE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode()

    def _plain_a(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words without white space by A, a space in front of each, and how many each has: distinct stems are given to
        the library many at a time as one text, in which the tokens that begin with a space begin the words."""
        stems, tails, of_stem, of_tail = defaultdict(), defaultdict(), [], []
        stems.default_factory, tails.default_factory = stems.__len__, tails.__len__
        for w in words:
            stem = w.rstrip(_TAIL)
            if not (stem and stem[-1].isascii() and stem[-1].isalpha()):
                stem = w
            of_stem.append(stems[stem])
            of_tail.append(tails[w[len(stem) :]])
        own = list(stems)
        ids = flat([e.ids for e in self.a.encode_batch_fast([" " + " ".join(own[i : i + JOINED]) for i in range(0, len(own), JOINED)], add_special_tokens=False)])
        first = np.flatnonzero(self.heads[ids])
        if len(first) != len(stems):
            return None
        ends = [self.a.encode(t, add_special_tokens=False).ids for t in tails]
        size = np.concatenate([np.diff(first, append=len(ids)), np.fromiter(map(len, ends), np.int64, len(ends))])
        start = np.cumsum(size) - size
        own = np.array([of_stem, np.array(of_tail) + len(stems)]).T.ravel()  # of each word its stem, then its tail
        return np.concatenate([ids, flat(ends)])[places(start[own], size[own])], size[own].reshape(-1, 2).sum(1)

    def ids_a(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words by A, a space in front of each, and how many each has."""
        plain = np.fromiter((_PLAIN.fullmatch(w) is not None for w in words), np.bool_, len(words))
        found = self._plain_a([w for w, p in zip(words, plain.tolist(), strict=True) if p]) if plain.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if found is None:
            plain[:], found = False, (np.zeros(0, np.int64), np.zeros(0, np.int64))
        rest = [e.ids for e in self.a.encode_batch_fast([" " + w for w, p in zip(words, plain.tolist(), strict=True) if not p], add_special_tokens=False)]
        size, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        size[plain], size[~plain] = found[1], [len(r) for r in rest]
        start[plain], start[~plain] = np.cumsum(size[plain]) - size[plain], len(found[0]) + np.cumsum(size[~plain]) - size[~plain]
        return np.concatenate([found[0], flat(rest)])[places(start, size)], size

    def ids_b(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by B, which puts the space in front itself; of nothing it would make nothing."""
        found = [x if w else [self.alone] for w, x in zip(words, self.b.encode(words, num_threads=1), strict=True)]
        return flat(found), np.fromiter(map(len, found), np.int64, len(found))


_LOADED: dict[int, Tokenizers] = {}


def tokenizers_of(shared: Broadcast) -> Tokenizers:
    """The tokenizers of a broadcast, made once a process."""
    a, b = shared.value
    key = xxhash.xxh3_64_intdigest(a + b)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizers(a, b)
    return _LOADED[key]


def shared_files(spark: SparkSession, *paths: str) -> Broadcast:
    """The contents of vocabulary files of the driver, a few MB, for all executors."""
    out = []
    for p in paths:
        with open(p, "rb") as f:
            out.append(f.read())
    return spark.sparkContext.broadcast(tuple(out))


def flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


def places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for `size` places, one run after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def cut(text: str) -> list[str]:
    """The words of a text, each without the space in front of it."""
    if _DOUBTFUL in text:
        return [text]
    if (text[0] != " " and not any(b in text for b in _BLANKS)) if text.isascii() else _RUNS.search(text) is None:
        return text.split(" ")
    return [w[1:] for w in _CUT.split(" " + text)]


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A the first token of B that it overlaps and the one after the last, by where tokens end, ascending."""
    first = np.searchsorted(b_end, np.concatenate([[0], a_end[:-1]]), "right")
    return first, np.searchsorted(np.concatenate([[0], b_end[:-1]]), a_end, "left")


def closing(first: np.ndarray, last: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of A and of B are the last of their group: those before a gap of B that no token of A spans."""
    n = len(b_end)
    spanned = np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(last - 1, minlength=n + 1))[:n]
    ends_b = spanned == 0
    return ends_b[last - 1] & (b_end[last - 1] == a_end), ends_b


def _joined(spell: pa.Array, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """What ids spell one after another, and where each ends."""
    taken = spell.take(pa.array(ids))
    _, ends, data = taken.buffers()
    ends = np.frombuffer(ends, np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    return (data.to_pybytes() if data is not None else b"")[: ends[-1]], ends[1:]


class Words:
    """The words that a worker has met, each aligned: counts of tokens and groups, links and the groups as text."""

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.clear()

    def clear(self) -> None:
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.done = 0
        self.bad = np.zeros(0, np.bool_)
        self.n = np.zeros((4, 0), np.int64)  # tokens of A, of B, groups, links
        self.codes: list[np.ndarray] = []
        self.texts: list[bytes] = []

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def align(self) -> None:
        """Align the words that have been numbered since the last call."""
        new = list(self.index)[self.done :]
        if not new:
            return
        raw = [b" " + w.encode() for w in new]
        a, size_a = self.t.ids_a(new)
        b, size_b = self.t.ids_b(new)
        bad = np.zeros(len(new), np.bool_)
        whole = b"".join(raw)
        if any(_joined(s, x)[0] != whole for s, x in ((self.t.spell_a, a), (self.t.spell_b, b))):
            for spell, ids, size in ((self.t.spell_a, a, size_a), (self.t.spell_b, b, size_b)):
                data, ends = _joined(spell, ids)
                at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(size)])].tolist()
                bad |= np.fromiter((data[x:y] != r for x, y, r in zip(at, at[1:], raw, strict=True)), np.bool_, len(raw))
            a, b = a[np.repeat(~bad, size_a)], b[np.repeat(~bad, size_b)]
            size_a, size_b = np.where(bad, 0, size_a), np.where(bad, 0, size_b)
        a_end, b_end = _joined(self.t.spell_a, a)[1], _joined(self.t.spell_b, b)[1]
        n = np.zeros((4, len(new)), np.int64)
        n[0], n[1] = size_a, size_b
        codes, texts = np.zeros(0, np.uint64), [b""] * len(new)
        if len(a):
            first, last = overlaps(a_end, b_end)
            ends_a, ends_b = closing(first, last, a_end, b_end)
            word_a, word_b = np.repeat(np.arange(len(new)), size_a), np.repeat(np.arange(len(new)), size_b)
            n[2] = np.bincount(word_b[ends_b], minlength=len(new))
            n[3] = np.bincount(word_a, weights=last - first, minlength=len(new)).astype(np.int64)
            codes = (np.repeat(a, last - first).astype(np.uint64) << np.uint64(self.t.bits)) | b[places(first, last - first)].astype(np.uint64)
            texts = self._texts(a, b, ends_a, ends_b, size_a + size_b)
        self.codes.append(codes)
        self.texts += texts
        self.bad, self.n = np.concatenate([self.bad, bad]), np.concatenate([self.n, n], 1)
        self.done += len(new)

    def _texts(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, size: np.ndarray) -> list[bytes]:
        """a1,a2|b1; and so on of the groups of each word, each with its end mark."""
        of_a, of_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b  # the group of each token
        at_a = np.arange(len(a)) + np.searchsorted(of_b, of_a, "left")
        at_b = np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")
        entry = np.empty(len(a) + len(b), np.int64)
        entry[at_a] = a * 3 + ends_a
        entry[at_b] = len(self.t.text_a) + b * 3 + 2 * ends_b
        data, ends = _joined(self.table, entry)
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(size)])].tolist()
        return [data[x:y] for x, y in zip(at, at[1:], strict=False)]

    @cached_property
    def table(self) -> pa.Array:
        return pa.concat_arrays([self.t.text_a, self.t.text_b])

    def split(self, texts: list[str | None]) -> list[np.ndarray]:
        """The aligned words of each text. A text with a word that either tokenizer spells otherwise is tried as one word, and
        has none if its bytes differ then too."""
        out = [self.numbers(cut(t)) if t else np.zeros(0, np.int64) for t in texts]
        self.align()
        if self.bad.any():
            wrong = [i for i, x in enumerate(out) if self.bad[x].any()]
            for i in wrong:
                out[i] = self.numbers([texts[i]])
            self.align()
            for i in wrong:
                if self.bad[out[i][0]]:
                    out[i] = out[i][:0]
        return out

    def links_of(self, used: np.ndarray) -> np.ndarray:
        """Codes of the links of words, one word's after another's."""
        size = self.n[3]
        self.codes = [np.concatenate([np.zeros(0, np.uint64), *self.codes])]
        return self.codes[0][places((np.cumsum(size) - size)[used], size[used])]


_BLOCKS = pa.schema([("block", pa.int64()), ("data", pa.binary()), ("codes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def _block(number: int, ids: list, split: list[np.ndarray], words: Words) -> pa.RecordBatch:
    """A block's documents with all that its own words say, its pairs of ids, and how often each is linked."""
    own = np.concatenate([np.zeros(0, np.int64), *split])
    size = np.fromiter(map(len, split), np.int64, len(split))
    count = np.bincount(own, minlength=len(words.index))
    used = np.flatnonzero(count)
    local = np.zeros(len(count), np.uint32)
    local[used] = np.arange(len(used))
    codes, links = words.links_of(used), words.n[3][used]
    pairs, at = np.unique(codes, return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, at, np.repeat(count[used], links))
    sums = [summed(x[own], size) for x in words.n]
    sha = b"".join(_digest(words.texts, x).encode().ljust(64) for x in split)
    data = blocks.pack(
        np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], np.bool_), size, *sums, sha, local[own], links.astype(np.uint32), at.astype(np.uint32)
    )
    return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([data], pa.binary()), pa.array([pairs.astype(np.int64)], _BLOCKS.field(2).type), pa.array([total], _BLOCKS.field(3).type)], schema=_BLOCKS)


def summed(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `size` values."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(size)
    return total[ends] - total[ends - size]


def _digest(texts: list[bytes], words: np.ndarray) -> str:
    return hashlib.sha256(b"".join(map(texts.__getitem__, words.tolist()))[:-1]).hexdigest() if len(words) else ""


def _blocked(shared: Broadcast, block_bytes: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = tokenizers_of(shared).words, TaskContext.get().partitionId() << 24
        ids, split, size = [], [], 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids += batch.column("doc_id").to_pylist()
            split += words.split(texts)
            size += sum(len(t) for t in texts if t)
            if size >= block_bytes or len(words.index) > most:
                yield _block(number, ids, split, words)
                number, ids, split, size = number + 1, [], [], 0
                if len(words.index) > most:
                    words.clear()
        if ids:
            yield _block(number, ids, split, words)

    return run


_DIGESTS = pa.schema(
    [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())]
)
_DIGESTS_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _counted(held: pa.Table, known: pa.Table) -> pa.Table:
    """The documents of one block with the counts of its pairs."""
    order = np.argsort(known.column("code").to_numpy())
    total, best = known.column("total").to_numpy()[order], known.column("best").to_numpy()[order].astype(np.int64)
    out = []
    for data in held.column("data").to_pylist():
        ids, none, size, *sums, sha, local, links, at = blocks.unpack(data)
        ids = pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(none, np.bool_))
        size, links = np.frombuffer(size, np.int64), np.frombuffer(links, np.uint32).astype(np.int64)
        at, local = np.frombuffer(at, np.uint32), np.frombuffer(local, np.uint32)
        scores = [summed(summed(x[at], links)[local], size) for x in (best, total)]
        texts = [sha[i : i + 64].decode().strip() for i in range(0, len(sha), 64)]
        out.append(pa.table([ids, *(np.frombuffer(s, np.int64) for s in sums), *scores, pa.array(texts, pa.string())], schema=_DIGESTS))
    return pa.concat_tables(out) if out else _DIGESTS.empty_table()


def pair_counts(pairs: DataFrame, bits: int, vocabulary: int) -> DataFrame:
    """code, total, best: links of each pair of ids (code, n), and whether no other A id has more links with its B id."""
    totals = pairs.groupBy("code").agg(F.sum("n").alias("total")).withColumn("b", F.col("code").bitwiseAND((1 << bits) - 1))
    totals = saved(totals, "pairs")
    top = totals.groupBy("b").agg(F.max("total").alias("top"))  # a row for each id of B at most, so it can be broadcast
    return totals.join(F.broadcast(top.limit(vocabulary)), "b").select("code", "total", (F.col("total") == F.col("top")).alias("best"))


def alignment_digests(docs: DataFrame, path_a: str = PATH_A, path_b: str = PATH_B, block_bytes: int = BLOCK_BYTES, words: int = WORDS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs (doc_id, text).

    n_a and n_b are the tokens of space+text by A and of text by B, n_groups the groups into which places where both end cut
    them, n_links the pairs of occurrences whose bytes overlap, n_best the links of pairs that are as frequent as any with
    their B id, ties included, count_sum the counts of all links' pairs. Null and empty texts, and those that A or B spell
    otherwise, have zeros and an empty digest, and add nothing to the counts. Rows are neither joined nor dropped: repeated
    rows count and stay as often as they come; null ids stay null; an empty table gives no rows; other columns, whatever
    their names, are ignored; a text of any length is aligned whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = shared_files(spark, path_a, path_b)
    vocabulary = len(tokenizers_of(shared).spell_b)
    d = typed(docs, doc_id="long", text="string")
    held = saved(d.mapInArrow(lean(_blocked(shared, block_bytes, words)), "block long, data binary, codes array<long>, counts array<long>"), "blocks")
    pairs = held.select(F.col("block").alias("of"), F.explode(F.arrays_zip("codes", "counts")).alias("p")).select("of", F.col("p.codes").alias("code"), F.col("p.counts").alias("n"))
    known = pairs.select(F.col("of").alias("block"), "code").join(pair_counts(pairs.select("code", "n"), tokenizers_of(shared).bits, vocabulary), "code")
    return held.select("block", "data").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lean_pair(_counted), _DIGESTS_SQL)


_ALIGNED = pa.schema(
    [
        ("doc_id", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())), ("a_ends", pa.list_(pa.int64())), ("b_ends", pa.list_(pa.int64())),
        ("a_group", pa.list_(pa.int32())), ("b_group", pa.list_(pa.int32())), ("links", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
    ]
)
_ALIGNED_SQL = "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<long>, b_ends array<long>, a_group array<int>, b_group array<int>, links array<struct<a:int,b:int>>"


def align_text(t: Tokenizers, text: str | None) -> dict:
    """The alignment of one text: ids, where tokens end in the bytes of space+text, groups from 0, links by position."""
    none = {c: [] for c in _ALIGNED.names[1:]}
    if not text:
        return none
    words = cut(text)
    for own in (words, [text]):
        (a, _), (b, _) = t.ids_a(own), t.ids_b(own)
        (raw_a, a_end), (raw_b, b_end) = _joined(t.spell_a, a), _joined(t.spell_b, b)
        if raw_a == raw_b == b" " + text.encode():
            first, last = overlaps(a_end, b_end)
            ends_a, ends_b = closing(first, last, a_end, b_end)
            n = last - first
            links = [{"a": x, "b": y} for x, y in zip(np.repeat(np.arange(len(a)), n).tolist(), places(first, n).tolist(), strict=True)]
            return dict(zip(none, (a, b, a_end, b_end, np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b, links), strict=True))
    return none


def alignments(docs: DataFrame, path_a: str = PATH_A, path_b: str = PATH_B) -> DataFrame:
    """doc_id, a_ids, b_ids, a_ends, b_ends, a_group, b_group, links: the alignment of each row of docs (doc_id, text) itself.

    Ends are byte offsets in space+text; groups are numbered from 0; links hold the positions of tokens that overlap. What
    alignment_digests says of nulls, empty texts, repeats and other columns holds here too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = shared_files(spark, path_a, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers_of(shared)
        for i, text in arrow_rows(batches, "doc_id", "text"):
            own = align_text(t, text)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), *(pa.array([own[f.name]], f.type) for f in list(_ALIGNED)[1:])], schema=_ALIGNED)

    return typed(docs, doc_id="long", text="string").mapInArrow(lean(run), _ALIGNED_SQL)
