"""Alignment, packing and clustering on small tables against brute force; nulls, ties, repeats, long texts, clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from tokenizers import Tokenizer

from orbitlake.llm import align, centroids, packing
from orbitlake.llm.queries import ORACLE

SCRAPS = [
    " ", " ", "  ", "\n", "\t", "\r\n", "\x00", "\x0b", "\x1c", "\x85", "᠎", "　", "​", "a", "The", "ing", "É", "İ", "é", "ſ", "ŉ", "Ж", "ς", "日本", "\U0001f600",
    "́", "ﬁ", "▁", "<s>", "<0x41>", "<|endoftext|>", "<|STARTOFTEXT|>", "<|", "|>", "'s", "'LL", "12", "½", "...", ",",
]


def scraps(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(SCRAPS) for _ in range(r.randrange(1, 30))) for _ in range(n)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "Gamma,", "délta."]) + str(r.randrange(50)) for _ in range(n))


EDGE = [(None, "a b c"), (None, None), (1, None), (2, ""), (3, " "), (4, "one two"), (4, "one two"), (5, "é▁ü"), (6, "word " * 4000), (7, "x" * 5000), (8, prose(1, 3000))]


@pytest.fixture(scope="module")
def tokenizers():
    with open(align.PATH_A, "rb") as a, open(align.PATH_B, "rb") as b:
        return align.Tokenizers(a.read(), b.read())


def by_hand(t, texts):
    """Whole texts through the libraries, links by sweeping both lists, groups by common ends."""
    out, count = [], Counter()
    for text in texts:
        own = ([], [], [], [])
        if text:
            a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
            spelt = [[s[i].as_py() for i in ids] for s, ids in ((t.spell_a, a), (t.spell_b, b))]
            if b"".join(spelt[0]) == b"".join(spelt[1]) == (" " + text).encode():
                ends = [[0], [0]]
                for e, s in zip(ends, spelt, strict=True):
                    for x in s:
                        e.append(e[-1] + len(x))
                links, j = [], 0
                for i in range(len(a)):
                    while ends[1][j + 1] <= ends[0][i]:
                        j += 1
                    k = j
                    while k < len(b) and ends[1][k] < ends[0][i + 1]:
                        links.append((i, k))
                        k += 1
                groups = [((ends[0].index(x), ends[0].index(y)), (ends[1].index(x), ends[1].index(y))) for x, y in _steps(sorted(set(ends[0]) & set(ends[1])))]
                own = (a, b, groups, links)
        out.append(own)
        count.update((own[0][i], own[1][k]) for i, k in own[3])
    return out, count


def _steps(marks):
    return zip(marks, marks[1:], strict=False)


def test_words_of_any_text_align_as_the_whole_text(tokenizers):
    texts = scraps(1, 2000)
    words = align.Words(tokenizers)
    split = words.split(texts)
    expected, _ = by_hand(tokenizers, texts)
    for text, own, (a, b, groups, links) in zip(texts, split, expected, strict=True):
        line = ";".join(",".join(map(str, a[x:y])) + "|" + ",".join(map(str, b[u:v])) for (x, y), (u, v) in groups)
        assert words.n[:, own].sum(1).tolist() == [len(a), len(b), len(groups), len(links)], text
        assert align._digest(words.texts, own) == (hashlib.sha256(line.encode()).hexdigest() if a else ""), text
    assert sum(not e[0] for e in expected) > 100 and sum(bool(e[0]) for e in expected) > 100


def test_alignment_digests(spark, tokenizers):
    rows = EDGE + [(100 + i, t) for i, t in enumerate(scraps(2, 60))] + [(200 + i, prose(i, 40)) for i in range(40)]
    expected, count = by_hand(tokenizers, [t for _, t in rows])
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    want = []
    for (i, _), (a, b, groups, links) in zip(rows, expected, strict=True):
        line = ";".join(",".join(map(str, a[x:y])) + "|" + ",".join(map(str, b[u:v])) for (x, y), (u, v) in groups)
        pairs = [(a[x], b[y]) for x, y in links]
        want.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[1]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(line.encode()).hexdigest() if a else ""))
    key = lambda r: tuple((x is not None, x) for x in r)
    docs = spark.createDataFrame([(i, t, 1, 2.0, "z") for i, t in rows], "doc_id long, text string, block long, n_a double, codes string").repartition(3)
    got = [tuple(r) for r in align.alignment_digests(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert align.alignment_digests(docs.limit(0)).collect() == []
    spans = {r["doc_id"]: r for r in align.alignments(docs.where("doc_id >= 100")).collect()}
    for (i, _), (a, b, groups, links) in zip(rows, expected, strict=True):
        if i is not None and i >= 100:
            r = spans[i]
            assert (r["a_ids"], r["b_ids"], [tuple(x) for x in r["links"]]) == (list(a), list(b), links)
            assert r["b_group"] == [g for g, (_, (u, v)) in enumerate(groups) for _ in range(u, v)]


def test_small_blocks_give_the_same(spark):
    docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(600)], "doc_id long, text string").coalesce(1)
    whole = sorted(map(tuple, align.alignment_digests(docs).collect()))
    assert sorted(map(tuple, align.alignment_digests(docs, block_bytes=100).collect())) == whole
    assert sorted(map(tuple, align.alignment_digests(docs, words=20).collect())) == whole


def test_word_ids_are_those_of_the_whole_text():
    with open(packing.PATH, "rb") as f:
        words = packing.WordIds(f.read())
    whole = Tokenizer.from_file(packing.PATH)
    texts = scraps(3, 3000) + [prose(1, 500), "Don't stop, we'll go! (ABC's) x²"]
    for _ in range(2):
        (ids, size), at = words.of(texts), 0
        for text, n in zip(texts, size.tolist(), strict=True):
            assert ids[at : at + n].tolist() == [*whole.encode(text, add_special_tokens=False).ids, packing.END], text
            at += n


def placed(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append(r)
    for own in at.values():
        end = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= capacity
    return len(at)


@pytest.mark.parametrize("shard", [packing.SHARD, 4])
def test_pack(spark, shard):
    rows = EDGE + [(100 + i, prose(i, 20 + 7 * i)) for i in range(40)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, slot long, length long, offset long").repartition(3)
    got = packing.pack(docs, 512, with_ids=True, shard=shard)
    found = got.collect()
    whole, want = Tokenizer.from_file(packing.PATH), Counter()
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 512):
            part = ids[k : k + 512]
            want[i, k // 512, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)), tuple(part)] += 1
    assert Counter((*(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), tuple(r["ids"])) for r in found) == want
    total = sum(k[3] * n for k, n in want.items())
    assert placed(found, 512) <= -(-total // 512) + 1
    assert packing.pack(docs.limit(0)).collect() == []


def test_sequences_hold_the_ids_in_place(spark):
    got = packing.pack(spark.createDataFrame([(i, prose(i, 10 + i)) for i in range(30)], "doc_id long, text string"), 128, with_ids=True).collect()
    again = {r["sequence_id"]: r["ids"] for r in packing.sequences(spark.createDataFrame(got)).collect()}
    assert all(again[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"] for r in got)


def test_local_search_never_loses_and_raises_squares():
    r = random.Random(5)
    for low, high, n in ((1, 60, 500), (200, 700, 300), (340, 520, 400), (600, 1000, 100)):
        sizes = [r.randrange(low, high) for _ in range(n)]
        first, bins = packing.best_fit(sizes, 1000), packing.packed(sizes, 1000)
        for own in (first, bins):
            assert sorted(p for b in own for p in b.pieces) == list(range(n))
            assert all(b.fill == sum(sizes[p] for p in b.pieces) <= 1000 and b.sizes == Counter(sizes[p] for p in b.pieces) for b in own)
        assert -(-sum(sizes) // 1000) <= len(bins) <= len(first)
        if len(bins) == len(first):
            assert sum(b.fill**2 for b in bins) >= sum(b.fill**2 for b in first)
    # best fit needs three, exchanges two
    assert len(packing.best_fit([6, 5, 4, 3, 2], 10)) == len(packing.packed([6, 5, 4, 3, 2], 10)) == 2
    swaps = [44, 6, 24, 6, 8, 21, 50, 27, 17, 7, 29, 34, 50, 7, 40]
    assert len(packing.packed(swaps, 100)) <= len(packing.best_fit(swaps, 100))


def lloyd(rows, k, rounds, scale):
    """Clusters in a loop over Python integers."""
    rows = [(i, [math.floor(scale * c) for c in x]) for i, x in rows]
    seeds = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in rows)[:k]
    cs = [q for _, q in seeds]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, q in rows:
            own[near(q)[1]].append(q)
        cs = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(cs)]
    return Counter((i, near(q)[1], near(q)[0], hashlib.sha256(",".join(map(str, cs[near(q)[1]])).encode()).hexdigest()) for i, q in rows)


@pytest.mark.parametrize("spread", [1.0, 1e-3, 1e9])
def test_clusters_against_a_loop(spark, spread):
    r = random.Random(7)
    middles = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [spread * (c + r.gauss(0, 0.2)) for c in r.choice(middles)]) for i in range(300)]
    rows += rows[:20] + [(None, [0.5] * 6), (None, [0.5] * 6), (7, [float(-x) for x in range(6)]), (1000, [spread * 40] * 6)]
    bad = [(1, None), (2, [1.0] * 5), (3, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (4, [math.nan] * 6), (5, [math.inf] * 6)]
    df = spark.createDataFrame([(i, x, 1, "q") for i, x in rows + bad], "vec_id long, embedding array<double>, cluster long, x string").repartition(3)
    got = centroids.clusters(df, clusters=6, rounds=5, dimension=6, segment=4).collect()
    want = lloyd(rows, 6, 5, 1024)
    sums, fitting = Counter(), Counter()
    for (i, j, d, h), n in want.items():
        fitting[i, j, d if d < 1 << 63 else None, h] += n
    assert Counter((g["vec_id"], g["cluster"], g["distance"], g["centroid_sha256"]) for g in got) == fitting
    for (_, j, d, _), n in want.items():
        sums[j] += n * d
    fits = lambda x: x if x < 1 << 63 else None
    wide = any(d >= 1 << 63 for _, _, d, _ in want)
    assert wide or all((g["cluster_inertia"], g["inertia"]) == (fits(sums[g["cluster"]]), fits(sum(sums.values()))) for g in got)
    assert centroids.clusters(df.limit(0)).collect() == [] and centroids.clusters(df.where("vec_id = 2")).collect() == []


def test_clusters_equal_sql(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{path}'")
    columns = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    got = centroids.clusters(spark.read.parquet(path)).selectExpr(*columns.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(c.execute(f"select {columns} from ({ORACLE['op13_centroid_clustering']})").fetchall())


def test_bounds_never_exceed_distances():
    import numpy as np

    q = np.random.default_rng(3).integers(-1000, 1000, (200, 10))
    cs = centroids.Centroids(q[:9].tolist(), 3)
    d = ((q[:, None] - cs.q[None]) ** 2).sum(2)
    low = cs.bounds(centroids.norms(q, 3))
    assert (low <= d).all() and (low > 0).any()
