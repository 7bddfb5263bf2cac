"""Near-duplicate groups by an inverted join over MinHash signature coordinates.

1. Texts with one shingle set are one representative; only those go on.
2. A representative is posted under each coordinate-value pair of its signature. Pairs that nobody shares go, then
   representatives with fewer shared pairs than the match threshold, until nothing goes.
3. What is left of a signature is ordered by how rare its pairs are. Two signatures that agree in MATCHES coordinates
   meet within the prefix that ends MATCHES - 1 before the end, so only prefixes are merged.
4. The posting lists are merged by counting: in each list members meet one pivot, and a member goes on with the pivot that
   it meets most often. The pair's collisions are then counted over all coordinates; pairs with MATCHES or more are
   retained, and linked if their full sets confirm it. Lists whose members are in one group already are skipped from then on.
5. What turns of pivots leave over is merged list by list in blocks: collisions of all members of a block pair are counted
   in one task, pairs with MATCHES or more are retained and confirmed there on the full sets. Where lists overlap so much
   that all they connect takes fewer comparisons, they are merged as one. A task joins what it has linked, and returns
   only links that join something new.
6. Groups are the components of the confirmed links; each turn contracts what is found before the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitlake.llm.common import WordHashes, arrow_rows, dropped, lean, lean_group, mixed, saved, shingles, sized, small_batches, words

#: Coordinates of a signature, and how many must agree: of a pair whose similarity is just 0.75, fewer than 23 of 48 agree
#: with a chance of about 3 in 100,000; of a pair at 0.8, 2 in 10 million.
COORDINATES, MATCHES = 48, 23
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Members of a block in step 5, and shingles of its sets, at most (a longer set is a block of its own).
BLOCK, BLOCK_ITEMS = 1024, 1 << 20
#: Pairs of occurrences of common shingles that a comparison of two blocks looks at together: they are what it needs memory for.
PAIRS = 1 << 20
#: Turns of pivots, and rows of one key that go to one task; a hotter key's are dealt to several.
PIVOTS, HOT = 3, 512
#: Links up to which their components are found in one task; more take joins.
LOCAL_LINKS = 250_000
_SEEDS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """For each coordinate, the least scrambled shingle."""
    out = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(s), 16384):
        out = np.minimum(out, (s[None, i : i + 16384] * _SEEDS[:, None]).min(1))
    return out


def _long(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def located(docs: DataFrame) -> DataFrame:
    """file, row, doc_id, text: each row with where it is stored. What isn't read from files as it is, is stored first."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        docs = saved(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), "rows")
    return docs.select(*_place(), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def _place() -> list:
    return [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document: the size of its shingle set, a 64-bit key of the set and the set's signature."""
    hashes = WordHashes()
    for b in batches:
        n, rep, sig = [], [], []
        for (text,) in arrow_rows([b], "text"):
            s = shingles(hashes.of(words(text)))
            n.append(len(s))
            rep.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [b.column("file"), b.column("row"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(rep, pa.int64()), pa.array(sig, pa.binary())],
            names=["file", "row", "doc_id", "n", "rep", "sig"],
        )


_KEYED = "file long, row long, doc_id long, n long, rep long, sig binary"


def _collisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sa, sb) whose signatures agree in MATCHES coordinates or more."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, COORDINATES) for c in ("sa", "sb"))
        yield b.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= MATCHES))


def _spread(many: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """many joined with few on key. Both hold n, how often a key is in many: rows of one that is there more than HOT times
    are dealt to several parts by a hash of `by`, and its row of few is copied to each part. The result has few's n."""
    parts = F.ceil(F.col("n") / HOT).cast("int")
    left = many.withColumn("part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("n")
    right = few.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right, [key, "part"]).drop("part")


def _sized(many: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """many with n for hot keys: lists (key, n) says how often each is in many; others have an n of 1."""
    hot = sized(lists.where(F.col("n") > HOT).select(key, "n"))
    return many.join(hot, key, "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long")))


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep and the key of each coordinate-value pair of its signature."""
    salt = mixed(np.arange(COORDINATES, dtype=np.uint64) + np.uint64(77))
    for b in batches:
        reps = b.column("rep").to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint64).reshape(len(reps), COORDINATES)
        keys = mixed(sig ^ salt)
        yield pa.RecordBatch.from_arrays([pa.array(_long(keys.ravel())), pa.array(np.repeat(reps, COORDINATES), pa.int64())], names=["key", "rep"])


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep and the full set of shingles."""
    hashes = WordHashes()
    for b in batches:
        reps, sets = [], []
        for r, t in arrow_rows([b], "rep", "text"):
            reps.append(r), sets.append(_long(shingles(hashes.of(words(t)))))
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "items"])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, comp of the links of all batches, by union and find."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for hi, lo in arrow_rows(batches, "hi", "lo"):
        a, b = top(up.setdefault(hi, hi)), top(up.setdefault(lo, lo))
        up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "comp"])


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for every node of edges (a, b).

    Up to LOCAL_LINKS edges, a few megabytes, are united in one task; more by alternating star joins.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = saved(e, "edges")
    if now.count() <= LOCAL_LINKS:
        out = saved(now.coalesce(1).mapInArrow(lean(_united), "node long, comp long"), "components")
        dropped(now)
        return out
    return _starred(now)


def _starred(now: DataFrame) -> DataFrame:
    """components() of saved edges (hi, lo) by alternating star joins.

    A large star ties each node's larger neighbours to its least one, a small star its smaller ones; both keep what is
    connected, and repeated they leave only stars. All steps are joins and minima; nothing goes to the driver but two sums.
    """
    before = None
    while True:
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        nxt = saved(
            small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(small.select("hi", F.col("m").alias("lo")))
            .where("hi <> lo").distinct(),
            "edges",
        )
        dropped(now)
        now = nxt
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            break
        before = mark
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct())


def confirmed(pairs: DataFrame, full: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs (a, b) those with MATCHES collisions of their signatures or more, and whose full sets link.

    A pivot may be in many pairs: its partition is large in bytes, so adaptive execution splits it.
    """
    sig = lambda x: nodes.select(F.col("rep").alias(x), F.col("sig").alias(f"s{x}"))
    met = pairs.join(sig("b"), "b").join(sig("a"), "a").select("a", "b", "sa", "sb")
    retained = saved(met.mapInArrow(lean(_collisions), "a long, b long"), "retained")
    one = full.select(F.col("rep").alias("a"), F.col("items").alias("xa"))
    two = full.select(F.col("rep").alias("b"), F.col("items").alias("xb"))
    joined = retained.join(two, "b").join(one, "a")
    both = joined.select("a", "b", F.size(F.array_intersect("xa", "xb")).alias("both"), (F.size("xa") + F.size("xb")).alias("sizes"))
    out = saved(both.where(100 * F.col("both") >= PERCENT * (F.col("sizes") - F.col("both"))).select("a", "b"), "links")
    dropped(retained)
    return out


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of one side with each of the other."""
    out = np.zeros((len(left), len(right)), np.float32)
    sides = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    items = [np.concatenate(x) for x in (left, right)]
    common = np.intersect1d(*items)
    row, col = [], []
    for x, side in zip(items, sides, strict=True):
        at = np.minimum(np.searchsorted(common, x), max(0, len(common) - 1))
        there = common[at] == x if len(common) else np.zeros(len(x), bool)
        row.append(side[there]), col.append(at[there])
    n = [np.bincount(c, minlength=len(common)) for c in col]
    often = n[0] * n[1] > 4096
    # frequent items by dense products of bounded width
    place = np.cumsum(often) - 1
    for lo in range(0, int(often.sum()), 2048):
        dense = []
        for k, x in enumerate((left, right)):
            pick = often[col[k]] & (place[col[k]] >= lo) & (place[col[k]] < lo + 2048)
            m = np.zeros((len(x), min(2048, int(often.sum()) - lo)), np.float32)
            m[row[k][pick], place[col[k][pick]] - lo] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    # the others by their pairs
    order = [np.argsort(np.where(often[c], len(common), c), kind="stable") for c in col]
    row = [r[o] for r, o in zip(row, order, strict=True)]
    first = [np.concatenate([[0], np.cumsum(np.where(often, 0, k))]) for k in n]
    width = np.where(often, 0, n[0] * n[1])
    ends = np.cumsum(width)
    lo = 0
    while lo < len(common):
        done = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        total = int(ends[hi - 1]) - done
        if total:
            item = np.repeat(np.arange(lo, hi), width[lo:hi])
            at = np.arange(total) - np.repeat(ends[lo:hi] - width[lo:hi] - done, width[lo:hi])
            x, y = row[0][first[0][item] + at // n[1][item]], row[1][first[1][item] + at % n[1][item]]
            out += np.bincount(x * len(right) + y, minlength=out.size).reshape(out.shape)
        lo = hi
    return out


def _agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether each signature of one side agrees with each of the other in MATCHES coordinates or more."""
    out = np.zeros((len(left), len(right)), np.uint8)
    for k in range(COORDINATES):
        out += left[:, k, None] == right[None, :, k]
    return out >= MATCHES


def _compared(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two blocks of a group, or within one, that join what nothing else of the task has joined."""
    i, j = key[1].as_py(), key[2].as_py()
    t = pa.Table.from_batches(list(batches))
    block, rep, comp = (t.column(c).to_numpy() for c in ("block", "rep", "comp"))
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if not len(left) or not len(right):
        return
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(len(rep), COORDINATES)
    retained = _agreeing(sig[left], sig[right]) & (comp[left][:, None] != comp[right][None])
    left, right = left[retained.any(1)], right[retained.any(0)]
    retained = retained[np.ix_(retained.any(1), retained.any(0))]
    if not len(left):
        return
    lists = t.column("items").combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    n = np.array([len(s) for s in sets])
    both = _overlaps([sets[x] for x in left], [sets[x] for x in right])
    linked = retained & (100 * both >= PERCENT * (n[left][:, None] + n[right][None] - both))
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    out = []
    for x, y in zip(*np.nonzero(linked), strict=True):
        c, d = top(int(comp[left[x]])), top(int(comp[right[y]]))
        if c != d:
            up[max(c, d)] = min(c, d)
            out.append((int(rep[left[x]]), int(rep[right[y]])))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _merged(left: DataFrame, full: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: links between members of a list (key, rep, comp) that aren't in one group, in blocks.

    A list of n members takes n * n comparisons. Where all members of connected lists together take fewer than the lists
    one by one, they are one group.
    """
    sizes = saved(left.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("hub")), "sizes")
    left = left.select("key", "rep", "comp", "n")
    lists = sizes.select("key", "hub", F.col("n").alias("own"))
    listed = saved(_spread(left, lists.join(left.groupBy("key").agg(F.first("n").alias("n")), "key"), "key", "rep"), "listed")
    tied = components(listed.select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    of = sizes.join(tied, sizes["hub"] == tied["node"]).select("key", "n", F.col("comp").alias("cluster"))
    members = tied.groupBy(F.col("comp").alias("cluster")).agg(F.count("*").alias("members"))
    cost = of.groupBy("cluster").agg(F.sum(F.col("n") * F.col("n")).alias("cost")).join(members, "cluster")
    whole = cost.where(F.col("members") * F.col("members") <= F.col("cost")).select("cluster", F.lit(True).alias("whole"))
    one = of.join(whole, "cluster", "left").select("key", F.when(F.col("whole"), F.col("cluster")).otherwise(F.col("key")).alias("g"))
    one = one.join(left.groupBy("key").agg(F.first("n").alias("n")), "key")
    cut = saved(_spread(left, one, "key", "rep").select("g", "rep", "comp").distinct(), "cut")
    some = cut.select("rep").distinct()
    sets = saved(full.join(some, "rep").join(nodes.select("rep", "sig"), "rep"), "members")
    sized_ = cut.join(sets.select("rep", F.size("items").alias("items")), "rep").groupBy("g").agg(F.count("*").alias("n"), F.sum("items").alias("items"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("items") / BLOCK_ITEMS)).cast("int")
    groups = saved(sized_.select("g", "n", blocks.alias("blocks")), "groups")
    cut2 = _spread(_sized(cut, groups, "g"), groups.withColumn("n", F.when(F.col("n") > HOT, F.col("n")).otherwise(1)), "g", "rep")
    cut2 = cut2.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # block b meets each block, itself included, in the task of the ordered pair
    cut2 = cut2.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "comp")
    out = saved(cut2.join(sets, "rep").groupBy("g", "i", "j").applyInArrow(lean_group(_compared), "a long, b long").distinct(), "links")
    dropped(sizes, listed, cut, sets, groups)
    return out


def _prefixes(nodes: DataFrame) -> DataFrame:
    """key, rep, n: the posts that are merged, see steps 2 and 3 above, and how many representatives have the pair."""
    posts = nodes.select("rep", "sig").mapInArrow(lean(_posted), "key long, rep long")
    for turn in range(2):
        lists = saved(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "lists")
        if turn:  # what the first turn has left knows how often each pair was there before
            few = lists.withColumnRenamed("n", "now").join(posts.groupBy("key").agg(F.first("n").alias("n")), "key")
            shared = _spread(posts.select("key", "rep", "n"), few, "key", "rep").select("key", "rep", F.col("now").alias("n"))
        else:
            few = lists.select("key", F.col("n").alias("now"), F.when(F.col("n") > HOT, F.col("n")).otherwise(1).alias("n"))
            shared = _spread(_sized(posts, lists, "key"), few, "key", "rep").select("key", "rep", F.col("now").alias("n"))
        shared = saved(shared, "shared")
        enough = shared.groupBy("rep").agg(F.count("*").alias("live")).where(F.col("live") >= MATCHES)
        kept = saved(shared.join(enough, "rep"), "posts")
        dropped(shared, posts, lists)
        posts = kept
    rarest = F.row_number().over(Window.partitionBy("rep").orderBy("n", "key"))
    out = saved(posts.withColumn("at", rarest).where(F.col("at") <= F.col("live") - MATCHES + 1).select("key", "rep", "n"), "prefixes")
    dropped(posts)
    return out


def _relabelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels (rep, comp, size) with the groups that links (a, b) join; what is in one group already is one node."""
    a = labels.select(F.col("rep").alias("a"), F.col("comp").alias("x"))
    b = labels.select(F.col("rep").alias("b"), F.col("comp").alias("y"))
    new = components(found.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    now = labels.join(new, labels["comp"] == new["node"], "left").select("rep", F.coalesce(new["comp"], labels["comp"]).alias("comp"))
    now = saved(now, "labels")
    out = saved(now.join(now.groupBy("comp").agg(F.count("*").alias("size")), "comp").select("rep", "comp", "size"), "labels")
    dropped(now, new)
    return out


def _groups(d: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """rep, comp: the group of each representative that is linked with any, and of some that aren't; None if none is."""
    posts = _prefixes(nodes)
    involved = saved(posts.select("rep").distinct(), "involved")
    if involved.isEmpty():
        dropped(posts, involved)
        return None
    # one text of each representative
    places = sets.where("rep is not null").join(involved, "rep", "left_semi").groupBy("rep").agg(F.min(F.struct("file", "row")).alias("p"))
    places = saved(places.select("rep", "p.file", "p.row"), "places")
    texts = d.select("file", "row", "text").join(sized(places), ["file", "row"]).select("rep", "text")
    full = saved(texts.mapInArrow(lean(_full), "rep long, items array<bigint>"), "sets")
    some = saved(nodes.join(involved, "rep").select("rep", "sig"), "signatures")
    labels = saved(involved.select("rep", F.col("rep").alias("comp"), F.lit(1).cast("long").alias("size")), "labels")
    for turn in range(PIVOTS + 1):
        mine = posts.select("key", "rep", "n").join(labels, "rep")
        # a hot list is reduced in parts first
        part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / HOT)).alias("part")
        mins = mine.groupBy("key", "n", part).agg(F.min(F.struct(-F.col("size"), "comp", "rep")).alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        lists = mins.groupBy("key").agg(F.min("p").alias("p"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n")).where("lo <> hi")
        lists = saved(lists.select("key", "n", F.col("p.rep").alias("pivot"), F.col("p.comp").alias("own")), "lists")
        left = saved(_spread(mine, lists, "key", "rep"), "left")
        dropped(posts, lists)
        posts = left
        if left.isEmpty():
            break
        if turn < PIVOTS:
            pairs = left.where("comp <> own").groupBy(F.col("pivot").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("hits"))
            found = confirmed(pairs.groupBy("b").agg(F.max_by("a", F.struct("hits", "a")).alias("a")).select("a", "b"), full, some)
        else:
            found = _merged(left.select("key", "rep", "comp", "n"), full, some)
        before, labels = labels, _relabelled(labels, found)
        dropped(before, found)
    dropped(posts, places, full, some, involved)
    return labels.select("rep", "comp")


def _judged(d: DataFrame) -> DataFrame:
    """file, row, doc_id, n, comp: each row's set size and group, null without a set."""
    small_batches(d.sparkSession)
    sets = saved(d.mapInArrow(lean(_keyed), _KEYED), "keys")
    # texts with one set are one node; copies meet in partial aggregates, so their number is no matter
    nodes = saved(sets.where("n > 0").groupBy("rep").agg(F.first("sig").alias("sig")), "nodes")
    groups = _groups(d, sets, nodes)
    if groups is not None:
        out = saved(sets.drop("sig").join(groups, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "groups")
    else:
        out = saved(sets.drop("sig").withColumn("comp", F.col("rep")), "groups")
    dropped(sets, nodes)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs (doc_id, text).

    Linked are documents with 100 * intersection >= 75 * union of their sets of distinct five-word shingles; fewer words
    make one shingle; null and empty texts and texts of white space have an empty set and are linked with nothing. Equal
    rows are equal documents. Rows that share a doc_id but not a text are documents of their own, each in its text's
    group. A null doc_id is never the smallest of a group that has another; a group of null ids alone, like an empty text
    with a null id, has a null component and is kept. Of pivots that a member meets equally often, the larger key counts.
    An empty table gives no rows; other columns are ignored.
    """
    rows = _judged(located(docs))
    least = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "comp", "left")
    comp = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) without all rows but one of each near-duplicate group.

    The row with the smallest doc_id stays, nulls last; of those, one. Rows are told apart by where they are stored, so
    rows that share a doc_id, have none or are equal in every column are documents of their own. Null and empty texts are
    in no group and stay. Texts aren't shuffled unless the rows to take out are too many to broadcast.
    """
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        docs = saved(docs, "rows")
    rows = _judged(located(docs))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
    stays = rows.where("comp is not null").groupBy("comp").agg(F.min(first).alias("s"), F.count("*").alias("n")).where("n > 1")
    gone = rows.join(stays.select("comp", F.col("s.file").alias("f"), F.col("s.row").alias("r")), "comp").where("file <> f or row <> r")
    gone = sized(saved(gone.select(F.col("file").alias("_file"), F.col("row").alias("_row")), "gone"))
    dropped(rows)
    file, row = _place()
    out = docs.select("*", file.alias("_at_file"), row.alias("_at_row"))
    return out.join(gone, (out["_at_file"] == gone["_file"]) & (out["_at_row"] == gone["_row"]), "left_anti").select(*docs.columns)
