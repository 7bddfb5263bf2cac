"""Test items inside documents, by MinHash containment over items partitioned by size.

A shingle's MinHash value is a hash of it. Items are partitioned by the size of their sets, in powers of two. A partition
has its own signature length: an item is sketched by that many of its least values. It also has its own limit, the largest
value in any of its signatures, and a document is sketched for a partition by its shingles up to that limit, so both sides
keep the low end of one order, and a long document keeps enough of it for a short item. The signature is one longer than
the most shingles that an item of the partition may lack; so a document that contains enough of an item has all of the
signature but as many as may lack, and this count is the item's threshold: nothing is lost. Pairs that reach it are verified
by exact containment of the whole set. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitlake.llm.common import dropped, saved, sized, typed

#: Words of a shingle, and the least share of an item's shingles that a document must contain, in percent.
WORDS, PERCENT = 5, 75
#: How much longer a signature is than the least length; more collisions are asked for in return, so fewer pairs are verified.
LONGER = 2
#: Items' shingles up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000


def _words(text: Column) -> Column:
    """Lower-case A-Z, then words [^\\x20\\x09-\\x0D]+."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, "[\\x20\\x09-\\x0D]+"), "")


def _shingles(words: Column) -> Column:
    """Hashes of runs of five words; fewer words make one run; none, none.

    The words are bound as a lambda's variable, so that the optimizer can't split the text again for each run.
    """

    def runs(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - WORDS + 1)))
        return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, WORDS), " ")))

    return F.transform(F.array(words), runs).getItem(0)


def _sets(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, _shingles(_words(F.col("text"))).alias("s"))


def size_partition(n: str | Column) -> Column:
    """Partition of an item by the size of its set: the power of two it reaches."""
    return F.floor(F.log2(n)).cast("int")


def signature_length(part: Column) -> Column:
    """Of a partition: LONGER times the most shingles that one of its items may lack, plus one."""
    most = F.pow(F.lit(2), part + 1).cast("long") - 1
    return F.floor(most * (100 - PERCENT) / 100).cast("long") * LONGER + 1


def _value(shingle: Column) -> Column:
    return F.xxhash64(shingle, F.lit(11))


def sketches(items: DataFrame) -> DataFrame:
    """item_id, n, shingle, value, part, sketch (whether the shingle is in the signature) and threshold, of all items."""
    one = typed(items, item_id="long", text="string").where("text is not null")
    sets = _sets(one, "item_id").select("item_id", F.explode("s").alias("shingle")).distinct()
    n = F.count("*").over(Window.partitionBy("item_id"))
    order = F.row_number().over(Window.partitionBy("item_id").orderBy("value", "shingle"))
    full = sets.withColumn("n", n).withColumn("value", _value(F.col("shingle"))).withColumn("at", order).withColumn("part", size_partition("n"))
    length = F.least(signature_length(F.col("part")), F.col("n"))
    may_lack = F.floor(F.col("n") * (100 - PERCENT) / 100).cast("long")
    return full.select("item_id", "n", "shingle", "value", "part", (F.col("at") <= length).alias("sketch"), (length - may_lack).alias("threshold"))


def contaminations(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared for each document that contains PERCENT of an item's shingles or more.

    Input: docs (doc_id, text), items (item_id, text). Texts with fewer than five words make one shingle; null and empty
    texts have none and neither contain nor are contained; null ids are ids; rows that share an id are one document or
    item, with the shingles of all; repeated rows and ties of values change nothing; empty tables give no rows; texts have
    no greatest length; other columns are ignored.
    """
    full = saved(sketches(items), "items")
    signatures = full.where("sketch")
    # a row for each power of two, which is what a partition is
    limits = signatures.groupBy("part").agg(F.max("value").alias("limit")).orderBy("part").collect()
    parts = F.array(*(F.struct(F.lit(r["part"]).alias("part"), F.lit(r["limit"]).alias("limit")) for r in limits)).cast("array<struct<part: int, limit: bigint>>")
    most = max((r["limit"] for r in limits), default=-(1 << 63))
    d = typed(docs, doc_id="long", text="string").where("text is not null")
    low = F.filter("s", lambda x: _value(x) <= F.lit(most))
    sketched = _sets(d, "doc_id").select("doc_id", F.explode(low).alias("shingle"))
    sketched = sketched.select("doc_id", "shingle", F.explode(F.transform(F.filter(parts, lambda p: p["limit"] >= _value(F.col("shingle"))), lambda p: p["part"])).alias("part"))
    # each shingle of a partition once, so that shingles which items share multiply nothing here
    known = sized(signatures.select("part", "shingle").distinct(), BROADCAST_ROWS)
    seen = sketched.join(known, ["part", "shingle"]).distinct()
    met = seen.join(sized(signatures.select("part", "shingle", "item_id", "threshold"), BROADCAST_ROWS), ["part", "shingle"])
    candidates = met.groupBy("doc_id", "item_id", "threshold").agg(F.count("*").alias("hits")).where("hits >= threshold")
    candidates = saved(candidates.select("doc_id", "item_id"), "candidates")
    # verification: the candidates' whole texts against their items' whole sets
    some = sized(candidates.select("doc_id").distinct())
    again = d.join(some, d["doc_id"].eqNullSafe(some["doc_id"]), "left_semi")
    found = _sets(again, "doc_id").select("doc_id", F.explode("s").alias("shingle")).join(sized(full.select("shingle").distinct(), BROADCAST_ROWS), "shingle").distinct()
    shared = found.join(sized(full.select("item_id", "n", "shingle"), BROADCAST_ROWS), "shingle").groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("n_shared"))
    sure = shared.where(F.col("n_shared") * 100 >= F.col("n") * PERCENT)
    c = candidates.select(F.col("doc_id").alias("d"), F.col("item_id").alias("i"))
    sure = sure.join(c, sure["doc_id"].eqNullSafe(c["d"]) & sure["item_id"].eqNullSafe(c["i"]), "left_semi")
    out = saved(sure.select("doc_id", "item_id", F.col("n").alias("n_shingles"), "n_shared"), "contaminations")
    dropped(full, candidates)
    return out
