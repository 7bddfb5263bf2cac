"""WARC records and a Merkle fixity audit of replicas.

A record's leaf is the SHA-256 of its bytes. Leaves are ordered by their offset in the file's index, and ranges of FANOUT
slots are hashed upwards to one root a file, so a tree can be compared without the records. The audit compares roots,
and then only the children of nodes that differ, down to the records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitlake.llm.common import dropped, saved, typed

#: Children of a node, levels above the leaves, and bytes of a slot: the offset ranges that are leaves' parents.
FANOUT, LEVELS, SLOT_BYTES = 16, 4, 1 << 16
#: Page ids of one archive file, and files for records without an id.
PAGES_PER_FILE, NO_ID_FILES = 512, 1 << 16


def record(url: Column, ident: Column, body: Column) -> Column:
    """A WARC/1.1 resource record as text; null bodies count as empty."""
    body = F.coalesce(body, F.lit(""))
    crlf = "\r\n"
    return F.concat(
        F.lit("WARC/1.1" + crlf + "WARC-Type: resource" + crlf + "WARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(crlf + "WARC-Record-ID: <urn:x-page:"), F.coalesce(ident.cast("string"), F.lit("")),
        F.lit(">" + crlf + "WARC-Date: 2000-01-01T00:00:00Z" + crlf + "Content-Type: text/html" + crlf + "Content-Length: "),
        F.octet_length(body).cast("string"), F.lit(crlf * 2), body, F.lit(crlf * 2),
    )


def records(pages: DataFrame) -> DataFrame:
    """file, page_id, length, digest, copies: the records of pages (page_id, url, html), equal ones counted.

    Pages go to files by ranges of page_id. A page without an id is known by its digest alone, and goes to one of
    NO_ID_FILES files by that. Bodies don't leave their tasks, and copies are counted before they are shuffled.
    """
    p = typed(pages, page_id="long", url="string", html="string").withColumn("r", record(F.col("url"), F.col("page_id"), F.col("html")))
    p = p.select("page_id", F.octet_length("r").cast("long").alias("length"), F.sha2("r", 256).alias("digest"))
    none = -1 - F.pmod(F.xxhash64("digest"), F.lit(NO_ID_FILES))
    file = F.coalesce(F.floor(F.col("page_id") / PAGES_PER_FILE).cast("long"), none.cast("long"))
    return p.select(file.alias("file"), "page_id", "length", "digest").groupBy("file", "page_id", "length", "digest").agg(F.count("*").alias("copies"))


def archive(pages: DataFrame) -> DataFrame:
    """file, page_id, length, digest, copies, offset: the index of an archive in page order.

    Inside a file records are ordered by id, then by digest; the copies of a record follow one another from `offset` on.
    """
    w = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("length") * F.col("copies")
    return records(pages).withColumn("offset", F.sum(size).over(w) - size)


def parse_warc(content: bytes) -> Iterator[dict]:
    """Records of a WARC file: offset, length, type, uri, id, body. A broken record ends the file."""
    at = 0
    while content.startswith(b"WARC/", at):
        head = content.find(b"\r\n\r\n", at)
        if head < 0:
            return
        fields = {}
        for line in content[at:head].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        size = fields.get("content-length", "")
        if not size.isdigit() or head + 4 + int(size) > len(content):
            return
        end = head + 4 + int(size)
        stop = end + 4 if content.startswith(b"\r\n\r\n", end) else end
        yield {"offset": at, "length": stop - at, "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "id": fields.get("warc-record-id"), "body": content[head + 4 : end]}
        at = stop


_PARSED = "path string, offset long, length long, type string, uri string, id string, body binary, digest string"


def read_warc(files: DataFrame) -> DataFrame:
    """Records of whole files (path, content), as binaryFile reads them; one file's records are parsed as they stream out."""
    import hashlib

    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("uri", pa.string()), ("id", pa.string()), ("body", pa.binary()), ("digest", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                part: list[dict] = []
                for r in parse_warc(content or b""):
                    part.append(r | {"path": path, "digest": hashlib.sha256(content[r["offset"] : r["offset"] + r["length"]]).hexdigest()})
                    if len(part) == 500:
                        yield pa.RecordBatch.from_pylist(part, schema=schema)
                        part = []
                yield pa.RecordBatch.from_pylist(part, schema=schema)

    return files.select("path", "content").mapInArrow(parse, _PARSED)


def tree(index: DataFrame) -> DataFrame:
    """file, level, node, hash: level 0 hashes the records of each offset slot in order, the last level is the root."""
    rows = index.select("file", F.floor(F.col("offset") / SLOT_BYTES).alias("node"), F.struct("offset", "length", "digest", "copies").alias("r"))
    level = rows.groupBy("file", "node").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    line = lambda r: F.concat_ws(":", r["offset"], r["length"], r["digest"], r["copies"])
    level = level.select("file", F.lit(0).alias("level"), "node", F.sha2(F.array_join(F.transform("rs", line), "\n"), 256).alias("hash"))
    leaves = saved(level, "tree")
    out = level = leaves
    for n in range(1, LEVELS + 1):
        # the root takes all that is left, so it is one whatever the file's size
        up = F.floor(F.col("node") / FANOUT) if n < LEVELS else F.lit(0).cast("long")
        above = level.groupBy("file", up.alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("cs"))
        level = above.select("file", F.lit(n).alias("level"), "node", F.sha2(F.array_join(F.transform("cs", lambda c: F.concat_ws(":", c["node"], c["hash"])), "\n"), 256).alias("hash"))
        out = out.unionByName(level)
    out = saved(out, "tree")
    dropped(leaves)
    return out


def differing(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """file, node of the offset slots in which two trees differ: roots first, then only children of nodes that differ."""
    at = lambda t, n, name: t.where(F.col("level") == n).select("file", "node", F.col("hash").alias(name))
    suspect = None
    for n in range(LEVELS, -1, -1):
        x, y = at(mine, n, "a"), at(theirs, n, "b")
        before = suspect
        if suspect is not None:
            up = F.floor(F.col("node") / FANOUT) if n + 1 < LEVELS else F.lit(0).cast("long")
            parents = suspect.select("file", F.col("node").alias("up"))
            x = x.withColumn("up", up).join(parents, ["file", "up"], "left_semi").drop("up")
            y = y.withColumn("up", up).join(parents, ["file", "up"], "left_semi").drop("up")
        suspect = saved(x.join(y, ["file", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "node"), "suspects")
        dropped(before)
    return suspect


def placed(primary: DataFrame, copies: DataFrame) -> DataFrame:
    """The records of copies with offsets in the primary's index: of the equal record, else of the page's first record,
    else the end of the file."""
    c = records(copies)
    same = primary.select(F.col("file").alias("f"), F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("offset").alias("at"))
    page = primary.groupBy(F.col("file").alias("f2"), F.col("page_id").alias("p2")).agg(F.min("offset").alias("first"))
    end = primary.groupBy(F.col("file").alias("f3")).agg(F.max(F.col("offset") + F.col("length") * F.col("copies")).alias("end"))
    out = c.join(same, (c["file"] == same["f"]) & c["page_id"].eqNullSafe(same["p"]) & (c["digest"] == same["d"]), "left")
    out = out.join(page, (out["file"] == page["f2"]) & out["page_id"].eqNullSafe(page["p2"]), "left").join(end, out["file"] == end["f3"], "left")
    return out.select("file", "page_id", "length", "digest", "copies", F.coalesce("at", "first", "end", F.lit(0)).alias("offset"))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """file, page_id, offset, length, digest, found, state for each record that the replica hasn't as the primary has it.

    Both are indexes: archive() of one, placed() of the other. Only children of differing nodes are compared on each level.
    Inside differing slots equal digests are matched first, copy by copy. What is left of a page on both sides is paired in
    the order of digests and corrupt; what the primary alone has is missing, what the replica alone has is extra.
    """
    mine, theirs = tree(primary), tree(replica)
    suspect = differing(mine, theirs)
    dropped(mine, theirs)
    slot = F.floor(F.col("offset") / SLOT_BYTES).alias("node")
    keys = ["file", "page_id", "digest", "length", "copies", "offset"]
    left = primary.select(*keys, slot).join(suspect, ["file", "node"], "left_semi")
    right = replica.select(*keys, slot).join(suspect, ["file", "node"], "left_semi")
    r = right.select(F.col("file").alias("f"), F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("length").alias("l"), F.col("offset").alias("o"), F.col("copies").alias("c"))
    both = left.join(r, (left["file"] == r["f"]) & left["page_id"].eqNullSafe(r["p"]) & (left["digest"] == r["d"]), "full")
    more = F.coalesce("copies", F.lit(0)) - F.coalesce("c", F.lit(0))
    both = saved(both.withColumn("more", more).where("more <> 0"), "unequal")
    number = F.row_number().over(Window.partitionBy("file", "page_id").orderBy("digest", "k"))
    each = lambda x, n: x.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    a = each(both.where("more > 0"), F.col("more"))
    # the copies that are left are the last ones
    a = a.select("file", "page_id", (F.col("offset") + F.col("length") * (F.col("copies") - F.col("more") + F.col("k") - 1)).alias("offset"), "length", "digest", "k").withColumn("at", number)
    b = each(both.where("more < 0"), -F.col("more")).select(F.col("f").alias("file"), F.col("p").alias("page_id"), F.col("o").alias("offset"), F.col("l").alias("length"), F.col("d").alias("digest"), "k")
    b = b.withColumn("at", number).select(F.col("file").alias("f"), F.col("page_id").alias("p"), F.col("at").alias("n"), F.col("offset").alias("o"), F.col("length").alias("l"), F.col("digest").alias("found"))
    out = a.join(b, (a["file"] == b["f"]) & a["page_id"].eqNullSafe(b["p"]) & (a["at"] == b["n"]), "full")
    state = F.when(F.col("digest").isNull(), "extra").when(F.col("found").isNull(), "missing").otherwise("corrupt")
    out = out.select(
        F.coalesce("file", "f").alias("file"), F.coalesce("page_id", "p").alias("page_id"), F.coalesce("offset", "o").alias("offset"),
        F.coalesce("length", "l").alias("length"), "digest", "found", state.alias("state"),
    )
    out = saved(out, "damage")
    dropped(suspect, both)
    return out


def fixity(pages: DataFrame, copies: DataFrame) -> DataFrame:
    """One row for each page's record: file, page_id, offset, length, digest, state (intact, corrupt or missing) in the replica.

    copies holds the replica's pages (page_id, url, html). Null bodies and urls are empty; a record without an id is intact
    or missing, by its digest; equal rows are records of their own, one after another; of a page's equal digests none is
    corrupt while another is left; empty tables give no rows; bodies have no greatest length; other columns are ignored.
    Records that the replica alone has come with state extra.
    """
    primary = saved(archive(pages), "primary")
    replica = saved(placed(primary, copies), "replica")
    bad = audit(primary, replica)
    k = bad.where("state <> 'extra'").select(F.col("file").alias("f"), F.col("page_id").alias("p"), F.col("offset").alias("o"), "state")
    each = primary.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    each = each.select("file", "page_id", (F.col("offset") + F.col("length") * F.col("k")).alias("offset"), "length", "digest")
    whole = each.join(k, (each["file"] == k["f"]) & each["page_id"].eqNullSafe(k["p"]) & (each["offset"] == k["o"]), "left")
    out = whole.select("file", "page_id", "offset", "length", "digest", F.coalesce("state", F.lit("intact")).alias("state"))
    out = saved(out.unionByName(bad.where("state = 'extra'").select("file", "page_id", "offset", "length", F.col("found").alias("digest"), "state")), "fixity")
    dropped(primary, replica, bad)
    return out
