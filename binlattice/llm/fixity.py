"""Merkle fixity audit of web-archive records.

Records are laid out by page_id; the primary's byte offsets cut every shard of
consecutive ids into ranges of about ``range_bytes``. A range's hash covers its
records' hashes in order, a shard's its ranges', and higher nodes ``fanout``
nodes each, up to one root. Two replicas are compared from the root down;
children are looked at only below nodes that differ, and records only in
ranges that differ.

Everything is DataFrame functions; records are hashed once per replica into a
small written table. Offsets come from sums by shard and by group of shards, and
shards where a page_id repeats very often are cut into slots, so no task sees
all records, whatever their page_ids are.

Defined cases: null url and html are empty; records that repeat a page_id are
told apart by their hash order; records without page_id have no place in the
tree, so those of the two sides are matched by their hashes, each with one at
most; a replica may be empty, then all of the other's records are missing or
extra, and two empty ones give no rows; records of any length are hashed whole;
other columns may have any names and are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch, narrow_join, partitions

RANGE_BYTES, SHARD, FANOUT, HOT_ROWS, SLOT_ROWS = 1 << 18, 512, 64, 1 << 14, 1 << 12


def record() -> Column:
    """The archived record of a page, as one string."""
    html = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, html, F.lit("\r\n\r\n"))


def located(pages: DataFrame, shard: int) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.withColumn("shard", F.floor(F.col("page_id") / shard))


def crowded(scratch: Scratch, sides: list[DataFrame], shard: int, hot_rows: int) -> DataFrame | None:
    """The shards of more than hot_rows records on both sides together, where one page_id repeats very often; None if there are none."""
    every = located(sides[0], shard).select("shard").unionByName(located(sides[1], shard).select("shard")).where("shard is not null")
    found = scratch.table(every.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("shard", F.lit("x").alias("mark")))
    return found if found.take(1) else None


def hashed(pages: DataFrame, shard: int = SHARD, crowd: DataFrame | None = None, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """(page_id, n_bytes, sha256, shard, nth, page, slot): nth tells records of one page_id apart.

    Crowded shards are cut by page and slot, a slot holding so many records of a
    page_id; in all others both are 0. There, nth comes from counts by the
    beginning of the hash, so records of one page_id are never sorted together.
    """
    rows = located(pages, shard).withColumns({"n_bytes": F.octet_length(record()).cast("long"), "sha256": F.sha2(record(), 256)}).select("page_id", "n_bytes", "sha256", "shard")
    zero = F.lit(0).cast("long")
    keyed, own = rows.where("page_id is not null"), W.partitionBy("shard", "page_id").orderBy("sha256")
    none = rows.where("page_id is null").withColumns({"nth": F.lit(0), "page": zero, "slot": zero})
    if crowd is None:
        return keyed.withColumns({"nth": F.row_number().over(own), "page": zero, "slot": zero}).unionByName(none)
    plain = narrow_join(keyed, crowd, "shard", "mark", "left_anti").withColumns({"nth": F.row_number().over(own), "page": zero, "slot": zero})
    heavy = narrow_join(keyed, crowd, "shard", "mark", "left_semi").withColumn("head", F.substring("sha256", 1, 3))
    counts = heavy.groupBy("page_id", "head").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("page_id").orderBy("head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("page_id", "head").orderBy("sha256"))
    heavy = heavy.withColumn("within", within).join(counts.select("page_id", "head", before.alias("before")), ["page_id", "head"])
    heavy = heavy.withColumn("nth", (F.col("before") + F.col("within")).cast("int")).drop("head", "before", "within")
    return plain.unionByName(heavy.withColumns({"page": F.col("page_id"), "slot": F.floor(F.col("nth") / slot_rows)})).unionByName(none)


SLICE = ["shard", "page", "slot"]


def laid_out(rows: DataFrame, range_bytes: int = RANGE_BYTES, group: int = SHARD) -> DataFrame:
    """Adds offset, the record's first byte in the archive, and range, its number in the shard."""
    keyed = rows.where("page_id is not null")
    slices = keyed.groupBy(*SLICE).agg(F.sum("n_bytes").alias("bytes")).withColumn("block", F.floor(F.col("shard") / group))
    blocks = slices.groupBy("block").agg(F.sum("bytes").alias("total"))
    past = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = slices.join(blocks.select("block", past("total", W.orderBy("block")).alias("before")), "block")
    bases = bases.select(*SLICE, (past("bytes", W.partitionBy("block").orderBy(*SLICE)) + F.col("before")).alias("base"), past("bytes", W.partitionBy("shard").orderBy("page", "slot")).alias("inside"))
    own = past("n_bytes", W.partitionBy(*SLICE).orderBy("page_id", "nth"))
    placed = keyed.withColumn("own", own).join(bases, SLICE)
    at = F.col("inside") + F.col("own")
    return placed.withColumn("offset", F.col("base") + F.col("own")).withColumn("range", F.floor(at / range_bytes)).drop("own", "base", "inside")


def aligned(rows: DataFrame, primary: DataFrame) -> DataFrame:
    """A replica's records with the primary's ranges: each record belongs to the range that last began before it."""
    first = F.struct("page_id", "nth", "page", "slot")
    edges = primary.groupBy("shard", "range").agg(F.min(first).alias("k")).select("shard", "k.page_id", "k.nth", "k.page", "k.slot", F.lit(0).alias("side"), "range")
    own = rows.where("page_id is not null").select("shard", "page_id", "nth", "page", "slot", F.lit(1).alias("side"), F.lit(None).cast("long").alias("range"), "n_bytes", "sha256")
    every = own.unionByName(edges, allowMissingColumns=True)
    last = F.last("range", ignorenulls=True).over(W.partitionBy(*SLICE).orderBy("page_id", "nth", "side"))
    earlier = F.max("top").over(W.partitionBy("shard").orderBy("page", "slot").rowsBetween(W.unboundedPreceding, -1))
    carried = every.groupBy(*SLICE).agg(F.max("range").alias("top")).select(*SLICE, earlier.alias("carried"))
    met = every.withColumn("last", last).where("side = 1").join(carried, SLICE)
    return met.withColumn("range", F.coalesce("last", "carried", F.lit(0))).drop("side", "last", "carried")


def _over(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(*order, value)))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x[value]), ","), 256).alias("hash"))


def tree(scratch: Scratch, rows: DataFrame, height: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from ranges (shard, range, hash) over shards (node, hash) to the root, each written once."""
    ranges = scratch.table(_over(rows, ["shard", "range"], ["page_id", "nth"], "sha256"))
    level = scratch.table(_over(ranges, ["shard"], ["range"], "hash").withColumnRenamed("shard", "node"))
    levels = [ranges, level]
    for _ in range(height):
        level = scratch.table(_over(level.withColumn("up", F.floor(F.col("node") / fanout)), ["up"], ["node"], "hash").withColumnRenamed("up", "node"))
        levels.append(level)
    return levels


def differing(scratch: Scratch, left: list[DataFrame], right: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(shard, range) of the ranges that differ, reached from the root through differing nodes only."""

    def apart(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        both = a.withColumnRenamed("hash", "h1").join(b.withColumnRenamed("hash", "h2"), keys, "full")
        return scratch.table(both.where(~F.col("h1").eqNullSafe(F.col("h2"))).select(*keys))

    bad = apart(left[-1], right[-1], ["node"])
    for a, b in list(zip(left, right, strict=True))[-2:0:-1]:
        above = bad.withColumnRenamed("node", "up")
        below = [x.withColumn("up", F.floor(F.col("node") / fanout)).join(above, "up", "left_semi").drop("up") for x in (a, b)]
        bad = apart(*below, ["node"])
    shards = bad.withColumnRenamed("node", "shard")
    return apart(*(x.join(shards, "shard", "left_semi") for x in (left[0], right[0])), ["shard", "range"])


def audit(primary: DataFrame, replica: DataFrame, *, range_bytes: int = RANGE_BYTES, shard: int = SHARD, fanout: int = FANOUT, hot_rows: int = HOT_ROWS, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """One row per record of either side: page_id, nth, offset, n_bytes, sha256, shard, range, status.

    Statuses are intact, altered, missing (from the replica), extra (only
    there) and, for records without page_id that both sides have, unkeyed.
    Offsets, sizes and hashes are the primary's, or the replica's for extra
    records; those and records without page_id have no offset.
    """
    scratch = Scratch(primary.sparkSession)
    crowd = crowded(scratch, [primary, replica], shard, hot_rows)
    hashes = [scratch.table(hashed(x, shard, crowd, slot_rows)) for x in (primary, replica)]
    left = scratch.table(laid_out(hashes[0], range_bytes))
    right = scratch.table(aligned(hashes[1], left))
    ends = left.select("shard").union(right.select("shard")).agg(F.min("shard"), F.max("shard")).first()
    height, lo, hi = 0, ends[0] or 0, ends[1] or 0
    while lo != hi:
        lo, hi, height = lo // fanout, hi // fanout, height + 1
        if (lo, hi) == (-1, 0):  # floors of either sign never meet
            break
    bad = differing(scratch, tree(scratch, left, height, fanout), tree(scratch, right, height, fanout), fanout)
    place, key = ["shard", "range"], ["shard", "range", "page_id", "nth"]
    ours = left.join(bad, place, "left_semi").select(*key, F.col("sha256").alias("ours"), F.col("n_bytes").alias("ours_bytes"))
    theirs = right.join(bad, place, "left_semi").select(*key, F.col("sha256").alias("theirs"), F.col("n_bytes").alias("their_bytes"))
    status = F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "extra").when(F.col("ours") != F.col("theirs"), "altered")
    wrong = scratch.table(ours.join(theirs, key, "full").withColumn("status", status).where("status is not null"))
    known = left.join(wrong.select(*key, "status"), key, "left").select("page_id", "nth", "offset", "n_bytes", "sha256", *place, F.coalesce("status", F.lit("intact")).alias("status"))
    extra = wrong.where("status = 'extra'").select("page_id", "nth", F.lit(None).cast("long").alias("offset"), F.col("their_bytes").alias("n_bytes"), F.col("theirs").alias("sha256"), *place, "status")
    return known.unionByName(extra).unionByName(unkeyed(*hashes))


def unkeyed(ours: DataFrame, theirs: DataFrame, chunk: int = 1000) -> DataFrame:
    """The records without page_id: by hash, as many as both sides have are unkeyed, the rest missing or extra.

    Counts are compared, not rows, and given out in chunks, so that no task holds all copies of a record.
    """
    sides = [x.where("page_id is null").groupBy("sha256", "n_bytes").agg(F.count("*").alias(c)) for x, c in ((ours, "a"), (theirs, "b"))]
    both = sides[0].join(sides[1], ["sha256", "n_bytes"], "full").fillna(0, ["a", "b"])
    kinds = [("unkeyed", F.least("a", "b"), F.lit(0)), ("missing", F.col("a") - F.col("b"), F.least("a", "b")), ("extra", F.col("b") - F.col("a"), F.least("a", "b"))]
    parts = both.select("sha256", "n_bytes", F.explode(F.array(*(F.struct(F.lit(s).alias("status"), n.alias("n"), base.alias("base")) for s, n, base in kinds))).alias("k")).where("k.n > 0")
    chunks = parts.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("k.n") - 1) / chunk))).alias("c")).repartition(partitions(ours.sparkSession))
    nth = F.explode(F.sequence(F.col("c") * chunk + 1, F.least((F.col("c") + 1) * chunk, F.col("k.n"))))
    none = [F.lit(None).cast("long").alias(c) for c in ("page_id", "offset", "shard", "range")]
    rows = chunks.select(*none, "n_bytes", "sha256", "k.status", "k.base", nth.alias("nth"))
    return rows.select("page_id", (F.col("base") + F.col("nth")).cast("int").alias("nth"), "offset", "n_bytes", "sha256", "shard", "range", "status")
