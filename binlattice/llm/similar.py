"""Near-duplicates by SimHash, verified by exact Jaccard similarity of word shingles, and completed by a prefix-filtered join.

Two texts link where their sets of five-word shingles have a similarity of 0.8
or more. Candidates come from SimHash first: fingerprints of the sets meet by
their deletion variants for ``LIMIT`` bits, and those that differ in ``WIDE`` bits
at most are verified. At 0.8 about ten bits differ, and no width is sure to hold
all such pairs, so a join on prefixes adds the links between texts that SimHash
has not connected.

All shingles have one order: those counted as frequent last, then by
hash. A set of n that reaches 0.8 with another shares at least ceil(0.8 n) of its
shingles, so both have a common one among the first n - ceil(0.8 n) + 1, and
only those are joined: no link is lost, whatever was counted as frequent.
Candidates pass exact bounds by size and by counts of shingles in classes, 128
and then about as many as half the shingles, before their sets are compared.

Texts of one set are one node. Sets of one fingerprint are compared with the first
of them, which meets the others. What SimHash connects gives no more pairs; all
other pairs of a prefix bucket follow. Links, not only components, hold at 0.8, but a
component may chain texts that are less similar.

Defined cases: null and empty texts have no shingles and are one node; fewer
words than a shingle are one shingle; equal sets are one node, so copies and
repeated rows link at 1.0; a similarity of exactly 0.8 links; every row counts by
its own text, also where a doc_id is on several rows; rows with a null doc_id are
left as they are and count for nothing; texts of any length are read whole; no
documents give no rows; other columns may have any names (``first_of_each``
passes them through).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from . import text as tx
from .shared import Scratch, by_key, components, narrow_join, places, without

SHINGLE, CLASSES, SMALL = 5, 128, 4
LIMIT, WIDE = 6, 12
COUNTED, OFTEN, FREQUENT = 1 << 22, 8, 1 << 18


def sets(texts: pa.Array):
    """The sorted distinct shingle hashes of each text."""
    for lo, hi, w in tx.words(texts, tx.NOT_SPACE, True):
        at, h = w.rolling(w.hashes(), SHINGLE)
        bounds = np.searchsorted(at, w.first)
        for i in range(hi - lo):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if 0 < b - a < SHINGLE:
                yield np.array([xxhash.xxh3_64_intdigest(b" ".join(w.run(a, b)))], dtype=np.uint64)
            else:
                yield np.unique(h[bounds[i] : bounds[i + 1]])


def node(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes())


def sketch(own: np.ndarray, classes: int = CLASSES) -> bytes:
    """Shingles in each class, 255 at most: the differences of two sets' sum to no more than what they don't share."""
    return np.minimum(np.bincount((own & np.uint64(classes - 1)).astype(np.int64), minlength=classes), 255).astype(np.uint8).tobytes()


def fine(own: np.ndarray) -> bytes:
    """The set's size, and a sketch of half as many classes to as many as it has shingles."""
    return len(own).to_bytes(8, "little") + sketch(own, max(CLASSES, 1 << max(len(own).bit_length() - 1, 0)))


def fine_passes(x: bytes, y: bytes) -> bool:
    a, b = (np.frombuffer(v[8:], dtype=np.uint8).astype(np.int64) for v in (x, y))
    size = int.from_bytes(x[:8], "little") + int.from_bytes(y[:8], "little")
    few = min(len(a), len(b))
    whole = int(a.max()) < 255 and int(b.max()) < 255
    if len(a) != len(b) and not whole:
        return True
    a, b = a.reshape(-1, few).sum(axis=0), b.reshape(-1, few).sum(axis=0)
    return 9 * ((size - int(np.abs(a - b).sum())) // 2) >= 4 * size


def reaches(x: bytes, y: bytes) -> bool:
    a, b = (np.frombuffer(v, dtype=np.uint64) for v in (x, y))
    return linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))


def prefix(own: np.ndarray, often: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles of the order, one of which any set within 0.8 has among its own."""
    n = len(own)
    if not n:
        return own
    count = np.zeros(n, dtype=np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, own), len(often) - 1)
        count = np.where(often[at] == own, times[at], 0)
    return own[np.lexsort((own, count))[: n - (4 * n + 4) // 5 + 1]]


def linked(common, x, y):
    """Whether sets of x and y shingles with so many in common reach 0.8."""
    return 9 * common >= 4 * (x + y)


def body(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *places()).where("doc_id is not null")


def frequent(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that come OFTEN times or more, and how often; empties the list."""
    h = np.concatenate(held)
    held.clear()
    h.sort()
    h, times = np.unique(h[: 1 - OFTEN][h[OFTEN - 1 :] == h[: 1 - OFTEN]], return_counts=True)
    return h, times + OFTEN - 1


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, row, tag, id, n, sketch, fp) of every document, and rows (often, times) of shingles that a task saw often."""

    def run(batches):
        held, size = [], 0

        def counted():
            h, times = frequent(held)
            none = [pa.nulls(len(h), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64())]
            return pa.RecordBatch.from_arrays([*none, pa.array(h.view(np.int64)), pa.array(times)], names)

        names = ["doc_id", "row", "tag", "id", "n", "sketch", "fp", "often", "times"]
        for batch in batches:
            ids, n, sketches, fps = [], [], [], []
            for own in sets(batch.column(1)):
                ids.append(node(own))
                n.append(len(own))
                sketches.append(sketch(own))
                fps.append(simhash.majority(own))
                held.append(own)
                size += len(own)
                if size > COUNTED:
                    yield counted()
                    size = 0
            none = [pa.nulls(len(n), pa.int64())] * 2
            ids, fps = (pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (ids, fps))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), ids, pa.array(n, pa.int32()), pa.array(sketches, pa.binary()), fps, *none], names)
        if held:
            yield counted()

    return body(docs).mapInArrow(run, "doc_id long, row long, tag int, id long, n int, sketch binary, fp long, often long, times long")


def by_fingerprint(scratch: Scratch, classes: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of sets (id, n, fp) by SimHash: each with the first of its fingerprint, and firsts within WIDE bits."""
    first = scratch.table(classes.groupBy("fp").agg(F.min(F.struct("id", "n")).alias("k")).select("fp", "k.id", "k.n"))
    met = simhash.variants(first, LIMIT).repartition(F.col("key")).sortWithinPartitions("key", "fp")
    pairs = scratch.table(met.mapInArrow(lambda batches: simhash.near(batches, LIMIT, WIDE), "a long, b long"))
    left, right = (first.select(F.col("fp").alias(x), F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    equal = classes.select("fp", F.col("id").alias("id_b"), F.col("n").alias("n_b")).join(first.select("fp", F.col("id").alias("id_a"), F.col("n").alias("n_a")), "fp").where("id_a <> id_b")
    every = pairs.join(left, "a").join(right, "b").select("id_a", "n_a", "id_b", "n_b").unionByName(equal.drop("fp"))
    return scratch.table(every.where(linked(F.least("n_a", "n_b"), F.col("n_a"), F.col("n_b"))).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")))


def shared(docs: DataFrame, often: np.ndarray, times: np.ndarray) -> DataFrame:
    """(key, id): the prefixes, but shingles that one set alone has there."""
    order = docs.sparkSession.sparkContext.broadcast((often, times))

    def run(batches):
        for batch in batches:
            keys, ids = [], []
            for own in sets(batch.column(1)):
                keys.append(prefix(own, *order.value))
                ids.append(np.full(len(keys[-1]), node(own), dtype=np.uint64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, ids)], ["key", "id"])

    def met(batches):
        for part in by_key(batches):
            key, ids = part.column(0).to_numpy(), part.column(1).to_numpy()
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
            key, ids = key[new], ids[new]
            again = key[1:] == key[:-1]
            many = np.concatenate([again, [False]]) | np.concatenate([[False], again])
            yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(ids[many])], ["key", "id"])

    rows = body(docs).mapInArrow(run, "key long, id long")
    return rows.repartition(F.col("key")).sortWithinPartitions("key", "id").mapInArrow(met, "key long, id long")


def candidates(batches):
    """(a, b) whose roots differ, within the bounds, from rows (key, id, root, n, sketch) sorted by key."""

    def passed(ids, n, counts, i, j):
        keep = root[i] != root[j]
        i, j = i[keep], j[keep]
        x, y = n[i], n[j]
        keep = linked(np.minimum(x, y), x, y)
        i, j = i[keep], j[keep]
        apart = np.abs(counts[i].astype(np.int16) - counts[j]).sum(axis=1, dtype=np.int64)
        keep = linked((n[i] + n[j] - apart) // 2, n[i], n[j])
        a, b = ids[i[keep]], ids[j[keep]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for part in by_key(batches):
        key, ids, root, n = (part.column(k).to_numpy() for k in range(4))
        n = n.astype(np.int64)
        counts = np.frombuffer(b"".join(part.column(4).to_pylist()), dtype=np.uint8).reshape(-1, CLASSES)
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        size = np.repeat(np.diff(bounds), np.diff(bounds))
        for step in range(1, SMALL):
            i = np.flatnonzero((key[step:] == key[:-step]) & (size[step:] <= SMALL))
            for k in range(0, len(i), 1 << 16):
                yield passed(ids, n, counts, i[k : k + (1 << 16)], i[k : k + (1 << 16)] + step)
        held, waiting = [], 0
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo <= SMALL:
                continue
            for i in range(lo, hi - 1):
                rest = i + 1 + np.flatnonzero(root[i + 1 : hi] != root[i])
                for k in range(0, len(rest), 1 << 16):
                    j = rest[k : k + (1 << 16)]
                    held.append((np.full(len(j), i), j))
                    waiting += len(j)
                    if waiting >= 1 << 16:
                        yield passed(ids, n, counts, *(np.concatenate(x) for x in zip(*held, strict=True)))
                        held, waiting = [], 0
        if held:
            yield passed(ids, n, counts, *(np.concatenate(x) for x in zip(*held, strict=True)))


def compared(docs: DataFrame, scratch: Scratch, classes: DataFrame, pairs: DataFrame, describe, passes) -> DataFrame:
    """The pairs (a, b) for which passes holds on what describe makes of their sets."""
    named = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = scratch.table(classes.join(named, "id").select("row", "tag", F.lit("x").alias("mark")))

    def read(batches):
        for batch in batches:
            own = list(sets(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.array([node(s) for s in own], dtype=np.uint64).view(np.int64)), pa.array([describe(s) for s in own], pa.binary())], ["id", "own"])

    def compare(batches):
        for batch in batches:
            keep = [passes(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = scratch.table(narrow_join(body(docs), wanted, ["row", "tag"], "mark", "left_semi").select("doc_id", "text").mapInArrow(read, "id long, own binary").join(named, "id", "left_semi").dropDuplicates(["id"]))
    both = narrow_join(pairs, own.select(F.col("id").alias("a"), F.col("own").alias("x")), "a", "x", "inner")
    both = narrow_join(both, own.select(F.col("id").alias("b"), F.col("own").alias("y")), "b", "y", "inner")
    out = scratch.table(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"))
    scratch.drop(wanted, own)
    return out


def verified(docs: DataFrame, scratch: Scratch, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach 0.8: what the fine sketches leave, by the sets themselves."""
    left = compared(docs, scratch, classes, pairs, fine, fine_passes)
    return compared(docs, scratch, classes, left, np.ndarray.tobytes, reaches)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, row and tag of ``places``, id of its set, component_id (the smallest doc_id that links reach)."""
    scratch = Scratch(docs.sparkSession)
    seen = scratch.table(described(docs))
    common = seen.where("often is not null").groupBy("often").agg(F.sum("times").alias("n")).orderBy(F.desc("n"), "often").limit(FREQUENT).toPandas()
    often, times = common["often"].to_numpy(np.int64).view(np.uint64), common["n"].to_numpy(np.int64)
    order = np.argsort(often)
    own = seen.where("doc_id is not null").select("doc_id", "row", "tag", "id")
    least = seen.where("doc_id is not null").groupBy("id").agg(F.min(F.struct("row", "tag")).alias("k"), *(F.first(c).alias(c) for c in ("n", "sketch", "fp")))
    classes = scratch.table(least.select("id", F.col("k.row").alias("least"), "k.row", "k.tag", "n", "sketch", "fp"))
    copies = own.select("row", "tag").distinct().join(classes.select("row", "tag"), ["row", "tag"], "left_anti")
    single = without(docs, scratch, copies)
    met = scratch.table(shared(single, often[order], times[order]))

    def rooted(edges):
        nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
        return components(scratch, nodes, edges)

    def named(rows, edges):
        return rows.join(rooted(edges), "id", "left").withColumn("root", F.coalesce("root", "id"))

    edges = verified(docs, scratch, classes, by_fingerprint(scratch, classes))
    buckets = named(met.join(classes.select("id", "n", "sketch"), "id"), edges).select("key", "id", "root", "n", "sketch")
    pairs = scratch.table(buckets.repartition(F.col("key")).sortWithinPartitions("key", "id").mapInArrow(candidates, "a long, b long").distinct())
    edges = scratch.table(edges.union(verified(docs, scratch, classes, pairs)))
    ended = named(classes.select("id", "least"), edges)
    least = ended.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = scratch.table(ended.join(least, "root").select("id", "component_id"))
    return own.join(groups, "id").select("doc_id", "row", "tag", "id", "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with one of each component: that of the smallest doc_id (several rows, if they share it)."""
    scratch = Scratch(docs.sparkSession)
    gone = near_duplicates(docs).where("doc_id <> component_id").select("row", "tag").distinct()
    return without(docs, scratch, gone)
