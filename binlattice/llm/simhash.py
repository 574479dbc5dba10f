"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into ``limit // 2 + 1`` segments, the fewest for
which two fingerprints within ``limit`` differing bits have a segment that
differs in one bit at most. Every segment is indexed once for each of its bits
with that bit left out, so such a segment gives an equal variant on both sides;
fingerprints with an equal variant meet and are verified bit by bit.

Documents with one fingerprint are one node, however many there are, and a
variant shared by many fingerprints gives a spanning forest of their links, not
all pairs: candidates in a large bucket are cut again over the bits that vary
there.

Defined cases: null and empty texts have no words and fingerprint zero, and are
linked like any other; fewer words than a shingle are one shingle; equal texts
always share a component; every row of documents gives one row, by its own text,
also where a doc_id is on several rows; rows without doc_id link as well, and a
component's id is null only where no row of it has one; a bit set in exactly half
the shingles is zero; texts of any length are read whole; no documents give no
rows; other columns may have any names and are not returned.

Distinct fingerprints of one variant meet in one task, eight bytes each; copies of
a text or fingerprint don't add to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import Scratch, by_key, components, places, without

SEED = 42
SMALL = 24
PARTNERS = 2
DIRECT = 2048
BLOCK = 1 << 16


def majority(h: np.ndarray) -> int:
    """The bits set in over half the hashes h; zero for none."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), BLOCK):
        part = h[i : i + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.translate(tx.LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    pairs = zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), dtype=np.uint64, count=n))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, row and tag, and the fingerprint of the text, as a signed long."""

    def run(batches):
        for batch in batches:
            data, at = tx.buffers(batch.column(1))
            whole = data.tobytes()
            fp = np.array([fingerprint(whole[a:b], shingle) for a, b in zip(at[:-1], at[1:], strict=True)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(fp.view(np.int64))], ["doc_id", "row", "tag", "fp"])

    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *places())
    return body.mapInArrow(run, "doc_id long, row long, tag int, fp long")


def segments(limit: int) -> list[tuple[int, int]]:
    """First bit and length of each segment."""
    k = limit // 2 + 1
    edges = [round(i * 64 / k) for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def variants(fps: DataFrame, limit: int) -> DataFrame:
    """A row (key, fp) for each segment of each fingerprint and each bit left out of it."""
    cut = segments(limit)
    bits = max(n for _, n in cut)
    if bits > 48:
        raise ValueError(f"limit {limit} leaves segments too long to number")

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys = np.empty((len(fp), 64), dtype=np.int64)
            for k, (first, n) in enumerate(cut):
                own = (fp >> np.uint64(first)) & np.uint64((1 << n) - 1)
                for bit in range(n):
                    tag = (k * 64 + bit) << bits
                    keys[:, first + bit] = (own & ~np.uint64(1 << bit)).astype(np.int64) | tag
            for i in range(0, len(fp), 4096):
                part = keys[i : i + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(part.ravel()), pa.array(np.repeat(fp[i : i + 4096].view(np.int64), 64))], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def forest(x: np.ndarray, limit: int, cut: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what links within limit bits connect among distinct fingerprints x."""
    varying = int(np.bitwise_or.reduce(x ^ x[0]))
    places = [b for b in range(64) if varying >> b & 1]
    if len(places) <= limit:
        return [(np.full(len(x) - 1, x[0]), x[1:])]
    out = []
    if cut and len(x) > DIRECT:
        for part in np.array_split(places, limit + 1):
            own = x & np.uint64(sum(1 << int(b) for b in part))
            order = np.argsort(own, kind="stable")
            for group in np.split(x[order], np.flatnonzero(np.diff(own[order])) + 1):
                if len(group) > 1:
                    out += forest(group, limit, len(group) < len(x))
        return out
    left = x
    while len(left):
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for i in range(0, len(frontier), 64):
                rest = np.flatnonzero(~near)
                for j in range(0, len(rest), BLOCK):
                    at = rest[j : j + BLOCK]
                    near[at] = (np.bitwise_count(left[at][:, None] ^ frontier[None, i : i + 64]) <= limit).any(axis=1)
            frontier, left = left[near], left[~near]
            if len(frontier):
                out.append((np.full(len(frontier), root), frontier))
    return out


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, node), one for each node but the roots, that connect what the edges (a, b) connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, before = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[rest]], nodes[rest]


def meeting(x: np.ndarray, y: np.ndarray, cut: list[tuple[int, int]]) -> np.ndarray:
    """The first tag of a variant, segment * 64 + bit, that x and y have in common, or -1."""
    out = np.full(len(x), -1, dtype=np.int64)
    for k, (first, n) in reversed(list(enumerate(cut))):
        apart = ((x ^ y) >> np.uint64(first)) & np.uint64((1 << n) - 1)
        bit = np.bitwise_count(np.where(apart == 0, apart, apart - np.uint64(1))).astype(np.int64)
        out = np.where(np.bitwise_count(apart) <= 1, k * 64 + bit, out)
    return out


def near(batches, limit: int, wide: int):
    """Pairs of fingerprints that share a key of ``variants`` and differ in wide bits at most; the rows come sorted by key and fingerprint.

    A pair comes once, from the first variant it shares. All pairs of a bucket, but no
    more than ``PARTNERS`` with later ones for each fingerprint of a bucket of more
    than ``SMALL``, taken from ``DIRECT`` at a time.
    """
    cut = segments(limit)
    bits = max(n for _, n in cut)

    def once(tag, x, y):
        keep = meeting(x, y, cut) == tag
        return x[keep], y[keep]

    def pairs(tag, x):
        for lo in range(0, len(x), DIRECT):
            own = x[lo : lo + DIRECT]
            for i in range(0, len(own), 64):
                a, b = np.nonzero(np.triu(np.bitwise_count(own[i : i + 64, None] ^ own[None, i:]) <= wide, 1))
                keep = meeting(own[i + a], own[i + b], cut) == tag
                a, b = a[keep], b[keep]
                keep = np.arange(len(a)) - np.searchsorted(a, a) < PARTNERS
                yield own[i + a[keep]], own[i + b[keep]]

    for part in by_key(batches):
        key, fp = (part.column(k).to_numpy() for k in range(2))
        fp = fp.view(np.uint64)
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        size = np.repeat(np.diff(bounds), np.diff(bounds))
        found = []
        for step in range(1, SMALL):
            i = np.flatnonzero((key[step:] == key[:-step]) & (size[step:] <= SMALL))
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= wide]
            found.append(once(key[i] >> bits, fp[i], fp[i + step]))
        for i in np.flatnonzero(np.diff(bounds) > SMALL):
            found += pairs(int(key[bounds[i]]) >> bits, fp[bounds[i] : bounds[i + 1]])
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def links(batches, limit: int):
    """Edges among fingerprints that share a key; the rows come sorted by key and fingerprint."""
    key, fp = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)

    def settle(key, fp):
        edges = []
        for step in range(1, SMALL):
            near = (key[step:] == key[:-step]) & (fp[step:] != fp[:-step])
            near &= np.bitwise_count(fp[step:] ^ fp[:-step]) <= limit
            at = np.flatnonzero(near)
            edges.append((fp[at], fp[at + step]))
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        for i in np.flatnonzero(np.diff(bounds) > SMALL):
            edges += forest(np.unique(fp[bounds[i] : bounds[i + 1]]), limit)
        a, b = spanning(*(np.concatenate(e) for e in zip(*edges, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        end = int(np.searchsorted(key, key[-1]))
        if end:
            yield settle(key[:end], fp[:end])
            key, fp = key[end:], fp[end:]
    if len(key):
        yield settle(key, fp)


def near_duplicates(docs: DataFrame, *, shingle: int = 4, limit: int = 4, keep: bool = False) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that links reach), with keep also row and tag of ``places``."""
    scratch = Scratch(docs.sparkSession)
    own = scratch.table(fingerprints(docs, shingle))
    classes = scratch.table(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    met = variants(classes, limit).repartition(F.col("key")).sortWithinPartitions("key", "fp")
    edges = scratch.table(met.mapInArrow(lambda batches: links(batches, limit), "a long, b long").distinct())
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    roots = components(scratch, nodes, edges)
    named = classes.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = scratch.table(named.join(least, "root").select("fp", "component_id"))
    return own.join(groups, "fp").select("doc_id", "fp", "component_id", *["row", "tag"][: 2 * keep])


def first_of_each(docs: DataFrame, *, shingle: int = 4, limit: int = 4) -> DataFrame:
    """The documents, all columns, with those of one doc_id of each component: the smallest; rows without doc_id stay."""
    scratch = Scratch(docs.sparkSession)
    found = near_duplicates(docs.select("text", "doc_id"), shingle=shingle, limit=limit, keep=True)
    return without(docs, scratch, found.where("doc_id <> component_id").select("row", "tag").distinct())
