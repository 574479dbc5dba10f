"""Exact repeats of long word runs, found by fixed-block anchors.

Every document is cut into non-overlapping blocks of ``(window + 1) // 2``
words, so any run of ``window`` words holds a whole block. The blocks' hashes
are the index; the hash of every rolling run of that many words is a probe. A
block that a second place matches is an anchor. Anchors are extended: the runs
of ``window`` words over an anchor, its neighbourhood to either side, are
compared with all others, and overlapping repeats are joined into maximal
ranges. Runs are compared by 96 bits of hashes with a key drawn anew for each
query, not word by word; texts cannot be made to collide without that key.

Hashes travel packed, a few blobs a task and bucket, and a task sends no hash
more than twice (probes) or once (runs), so a passage that very many documents
share doesn't grow a bucket with them. Buckets go by hash of the run, so the
different runs at the edges of one frequent passage spread out. The number of
buckets follows from measured sizes: about ``bucket_bytes`` each.

Defined cases: null and empty texts have no words; a document shorter than the
window has no repeats; repeats inside one document count, overlapping ones too;
every row of documents is a document of its own, also where a doc_id is null
or on several rows, so equal rows are copies; of equal runs all go, so there
are no ties; texts of any length are taken whole; no documents give no rows;
other columns may have any names and are not returned.
"""

from __future__ import annotations

import hashlib
import math
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import Scratch, narrow_join, partitions, places

WINDOW, BUCKET_BYTES = 35, 64 << 20
FLUSH, FLUSH_MOST, BLOB = 1 << 20, 1 << 25, 16
LOW = np.uint64(0xFFFFFFFF)


def flush_size(buckets: int) -> int:
    """Hashes that a task holds before it sends them: enough for about BLOB in each bucket, within limits."""
    return min(FLUSH_MOST, max(FLUSH, BLOB * buckets))


def _pack(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(values)
    return pa.array([data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())


def _by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _joined(batches: list[pa.RecordBatch], column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for b in batches for x in b.column(column).to_pylist()), dtype=kind)


def _filled(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Without the buckets that got nothing."""
    some = np.zeros(batch.num_rows, dtype=bool)
    for column in batch.columns[1:]:
        some |= np.fromiter(map(len, column.to_pylist()), dtype=np.int64, count=batch.num_rows) > 0
    return batch.filter(pa.array(some))


def probe_blobs(batches, block: int, window: int, buckets: int, key: int):
    """Per bucket: rolling hashes (low halves, each at most twice), and blocks with row, tag and number."""
    probes: list[np.ndarray] = []
    blocks: list[tuple[np.ndarray, ...]] = []
    most, size = flush_size(buckets), 0

    def flush():
        h = np.concatenate(probes)
        h = ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | h & LOW
        h.sort()
        h = h[np.concatenate([[True, True][: len(h)], h[2:] != h[:-2]])]
        bounds = np.searchsorted(h >> np.uint64(32), np.arange(buckets + 1))
        own, row, tag, number = (np.concatenate(x) for x in zip(*blocks, strict=True))
        order, cut = _by_bucket((own >> np.uint64(32)) % np.uint64(buckets), buckets)
        columns = [pa.array(np.arange(buckets, dtype=np.int32)), _pack((h & LOW).astype(np.uint32), bounds)]
        columns += [_pack(x[order], cut) for x in ((own & LOW).astype(np.uint32), row, tag, number.astype(np.int32))]
        probes.clear()
        blocks.clear()
        return _filled(pa.RecordBatch.from_arrays(columns, ["bucket", "probes", "block", "row", "tag", "number"]))

    for batch in batches:
        rows, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        for lo, hi, w in tx.words(batch.column(0), tx.NOT_SPACE, False):
            at, h = w.rolling(w.hashes(key), block, key=key)
            doc = np.searchsorted(w.first, at, side="right") - 1
            long = w.counts[doc] >= window
            at, h, doc = at[long], h[long], doc[long]
            if not len(at):
                continue
            place = at - w.first[doc]
            first = place % block == 0
            probes.append(h)
            blocks.append((h[first], rows[lo:hi][doc[first]], tags[lo:hi][doc[first]], place[first] // block))
            size += len(h)
            if size >= most:
                yield flush()
                size = 0
    if probes:
        yield flush()


def anchors(batches):
    """(row, tag, number) of the blocks of a bucket that at least two places match."""
    for have in _buckets(batches):
        probes = np.sort(_joined(have, "probes", np.uint32))
        block, row, tag, number = (_joined(have, c, k) for c, k in (("block", np.uint32), ("row", np.int64), ("tag", np.int32), ("number", np.int32)))
        at = np.searchsorted(probes, block)
        hit = np.zeros(len(block), dtype=bool)
        inside = at + 1 < len(probes)
        hit[inside] = probes[at[inside] + 1] == block[inside]
        yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (row, tag, number)], ["row", "tag", "number"])


def _buckets(batches):
    """The batches of each bucket: a partition holds one bucket, or several where it had to be."""
    held: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        own = batch.column(0).to_numpy()
        for k in np.unique(own).tolist():
            held.setdefault(k, []).append(batch.filter(pa.array(own == k)))
    while held:
        yield held.popitem()[1]


def run_blobs(batches, block: int, window: int, buckets: int, key: int):
    """Per bucket: the runs over anchors. What repeats within the task is known: it goes as one hash without place, and as ranges."""
    parts: list[tuple[np.ndarray, ...]] = []
    most, size = flush_size(buckets), 0

    def flush():
        h, g, row, tag, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.lexsort((g, h))
        same = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
        head = np.concatenate([[True], ~same])
        many = np.concatenate([same, [False]]) | ~head
        known, sent = order[many], np.concatenate([order[~many], order[many & head]])
        place = at[sent].astype(np.int32)
        place[len(order) - len(known) :] = -1
        turn, cut = _by_bucket(h[sent] % np.uint64(buckets), buckets)
        sent, place = sent[turn], place[turn]
        ranges = _ranges(row[known], tag[known], at[known])
        share = np.linspace(0, len(ranges[0]), buckets + 1).astype(np.int64)
        columns = [_pack(x, cut) for x in (h[sent], g[sent].astype(np.uint32), row[sent], tag[sent], place)] + [_pack(x, share) for x in ranges]
        return _filled(pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), *columns], ["bucket", "h", "g", "row", "tag", "at", "krow", "ktag", "kfirst", "klast"]))

    for batch in batches:
        rows, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        numbers = batch.column(3).to_pylist()
        for lo, hi, w in tx.words(batch.column(0), tx.NOT_SPACE, False):
            hashes = w.hashes(key)
            at, h = w.rolling(hashes, window, key=key)
            if not len(at):
                continue
            doc = np.searchsorted(w.first, at, side="right") - 1
            base = np.concatenate([[0], np.cumsum(w.counts // block + 1)])
            hit = np.zeros(base[-1] + 1, dtype=bool)
            for d, own in enumerate(numbers[lo:hi]):
                hit[base[d] + np.frombuffer(own, dtype=">i4")] = True
            keep = hit[base[doc] + -(-(at - w.first[doc]) // block)]
            if not keep.any():
                continue
            _, g = w.rolling(hashes, window, True, key)
            doc = doc[keep]
            parts.append((h[keep], g[keep] & LOW, rows[lo:hi][doc], tags[lo:hi][doc], at[keep] - w.first[doc]))
            size += len(doc)
            if size >= most:
                yield flush()
                size = 0
    if parts:
        yield flush()


def _ranges(row: np.ndarray, tag: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """row, tag, first and last of the ranges of consecutive places, each place once."""
    order = np.lexsort((at, tag, row))
    row, tag, at = row[order], tag[order], at[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] > at[:-1] + 1)
    last = np.append(first[1:], True)[: len(row)]
    return [row[first], tag[first], at[first].astype(np.int32), at[last].astype(np.int32)]


def repeated(batches, buckets: int):
    """Ranges of starts of runs that another place has too, packed by the bucket of their row."""
    kinds = (("krow", np.int64), ("ktag", np.int32), ("kfirst", np.int32), ("klast", np.int32))
    for have in _buckets(batches):
        found = [_joined(have, c, k) for c, k in kinds]
        h, g, row, tag, at = (_joined(have, c, k) for c, k in (("h", np.uint64), ("g", np.uint32), ("row", np.int64), ("tag", np.int32), ("at", np.int32)))
        if len(h):
            order = np.lexsort((g, h))
            h, g, row, tag, at = h[order], g[order], row[order], tag[order], at[order]
            same = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
            twice = (np.append(same, False) | np.concatenate([[False], same])) & (at >= 0)
            found = [np.concatenate(x) for x in zip(found, _ranges(row[twice], tag[twice], at[twice]), strict=True)]
        order, cut = _by_bucket(found[0].view(np.uint64) % np.uint64(buckets), buckets)
        columns = [_pack(x[order], cut) for x in found]
        yield _filled(pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), *columns], ["bucket", "row", "tag", "first", "last"]))


def merged(batches, window: int):
    """(row, tag, ranges): the word ranges [start, end) under repeated runs, maximal, packed as int32 pairs."""
    for have in _buckets(batches):
        row, tag, first, last = (_joined(have, c, k) for c, k in (("row", np.int64), ("tag", np.int32), ("first", np.int32), ("last", np.int32)))
        order = np.lexsort((first, tag, row))
        row, tag, first, end = row[order], tag[order], first[order].astype(np.int64), last[order].astype(np.int64) + window
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (tag[1:] != tag[:-1])
        doc = np.cumsum(new) - 1
        lift = doc * (int(end.max()) + 1)  # so that no range reaches into the next document
        reach = np.maximum.accumulate(end + lift)
        open_ = np.ones(len(row), dtype=bool)
        open_[1:] = first[1:] + lift[1:] > reach[:-1]
        stop = np.append(open_[1:], True)
        pairs = np.stack([first[open_], reach[stop] - lift[stop]], axis=1).astype("<i4")
        heads = np.flatnonzero(new)
        bounds = np.append(np.searchsorted(np.flatnonzero(open_), heads), len(pairs))
        yield pa.RecordBatch.from_arrays([pa.array(row[heads]), pa.array(tag[heads]), _pack(pairs, bounds)], ["row", "tag", "ranges"])


def bucket_count(spark, size: int, bucket_bytes: int) -> int:
    return max(partitions(spark), math.ceil(size / bucket_bytes))


def marks(docs: DataFrame, scratch: Scratch, window: int = WINDOW, *, bucket_bytes: int = BUCKET_BYTES, limit: int | None = None) -> DataFrame:
    """(row, tag, ranges): maximal word ranges [start, end) under repeated runs, packed as int32 pairs."""
    spark, block, key = docs.sparkSession, (window + 1) // 2, secrets.randbits(60)
    body = docs.select(F.col("text").cast("string").alias("text"), *places())
    size = body.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = bucket_count(spark, size, bucket_bytes)  # a word has six bytes or so, and sends four and a block's share
    probes = body.mapInArrow(lambda b: probe_blobs(b, block, window, buckets, key), "bucket int, probes binary, block binary, row binary, tag binary, number binary")
    found = probes.repartitionById(buckets, "bucket").mapInArrow(anchors, "row long, tag int, number int")
    packed = found.groupBy("row", "tag").agg(F.collect_set("number").alias("n"))
    as_bytes = F.unhex(F.array_join(F.transform("n", lambda x: F.lpad(F.hex(x), 8, "0")), ""))
    anchored = scratch.table(packed.select("row", "tag", as_bytes.alias("numbers")))
    count = anchored.agg(F.sum(F.length("numbers"))).first()[0] or 0
    buckets = bucket_count(spark, count // 4 * block * 28, bucket_bytes)  # a block is the first whole one of so many runs
    over = narrow_join(body, anchored, ["row", "tag"], "numbers", "inner", limit=limit).select("text", "row", "tag", "numbers")
    names = "bucket int, h binary, g binary, row binary, tag binary, at binary, krow binary, ktag binary, kfirst binary, klast binary"
    blobs = over.mapInArrow(lambda b: run_blobs(b, block, window, buckets, key), names).repartitionById(buckets, "bucket")
    ranges = blobs.mapInArrow(lambda b: repeated(b, buckets), "bucket int, row binary, tag binary, first binary, last binary").repartitionById(buckets, "bucket")
    return scratch.table(ranges.mapInArrow(lambda b: merged(b, window), "row long, tag int, ranges binary"))


def dedup(docs: DataFrame, *, window: int = WINDOW, keep_text: bool = False, bucket_bytes: int = BUCKET_BYTES, limit: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256; with keep_text also the kept words (text) and the ranges."""
    scratch = Scratch(docs.sparkSession)
    found = marks(docs, scratch, window, bucket_bytes=bucket_bytes, limit=limit)
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *places())
    joined = narrow_join(body, found, ["row", "tag"], "ranges", limit=limit).select("doc_id", "text", "ranges")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text", "ranges"] * keep_text

    def run(batches):
        for batch in batches:
            data, at = tx.buffers(batch.column(1))
            whole = data.tobytes()
            n, removed, sums, texts, spans = [], [], [], [], []
            for a, b, packed in zip(at[:-1], at[1:], batch.column(2).to_pylist(), strict=True):
                words = whole[a:b].split()
                own = np.frombuffer(packed or b"", dtype="<i4").reshape(-1, 2).tolist()
                kept, last = [], 0
                for lo, hi in own:
                    kept += words[last:lo]
                    last = hi
                kept += words[last:]
                joint = b" ".join(kept)
                n.append(len(words))
                removed.append(len(words) - len(kept))
                sums.append(hashlib.sha256(joint).hexdigest())
                if keep_text:
                    texts.append(joint.decode())
                    spans.append([{"start": x, "end": y} for x, y in own])
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string())]
            if keep_text:
                columns += [pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string, ranges array<struct<start:int,end:int>>" * keep_text
    return joined.mapInArrow(run, kinds)
