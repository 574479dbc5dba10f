"""Benchmark decontamination by prefix-filtered set join.

A *unit* is what must be found in a document: a run of ``window`` consecutive
words of a benchmark item (an item of fewer words is one unit), or the whole
item when ``window`` is None. Its set is its word shingles. Shingles are ordered
by rarity over all documents; since ``need`` of ``n`` distinct shingles must
occur, one of the ``n - need + 1`` rarest must, so only those prefix shingles
are joined. A match fixes where the unit can lie; placements outside the
document are out by length and position, and the rest are verified word by word
over windows of the unit's own size.

Items are taken in blocks of a fixed size, whose units are arrays over the block's
words, about a hundred bytes a word. What a block finds is written, a row for
each text that holds one of its units, and its broadcasts are destroyed, so memory
doesn't grow with the benchmark beyond a block; one last pass puts the rows to the
documents, the same way for one block as for many.

Defined cases: null or empty texts have no words and no hits; items without
words are never found; items of one item_id count as one item, whatever their
texts, and so do those without item_id, which have no name in the lists; equal
windows of several items are found for each; every row of documents gives one
row, judged by its own text, also where a doc_id is null or on several rows;
texts of any length are scanned whole; no documents give no rows, no items no
hits; other columns of the documents may have any names (``clean`` passes them
through, ``mark`` returns only its own).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import Scratch, narrow_join, places, without

SHINGLE = 5
BLOCK_BYTES, TABLE_CELLS = 8 << 20, 1 << 20


@dataclass
class Items:
    """The words of a block's items: bytes, bounds of each word, first word of each item."""

    ids: list[int | None]
    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


@dataclass
class Group:
    """Units whose shingles have the same number of words. A unit is a run of the items' words; all is in arrays, about 100 bytes a word."""

    width: int
    items: Items
    first: np.ndarray  # word of the items
    size: np.ndarray
    need: np.ndarray
    exact: np.ndarray  # whether all shingles are needed
    owners: np.ndarray  # item numbers, by unit
    owned: np.ndarray
    place: np.ndarray  # of the shingle that begins at a word, in the vocabulary
    vocabulary: np.ndarray
    screen: np.ndarray
    post_first: np.ndarray = None  # postings by place: the units that a prefix shingle stands for, and its word offset there
    post_unit: np.ndarray = None
    post_offset: np.ndarray = None

    def matches(self, words: tx.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start words, and their places in the vocabulary, of shingles that some unit has."""
        at, h = words.rolling(hashes, self.width)
        keep = self.screen[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        at, h = at[keep], h[keep]
        place = np.searchsorted(self.vocabulary, h)
        place[place == len(self.vocabulary)] = 0
        same = self.vocabulary[place] == h
        return at[same], place[same]

    @property
    def bits(self) -> int:
        return len(self.screen).bit_length() - 1

    def shingles(self, unit: int) -> np.ndarray:
        lo = self.first[unit]
        return self.place[lo : lo + self.size[unit] - self.width + 1]

    def tables(self):
        """(units, their shingles' places as a table): units of one size, some at a time."""
        for size in np.unique(self.size).tolist():
            units, n = np.flatnonzero(self.size == size), size - self.width + 1
            step = max(1, TABLE_CELLS // n)
            for lo in range(0, len(units), step):
                some = units[lo : lo + step]
                yield some, self.place[self.first[some][:, None] + np.arange(n)]


def distinct_in_rows(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted, and how many distinct values come up to each place."""
    table = np.sort(table, axis=1)
    new = np.ones(table.shape, dtype=np.int32)
    new[:, 1:] = table[:, 1:] != table[:, :-1]
    return table, np.cumsum(new, axis=1)


def read_items(items: list[tuple[int | None, str | None]]) -> tuple[Items, list[tuple[tx.Words, int]]]:
    data, starts, ends, first, parts, bytes_, words = [], [], [], [np.zeros(1, dtype=np.int64)], [], 0, 0
    for _, _, w in tx.words(pa.array([t for _, t in items], pa.string()), tx.ALNUM, True):
        parts.append((w, words))
        data.append(w.data.tobytes())
        starts.append(w.starts + bytes_)
        ends.append(w.ends + bytes_)
        first.append(w.first[1:] + words)
        bytes_, words = bytes_ + len(w.data), words + len(w.starts)
    whole = lambda x: np.concatenate(x) if x else np.empty(0, dtype=np.int64)
    return Items([i for i, _ in items], b"".join(data), whole(starts), whole(ends), whole(first)), parts


def same_words(items: Items, a: int, b: int, size: int) -> bool:
    return all(items.word(a + k) == items.word(b + k) for k in range(size))


def build(block: list[tuple[int | None, str | None]], window: int | None, containment: float, shingle: int) -> list[Group]:
    items, parts = read_items(block)
    length = np.diff(items.first)
    size = length if window is None else np.minimum(window, length)
    widths, groups = np.minimum(shingle, size), []
    for width in np.unique(widths[length > 0]).tolist():
        own = np.flatnonzero((widths == width) & (length > 0))
        inside = np.zeros(len(items.starts), dtype=bool)
        for i in own.tolist():
            inside[items.first[i] : items.first[i + 1]] = True
        at, h = (np.concatenate(x) for x in zip(*((p + base, v) for w, base in parts for p, v in [w.rolling(w.hashes(), width)]), strict=True))
        at, h = at[inside[at]], h[inside[at]]
        vocabulary = np.unique(h)
        bits = max(20, min(24, len(vocabulary).bit_length() + 3))
        screen = np.zeros(1 << bits, dtype=bool)
        screen[(vocabulary >> np.uint64(64 - bits)).astype(np.int64)] = True
        place = np.full(len(items.starts), -1, dtype=np.int32)
        place[at] = np.searchsorted(vocabulary, h)
        number = length[own] - size[own] + 1
        item = np.repeat(own, number)
        first = items.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(number) - number, number)
        g = Group(width, items, first, size[item], np.empty(0), np.empty(0), item, np.empty(0), place, vocabulary, screen)
        merge_equal(g)
        g.need, g.exact = np.empty(len(g.first), dtype=np.int64), np.empty(len(g.first), dtype=bool)
        for units, table in g.tables():
            n = distinct_in_rows(table)[1][:, -1]
            g.need[units] = np.maximum(1, np.ceil(containment * n - 1e-9).astype(np.int64))
            g.exact[units] = g.need[units] == n
        groups.append(g)
    return groups


def merge_equal(g: Group) -> None:
    """Units of the same words become one with all their items, compared word by word where their shingles agree."""
    rng = np.random.default_rng(1)
    leader = np.arange(len(g.first))
    for units, table in g.tables():
        key = (table.astype(np.uint64) * rng.integers(1, 1 << 62, table.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        _, head, group = np.unique(key, return_index=True, return_inverse=True)
        lead = units[head[group]]
        for u, k in zip(units[lead != units].tolist(), lead[lead != units].tolist(), strict=True):
            if same_words(g.items, int(g.first[u]), int(g.first[k]), int(g.size[u])):
                leader[u] = k
    kept, to = np.unique(leader, return_inverse=True)
    pairs = np.unique(np.stack([to, g.owners], axis=1), axis=0)
    g.first, g.size = g.first[kept], g.size[kept]
    g.owned, g.owners = np.searchsorted(pairs[:, 0], np.arange(len(kept) + 1)), pairs[:, 1]


def order(groups: list[Group], counts: dict[int, np.ndarray]) -> None:
    """Fills the postings with each unit's rarest shingles; counts are documents' shingles by width and place."""
    for g in groups:
        rank = counts.get(g.width, np.zeros(len(g.vocabulary), dtype=np.int64))
        turn = np.empty(len(rank), dtype=np.int64)
        turn[np.lexsort((np.arange(len(rank)), rank))] = np.arange(len(rank))  # by rarity, ties by place
        found = []
        for units, table in g.tables():
            turns = turn[table]
            ranked, upto = distinct_in_rows(turns)
            last = (upto <= (upto[:, -1] - g.need[units] + 1)[:, None]).sum(axis=1) - 1
            row, offset = np.nonzero(turns <= ranked[np.arange(len(units)), last][:, None])
            found.append((table[row, offset], units[row], offset))
        place, unit, offset = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((offset, unit, place))
        g.post_unit, g.post_offset = unit[by].astype(np.int32), offset[by].astype(np.int32)
        g.post_first = np.searchsorted(place[by], np.arange(len(g.vocabulary) + 1))


def find(groups: list[Group], words: tx.Words, hashes: np.ndarray):
    """(document, item, first hit word, end word) of every verified occurrence."""
    for g in groups:
        at, place = g.matches(words, hashes)
        if not len(at):
            continue
        docs = np.searchsorted(words.first, at, side="right") - 1
        done: set[tuple[int, int, int]] = set()
        listed = np.flatnonzero(g.post_first[place + 1] > g.post_first[place])
        for p, v, d in zip(at[listed].tolist(), place[listed].tolist(), docs[listed].tolist(), strict=True):
            lo, hi = int(words.first[d]), int(words.first[d + 1])
            span = slice(g.post_first[v], g.post_first[v + 1])
            for k, offset in zip(g.post_unit[span].tolist(), g.post_offset[span].tolist(), strict=True):
                size, first = int(g.size[k]), int(g.first[k])
                ids = [g.items.ids[i] for i in g.owners[g.owned[k] : g.owned[k + 1]].tolist()]
                if g.exact[k]:
                    start = p - offset
                    if start < lo or start + size > hi or (k, d, start) in done:
                        continue
                    done.add((k, d, start))
                    if all(words.word(start + i) == g.items.word(first + i) for i in range(size)):
                        for item in ids:
                            yield d, item, start, start + size
                    continue
                if (k, d, p) in done:
                    continue
                done.add((k, d, p))
                own = set(g.shingles(k).tolist())
                reach = slice(np.searchsorted(at, max(lo, p - size + g.width)), np.searchsorted(at, min(hi, p + size)))
                near = [(a, b) for a, b in zip(at[reach].tolist(), place[reach].tolist(), strict=True) if b in own]
                for i, (a, _) in enumerate(near):
                    inside = [(x, b) for x, b in near[i:] if x + g.width <= a + size]
                    if len({b for _, b in inside}) >= g.need[k]:
                        for item in ids:
                            yield d, item, a, inside[-1][0] + g.width
                        break


def item_blocks(items: DataFrame, limit: int):
    """The items, at most about limit bytes of them on the driver at a time; no block is empty."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "") + 64
        if size > limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def joined(spans: np.ndarray) -> np.ndarray:
    """Ranges [start, end) without overlaps that cover what the given ones do."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.ones(len(spans), dtype=bool)
    first[1:] = spans[1:, 0] > reach[:-1]
    last = np.append(first[1:], True)[: len(spans)]
    return np.stack([spans[first, 0], reach[last]], axis=1).astype("<i4")


def hits(docs: DataFrame, items: DataFrame, scratch: Scratch, *, window: int | None, containment: float, shingle: int, block_bytes: int) -> DataFrame:
    """(row, tag, ranges, item_ids) of the texts that hold a unit: word ranges as packed int32 pairs, one set a block."""
    context = docs.sparkSession.sparkContext
    body = docs.select(F.col("text").cast("string").alias("text"), *places())
    parts = []
    for block in item_blocks(items, block_bytes):
        groups = build(block, window, containment, shingle)
        if not groups:
            continue
        plain = context.broadcast(groups)

        def count(batches, shared=plain):
            total = {g.width: np.zeros(len(g.vocabulary), dtype=np.int64) for g in shared.value}
            for batch in batches:
                for _, _, w in tx.words(batch.column(0), tx.ALNUM, True):
                    h = w.hashes()
                    for g in shared.value:
                        total[g.width] += np.bincount(g.matches(w, h)[1], minlength=len(g.vocabulary))
            for width, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), width, dtype=np.int32)), pa.array(at), pa.array(n[at])], ["width", "at", "n"])

        seen = body.select("text").mapInArrow(count, "width int, at long, n long").groupBy("width", "at").agg(F.sum("n").alias("n")).toArrow()
        width, at, n = (seen[c].to_numpy() for c in ("width", "at", "n"))
        counts = {g.width: np.zeros(len(g.vocabulary), dtype=np.int64) for g in groups}
        for w, total in counts.items():
            total[at[width == w]] = n[width == w]
        order(groups, counts)
        ranked = context.broadcast(groups)

        def scan(batches, shared=ranked):
            for batch in batches:
                at, ranges, ids = [], [], []
                for lo, _, w in tx.words(batch.column(0), tx.ALNUM, True):
                    spans, own = defaultdict(list), defaultdict(set)
                    for d, item, a, b in find(shared.value, w, w.hashes()):
                        spans[d].append((a - int(w.first[d]), b - int(w.first[d])))
                        own[d].add(item)
                    for d in sorted(spans):
                        at.append(lo + int(d))
                        ranges.append(joined(np.array(spans[d])).tobytes())
                        ids.append(sorted(own[d], key=lambda i: (i is None, i or 0)))
                found = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([found.column(1), found.column(2), pa.array(ranges, pa.binary()), pa.array(ids, pa.list_(pa.int64()))], ["row", "tag", "ranges", "item_ids"])

        parts.append(scratch.table(body.mapInArrow(scan, "row long, tag int, ranges binary, item_ids array<long>")))
        plain.destroy()
        ranked.destroy()
    if not parts:
        return docs.sparkSession.createDataFrame([], "row long, tag int, ranges array<binary>, item_ids array<long>")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.groupBy("row", "tag").agg(F.collect_set("ranges").alias("ranges"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"))
    return scratch.table(every)


def mark(docs: DataFrame, items: DataFrame, *, window: int | None = 8, containment: float = 1.0, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES, limit: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, item_ids; limit as in ``narrow_join``."""
    found = hits(docs, items, Scratch(docs.sparkSession), window=window, containment=containment, shingle=shingle, block_bytes=block_bytes)
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *places())
    size = F.aggregate("ranges", F.lit(0), lambda n, r: n + F.length(r) + 16) + 8 * F.size("item_ids")
    both = narrow_join(body, found, ["row", "tag"], size, limit=limit).select("doc_id", "text", "ranges", "item_ids")

    def count(batches):
        for batch in batches:
            n = [c for _, _, w in tx.words(batch.column(1), tx.ALNUM, True) for c in w.counts.tolist()]
            covered = []
            for own in batch.column(2).to_pylist():
                spans = joined(np.frombuffer(b"".join(own), dtype="<i4").reshape(-1, 2)) if own else np.empty((0, 2), dtype=int)
                covered.append(int((spans[:, 1] - spans[:, 0]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(covered, pa.int64()), batch.column(3)], ["doc_id", "n_words", "n_hit", "item_ids"])

    counted = both.mapInArrow(count, "doc_id long, n_words long, n_hit long, item_ids array<long>").withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<long>")))
    as_text = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return counted.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(as_text, 256).alias("items_sha256"), "item_ids")


def clean(docs: DataFrame, items: DataFrame, *, containment: float = 0.8, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, without those that hold a benchmark item.

    An item is held where a window of its own number of words has at least the
    given share of its shingles.
    """
    scratch = Scratch(docs.sparkSession)
    return without(docs, scratch, hits(docs, items, scratch, window=None, containment=containment, shingle=shingle, block_bytes=block_bytes))


def digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
