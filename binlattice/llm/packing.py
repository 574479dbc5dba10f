"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost: by default its tokens,
a fixed overhead, and attention, which grows with the square of the length, so
that neither the longest nor the shortest length is always best. The lengths are
optimised jointly: the largest piece left opens a bin; each permitted length is
filled on trial with the pieces to come, the best fitting first, and downsized
to the least length that holds what it got; the bin opens with the length of
least cost a token and keeps those pieces. That packing is compared with plain
best fit that opens one length only (or what a longer piece needs), for each
length, and the one of least total cost after downsizing is taken.

Documents are dealt to shards of about ``shard_docs`` by a hash of doc_id and
text, and rows that are equal in both are counted and dealt ``EQUAL`` at a time,
so no doc_id, null or repeated, fills a shard. A shard is packed on its own, so
memory is bounded and the result doesn't depend on partitions. Each shard
leaves few bins partly filled, a share that shrinks with shard_docs.

Defined cases: null and empty texts have no tokens and no piece; documents
longer than the largest length are cut into full pieces and a rest; ties go by
doc_id, number of tokens, hash of the text and piece, null doc_ids first; rows
that repeat a doc_id are packed as often as they occur, told apart by ``tag``, a
hash of the text, and those equal in it by ``copy``; rows with a null doc_id are packed too; no documents give no
rows; other columns may have any names and are not returned.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import places
from .text import buffers

LENGTHS, OVERHEAD, ATTENTION, SHARD_DOCS, EQUAL = (512, 1024, 2048, 4096), 32, 1 << 15, 8192, 1024
RESULT = "shard long, bin int, length int, slot int, at int, doc_id long, tag int, copy int, piece int, start long, n_tokens int"


def costs(lengths: tuple[int, ...], overhead: float = OVERHEAD, attention: float = ATTENTION) -> dict[int, float]:
    """What a sequence of each length costs, in tokens: attention doubles it at that many."""
    return {c: c + overhead + c * c / attention for c in lengths}


def tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, tag, n): words between ASCII white space, or tokens of a public tokenizer file."""

    def run(batches):
        coder = None
        if tokenizer:
            from tokenizers import Tokenizer

            coder = Tokenizer.from_file(tokenizer)
        for batch in batches:
            if coder:
                n = [len(coder.encode(t or "", add_special_tokens=False).ids) for t in batch.column(1).to_pylist()]
            else:
                data, at = buffers(batch.column(1))
                whole = data.tobytes()
                n = [len(whole[a:b].split()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "tag", "n"])

    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), places()[1])
    return body.mapInArrow(run, "doc_id long, tag int, n long")


class Pool:
    """Sizes of pieces still to come, with their numbers."""

    def __init__(self, sizes: list[int]):
        self.sizes = sorted(set(sizes))
        self.count = {s: 0 for s in self.sizes}
        for s in sizes:
            self.count[s] += 1

    def take(self, size: int, n: int = 1) -> None:
        self.count[size] -= n
        if not self.count[size]:
            self.sizes.pop(bisect_left(self.sizes, size))

    def fill(self, gap: int) -> tuple[int, list[tuple[int, int]]]:
        """How much of a gap is filled if the largest piece that fits is put there again and again, and by what."""
        left, k, picks = gap, len(self.sizes), []
        while left and (k := bisect_right(self.sizes, left, 0, k)):
            size = self.sizes[k - 1]
            n = min(self.count[size], left // size)
            picks.append((size, n))
            left -= size * n
            k -= 1
        return gap - left, picks


def joint(sizes: list[int], lengths: tuple[int, ...], price: dict[int, float]) -> tuple[list[int], list[int]]:
    """The bin of each size, and what each bin holds: the largest piece left opens the bin of least cost a token once filled."""
    pool, used, owners = Pool(sizes), [], {}
    while pool.sizes:
        size = pool.sizes[-1]
        pool.take(size)
        best, chosen = math.inf, (size, [])
        for c in lengths[bisect_left(lengths, size) :]:
            more, picks = pool.fill(c - size)
            each = price[lengths[bisect_left(lengths, size + more)]] / (size + more)
            if each < best:
                best, chosen = each, (size + more, picks)
        for s, n in [(size, 1), *chosen[1]]:
            owners.setdefault(s, []).extend([len(used)] * n)
        for s, n in chosen[1]:
            pool.take(s, n)
        used.append(chosen[0])
    turns = {s: iter(b) for s, b in owners.items()}
    return [next(turns[s]) for s in sizes], used


def single(sizes: list[int], lengths: tuple[int, ...], length: int) -> tuple[list[int], list[int]]:
    """The bin of each size, and what each bin holds: best fit, where new bins have one length, or the least that a longer piece needs."""
    room, used, at = [], [], []
    for size in sizes:
        k = bisect_left(room, (size, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            b, left = len(used), max(length, lengths[bisect_left(lengths, size)])
            used.append(0)
        if left > size:
            insort(room, (left - size, b))
        at.append(b)
        used[b] += size
    return at, used


def pack(sizes: list[int], lengths: tuple[int, ...], price: dict[int, float]) -> list[tuple[int, int, int]]:
    """(bin, its final length, slot) of each size; sizes come in falling order, none over the largest length."""
    shrunk = lambda used: lengths[bisect_left(lengths, used)]
    ways = [joint(sizes, lengths, price), *(single(sizes, lengths, c) for c in lengths)]
    at, used = min(ways, key=lambda way: sum(price[shrunk(u)] for u in way[1]))
    final, slots, out = [shrunk(u) for u in used], [0] * len(used), []
    for b in at:
        out.append((b, final[b], slots[b]))
        slots[b] += 1
    return out


def best_fit(docs: DataFrame, *, lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD, attention: float = ATTENTION, shard_docs: int = SHARD_DOCS, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: shard, bin, its length, slot and first position, and the piece's document, copy, number and token span."""
    lengths = tuple(sorted(lengths))
    price = costs(lengths, overhead, attention)
    shards = max(1, math.ceil(docs.count() / shard_docs))
    equal = tokens(docs, tokenizer).where("n > 0").groupBy("doc_id", "tag", "n").agg(F.count("*").alias("m"))
    chunks = equal.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / EQUAL))).alias("chunk"))
    dealt = chunks.withColumn("m", F.least(F.col("m") - F.col("chunk") * EQUAL, F.lit(EQUAL))).withColumn("shard", F.pmod(F.xxhash64("doc_id", "tag", "chunk"), F.lit(shards)))

    def run(key, table):
        pieces = []
        for doc, tag, n, m, chunk in zip(*(table.column(c).to_pylist() for c in ("doc_id", "tag", "n", "m", "chunk")), strict=True):
            cut = [(min(lengths[-1], n - s), i, s) for i, s in enumerate(range(0, n, lengths[-1]))]
            pieces += [(size, doc, n, tag, chunk * EQUAL + copy, i, s) for copy in range(m) for size, i, s in cut]
        pieces.sort(key=lambda p: (-p[0], p[1] is not None, p[1] or 0, *p[2:]))
        filled: dict[int, int] = {}
        rows = []
        for (size, doc, _, tag, copy, piece, start), (b, length, slot) in zip(pieces, pack([p[0] for p in pieces], lengths, price), strict=True):
            at = filled.get(b, 0)
            filled[b] = at + size
            rows.append((key[0].as_py(), b, length, slot, at, doc, tag, copy, piece, start, size))
        names = [f.split()[0] for f in RESULT.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32()}
        return pa.table({name: pa.array(v, kinds[f.split()[1]]) for name, f, v in zip(names, RESULT.split(", "), zip(*rows, strict=True), strict=True)})

    return dealt.groupBy("shard").applyInArrow(run, RESULT)
