"""Divergences of sources from each other and from their language.

Texts are tokenised on their bytes: a table of 256 flags over the concatenated
UTF-8 buffers of many documents gives the bounds of all terms at once, xxhash groups
the slices, and the bytes of every slice are compared with those of its group.
Tasks count before they shuffle.

Counts of the terms that a language keeps are laid out in blocks: a tile of sources by a
tile of sources by a slice of the terms, each a CSR matrix with a row for each
source. A source's row is spread over the slice's columns, and one reduceat over all
other rows gives its divergence from each. Terms that a source lacks are all alike
to it, so they are counted and not stored.

A share is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and the divergence of two
is floor((p - q)^2 / (p + q)), all in integers: exact while a language has
fewer than 4 * 10^15 occurrences of kept terms.

Defined cases: null text, lang or source count as empty; texts of any length are
taken whole, a piece at a time; rows that repeat are that many documents, whatever
their doc_id, which isn't read; a source without terms has a row of zeros, and so
has a language that keeps no term, where every pair has the value 0; a language of
one source has no pairs; ties rank by the bytes of the item; no documents give
no rows; other columns may have any names and are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch, narrow_join
from .text import Words, buffers

PIECE, HELD, HELD_BYTES = 1 << 19, 1 << 20, 32 << 20
TILE, BLOCK_ROWS, TOP, SCALE = 256, 1 << 15, 10, 1_000_000_000
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = PIECE):
    """(first document, bytes, bounds, whether the last document goes on): about size bytes at a time, cut where no term goes on."""
    lo = 0
    while lo < len(data):
        hi = min(lo + size, len(data))
        while hi < len(data) and LETTERS[data[hi - 1]] and LETTERS[data[hi]] and offsets[np.searchsorted(offsets, hi)] != hi:
            ahead = np.flatnonzero(~LETTERS[data[hi : hi + size]])
            hi = min(hi + (int(ahead[0]) if len(ahead) else size), int(offsets[np.searchsorted(offsets, hi)]))
        first = int(np.searchsorted(offsets, lo, side="right")) - 1
        last = int(np.searchsorted(offsets, hi))
        yield first, data[lo:hi], np.clip(offsets[first : last + 1], lo, hi) - lo, offsets[last] > hi
        lo = hi


def same_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each slice has the bytes of the slice whose number other gives."""
    size = ends - starts
    ok = size == size[other]
    at = np.flatnonzero(ok & (size > 0) & (other != np.arange(len(other))))
    if len(at):
        n = size[at]
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(first, n)
        equal = data[np.repeat(starts[at], n) + within] == data[np.repeat(starts[other[at]], n) + within]
        ok[at] &= np.logical_and.reduceat(equal, first)
    return ok


class Terms:
    """Numbers of terms: by hash, and by their bytes where terms share one."""

    def __init__(self, digest=xxhash.xxh3_64_intdigest):
        self.digest, self.names, self.by_hash, self.by_bytes, self.size = digest, [], {}, {}, 0

    def number(self, h: int, name: bytes) -> int:
        at = self.by_hash.get(h)
        if at is not None and self.names[at] == name:
            return at
        if at is not None and (known := self.by_bytes.get(name)) is not None:
            return known
        self.names.append(name)
        self.size += len(name) + 64
        if at is None:
            self.by_hash[h] = len(self.names) - 1
        else:
            self.by_bytes[name] = len(self.names) - 1
        return len(self.names) - 1

    def numbers(self, words: Words) -> np.ndarray:
        """The number of each slice."""
        body, starts, ends = words.data.tobytes(), words.starts.tolist(), words.ends.tolist()
        digest = self.digest
        hashes = np.array([digest(body[i:j]) for i, j in zip(starts, ends)], dtype=np.uint64)
        _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
        slices, of_hash, names = [body[starts[i] : ends[i]] for i in first.tolist()], hashes[first].tolist(), self.names
        known = list(map(self.by_hash.get, of_hash))
        for k, (at, name) in enumerate(zip(known, slices)):
            if at is None or names[at] != name:
                known[k] = self.number(of_hash[k], name)
        out = np.array(known, dtype=np.int64)[group]
        for i in np.flatnonzero(~same_slices(words.data, words.starts, words.ends, first[group])).tolist():
            out[i] = self.number(int(hashes[i]), body[starts[i] : ends[i]])
        return out


def _added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of values summed by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values[:0]


def _count(batches):
    """(lang, source, term, n, docs) of a task's documents, and a row without term for each group with its documents."""
    groups, terms, parts, rows = {}, Terms(), [], 0
    documents = np.zeros(0, dtype=np.int64)

    def flushed():
        keys, values = _added(np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts])) if parts else (np.empty(0, dtype=np.int64), np.empty((0, 2), dtype=np.int64))
        of, term = keys >> 32, keys & 0xFFFFFFFF
        names = list(groups)
        lang, source = (pa.array([g[k] for g in names], pa.string()) for k in (0, 1))
        spelt = pa.array(terms.names, pa.binary()).cast(pa.string())
        for lo in range(0, len(keys), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            own = pa.array(of[part])
            yield pa.RecordBatch.from_arrays([lang.take(own), source.take(own), spelt.take(pa.array(term[part])), *(pa.array(values[part, k]) for k in (0, 1))], ["lang", "source", "term", "n", "docs"])
        seen = np.flatnonzero(documents)
        yield pa.RecordBatch.from_arrays([pa.array([names[g][0] for g in seen], pa.string()), pa.array([names[g][1] for g in seen], pa.string()), pa.nulls(len(seen), pa.string()), pa.array(np.zeros(len(seen), dtype=np.int64)), pa.array(documents[seen])], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        of = np.array([groups.setdefault((a or "", b or ""), len(groups)) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], dtype=np.int64)
        documents = np.r_[documents, np.zeros(len(groups) - len(documents), dtype=np.int64)] + np.bincount(of, minlength=len(groups))
        data, offsets = buffers(batch.column(2))
        going_on = np.empty(0, dtype=np.int64)  # terms that the first document of a piece has had in earlier ones
        for first, body, bounds, more in pieces(data, offsets):
            words = Words(body, bounds, LETTERS, fold=True)
            term = terms.numbers(words)
            doc = words.doc()
            held, n = np.unique(doc << 32 | term, return_counts=True)  # each document's terms, with their number there
            new = ~np.isin(held, going_on) if len(going_on) else np.ones(len(held), dtype=bool)
            parts.append(_added(of[first + (held >> 32)] << 32 | held & 0xFFFFFFFF, np.stack([n, new], axis=1)))
            rows += len(parts[-1][0])
            last = len(bounds) - 2
            mine = held[held >> 32 == last] & 0xFFFFFFFF
            going_on = (np.union1d(going_on, mine) if last == 0 else mine) if more else np.empty(0, dtype=np.int64)
            if rows > 2 * HELD:
                parts = [_added(np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts]))]
                rows = len(parts[0][0])
            if rows > HELD or terms.size > HELD_BYTES:
                yield from flushed()
                names = [terms.names[t] for t in going_on.tolist()]
                parts, rows, terms, documents = [], 0, Terms(), np.zeros(len(groups), dtype=np.int64)
                going_on = np.array(sorted(terms.number(terms.digest(x), x) for x in names), dtype=np.int64)
    yield from flushed()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term, and the documents of every group in a row without term."""
    text = docs.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    found = text.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)) digit by digit, so that nothing leaves 64 bits."""
    below = np.asarray(total, dtype=np.int64) + 2 * kept
    left = np.asarray(count, dtype=np.int64) + 2
    out, left = np.divmod(left, np.maximum(below, 1))
    for _ in range(3):
        digit, left = np.divmod(left * 1000, np.maximum(below, 1))
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def block_pairs(at: np.ndarray, term: np.ndarray, p: np.ndarray, absent: np.ndarray, rows: np.ndarray, columns: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, later source, sum) over a block's terms, less what two sources without a term add to each other.

    at and term place the shares p in a CSR matrix sorted by source; absent is each
    source's share of a term it lacks; rows and columns are the sources of the two tiles.
    """
    first = np.searchsorted(at, np.arange(len(absent) + 1))
    filled = np.flatnonzero(first[1:] > first[:-1])
    missing = absent[at]  # of the other side, for each stored share
    dense = np.empty(width, dtype=np.int64)
    a_out, b_out, v_out = [], [], []
    for a in rows.tolist():
        others = columns[columns > a] if len(rows) == len(columns) and rows[0] == columns[0] else columns
        if not len(others):
            continue
        lo, hi = first[a], first[a + 1]
        dense[:] = absent[a]
        dense[term[lo:hi]] = p[lo:hi]
        facing = dense[term]
        sums = np.zeros(len(absent), dtype=np.int64)
        if len(filled):
            sums[filled] = np.add.reduceat(divergence(facing, p) - divergence(facing, missing), first[filled])
        value, times = np.unique(p[lo:hi], return_counts=True)
        for k in range(0, len(value), 1 << 12):
            some = value[k : k + (1 << 12), None]
            sums[others] += (times[k : k + (1 << 12), None] * (divergence(some, absent[others][None, :]) - divergence(absent[a], absent[others])[None, :])).sum(axis=0)
        a_out.append(np.full(len(others), a))
        b_out.append(others)
        v_out.append(sums[others])
    none = [np.empty(0, dtype=np.int64)]
    return tuple(np.concatenate(x or none) for x in (a_out, b_out, v_out))


def _block(top: int):
    def run(table: pa.Table) -> pa.Table:
        """One block: rows without term are its sources, in order of pos; the others their counts."""
        named = table.filter(pc.is_null(table["term"])).sort_by("pos")
        held = table.filter(pc.is_valid(table["term"]))
        lang, ti, tj, shard = (table[c][0].as_py() for c in ("lang", "ti", "tj", "shard"))
        vocabulary, of_lang = (table[c][0].as_py() for c in ("v", "lang_n"))
        pos, total, source = (named[c].to_numpy() for c in ("pos", "source_n", "source"))
        absent = share(np.zeros(len(pos)), total, vocabulary) if vocabulary else np.ones(len(pos), dtype=np.int64)
        at = np.searchsorted(pos, held["pos"].to_numpy())
        codes = held["term"].combine_chunks().dictionary_encode()
        term, spelt = codes.indices.to_numpy().astype(np.int64), codes.dictionary
        order = np.lexsort((term, at))
        at, term = at[order], term[order]
        n = held["n"].to_numpy()[order]
        p = share(n, total[at], vocabulary) if len(at) else np.empty(0, dtype=np.int64)
        tile = pos // TILE
        a, b, value = block_pairs(at, term, p, absent, np.flatnonzero(tile == ti), np.flatnonzero(tile == tj), len(spelt))
        if shard == 0 and vocabulary:
            value = value + vocabulary * divergence(absent[a], absent[b])
        out = [("pair", source[x], source[y], v) for x, y, v in zip(a.tolist(), b.tolist(), value.tolist())]
        if ti == tj and len(at):
            q = share(held["lang_count"].to_numpy()[order], of_lang, vocabulary)
            gain = divergence(p, q)
            names = np.array(spelt.cast(pa.binary()).to_pylist(), dtype=object)
            by_name = np.empty(len(names), dtype=np.int64)
            by_name[np.argsort(names)] = np.arange(len(names))
            best = np.lexsort((by_name[term], -gain, at))
            best = best[p[best] > q[best]]
            rank = np.arange(len(best)) - np.searchsorted(at[best], at[best])
            best = best[rank < top]
            out += [("term", source[at[i]], spelt[int(term[i])].as_py(), int(gain[i])) for i in best.tolist()]
        part, own, item, value = zip(*out) if out else ((), (), (), ())
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "part": pa.array(part, pa.string()), "source": pa.array(own, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    return run


def audit(docs: DataFrame, *, least_docs: int = 10, top: int = TOP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair ranks all other sources of the language, part term the top terms that the source favours."""
    scratch = Scratch(docs.sparkSession)
    all_counts = scratch.table(counts(docs))
    terms = all_counts.where("term IS NOT NULL")
    kept = scratch.table(terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_count"), F.count("*").alias("rows")).where(F.col("docs") >= least_docs).drop("docs"))
    size = F.octet_length("lang") + F.octet_length("term") + 16
    held = scratch.table(narrow_join(terms.drop("docs"), kept.drop("rows"), ["lang", "term"], size, "inner"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("lang_n"), F.sum("rows").alias("rows"))
    own = held.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    sources = all_counts.where("term IS NULL").select("lang", "source").join(own, ["lang", "source"], "left").withColumn("pos", place)
    last = F.max("pos").over(W.partitionBy("lang"))
    sources = sources.withColumn("tiles", F.floor(last / TILE).cast("int") + 1).join(langs, "lang", "left")
    sources = sources.select("lang", "source", F.coalesce("source_n", F.lit(0)).alias("source_n"), "pos", "tiles", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"), F.ceil(F.greatest(F.coalesce("rows", F.lit(0)), F.lit(1)) / block_rows).cast("int").alias("shards"))
    sources = scratch.table(sources)
    tile = F.floor(F.col("pos") / TILE).cast("int")
    facing = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least(j, tile).alias("ti"), F.greatest(j, tile).alias("tj")))
    columns = ["lang", "shard", "tile.ti", "tile.tj", "source", "pos", "source_n", "v", "lang_n", "term", "n", "lang_count"]
    size = F.octet_length("lang") + F.octet_length("source") + 48
    placed = narrow_join(held, sources, ["lang", "source"], size, "inner").withColumn("shard", F.expr("CAST(pmod(xxhash64(term), shards) AS INT)"))
    heads = sources.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("term", F.lit(None).cast("string")).withColumn("n", F.lit(0).cast("long")).withColumn("lang_count", F.lit(0).cast("long"))
    rows = placed.withColumn("tile", F.explode(facing)).select(*columns).union(heads.withColumn("tile", F.explode(facing)).select(*columns))
    found = scratch.table(rows.groupBy("lang", "ti", "tj", "shard").applyInArrow(_block(top), "lang string, part string, source string, item string, value long"))
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", "value", ways.alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    best = found.where("part = 'term'").select("lang", "source", "part", "item", "value")
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return pairs.union(best).withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))
