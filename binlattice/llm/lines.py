"""Line de-duplication over levelled sorted runs of line hashes.

A line's key is its text without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z
lower-cased; only its 128-bit hash is kept. Documents come in batches. A batch
is counted by key (n documents, and the last doc_id), laid out in as many hash
buckets as the runs and merge-anti-joined with them: keys that no run has are
``fresh`` and become a run of their own, so runs never share a key; known keys
only add to counts, which are runs of a second kind. As soon as a level has
``fanout`` runs they are merged, two at a time, into one of the next level, so
there are few runs however many batches came.

Every run has the same hash layout, sorted within buckets, so joins with runs,
their merging and the decision move no data between tasks; the only shuffles
are those that count a batch. Counting first splits every key over ``SALTS``
parts by document, so that a line that a third of all documents hold is counted
by many tasks; likewise keys of very many documents are looked up in a broadcast
table of at most ``HOT_SHARE`` keys, so their rows don't meet in one task.

Defined cases: null and empty texts are one empty line; lines of a document
that repeat count once for it, and all go or stay together; rows that repeat a
doc_id count as one document, each row losing its own lines; rows with a null
doc_id are left as they are and count for nothing; the largest doc_id is unique
to a key, so there are no ties; texts and lines of any length are taken whole; no
documents give no rows; with keep_text, other columns may have any names, else
only the digest columns return.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import Scratch, free_prefix, narrow_join, partitions, places

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 20, 3, 4, 2
BUCKET_ROWS, BUCKETS_MOST, SALTS, HOT_SHARE = 4_000_000, 100_000, 64, 100_000  # Spark lays out no more buckets


def line_key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(tx.SPACE).translate(tx.LOWER_BYTES)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, key) of every document, once for each."""

    def run(batches):
        for batch in batches:
            data, at = tx.buffers(batch.column(1))
            whole = data.tobytes()
            own = [list({k for line in whole[a:b].split(b"\n") if (k := line_key(line, min_chars))}) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.binary()))], ["doc_id", "keys"])

    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return body.mapInArrow(run, "doc_id long, keys array<binary>").select("doc_id", F.explode("keys").alias("key"))


class LineRuns:
    """Two ladders of levels: runs (key, n, last) that share no key, and runs of what later batches add to known keys."""

    def __init__(self, scratch: Scratch, buckets: int, fanout: int = FANOUT):
        self.scratch, self.buckets, self.fanout = scratch, buckets, fanout
        self.seen: list[list[DataFrame]] = []
        self.added: list[list[DataFrame]] = []

    def add(self, batch: DataFrame) -> None:
        """batch: (doc_id, key) of documents that no earlier batch had."""
        salted = batch.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).repartition(F.col("key"), F.col("salt"))
        each = salted.groupBy("key", "salt", "doc_id").agg(F.lit(1).alias("one")).groupBy("key", "salt").agg(F.count("one").alias("n"), F.max("doc_id").alias("last"))
        own = each.repartition(self.buckets, F.col("key")).groupBy("key").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        if not self.seen:
            self._put(self.seen, 0, own)
            return
        own = self._written(own)
        new = self._written(self.fresh(own))
        self._put(self.added, 0, own.join(new.select("key").hint("merge"), "key", "left_anti"))
        self._put(self.seen, 0, new)
        self.scratch.drop(own)

    def _written(self, run: DataFrame) -> DataFrame:
        return self.scratch.run(run, "key", self.buckets)

    def _put(self, ladder: list[list[DataFrame]], level: int, run: DataFrame) -> None:
        if level == len(ladder):
            ladder.append([])
        ladder[level].append(run if hasattr(run, "_binlattice_run") else self._written(run))
        if len(ladder[level]) == self.fanout:
            full, ladder[level] = ladder[level], []
            while len(full) > 1:
                pair, full = full[:2], full[2:]
                full.append(self._written(merged(*pair)))
                self.scratch.drop(*pair)
            self._put(ladder, level + 1, full[0])

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose key no run has."""
        for run in (run for level in self.seen for run in level):
            batch = batch.join(run.select("key").hint("merge"), "key", "left_anti")
        return batch

    def rows(self) -> DataFrame:
        """(key, n, last) of all keys: each run with what later batches added."""
        out = None
        for run in (run for level in self.seen for run in level):
            for more in (more for level in self.added for more in level):
                run = merged(run, more, "left")
            out = run if out is None else out.unionByName(run)
        return out


def merged(left: DataFrame, right: DataFrame, how: str = "full") -> DataFrame:
    """Two runs of one layout as one, bucket by bucket."""
    other = right.select("key", F.col("n").alias("_n"), F.col("last").alias("_last")).hint("merge")
    zero = F.lit(0)
    return left.join(other, "key", how).select("key", (F.coalesce("n", zero) + F.coalesce("_n", zero)).alias("n"), F.greatest("last", "_last").alias("last"))


def decide(batch: DataFrame, common: DataFrame, hot: DataFrame) -> DataFrame:
    """(doc_id, key) to drop: rows whose key is common or hot, but in the last document that holds it."""
    known = batch.join(F.broadcast(hot.select("key", F.col("last").alias("hot_last"))), "key", "left")
    rare = known.where("hot_last is null").drop("hot_last").join(common.select("key", "last").hint("merge"), "key")
    return known.withColumnRenamed("hot_last", "last").where("last is not null").select("doc_id", "key", "last").unionByName(rare).where("doc_id <> last").select("doc_id", "key")


def drops(docs: DataFrame, scratch: Scratch, *, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(doc_id, keys): all keys to drop in a document, joined into one binary value."""
    dealt = keys(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    staged = scratch.table(dealt, "batch")
    rows = staged.count()
    buckets = min(BUCKETS_MOST, max(partitions(docs.sparkSession), math.ceil(rows / BUCKET_ROWS)))
    runs = LineRuns(scratch, buckets, fanout)
    for b in range(batches):
        runs.add(staged.where(F.col("batch") == b).select("doc_id", "key"))
    common = scratch.table(runs.rows().where(F.col("n") >= min_docs))
    scratch.drop(*(run for ladder in (runs.seen, runs.added) for level in ladder for run in level))
    cut = max(10_000, rows // HOT_SHARE)
    gone = decide(staged.select("doc_id", "key"), common.where(F.col("n") <= cut), common.where(F.col("n") > cut))
    packed = gone.groupBy("doc_id").agg(F.unhex(F.array_join(F.transform(F.collect_set("key"), F.hex), "")).alias("keys"))
    kept = scratch.table(packed)
    scratch.drop(staged, common)
    return kept


def dedup(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, keep_text: bool = False, limit: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document; with keep_text all columns of docs and the kept text."""
    scratch = Scratch(docs.sparkSession)
    gone = drops(docs, scratch, min_chars=min_chars, min_docs=min_docs, batches=batches, fanout=fanout)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) if not keep_text else docs
    free = free_prefix(own.columns)
    row, keys = f"{free}row", f"{free}keys"
    marks = gone.select(F.col("doc_id").alias(row), F.col("keys").alias(keys))
    joined = narrow_join(own.select("*", places(free)[0]), marks, row, keys, limit=limit)  # rows without doc_id spread by their texts
    names, extra = docs.columns, ["n_lines", "n_dropped", "kept_sha256"]

    def run(stream):
        for batch in stream:
            data, at = tx.buffers(batch.column("text"))
            whole = data.tobytes()
            out: list[tuple[int, int, bytes]] = []
            for a, b, packed in zip(at[:-1], at[1:], batch.column(keys).to_pylist(), strict=True):
                lines = whole[a:b].split(b"\n")
                kept = lines
                if packed:
                    drop = {packed[i : i + 16] for i in range(0, len(packed), 16)}
                    kept = [x for x in lines if line_key(x, min_chars) not in drop]
                out.append((len(lines), len(lines) - len(kept), whole[a:b] if kept is lines else b"\n".join(kept)))
            counts = [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())]
            if keep_text:
                texts = pa.array([o[2].decode() for o in out], pa.string())
                columns = [texts if name == "text" else batch.column(name) for name in names]
                yield pa.RecordBatch.from_arrays(columns, names)
            else:
                sums = pa.array([hashlib.sha256(o[2]).hexdigest() for o in out])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, sums], ["doc_id", *extra])

    if keep_text:
        return joined.select(*names, keys).mapInArrow(run, docs.schema)
    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
