"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are rotated so that the dimensions of most variance come first.
Blocks of vectors are compared in tiles: after each leading group of
dimensions, the product so far plus the product of the suffix norms bounds the
cosine, and rows and columns that cannot reach the threshold leave the tile.
What is left is verified in double precision on the vectors as given.

Blocks are leaves of a tree of median splits along the leading dimensions of the
sample, cut further by a hash to a bounded size. A leaf's bounding box comes from
all its vectors, and two leaves whose boxes lie farther apart than linked vectors
can are not sent to each other; all other pairs of blocks are one task's work
each, and compare everything in it.

Equal vectors are one node with a count, links are counted where they are
found and only a spanning forest of them leaves a task, so a large group of
copies costs no pairs.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component link with nothing, and neither do rows without vec_id, whose
component_id is null; only vectors of one length are compared, at any length;
the rotation and the splits are fitted on a bounded sample, which affects speed
only; rows that repeat a vec_id count as that many vectors, and each gives its
own row; a cosine of exactly the threshold links; no vectors give no rows; other
columns may have any names and are not returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, components

BLOCK, TILE, FIT, SLACK = 4096, 512, 4096, 1e-4
BLOCK_BYTES, SPREAD, LEADING, LEAF_FIT = 16 << 20, 32, 16, 8


def _classes(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, key), and one row (id, n, dim, raw) for each distinct valid vector."""

    def run(batches):
        for batch in batches:
            keys: list[bytes | None] = []
            raws: list[bytes | None] = []
            for known, v in zip(batch.column(0).is_valid().to_pylist(), batch.column(1), strict=True):
                a = None if not known or not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype("<f8")
                good = a is not None and len(a) and np.isfinite(a).all() and a.any()
                raws.append((a + 0.0).tobytes() if good else None)
                keys.append(xxhash.xxh3_128_digest(raws[-1]) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "key", "raw"])

    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = own.mapInArrow(run, "vec_id long, key binary, raw binary")
    each = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("raw").alias("raw"))
    classes = scratch.table(each.withColumn("dim", (F.length("raw") / 8).cast("int")))
    return scratch.table(rows.select("vec_id", "key")), classes


def block_count(count: int, dim: int, block: int) -> int:
    """How many blocks: of ``block`` vectors up to SPREAD of them, then of up to BLOCK_BYTES, as each vector is sent once a block."""
    largest = max(block, BLOCK_BYTES // (8 * dim))
    return max(math.ceil(count / largest), min(math.ceil(count / block), SPREAD))


def unit(raws: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), dtype="<f8").reshape(len(raws), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(x: np.ndarray) -> np.ndarray:
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


def splits(lead: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """A complete tree of splits (dimension, value) in breadth-first order, with at least ``leaves`` leaves if the sample allows."""
    parts, tree = [lead], []
    while len(parts) < min(leaves, len(lead) // LEAF_FIT):
        level = []
        for x in parts:
            k = int(np.argmax(x.var(axis=0))) if len(x) else 0
            cut = float(np.median(x[:, k])) if len(x) else 0.0
            tree.append((k, cut))
            level += [x[x[:, k] < cut], x[x[:, k] >= cut]]
        parts = level
    return tree


def leaf(lead: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(lead), dtype=np.int64)
    k, v = (np.array(x) for x in zip(*tree, strict=True)) if tree else (None, None)
    for _ in range((len(tree) + 1).bit_length() - 1):
        at = 2 * at + 1 + (lead[np.arange(len(lead)), k[at]] >= v[at])
    return at - len(tree)


class Side:
    """Vectors of one block, sorted along the leading dimension."""

    def __init__(self, table: pa.Table, basis: np.ndarray, groups: list[int]):
        x = unit(table.column("raw").to_pylist())
        r = x @ basis
        order = np.argsort(r[:, 0], kind="stable")
        self.x, r = x[order], r[order]
        self.ids = table.column("id").to_numpy()[order]
        self.n = table.column("n").to_numpy()[order]
        self.links = np.zeros(len(order), dtype=np.int64)
        self.lead = r[:, 0]
        self.parts = [r[:, a:b].astype(np.float32) for a, b in zip([0, *groups[:-1]], groups, strict=True)]
        tail = np.sqrt(np.maximum(0, np.cumsum((r**2)[:, ::-1], axis=1)[:, ::-1]))
        self.tails = [tail[:, b].astype(np.float32) if b < r.shape[1] else np.zeros(len(r), np.float32) for b in groups]


def _near(a: Side, b: Side, rows: slice, cols: slice, threshold: float) -> np.ndarray | None:
    """Which of a tile's pairs reach the threshold, or None if none can."""
    if a.lead[rows][0] - b.lead[cols][-1] > (reach := math.sqrt(2 - 2 * threshold + SLACK)) or b.lead[cols][0] - a.lead[rows][-1] > reach:
        return None
    i, j = np.arange(rows.start, rows.stop), np.arange(cols.start, cols.stop)
    dots = np.zeros((len(i), len(j)), dtype=np.float32)
    for pa_, pb, ta, tb in zip(a.parts, b.parts, a.tails, b.tails, strict=True):
        dots += pa_[i] @ pb[j].T
        open_ = dots + ta[i][:, None] * tb[j] >= threshold - SLACK
        r, c = open_.any(axis=1), open_.any(axis=0)
        if not r.any():
            return None
        if r.mean() < 0.9 or c.mean() < 0.9:
            i, j, dots, open_ = i[r], j[c], dots[np.ix_(r, c)], open_[np.ix_(r, c)]
    out = np.zeros((rows.stop - rows.start, cols.stop - cols.start), dtype=bool)
    if open_.mean() > 0.05:
        out[np.ix_(i - rows.start, j - cols.start)] = a.x[i] @ b.x[j].T >= threshold
        return out
    p, q = np.nonzero(open_)
    exact = np.einsum("ij,ij->i", a.x[i[p]], b.x[j[q]]) >= threshold
    out[i[p][exact] - rows.start, j[q][exact] - cols.start] = True
    return out


def _compare(a: Side, b: Side, same: bool, threshold: float) -> pa.Table:
    parent = list(range(len(a.ids) + (0 if same else len(b.ids))))
    shift = 0 if same else len(a.ids)

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for r in range(0, len(a.ids), TILE):
        rows = slice(r, min(r + TILE, len(a.ids)))
        for c in range(r if same else 0, len(b.ids), TILE):
            cols = slice(c, min(c + TILE, len(b.ids)))
            near = _near(a, b, rows, cols, threshold)
            if near is None:
                continue
            if same and r == c:
                near |= near.T
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            a.links[rows] += near @ b.n[cols]
            if not same or r != c:
                b.links[cols] += near.T @ a.n[rows]
            label = np.where(near.any(axis=1), np.arange(len(near)), -1)
            while True:  # the least row of each connected part of the tile
                down = np.where(near, label[:, None], TILE).min(axis=0)
                up = np.minimum(label, np.where(near, down[None, :], TILE).min(axis=1))
                if (up == label).all():
                    break
                label = up
            for k in np.flatnonzero(label >= 0):
                x, y = top(r + int(k)), top(r + int(label[k]))
                parent[max(x, y)] = min(x, y)
            for k in np.flatnonzero(down < TILE):
                x, y = top(shift + c + int(k)), top(r + int(down[k]))
                parent[max(x, y)] = min(x, y)
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    links = a.links if same else np.concatenate([a.links, b.links])
    at = np.flatnonzero(links)
    roots = ids[[top(int(k)) for k in at]] if len(at) else ids[:0]
    return pa.table({"id": ids[at], "n": links[at], "root": roots})


def _leaves(classes: DataFrame, plan: dict) -> DataFrame:
    """The classes with their leaf and its extent in the leading dimensions."""

    def run(batches):
        for batch in batches:
            dims, raws = batch.column(2).to_numpy(), batch.column(3).to_pylist()
            at, lead = np.zeros(len(raws), dtype=np.int64), [b""] * len(raws)
            for dim in np.unique(dims).tolist():
                basis, tree = plan[dim][0], plan[dim][3]
                own = np.flatnonzero(dims == dim)
                x = unit([raws[i] for i in own]) @ basis[:, :LEADING]
                at[own] = leaf(x, tree)
                for i, v in zip(own.tolist(), x, strict=True):
                    lead[i] = v
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(lead, pa.list_(pa.float64()))], [*batch.schema.names, "leaf", "lead"])

    return classes.select("id", "n", "dim", "raw").mapInArrow(run, "id long, n long, dim int, raw binary, leaf long, lead array<double>")


def _boxes(placed: DataFrame) -> dict[int, dict[int, tuple[int, np.ndarray, np.ndarray]]]:
    """By dim and leaf: how many vectors, and their least and largest leading coordinates."""

    def run(batches):
        seen: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            for dim, at, lead in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, lo, hi = seen.get((dim, at), (0, lead, lead))
                seen[dim, at] = n + 1, np.minimum(lo, lead), np.maximum(hi, lead)
        keys, values = list(seen), list(seen.values())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([v[0] for v in values], pa.int64()), *(pa.array([list(v[i]) for v in values], pa.list_(pa.float64())) for i in (1, 2))], ["dim", "leaf", "n", "lo", "hi"])

    parts = placed.select("dim", "leaf", "lead").mapInArrow(run, "dim int, leaf long, n long, lo array<double>, hi array<double>")
    flat = parts.select("dim", "leaf", "n", F.posexplode(F.arrays_zip("lo", "hi")).alias("k", "x"))
    out: dict[int, dict] = {}
    for r in flat.groupBy("dim", "leaf", "k").agg(F.sum("n").alias("n"), F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi")).orderBy("dim", "leaf", "k").collect():  # leaves times dimensions
        own = out.setdefault(r.dim, {}).setdefault(r.leaf, (r.n, [], []))
        own[1].append(r.lo)
        own[2].append(r.hi)
    return out


def partners(boxes: dict[int, tuple[int, np.ndarray, np.ndarray]], size: int, threshold: float) -> list[tuple[int, int, int, int, int]]:
    """(leaf, its first block, its blocks, first block of a leaf that may hold links to it, blocks of that)."""
    ids = sorted(boxes)
    blocks = np.array([-(-boxes[i][0] // size) for i in ids])
    first = np.concatenate([[0], np.cumsum(blocks)])
    lo, hi = (np.array([boxes[i][side] for i in ids]) for side in (1, 2))
    out = []
    for k, i in enumerate(ids):
        gap = np.maximum(0, np.maximum(lo - hi[k], lo[k] - hi))
        near = np.flatnonzero((gap**2).sum(axis=1) <= 2 - 2 * threshold + SLACK)
        out += [(i, int(first[k]), int(blocks[k]), int(first[j]), int(blocks[j])) for j in near]
    return out


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.9, block: int = BLOCK, fit: int = FIT) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows, classes = _classes(vectors, scratch)
    sizes = {r.dim: r["count"] for r in classes.groupBy("dim").count().collect()}
    plan = {}
    for dim, count in sizes.items():
        picked = classes.where(F.col("dim") == dim).select("id").orderBy(F.xxhash64("id"), "id").limit(fit)
        x = unit([bytes(r.raw) for r in classes.join(F.broadcast(picked), "id", "left_semi").orderBy("id").select("raw").collect()])
        groups = sorted({min(dim, g) for g in (16, 32, dim)})
        basis, blocks = rotation(x), block_count(count, dim, block)
        plan[dim] = (basis, groups, math.ceil(count / blocks), splits(x @ basis[:, :LEADING], blocks))
    placed = scratch.table(_leaves(classes, plan))
    met = [(dim, *p) for dim, boxes in _boxes(placed).items() for p in partners(boxes, plan[dim][2], threshold)]

    def compare(key, table):
        dim, i, j = (k.as_py() for k in key)
        basis, groups = plan[dim][:2]
        own = np.asarray(table.column("block"))
        a = Side(table.filter(pa.array(own == i)), basis, groups) if (own == i).any() else None
        b = a if i == j else Side(table.filter(pa.array(own == j)), basis, groups) if (own == j).any() else None
        if a is None or b is None:
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        return _compare(a, b, i == j, threshold)

    near = spark.createDataFrame(met, "dim int, leaf long, base long, own long, first long, others long")  # at most (FIT / LEAF_FIT) ** 2 rows a dim
    other = placed.drop("lead").join(F.broadcast(near), ["dim", "leaf"]).withColumn("block", F.col("base") + F.pmod(F.xxhash64("id"), F.col("own")))
    other = other.withColumn("other", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("others") - 1)))
    paired = other.select("dim", "id", "n", "raw", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = scratch.table(paired.groupBy("dim", "i", "j").applyInArrow(compare, "id long, n long, root long"))
    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b"))
    roots = components(scratch, found.select("id").distinct(), edges)
    links = found.groupBy("id").agg(F.sum("n").alias("linked"))
    named = classes.select("key", "id", "n").join(links, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    groups = named.join(least, "root").select("key", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    out = rows.where("key is not null").join(groups, "key").unionByName(rows.where("key is null"), allowMissingColumns=True)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
